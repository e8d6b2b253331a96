"""Fill-in-middle over seekable compressed frames (operator 13).

``store`` writes every text as independent zstandard frames with the number of code points in each, so the place of any
unit is found from the counts and only the frame around it is decompressed. A blob is a run of frames, a skippable frame
with the code points of each and a flag, and the seek table of the public seekable format; any zstandard decoder reads the text from it.
A cut is chosen from the counts alone; its byte position needs one frame. What is output streams the frames in order.

Texts are handled as UTF-8 bytes: a code point starts at every byte that does not continue one.

Defined results: a null text counts as an empty one and is plain; a null id counts as an empty one in the hash; repeated
rows are one row each; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table
from lorekeep.operators.skew import cut

# Fixed values of the seekable format and of the output.
SKIPPABLE, SEEK_TABLE, FOOTER, HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text in one frame, and of a hundred texts how many are transformed and how many of these start with the suffix.
FRAME, TRANSFORMED, SUFFIX_FIRST, SEED = 1 << 16, 90, 20, 1


def pack(text: bytes, frame: int = FRAME) -> bytes:
    """The frames of ``text``, cut between code points, then the counts and the seek table."""
    import xxhash
    import zstandard

    out, entries, units, at = [], [], [], 0
    packer = zstandard.ZstdCompressor(level=1)
    while at < len(text):
        end = min(at + frame, len(text))
        # At most three bytes back is the start of a code point; broken bytes are cut where they are.
        end = next((e for e in range(end, max(end - 4, at), -1) if e == len(text) or text[e] & 0xC0 != 0x80), end)
        piece = text[at:end]
        packed = packer.compress(piece)
        out.append(packed)
        entries.append((len(packed), len(piece), xxhash.xxh64_intdigest(piece) & 0xFFFFFFFF))
        units.append(_units(piece))
        at = end
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    counts = struct.pack("<B", marked) + np.array(units, "<u4").tobytes()
    out.append(struct.pack("<II", SKIPPABLE, len(counts)) + counts)
    entries.append((len(counts) + 8, 0, 0))
    rows = np.array(entries, "<u4").tobytes()
    out.append(struct.pack("<II", SEEK_TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(entries), HAS_CHECKSUM, FOOTER))
    return b"".join(out)


def _units(piece: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(piece, np.uint8) & 0xC0) != 0x80))


class Framed:
    """Random access to one packed text."""

    def __init__(self, blob: bytes):
        n, flags, magic = struct.unpack_from("<IBI", blob, len(blob) - 9)
        if magic != FOOTER or flags != HAS_CHECKSUM:
            raise ValueError("no seek table")
        self.blob = memoryview(blob)
        rows = np.frombuffer(blob, "<u4", 3 * n, len(blob) - 9 - 12 * n).reshape(n, 3).astype(np.int64)
        self.n, self.check = n - 1, rows[:, 2].tolist()
        self.offset = [0, *np.cumsum(rows[:, 0]).tolist()]
        self.start = [0, *np.cumsum(rows[:-1, 1]).tolist()]
        self.marked = bool(blob[self.offset[self.n] + 8])
        self.before = [0, *np.cumsum(np.frombuffer(blob, "<u4", self.n, self.offset[self.n] + 9).astype(np.int64)).tolist()]
        self.units = self.before[-1]
        self.opened = 0

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        self.opened += 1
        data = zstandard.ZstdDecompressor().decompress(self.blob[self.offset[k] : self.offset[k + 1]], max_output_size=self.start[k + 1] - self.start[k])
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.check[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def byte_at(self, unit: int) -> int:
        """The byte where a unit starts; only its frame is decompressed, and none at the ends of frames."""
        k = min(bisect_right(self.before, unit), self.n + 1) - 1
        if self.before[k] == unit or k == self.n:
            return self.start[min(k, self.n)]
        starts = np.flatnonzero((np.frombuffer(self.frame(k), np.uint8) & 0xC0) != 0x80)
        return self.start[k] + int(starts[unit - self.before[k]])

    def stream(self, a: int, b: int) -> Iterator[bytes]:
        """Bytes ``a`` to ``b``, frame after frame."""
        k = bisect_right(self.start, a) - 1
        while k < self.n and self.start[k] < b:
            yield self.frame(k)[max(a - self.start[k], 0) : b - self.start[k]]
            k += 1


def numbers(doc_id: int | None) -> tuple[int, ...]:
    """The first four groups of eight hex digits of the hash of a document's id."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).digest()
    return struct.unpack(">4I", digest[:16])


class Cut:
    """Form and cuts of one document, in units and in bytes."""

    def __init__(self, doc_id: int | None, text: Framed):
        h1, h2, h3, h4 = numbers(doc_id)
        self.text, n = text, text.units
        self.form = "plain" if n == 0 or text.marked or h3 % 100 >= TRANSFORMED else "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
        self.a, self.b = (0, n) if self.form == "plain" else sorted((h1 % (n + 1), h2 % (n + 1)))

    def chunks(self) -> Iterator[bytes]:
        """The output in order."""
        text, size = self.text, self.text.start[-1]
        if self.form == "plain":
            yield from text.stream(0, size)
            return
        a, b = text.byte_at(self.a), text.byte_at(self.b)
        pieces = {PREFIX: (0, a), SUFFIX: (b, size), MIDDLE: (a, b)}
        for mark in (PREFIX, SUFFIX, MIDDLE) if self.form == "psm" else (SUFFIX, PREFIX, MIDDLE):
            yield mark
            yield from text.stream(*pieces[mark])


def restored(output: bytes, form: str) -> list[memoryview]:
    """The pieces of the text, in its order, from an output and its form."""
    whole = memoryview(output)
    if form == "plain":
        return [whole]
    second = output.index(SUFFIX if form == "psm" else PREFIX)
    third = output.index(MIDDLE, second)
    one, two, middle = whole[3:second], whole[second + 3 : third], whole[third + 3 :]
    return [one, middle, two] if form == "psm" else [two, middle, one]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob) of every row."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [pack(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    return rows.mapInArrow(task, "doc_id long, blob binary")


def transform(stored: DataFrame) -> DataFrame:
    """(doc_id, form, output): the text to train on, of every stored document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                made = Cut(doc_id, Framed(blob.as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([made.form]), pa.array([b"".join(made.chunks())], pa.binary())], ["doc_id", "form", "output"]
                )

    return stored.mapInArrow(task, "doc_id long, form string, output binary").withColumn("output", F.col("output").cast("string"))


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def digests(stored: DataFrame) -> DataFrame:
    """Units, form, cuts, the digest of the output as its frames stream by, and that of the text rebuilt from the output."""

    def row(doc_id: int | None, blob: bytes) -> tuple:
        made, seen, whole = Cut(doc_id, Framed(blob)), hashlib.sha256(), bytearray()
        for chunk in made.chunks():
            seen.update(chunk)
            whole += chunk
        back = hashlib.sha256()
        for piece in restored(bytes(whole), made.form):
            back.update(piece)
        prefix, middle = (None, None) if made.form == "plain" else (made.a, made.b - made.a)
        return doc_id, made.text.units, made.form, prefix, middle, seen.hexdigest(), back.hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [row(d, blob.as_buffer().to_pybytes()) for d, blob in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in DIGESTS.split(", ")])

    return stored.mapInArrow(task, DIGESTS)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, cuts and digests of all ``documents``, from their stored frames."""
    return digests(cut(store(table(spark, sf_dir, "documents")), "framed-texts"))


OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
