"""Token ids in seekable zstandard files (operator 2).

A file is a run of independent frames, one for each document, then a skippable frame with the document ids, then the
seek table that the public seekable format prescribes: sizes and the low half of the XXH64 of every frame, and a footer.
A reader takes the footer, the table and the ids, and decompresses only the frames it is asked for. Tasks write the
files of their own range of ids under the shared folder: first by another name, then moved, so a repeated task
replaces its file by an equal one. Any store that Arrow's file systems reach will do.

Defined results: a null text is encoded as an empty one, so a document has at least its end id; null ids come first;
rows with equal ids follow the hash of their text; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table
from lorekeep.session import work_dir

# Fixed values of the seekable format.
SKIPPABLE, SEEK_TABLE, FOOTER, HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID = 2
#: Longest piece of a document in one frame, and words whose ids a worker remembers.
FRAME_BYTES, REMEMBERED = 1 << 28, 1_200_000
#: A word of letters that the tokenizer takes as they are and of marks that it parts from a letter before them; or any other.
SHAPE = re.compile(rb"""(?m)^((?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])*+)([-.,;:!?%#$&*()[\]{}|_+=/~^"]*+)$|^(.+)$""")
#: What the vocabulary adds to a token that ends a word, and words whose ids are gathered at once.
WORD_END, GATHERED = "</w>", 1 << 19
MANIFEST = "part int, path string, n_docs long, n_tokens long"


class WordIds:
    """Ids of texts by the tokenizers library, which sees every distinct word of a worker once while it is remembered.

    Only for a tokenizer that drops white space and ignores case: words apart by white space are then independent.
    When there is no more room for words, those of the batch at hand stay.
    """

    _own: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}
        self.mark = self._ids("\x01")
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        self.known.update(zip(words, (raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist()))))

    def _marked(self, words: list[bytes]) -> None:
        """Encodes words in one go, with a mark between them that no word holds."""
        ids = self._ids(b" \x01 ".join(words).decode())
        cuts = np.flatnonzero(ids == self.mark[0])
        self._keep(words, ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]]))

    def _letters(self, words: list[bytes]) -> None:
        """Encodes words of plain letters: each ends with the one token that ends a word."""
        ids = self._ids(b" ".join(words).decode())
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._marked(words)
        self._keep(words, ids, np.concatenate([[0], cuts[:-1]]), cuts)

    def learn(self, words: list[bytes]) -> None:
        known = self.known
        if len(known) > REMEMBERED:
            known = self.known = {b"": b""} | {w: known[w] for w in words if w in known}
        fresh = [w for w in words if w not in known]
        shapes = SHAPE.findall(b"\n".join(fresh))
        # A word with marks behind its letters has the ids of both parts.
        parts = [(w, core, marks) for w, (core, marks, other) in zip(fresh, shapes) if marks]
        letters = list({core for core, _, _ in shapes} - known.keys())
        others = list({other or marks for _, marks, other in shapes} - known.keys())
        for kind, some in ((self._letters, letters), (self._marked, others)):
            for at in range(0, len(some), 20_000):
                kind(some[at : at + 20_000])
        known.update([(w, known[core] + known[marks]) for w, core, marks in parts])

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; every distinct word of the batch is looked up once, then ids are gathered by its number."""
        # Special tokens and the mark make words depend on each other: the library takes such a text as a whole.
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring(texts, "\x01"))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
        self.learn(distinct)
        ids = list(map(self.known.__getitem__, distinct))
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(length) - length
        number = numbered.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(length[number])])
        out = np.empty(ends[-1], "<u4")
        for at in range(0, len(number), GATHERED):
            some, n = number[at : at + GATHERED], length[number[at : at + GATHERED]]
            a, b = ends[at], ends[at + len(some)]
            out[a:b] = flat[np.arange(a, b) + np.repeat(start[some] - ends[at : at + len(some)], n)]
        cuts = ends[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])]
        for k, whole in enumerate(odd.to_pylist()):
            yield self._ids(texts[k].as_py()).tobytes() if whole else out[cuts[k] : cuts[k + 1]].tobytes()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """One file; ``add`` documents in order, then ``close``."""

    def __init__(self, path: str):
        import zstandard

        self.path, self.hidden = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.fs, self.at = _store(self.hidden)
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.at)
        self.frame = zstandard.ZstdCompressor(level=3)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.known: list[bool] = []
        self.frames: list[int] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        import xxhash

        pieces = [data[k : k + FRAME_BYTES] for k in range(0, len(data), FRAME_BYTES)] or [b""]
        for piece in pieces:
            packed = self.frame.compress(piece)
            self.out.write(packed)
            self.table.append((len(packed), len(piece), xxhash.xxh64_intdigest(piece) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.frames.append(len(pieces))
        self.n_tokens += len(data) // 4

    def close(self) -> None:
        n = len(self.ids)
        names = struct.pack("<Q", n) + np.array(self.ids, "<i8").tobytes() + np.array(self.frames, "<u4").tobytes() + np.array(self.known, "u1").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(names)) + names)
        self.table.append((len(names) + 8, 0, 0))
        entries = np.array(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), HAS_CHECKSUM, FOOTER))
        self.out.close()
        fs, to = _store(self.path)
        fs.move(self.at, to)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        fs, at = _store(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != FOOTER or flags != HAS_CHECKSUM:
            raise ValueError(f"{path} has no seek table")
        start = size - 9 - 12 * n
        if struct.unpack("<II", self._bytes(start - 8, 8)) != (SEEK_TABLE, 12 * n + 9):
            raise ValueError(f"{path} has a broken seek table")
        self.table = np.frombuffer(self._bytes(start, 12 * n), "<u4").reshape(n, 3).astype("int64")
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        names = self._bytes(int(self.offset[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)
        (docs,) = struct.unpack_from("<Q", names)
        self.ids = np.frombuffer(names, "<i8", docs, 8)
        frames = np.frombuffer(names, "<u4", docs, 8 + 8 * docs)
        self.known = np.frombuffer(names, "u1", docs, 8 + 12 * docs).astype(bool)
        self.first = np.concatenate([[0], np.cumsum(frames)]).astype("int64")
        # Sizes are in the table, so the place of a document among all ids needs no decompression.
        ends = np.concatenate([[0], np.cumsum(self.table[:, 1])])[self.first]
        self.start = ends // 4

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, k: int) -> bytes:
        """The ids of the ``k``-th document as bytes; other frames are not touched."""
        import xxhash
        import zstandard

        out = []
        for f in range(int(self.first[k]), int(self.first[k + 1])):
            data = zstandard.ZstdDecompressor().decompress(self._bytes(int(self.offset[f]), int(self.table[f, 0])), max_output_size=int(self.table[f, 1]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[f, 2]:
                raise ValueError(f"frame {f} is damaged")
            out.append(data)
        return b"".join(out)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col="doc_id", text_col="text", end_id: int = END_ID, files: int | None = None) -> list[tuple[int, str, int, int]]:
    """Writes ``docs`` in ascending id order; returns (part, path, n_docs, n_tokens) of each file, in that order."""
    spark = docs.sparkSession
    arrow_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, path = None, f"{folder}/part-{part:06d}.zst"
        words = WordIds.of(tokenizer)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = out or Writer(path)
            for doc_id, data in zip(batch.column(0).to_pylist(), words.encode(batch.column(1))):
                out.add(doc_id, data + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(out.ids)], "n_tokens": [out.n_tokens]})

    # A row for each file, as many as there are partitions.
    made = sorted((r.part, r.path, r.n_docs, r.n_tokens) for r in ordered.mapInArrow(task, MANIFEST).collect())
    if made:
        _sweep(folder)
    return made


def _sweep(folder: str) -> None:
    """Removes what lost tasks have left under other names."""
    from pyarrow import fs

    store, at = _store(folder)
    for info in store.get_file_info(fs.FileSelector(at)):
        if info.path.endswith(".tmp"):
            store.delete_file(info.path)


def read(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, one task for each file."""
    base, rows = 0, []
    for _, path, _, n_tokens in files:
        rows.append((path, base))
        base += n_tokens
    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(path)
                got, held = [], 0
                for k in range(len(file.ids) + 1):
                    if k == len(file.ids) or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"]
                        )
                        got, held = [], 0
                    if k < len(file.ids):
                        data = file.document(k)
                        got.append((int(file.ids[k]) if file.known[k] else None, first + int(file.start[k]), len(data) // 4, data))
                        held += len(data) + 64

    return listed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all ``documents`` hold."""
    import public_tokenizers

    folder = work_dir(spark, "token-files")
    files = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
