"""WARC archives from legacy ARC archives (operator 12).

``write_arc`` puts captures into ARC files of version 1 or 2: a header line whose fields the version fixes, the declared
number of bytes, a line feed; every record is a gzip member of its own. ``convert`` reads such files by their header lines
and declared lengths and writes WARC/1.1 files: a ``filedesc`` becomes a warcinfo record, an HTTP capture a response,
anything else a resource; identifiers follow the file's name and the record's position, times the 14 digits of the header,
digests the bytes. Of equal payloads of at least ``LEAST`` bytes one record keeps the payload, the others become revisits
of it. ``read_warc`` gives the records back, with the payloads of responses checked against their digests.

A file is one task's work and passes it record by record. The list of files is a written table, never on the driver. What a
task writes it moves into place at the end, so a repeated task replaces its file by an equal one.

Defined results: a null payload counts as an empty one; a null url is written as ``urn:unknown`` and one with spaces or
letters beyond ASCII with escapes; null ids count after all others; of repeated rows that tie, the one that is first in its
archive is the response; an empty table gives no rows; other columns play no part. Lines of an ARC file that are no header
are skipped, and a record that its file cuts short is kept with a note of that.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table
from lorekeep.operators.skew import cut
from lorekeep.session import work_dir

#: Payloads under so many bytes are stored each time.
LEAST = 100
# Fixed values of the formats: the fields of a header line by version, and the profile of a revisit.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Field of the HTTP header that carries the id of a captured row.
KEY = "X-Capture-Id"
FILES = "path string, records long"
INDEX = "path string, seq long, key long, url string, date string, bytes long, digest string"
READ = "key long, record_id string, record_type string, refers_to string, bytes long, digest string"


class Capture(NamedTuple):
    """A record of an ARC file; ``cut`` when the file ends before the declared length."""

    url: str
    ip: str
    date: str
    kind: str
    content: bytes
    cut: bool = False

    @property
    def http(self) -> bool:
        return self.content.startswith(b"HTTP/")

    def split(self) -> tuple[bytes, bytes]:
        """HTTP header and payload; without a header all is payload."""
        if not self.http:
            return b"", self.content
        ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := self.content.find(mark)) >= 0]
        at, n = min(ends, default=(len(self.content), 0))
        return self.content[: at + n], self.content[at + n :]


def header_value(header: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", header)
    return found[1].decode("utf-8", "replace").strip() if found else None


def digest_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Members:
    """A file of gzip members under another name, moved into place by ``close``."""

    def __init__(self, path: str, level: int):
        self.path, self.level, self.records = path, level, 0
        self.fs, self.at = _store(f"{path}.{uuid.uuid4().hex}.tmp")
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.at, compression=None)

    def add(self, *parts: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        for part in parts:
            self.out.write(packer.compress(part))
        self.out.write(packer.flush())
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        self.fs.move(self.at, _store(self.path)[1])
        return self.path, self.records


def _open(path: str):
    """The bytes of a file, unpacked where it is packed."""
    fs, at = _store(path)
    raw = io.BufferedReader(fs.open_input_stream(at, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


# --- ARC -----------------------------------------------------------------------------------------------------------------


def arc_header(capture: Capture, version: int, name: str, offset: int, status: str) -> bytes:
    url = quote(capture.url, safe="!#$%&'()*+,/:;=?@[]~")
    values = {"URL": url, "IP-address": capture.ip, "Archive-date": capture.date, "Content-type": capture.kind, "Archive-length": str(len(capture.content))}
    values |= {"Result-code": status, "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"


class ArcWriter(Members):
    def __init__(self, path: str, version: int, level: int = 1):
        super().__init__(path, level)
        self.version, self.name, self.size = version, path.rpartition("/")[2], 0
        about = f"{version} 0 lorekeep\n{' '.join(FIELDS[version])}\n".encode()
        self.capture(Capture(f"filedesc://{self.name}", "0.0.0.0", "19700101000000", "text/plain", about), "200")

    def capture(self, capture: Capture, status: str) -> None:
        head = arc_header(capture, self.version, self.name, self.size, status)
        self.add(head, capture.content, b"\n")
        self.size += len(head) + len(capture.content) + 1


def _line(line: bytes, version: int) -> Capture | None:
    """The fields of a header line, read from its right end, as a URL may hold spaces."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(FIELDS[version]) - 1)
    if len(parts) != len(FIELDS[version]) or not parts[0]:
        return None
    got = dict(zip(FIELDS[version], parts))
    if not re.fullmatch(r"[0-9]{12,14}", got["Archive-date"]) or not re.fullmatch(r"[0-9]+", got["Archive-length"]):
        return None
    return Capture(got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], got["Archive-length"].encode())


def captures(file) -> Iterator[Capture]:
    """The records of an ARC file; its first one names the version that the header lines after it follow."""
    version = None
    while line := file.readline():
        # The first line is of either form; it has ten fields or five.
        found = _line(line, version) if version else _line(line, 2) or _line(line, 1)
        if found is None:
            continue
        length = int(found.content)
        content = file.read(length)
        found = found._replace(content=content, cut=len(content) < length)
        version = version or 1
        if found.url.startswith("filedesc://"):
            stated = content.split(b" ", 1)[0]
            version = int(stated) if stated in (b"1", b"2") else 1
        yield found


# --- WARC ----------------------------------------------------------------------------------------------------------------


def record_id(path: str, seq: int) -> str:
    """The identifier of the ``seq``-th record of an archive, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path.rpartition('/')[2] + '#' + str(seq))}>"


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def warc_record(capture: Capture, path: str, seq: int, refers: dict | None) -> tuple[bytes, bytes]:
    """Header and block of what a capture becomes; ``refers`` is the record that already holds its payload."""
    head, payload = capture.split()
    about = capture.url.startswith("filedesc://")
    kind = "warcinfo" if about else "revisit" if refers else "response" if capture.http else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(path, seq)), ("WARC-Date", iso(capture.date))]
    if about:
        block = f"software: lorekeep\r\nformat: WARC File Format 1.1\r\ndescription: from {capture.url[11:]}\r\n".encode()
        fields += [("WARC-Filename", path.rpartition("/")[2].replace(".arc", ".warc")), ("Content-Type", "application/warc-fields")]
    else:
        block = head if refers else capture.content
        fields += [("WARC-Target-URI", capture.url), ("WARC-Payload-Digest", f"sha256:{digest_of(payload)}")]
        if capture.ip != "0.0.0.0":
            fields.append(("WARC-IP-Address", capture.ip))
        if refers:
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers["path"], refers["seq"]))]
            fields += [("WARC-Refers-To-Target-URI", refers["url"]), ("WARC-Refers-To-Date", iso(refers["date"]))]
        if capture.cut:
            fields.append(("WARC-Truncated", "unspecified"))
        fields.append(("Content-Type", "application/http; msgtype=response" if capture.http else capture.kind))
    fields += [("WARC-Block-Digest", f"sha256:{digest_of(block)}"), ("Content-Length", str(len(block)))]
    return _warc_head(fields), block


class Stored(NamedTuple):
    fields: dict[str, str]
    block: bytes

    def split(self) -> tuple[bytes, bytes]:
        return Capture("", "", "", "", self.block).split()


def records(file) -> Iterator[Stored]:
    """The records of a WARC file."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        yield Stored(fields, file.read(int(fields["Content-Length"])))


# --- jobs ----------------------------------------------------------------------------------------------------------------


def _spread(files: DataFrame) -> DataFrame:
    """The paths dealt over tasks."""
    return files.select("path").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    named = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], [n for n, _ in named])


def _each_file(files: DataFrame, rows_of: Callable[[str], Iterator[tuple]], schema: str, held: int = 5_000) -> DataFrame:
    """The rows that ``rows_of`` gives for each file, in batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in rows_of(path):
                    rows.append(row)
                    if len(rows) >= held:
                        yield _batch(schema, rows)
                        rows = []
                yield _batch(schema, rows)

    return _spread(files).mapInArrow(task, schema)


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "19700101000000") -> DataFrame:
    """(path, records) of the ARC files with one capture for each row, a file for each partition; odd ones have version 2."""
    arrow_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long"), F.coalesce(F.col(url_col), F.lit("urn:unknown")), F.coalesce(F.col(html_col), F.lit("")).cast("binary"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        for batch in batches:
            for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                out = out or ArcWriter(f"{folder}/part-{part:06d}.arc.gz", 1 + part % 2)
                payload = html.as_buffer().to_pybytes()
                known = "" if key is None else f"{KEY}: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n"
                out.capture(Capture(url, "0.0.0.0", date, "text/html", head.encode() + payload), "200")
        if out:
            yield _batch(FILES, [out.close()])

    return cut(rows.mapInArrow(task, FILES), "arc-files")


def arc_index(files: DataFrame) -> DataFrame:
    """A row for each record of the ARC files, ``filedesc`` included."""

    def rows(path: str) -> Iterator[tuple]:
        with _open(path) as file:
            for seq, capture in enumerate(captures(file)):
                head, payload = capture.split()
                key = header_value(head, KEY) or ""
                yield path, seq, int(key) if re.fullmatch("-?[0-9]+", key) else None, capture.url, capture.date, len(payload), digest_of(payload)

    return _each_file(files, rows, INDEX)


def convert(files: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """(path, records) of the WARC files made from ARC files, one from each.

    Of records with equal payloads the one with the smallest capture id stays a response; without ids the first by time,
    file and position.
    """
    index = cut(arc_index(files), "arc-index")
    place = F.struct(F.col("key").isNull(), "key", "date", "path", "seq")
    large = index.where((F.col("bytes") >= least) & ~F.col("url").startswith("filedesc://"))
    groups = large.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("path", "seq", "url", "date"), place).alias("first"))
    shared = groups.where("n > 1").select("digest", "bytes", "first")
    own = (F.col("first.path") == F.col("path")) & (F.col("first.seq") == F.col("seq"))
    known = index.select("path", "seq", "digest", "bytes", F.col("url").startswith("filedesc://").alias("about"))
    met = known.join(shared, ["digest", "bytes"], "left").select("path", "seq", F.when(~own & ~F.col("about"), F.col("first")).alias("refers"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = met.repartition(parts, "path").sortWithinPartitions("path", "seq")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, walk, out = None, None, iter(()), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if out:
                        file.close()
                        yield _batch(FILES, [out.close()])
                    path = row["path"]
                    file = _open(path)
                    walk = captures(file)
                    name = path.rpartition("/")[2].replace(".arc", ".warc")
                    out = Members(f"{folder}/{name if name.endswith('.gz') else name + '.gz'}", 6)
                head, block = warc_record(next(walk), path, row["seq"], row["refers"])
                out.add(head, block, b"\r\n\r\n")
        if out:
            file.close()
            yield _batch(FILES, [out.close()])

    return cut(ordered.mapInArrow(task, FILES), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """(key, record_id, record_type, refers_to, bytes, digest) of all records but warcinfo; stored payloads are checked."""

    def rows(path: str) -> Iterator[tuple]:
        with _open(path) as file:
            for record in records(file):
                fields, kind = record.fields, record.fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                head, payload = record.split()
                stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind != "revisit" and digest_of(payload) != stated:
                    raise ValueError(f"{path}: {fields['WARC-Record-ID']} is damaged")
                size = int(header_value(head, "Content-Length") or 0) if kind == "revisit" else len(payload)
                key = header_value(head, KEY) if head else None
                yield int(key) if key else None, fields["WARC-Record-ID"], kind, fields.get("WARC-Refers-To"), size, stated

    return _each_file(files, rows, READ)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the WARC archives of all ``pages`` hold, converted from ARC archives of them."""
    folder = work_dir(spark, "archives")
    arcs = write_arc(table(spark, sf_dir, "pages"), f"{folder}/arc")
    stored = cut(read_warc(convert(arcs, f"{folder}/warc")), "warc-records")
    held = stored.where(F.col("record_type") != "revisit").select(F.col("record_id").alias("held"), F.col("key").alias("first"))
    revisits = stored.where(F.col("record_type") == "revisit")
    named = revisits.join(held, F.col("refers_to") == F.col("held"), "left")
    rows = stored.where(F.col("record_type") != "revisit").withColumn("first", F.lit(None).cast("long")).unionByName(named.drop("held"))
    return rows.select(
        F.col("key").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("first").alias("refers_to")
    )


OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
