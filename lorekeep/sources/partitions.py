"""Tables in buckets, with versions that replace only the buckets a commit touches.

A version is one small manifest: for each table its schema, its key columns and the folders that hold each bucket, and a few
numbers that belong to the version. A commit writes new folders for the buckets it changes, takes over the folders of all
others, and publishes its manifest under the next version number with a rename that fails where that number is taken: of
two writers that start from one version one wins, and the loser removes what it wrote. What no kept version names is
removed by ``vacuum``.

The number of buckets is fixed when a table is made and named by the caller, by the size it is meant for; rows of a bucket
are spread over as many files as Spark's rebalancing finds right.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has published the version that a commit was meant to be."""


@dataclass(frozen=True)
class Draft:
    """Rows of a table that lie in its buckets already; a commit takes their folders over."""

    folder: str
    parts: dict[str, list[str]]
    schema: StructType


@dataclass(frozen=True)
class Change:
    """Rows for a table: the whole content of ``buckets`` (all where None), or with ``append`` more rows of theirs.

    With ``local`` every task writes its own file for each bucket and no row is moved: for rows that are large and many.
    """

    rows: DataFrame | Draft
    buckets: Sequence[int] | None = None
    append: bool = False
    local: bool = False


@dataclass
class Manifest:
    version: int
    tables: dict = field(default_factory=dict)
    facts: dict = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f for t in self.tables.values() for parts in t["parts"].values() for f in parts}


class PartitionStore:
    """Versioned tables under one folder that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    # -- files ---------------------------------------------------------------------------------------------------

    def _list(self, folder: str) -> list:
        at = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _remove(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self._list("versions"))

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> Manifest:
        v = self.current() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no published version in {self.path}")
        at = self._fs.open(self._path(f"{self.path}/versions/{v}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
        finally:
            at.close()
        found = json.loads(text)
        return Manifest(v, found["tables"], found["facts"])

    def _publish(self, manifest: Manifest) -> bool:
        """Puts the manifest in place in one step; False where the version exists."""
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        self._fs.mkdirs(self._path(f"{self.path}/drafts"))
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"tables": manifest.tables, "facts": manifest.facts}).encode()))
        out.close()
        try:
            # A rename without the option to overwrite.
            self._files.rename(draft, self._path(f"{self.path}/versions/{manifest.version}"), self._options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    # -- reading -------------------------------------------------------------------------------------------------

    def read(self, table: str, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of a table, of some buckets only where these are named: other files are not listed in the plan."""
        t = self.manifest(version).tables[table]
        wanted = t["parts"] if buckets is None else {str(b): t["parts"].get(str(b), []) for b in buckets}
        paths = [f"{self.path}/{f}" for parts in wanted.values() for f in parts]
        schema = StructType.fromJson(t["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, table: str, manifest: Manifest | None = None) -> Column:
        t = (manifest or self.manifest()).tables[table]
        return F.pmod(F.xxhash64(*t["keys"]), F.lit(t["buckets"])).cast("int")

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """Buckets of the given keys: at most as many numbers as the table has buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(table)).distinct().collect())

    def update(self, table: str, keys: DataFrame, step: Callable[[DataFrame], DataFrame]) -> Change:
        """The change that ``step`` makes to the buckets of ``keys``; it sees and returns the rows of these buckets."""
        buckets = self.touched(table, keys)
        return Change(step(self.read(table, buckets=buckets)), buckets)

    # -- writing -------------------------------------------------------------------------------------------------

    def _write_local(self, placed: DataFrame, folder: str, buckets: int) -> None:
        """A file for each task and bucket, all of a task open together, so that its rows are not sorted by bucket."""
        key = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(buckets))
        try:
            placed.write.partitionBy(BUCKET).option("compression", "zstd").parquet(folder)
        finally:
            self.spark.conf.set(key, before)

    def _write(self, table: str, keys: Sequence[str], buckets: int, rows: DataFrame, local: bool = False) -> tuple[str, dict[str, list[str]]]:
        folder = f"data/{table}/{uuid.uuid4().hex}"
        at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        placed = rows.withColumn(BUCKET, at)
        if local:
            self._write_local(placed, f"{self.path}/{folder}", buckets)
        else:
            placed.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._list(folder)]
        return folder, {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith(f"{BUCKET}=")}

    def draft(self, table: str, keys: Sequence[str], buckets: int, rows: DataFrame, local: bool = False) -> Draft:
        """Rows written for a commit to come, so that what else it holds can be made from them; ``drafted`` reads them."""
        return Draft(*self._write(table, keys, buckets, rows, local), rows.schema)

    def drafted(self, draft: Draft) -> DataFrame:
        paths = [f"{self.path}/{f}" for parts in draft.parts.values() for f in parts]
        return self.spark.read.schema(draft.schema).parquet(*paths) if paths else self.spark.createDataFrame([], draft.schema)

    def create(self, tables: Mapping[str, tuple[DataFrame | Draft, Sequence[str], int]], facts: Mapping | None = None, local: Sequence[str] = ()) -> bool:
        """The first version: for each table its rows, key columns and number of buckets. False where a version exists.

        The tables named by ``local`` are written as a local ``Change`` is.
        """
        first = Manifest(0, {n: {"keys": list(k), "buckets": b, "schema": rows.schema.jsonValue(), "parts": {}} for n, (rows, k, b) in tables.items()})
        return self._commit(first, {n: Change(rows, local=n in local) for n, (rows, _, _) in tables.items()}, facts)

    def commit(self, base: int, changes: Mapping[str, Change], facts: Mapping | None = None, without: Mapping[str, set[str]] | None = None) -> int:
        """Publishes version ``base + 1``; raises ``Conflict`` where another writer has done so.

        The new version leaves out the folders of a table that ``without`` names.
        """
        following = Manifest(base + 1, **{k: v for k, v in vars(self.manifest(base)).items() if k != "version"})
        for name, gone in (without or {}).items():
            parts = following.tables[name]["parts"]
            following.tables[name]["parts"] = {b: left for b, folders in parts.items() if (left := [f for f in folders if f not in gone])}
        if not self._commit(following, changes, facts):
            raise Conflict(f"version {base + 1} of {self.path} exists")
        return base + 1

    def _commit(self, following: Manifest, changes: Mapping[str, Change], facts: Mapping | None) -> bool:
        written = []
        for name, change in changes.items():
            t = following.tables[name]
            if isinstance(change.rows, Draft):
                folder, parts = change.rows.folder, change.rows.parts
            else:
                columns = [f["name"] for f in t["schema"]["fields"]]
                folder, parts = self._write(name, t["keys"], t["buckets"], change.rows.select(*columns), change.local)
            written.append(folder)
            if change.buckets is not None and (stray := set(parts) - {str(b) for b in change.buckets}):
                raise ValueError(f"rows of {name} belong to buckets {sorted(stray)} that the change does not name")
            kept = t["parts"] if change.append else {} if change.buckets is None else {b: f for b, f in t["parts"].items() if int(b) not in set(change.buckets)}
            t["parts"] = kept | {b: [*kept.get(b, []), *f] for b, f in parts.items()}
        following.facts = following.facts | dict(facts or {})
        if self._publish(following):
            return True
        for folder in written:
            self._remove(folder)
        return False

    def vacuum(self, keep: int = 1, grace_seconds: float = 86_400) -> int:
        """Removes all but the last ``keep`` versions and the folders none of these names; returns how many folders went.

        Folders younger than ``grace_seconds`` stay: they may belong to a commit under way.
        """
        versions = self.versions()
        for v in versions[: max(len(versions) - keep, 0)]:
            self._fs.delete(self._path(f"{self.path}/versions/{v}"), False)
        named = {f for v in self.versions() for f in self.manifest(v).folders()}
        before, gone = (time.time() - grace_seconds) * 1000, 0
        for table in self._list("data"):
            for batch in self._list(f"data/{table.getPath().getName()}"):
                folder = f"data/{table.getPath().getName()}/{batch.getPath().getName()}"
                inside = [f for f in self._list(folder) if f.isDirectory()]
                dead = [f"{folder}/{f.getPath().getName()}" for f in inside if f"{folder}/{f.getPath().getName()}" not in named]
                if batch.getModificationTime() > before:
                    continue
                for f in dead:
                    self._remove(f)
                gone += len(dead)
                if len(dead) == len(inside):
                    self._remove(folder)
        return gone
