"""Streaming forms of the incremental operators. Each returns the rows its batch twin returns for the same input."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorekeep.functions.times import local_date
from lorekeep.operators.ledger import spend_columns
from lorekeep.operators.skew import first_by
from lorekeep.session import configure, work_dir
from lorekeep.sources.partitions import Change, PartitionStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """State in RocksDB, so that its size is bound by disk and not by the heap of an executor."""
    configure(spark).conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def read_table(spark: SparkSession, folder: str, file: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table or file pattern of a folder as a stream, with its timestamps as instants.

    A table is one file or a folder of files.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if held and all(f.isDirectory() for f in held):
        folder, file = f"{folder}/{file}", "*"
    static = spark.read.option("pathGlobFilter", file).parquet(folder)
    r = spark.readStream.schema(static.schema).option("pathGlobFilter", file)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    df = r.parquet(folder)
    ntz = [f.name for f in static.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def run(df: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = (), checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs a stream over everything available and returns what it wrote.

    Every micro-batch overwrites its own folder, so a batch that is repeated after a failure changes nothing. With
    ``update`` mode the last value of each key is returned.
    """
    spark = df.sparkSession
    base = work_dir(spark, name)
    out = out or f"{base}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    return first_by(rows, list(keys), F.col("batch"), descending=True).drop("batch") if keys else rows.drop("batch")


# -- windows and duplicates -----------------------------------------------------------------------------------


def day_counts(stream: DataFrame, scope: str, tz: str, delay: str = "300 seconds") -> DataFrame:
    """Messages per scope and local day under a watermark; run in update mode."""
    g = stream.withWatermark("ts", delay)
    totals = [F.count(F.lit(1)).alias("messages"), F.max("ts").alias("last_ts")]
    if tz == "UTC":
        days = g.groupBy(F.window("ts", "1 day").alias("w"), scope).agg(*totals)
        return days.select(scope, F.to_date("w.start").alias("day"), "messages", "last_ts")
    return g.groupBy(scope, local_date(F.col("ts"), tz).alias("day")).agg(*totals)


def drop_repeats(stream: DataFrame, keys: Sequence[str], delay: str = "300 seconds") -> DataFrame:
    """One row per key across overlapping fetches; the state of a key ends with the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def weekly_spend(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running spend per Monday week in UTC; run in update mode."""
    w = F.window("at", "7 days", startTime="4 days")
    g = ledger.withWatermark("at", delay).groupBy(w.alias("w")).agg(*spend_columns())
    return g.select(F.to_date("w.start").alias("period_start"), *[c for c in g.columns if c != "w"])


# -- keyed state ----------------------------------------------------------------------------------------------

_MARK = T.StructType([T.StructField("mark", T.LongType())])


class HighWater(StatefulProcessor):
    """Rows newer than the mark of their key, in event order; the mark moves to the newest row of the batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", _MARK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        top = mark
        for pdf in rows:
            fresh = pdf if mark is None else pdf[pdf["micros"] > mark]
            if len(fresh):
                newest = int(fresh["micros"].max())
                top = newest if top is None else max(top, newest)
                yield fresh[["scope", "row_id", "micros"]]
        if top is not None and top != mark:
            self.mark.update((top,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.mark.update((int(initialState["mark"].max()),))

    def close(self) -> None:
        pass


def high_water(stream: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``stream(scope, row_id, micros)`` past the mark of its scope. ``marks(scope, mark)`` are stored marks to start from."""
    initial = None if marks is None else marks.groupBy("scope")
    return stream.groupBy("scope").transformWithStateInPandas(
        HighWater(), "scope long, row_id long, micros long", "append", "None", initialState=initial
    )


class Watch(StatefulProcessor):
    """Reports a thread once it had no activity for ``days``, and drops its state."""

    def __init__(self, days: float):
        self.millis = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _MARK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get()[0] if self.last.exists() else None
        newest = max(int(pdf["millis"].max()) for pdf in rows)
        if old is None or newest > old:
            if old is not None:
                self.handle.deleteTimer(old + self.millis)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.millis)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"scope": [key[0]], "last_millis": [last]})

    def close(self) -> None:
        pass


def forgotten_threads(stream: DataFrame, days: float, delay: str = "1 hour") -> DataFrame:
    """``(scope, last_millis)`` of threads that went quiet, from ``stream(scope, ts)``."""
    rows = stream.withColumn("millis", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.groupBy("scope").transformWithStateInPandas(Watch(days), "scope long, last_millis long", "append", "EventTime")


_HASH = T.StructType([T.StructField("sha", T.StringType()), T.StructField("micros", T.LongType())])


class Changes(StatefulProcessor):
    """new, changed or unchanged by the newest hash known for the key; late where a newer version is known already.

    Versions of one batch are taken in the order of their time, then hash, however they arrive; equal ones are one change.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _HASH)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, since = self.last.get() if self.last.exists() else (None, None)
        batch = pd.concat(rows).sort_values(["micros", "sha"], kind="stable")
        states = []
        for sha, micros in zip(batch["sha"].tolist(), batch["micros"].tolist()):
            if since is not None and micros < since:
                states.append("late")
                continue
            states.append("new" if known is None else "unchanged" if known == sha else "changed")
            known, since = sha, micros
        if known is not None:
            self.last.update((known, since))
        yield pd.DataFrame({"doc": batch["doc"], "micros": batch["micros"], "sha": batch["sha"], "change": states})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        newest = initialState.sort_values(["micros", "sha"]).iloc[-1]
        self.last.update((str(newest["sha"]), int(newest["micros"])))

    def close(self) -> None:
        pass


def document_changes(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``stream(doc, micros, sha)`` with its ``change`` against the state, which starts from ``known(doc, micros, sha)``."""
    initial = None if known is None else known.select("doc", "micros", "sha").groupBy("doc")
    rows = stream.select("doc", "micros", "sha").groupBy("doc")
    return rows.transformWithStateInPandas(Changes(), "doc long, micros long, sha string, change string", "append", "None", initialState=initial)


# -- catalog commits ------------------------------------------------------------------------------------------

Step = Callable[[PartitionStore, DataFrame], Mapping[str, Change]]


class BatchCommitter:
    """``foreachBatch`` function that turns each micro-batch into one version of the tables it touches.

    ``step(store, batch)`` returns the changes: entries, queue and cursors together, so a cursor is never ahead of the data.
    Buckets that a batch does not touch keep their files. The batch id is a fact of the version, so a batch that is run
    again is recognized and skipped.
    """

    def __init__(self, store: PartitionStore, step: Step):
        self.store, self.step = store, step

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        base = self.store.manifest()
        if base.facts["batch"] >= batch_id:
            return
        batch.persist()
        try:
            self.store.commit(base.version, self.step(self.store, batch), {"batch": batch_id})
        finally:
            batch.unpersist()


def commit_stream(stream: DataFrame, store: PartitionStore, initial: Mapping[str, tuple[DataFrame, Sequence[str], int]], step: Step, checkpoint: str) -> None:
    """Runs ``step`` over everything available, starting from ``initial`` (rows, keys, buckets) where the store is empty."""
    if store.current() is None:
        store.create(initial, {"batch": -1})
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(BatchCommitter(store, step)).start().awaitTermination()
