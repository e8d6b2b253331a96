"""Exact deduplication as a stateful stream (operator 10).

Rows arrive as files. A streaming aggregation keyed by the digest of the text keeps, on disk (RocksDB) and without
expiry, the largest stable identifier with the locator (file and row) of its content, and how often the digest came.
The state itself is then read as a table. A digest that came once needs nothing more; on a hit the full text of the
row is compared with the text that the locator names. Rows that share a digest but not the text are grouped by text.

Defined results: a null text equals an empty one; a null identifier is smaller than any other; of rows with the same
identifier and text the one with the largest locator stays; an empty input gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.skew import cut
from lorekeep.session import work_dir

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Keys of one partition of the state. A partition is a store of its own with a fixed cost, for the life of the stream.
KEYS_PER_STORE = 50_000
#: Copies compared with one replica of the text that stays.
COPIES_PER_REPLICA = 1000


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _locator(rows: DataFrame, file: str, row: str) -> list[Column]:
    """Where a row lies; a column of the table by the name of the metadata doesn't hide it."""
    at = rows.metadataColumn("_metadata")
    return [at["file_path"].alias(file), at["row_index"].alias(row)]


def _keyed(rows: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    return rows.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        digest(F.col(text_col)).alias("digest"),
        *_locator(rows, "file", "row"),
    )


def keyed_state(spark: SparkSession, path: str, id_col="doc_id", text_col="text", digest=sha, files_per_batch: int | None = None, checkpoint: str | None = None, stores: int | None = None) -> DataFrame:
    """(digest, n, keep_id, keep_file, keep_row) after all files under ``path``; ``checkpoint`` resumes an earlier run."""
    place = checkpoint or work_dir(spark, "dedup-state")
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    source = spark.readStream.schema(schema)
    # A bounded share of a large backlog is one batch.
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source.option("maxBytesPerTrigger", str(256 << 30))
    # As a pattern, because the stream takes a plain path for a folder and this may be one file.
    rows = _keyed(source.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text_col, digest).drop("text")
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    stores = stores or max(12, -(-spark.read.parquet(path).count() // KEYS_PER_STORE))
    settings = STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(stores)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", place).trigger(availableNow=True).start()
        run.awaitTermination()
        kept = spark.read.format("statestore").load(place)
        keep, n = kept.schema["value"].dataType.fieldNames()
        # Written once: the state is read by several joins.
        return cut(
            kept.select(
                F.col("key")[kept.schema["key"].dataType.fieldNames()[0]].alias("digest"),
                F.col("value")[n].alias("n"),
                *[F.col("value")[keep][c].alias(a) for c, a in (("doc_id", "keep_id"), ("file", "keep_file"), ("row", "keep_row"))],
            ),
            "dedup-keys",
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def decisions(spark: SparkSession, path: str, id_col="doc_id", text_col="text", digest=sha, **stream) -> DataFrame:
    """One row per row under ``path``: doc_id, file, row, digest, keep_id, group_size, kept."""
    log = _keyed(spark.read.parquet(path), id_col, text_col, digest)
    hits = keyed_state(spark, path, id_col, text_col, digest, **stream).where("n > 1")
    single = log.drop("text").join(hits.select("digest"), "digest", "left_anti").select(
        "doc_id", "file", "row", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )

    found = cut(log.join(hits, "digest"), "dedup-hits")
    is_keeper = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    replicas = F.ceil(F.col("n") / COPIES_PER_REPLICA)
    keepers = found.where(is_keeper).select("digest", F.explode(F.sequence(F.lit(0).cast("long"), replicas - 1)).alias("salt"), F.col("text").alias("keep_text"))
    rows = found.withColumn("salt", F.pmod(F.xxhash64("file", "row"), replicas))
    checked = rows.join(keepers, ["digest", "salt"]).select(
        "doc_id", "file", "row", "digest", "keep_id", "n", is_keeper.alias("kept"), (F.col("text") == F.col("keep_text")).alias("same"),
        F.when(F.col("text") != F.col("keep_text"), F.col("text")).alias("text"),
    )
    checked = cut(checked, "dedup-checked")
    other = checked.where("not same")
    # Equal digests of unequal texts: none is expected, any is grouped by its text.
    groups = other.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    regrouped = other.drop("keep_id", "kept").join(groups, ["digest", "text"]).select(
        "doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"),
    )
    less = other.groupBy("digest").agg(F.count(F.lit(1)).alias("away"))
    equal = checked.where("same").join(less, "digest", "left").select(
        "doc_id", "file", "row", "digest", "keep_id", (F.col("n") - F.coalesce("away", F.lit(0))).alias("group_size"), "kept"
    )
    return single.unionByName(equal).unionByName(regrouped)


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ``docs`` is written once as the log that the stream reads."""
    spark, path = docs.sparkSession, work_dir(docs.sparkSession, "dedup-log")
    # Columns by number, so that no name of theirs meets one that is used here or hides the file's own metadata.
    number = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    docs.toDF(*number.values()).write.parquet(path)
    kept = decisions(spark, path, number[id_col], number[text_col], **how).where("kept").select(F.col("file").alias("_f"), F.col("row").alias("_r"))
    log = spark.read.parquet(path)
    file, row = _locator(log, "file", "row")
    at = (file == F.col("_f")) & (row == F.col("_r"))
    return log.join(kept, at, "left_semi").toDF(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of ``documents`` stays for each text."""
    found = decisions(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
