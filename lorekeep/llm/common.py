"""Reading the tables and settings shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, in rows and bytes, so that very long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the documents that no model learns from; a null id counts as an empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def fold(doc_id: str) -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % 5).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y, fold) of at most ``rows`` labelled documents outside the held-out fifth, each text once.

    The rows are the first by a hash of the id, so the sample does not depend on the layout of the tables. They are the
    side that is broadcast: their number is the bound.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")).withColumn("fold", fold("doc_id"))
