"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.times import entry_date


def as_json(df: DataFrame, schema_tag: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every row as one JSON object that starts with its schema tag."""
    body = F.to_json(F.struct(F.lit(schema_tag).alias("schema"), *[F.col(c) for c in df.columns]))
    return df.select(*keep, body.alias("json"))


def write_json(df: DataFrame, path: str, schema_tag: str) -> None:
    as_json(df, schema_tag).select("json").write.mode("overwrite").text(path)


def write_raw(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Raw segments partitioned as account / kind / year / month of the entry date.

    ``raw`` has the entry's ``source_created_at`` and ``ingested_at``. Spark balances the writing tasks by the sizes it
    finds: a large account or month is split over as many tasks as its bytes need, small ones share a task.
    """
    at = entry_date()
    keys = ["account_id", "source_kind", "year", "month"]
    out = raw.withColumn("year", F.year(at)).withColumn("month", F.month(at))
    out.hint("rebalance", *[F.col(k) for k in keys]).write.mode(mode).partitionBy(*keys).parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Ledger rows, failed billed attempts included, partitioned by day so that period reads prune."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)
