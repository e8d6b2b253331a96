"""Health checks over the catalog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import jsonx
from lorekeep.operators.items import alias_union
from lorekeep.operators.skew import first_by
from lorekeep.schemas import DEFAULTS


def queue_health(queue: DataFrame, now: datetime, max_attempts: int = DEFAULTS.queue_max_attempts) -> DataFrame:
    """Queued rows, those older than a week, those at the attempt limit, and the error of the first such row."""
    stuck = F.col("attempts") >= max_attempts
    old = F.col("enqueued_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(7))
    first = F.min_by("last_error", F.when(stuck & F.col("last_error").isNotNull(), F.struct("enqueued_at", "source_id")))
    return queue.agg(F.count(F.lit(1)).alias("queued"), F.count_if(old).alias("stale"), F.count_if(stuck).alias("stuck"), first.alias("example_error"))


def summary_backlog(entries: DataFrame, max_attempts: int = DEFAULTS.summary_max_attempts) -> DataFrame:
    st = F.col("summary_status")
    g = entries.agg(
        F.count_if(st == "pending").alias("pending"), F.count_if(st == "failed").alias("failed"),
        F.count_if((st == "failed") & (F.col("summary_attempts") >= max_attempts)).alias("at_limit"),
    )
    return g.withColumn("level", F.when(F.col("failed") > 0, "warning").when(F.col("pending") > 0, "info").otherwise("ok"))


def meetings_without_transcript(entries: DataFrame) -> DataFrame:
    """Meetings with raw data, and those without a transcript."""
    m = entries.where((F.col("source_kind") == "google.meet") & (F.col("raw_status") == "present"))
    has = F.coalesce(jsonx.get("metadata", "has_transcript") == "true", F.lit(False))
    return m.agg(F.count(F.lit(1)).alias("meetings"), F.count_if(~has).alias("without_transcript"))


def run_health(runs: DataFrame, now: datetime, by: tuple[str, ...] = (), command: str = "sync", trigger: str = "schedule") -> DataFrame:
    """Latest run of a command and trigger: failed, old, incomplete or ok, with the work it left."""
    r = runs.where(F.col("command").startswith(command) & (F.col("trigger") == trigger))
    keys = list(by) or ["_all"]
    r = r if by else r.withColumn("_all", F.lit(0))
    last = first_by(r, keys, F.struct("started_at", "id"), descending=True)
    age = F.lit(now).cast("timestamp") - F.coalesce("finished_at", "started_at")
    health = (
        F.when(F.col("status") == "failed", "error").when(age > F.make_dt_interval(F.lit(0), F.lit(36)), "old")
        .when(F.col("status") == "ok", "ok").otherwise("incomplete")
    )
    left = [F.coalesce(jsonx.get("stats", k).cast("long"), F.lit(0)).alias(k) for k in ("queue_remaining", "pending_summaries")]
    return last.select(*by, "id", "status", health.alias("health"), *left)


def alias_health(accounts: DataFrame, has_items: Column) -> DataFrame:
    """Enabled chat and document accounts without any alias, and whether no alias is known while items exist."""
    cfg = F.from_json("config", "struct<aliases:struct<names:array<string>,emails:array<string>>,extra_aliases:struct<names:array<string>,emails:array<string>>>")
    on = accounts.where(F.col("kind").isin("slack", "google", "microsoft") & (F.col("status") != "disabled")).select("id", cfg.alias("c"))
    n = F.lit(0)
    for group in ("aliases", "extra_aliases"):
        for f in ("names", "emails"):
            n = n + F.greatest(F.coalesce(F.size(F.col("c")[group][f]), F.lit(0)), F.lit(0))
    known = alias_union(accounts).agg(F.count(F.lit(1)).alias("n")).scalar()
    empty = F.when(n == 0, F.col("id"))
    return on.agg(
        F.count(F.lit(1)).alias("accounts"), F.count(empty).alias("without_alias"), F.min(empty).alias("example"),
        F.max((known == 0) & has_items).alias("nobody_known"),
    )


def sync_plan(accounts: DataFrame, queue: DataFrame, syncable: dict[str, str], pending: Column) -> DataFrame:
    """What a run would do per account: sources by account kind (``syncable``), queued rows, why it is skipped."""
    q = queue.groupBy(F.col("account_id").alias("id")).agg(F.count(F.lit(1)).alias("queued"))
    sources = F.lit(None).cast("string")
    for kind, names in syncable.items():
        sources = F.when(F.col("kind") == kind, names).otherwise(sources)
    skip = (
        F.when(F.col("status") == "disabled", "disabled").when(F.col("status") == "needs_reauth", "needs re-authentication")
        .when(sources.isNull(), "on-demand source only")
    )
    return accounts.join(q, "id", "left").select(
        "id", "kind", "status", F.when(skip.isNull(), sources).alias("sources"), F.coalesce("queued", F.lit(0)).alias("queued"),
        skip.alias("skipped_reason"), pending.alias("pending_summaries"),
    )
