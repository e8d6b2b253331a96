"""What a run covers: ranges per scope, windows, coverage records, watched threads, history windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import jsonx
from lorekeep.functions.times import local_date, local_midnight, message_time, safe_time
from lorekeep.operators.messages import is_day_message
from lorekeep.schemas import DEFAULTS, Settings


def plan_ranges(scopes: DataFrame) -> DataFrame:
    """Forward and backward range of one run per scope.

    ``scopes``: ``covered_since, until, run_start, initial_start, since, until_arg``; ``until`` is null without a cursor.
    Adds ``forward_from, forward_to, backward_from, backward_to, record``.
    """
    start, has = F.col("run_start"), F.col("until").isNotNull()
    frm = F.coalesce("until", "initial_start")
    covered = F.when(has, F.coalesce("covered_since", "until")).otherwise(F.col("initial_start"))
    x, y = F.col("since"), F.least("until_arg", "run_start")
    open_end = F.col("until_arg").isNull()
    forward = frm < start
    back = F.coalesce(F.when(open_end, x < covered).otherwise(x < y), F.lit(False))
    return scopes.select(
        "*", F.when(forward, frm).alias("forward_from"), F.when(forward, start).alias("forward_to"),
        F.when(back, x).alias("backward_from"), F.when(back, F.when(open_end, covered).otherwise(y)).alias("backward_to"),
        (back & (open_end | ((y >= covered) & (x < covered)))).alias("record"),
    )


def next_cursor(frm: Column, run_start: Column, overlap_secs: int = DEFAULTS.overlap_secs) -> Column:
    """Kept an overlap behind the run's start, never behind where the run began."""
    return F.greatest(run_start - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(overlap_secs)), frm)


def look_back(frm: Column, has_cursor: Column, days: int = DEFAULTS.calendar_overlap_days) -> Column:
    """Listing start that reaches behind a cursor, for rows that get their parts late."""
    return F.when(has_cursor, frm - F.make_dt_interval(F.lit(days))).otherwise(frm)


def folder_window(scopes: DataFrame) -> DataFrame:
    """Window and next coverage of a folder: ``stored, run_start, initial_days, since, until_arg``."""
    base = F.coalesce("stored", F.col("run_start") - F.make_dt_interval(F.col("initial_days")))
    x, y = F.col("since"), F.col("until_arg")
    both, longer = x.isNotNull() & y.isNotNull(), x.isNotNull() & y.isNull() & (x < base)
    return scopes.select(
        "*", F.when(both | longer, x).otherwise(base).alias("window_from"), F.when(both, y).alias("window_until"),
        F.when(longer, x).when(both & (y >= base), F.least(base, x)).otherwise(base).alias("covered_since"),
    )


def in_window(modified: Column, frm: Column, until: Column) -> Column:
    """A file without a time cannot be placed, so it is in scope."""
    return modified.isNull() | ((modified >= frm) & (until.isNull() | (modified < until)))


def extend(covered: Column, frm: Column, to: Column) -> Column:
    """Coverage start after a window: moved back only by a window that touches the covered interval."""
    return F.when(covered.isNull() | ((to >= covered) & (frm < covered)), frm).otherwise(covered)


def fold(cursors: DataFrame) -> DataFrame:
    """Coverage per account and source over its scopes ``(account_id, source, covered_since, covered_until)``: the
    latest start and the earliest end hold for every scope."""
    return cursors.groupBy("account_id", "source").agg(F.max("covered_since").alias("covered_since"), F.min("covered_until").alias("covered_until"))


def chat_scopes(cursors: DataFrame) -> DataFrame:
    """Conversation cursors as coverage scopes."""
    return cursors.where(F.col("key").startswith("conv:")).select(
        "account_id", F.lit("slack").alias("source"), safe_time(jsonx.get("value", "covered_since")).alias("covered_since"),
        F.when(jsonx.get("value", "oldest").isNotNull(), message_time(jsonx.get("value", "oldest"))).alias("covered_until"))


def backfill_windows(ranges: DataFrame, tz: str, days: int = DEFAULTS.window_days) -> DataFrame:
    """Windows of a backward range ``(scope, backward_from, backward_to)``, newest first, starting at local midnights.

    A calendar shift, so that a clock change cannot move the alignment.
    """
    last = local_date(F.col("backward_to"), tz)
    n = F.greatest(F.ceil(F.datediff(last, local_date(F.col("backward_from"), tz)) / days).cast("int"), F.lit(0))
    rows = ranges.where(F.col("backward_from") < F.col("backward_to")).select(
        "*", last.alias("_last"), F.explode(F.sequence(F.lit(0), n)).alias("no"))
    edge = local_midnight(F.date_sub("_last", F.col("no") * days), tz)
    prior = local_midnight(F.date_sub("_last", (F.col("no") + 1) * days), tz)
    end = F.when(F.col("no") == 0, F.col("backward_to")).otherwise(edge)
    out = rows.withColumn("window_to", end).withColumn("window_from", F.greatest(prior, F.col("backward_from")))
    return out.where(F.col("window_to") > F.col("window_from")).drop("_last")


def union_range(ranges: DataFrame) -> DataFrame:
    return ranges.agg(F.min("backward_from").alias("from"), F.max("backward_to").alias("to"))


def day_entries(messages: DataFrame, state: DataFrame, tz: str) -> DataFrame:
    """Day entries of fetched messages ``(channel, ts, at, …)``: only messages past the stored mark of their day count.

    ``state(source_id, last_ts)``. Returns ``source_id, day, created_at, first_ts, last_ts, messages``.
    """
    m = messages.where(is_day_message()).withColumn("day", local_date(F.col("at"), tz))
    m = m.withColumn("source_id", F.concat("channel", F.lit(":day:"), F.col("day").cast("string")))
    s = state.select("source_id", message_time(F.col("last_ts")).alias("_mark"))
    fresh = m.join(s, "source_id", "left").where(F.col("_mark").isNull() | (F.col("at") > F.col("_mark")))
    g = fresh.groupBy("source_id", "day").agg(F.min_by("ts", "at").alias("first_ts"), F.max_by("ts", "at").alias("last_ts"), F.count(F.lit(1)).alias("messages"))
    return g.withColumn("created_at", local_midnight(F.col("day"), tz))


def high_water(messages: DataFrame, state: DataFrame, key: str = "source_id") -> DataFrame:
    """Messages past the stored mark of their entry; earlier ones wait for a full refetch."""
    s = state.select(key, message_time(F.col("last_ts")).alias("_mark"))
    return messages.join(s, key, "left").where(F.col("_mark").isNull() | (F.col("at") > F.col("_mark"))).drop("_mark")


def discover_threads(parents: DataFrame, state: DataFrame, wanted: Column) -> DataFrame:
    """Threads to fetch among thread parents ``(channel, ts, thread_ts, latest_reply, reply_count, …)``.

    ``state(source_id, last_ts, exists)``. Adds ``reason``: new_thread, new_replies, or null for one that is up to date.
    """
    p = parents.where((F.col("thread_ts").isNull() | (F.col("thread_ts") == F.col("ts"))) & wanted)
    p = p.select(F.concat_ws(":", "channel", "ts").alias("source_id"), F.coalesce("latest_reply", "ts").alias("latest"))
    j = p.join(state.select("source_id", "last_ts", "exists"), "source_id", "left")
    exists = F.coalesce("exists", F.lit(False))
    needed = ~exists | F.col("last_ts").isNull() | (message_time(F.col("latest")) > message_time(F.col("last_ts")))
    return j.select("source_id", "latest", F.when(needed & exists, "new_replies").when(needed, "new_thread").alias("reason"))


def watched_threads(cursors: DataFrame, entries: DataFrame, now: datetime, deep: bool, settings: Settings = DEFAULTS) -> DataFrame:
    """``action`` per watched thread: forget the old ones, fetch the recent ones that are entries, else none."""
    last = message_time(jsonx.get("value", "last_activity"))
    age = F.lit(now).cast("timestamp") - last
    horizon = settings.thread_watch_days if deep else settings.thread_hot_days
    w = cursors.where(F.col("key").startswith("watch:") & jsonx.get("value", "last_activity").isNotNull())
    w = w.select("account_id", "key", F.expr("substring(key, 7)").alias("source_id"), age.alias("age"))
    known = entries.select("source_id").distinct().withColumn("_k", F.lit(True))
    action = F.when(F.col("age") > F.make_dt_interval(F.lit(settings.thread_watch_days)), "forget").when(
        (F.col("age") <= F.make_dt_interval(F.lit(horizon))) & F.col("_k"), "fetch").otherwise("none")
    return w.join(known, "source_id", "left").select("account_id", "key", "source_id", action.alias("action"))


def dormant(last_activity: Column, run_start: Column, is_full: Column, days: int = DEFAULTS.dormant_days) -> Column:
    """A scope without activity for too long; full channels never are."""
    return ~is_full & F.coalesce(run_start - last_activity > F.make_dt_interval(F.lit(days)), F.lit(False))
