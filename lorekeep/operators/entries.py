"""Entry queries: filters, orders, pages of results, semi/anti joins, bulk assembly and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import jsonx
from lorekeep.functions.times import activity_at, entry_date
from lorekeep.operators.skew import first_by
from lorekeep.schemas import ITEM_PROMPTS


@dataclass(frozen=True)
class EntryFilter:
    """An AND of optional conditions; an empty list means no condition."""

    accounts: Sequence[str] = ()
    source_kinds: Sequence[str] = ()
    entry_uids: Sequence[str] = ()
    raw_status: Sequence[str] = ()
    summary_status: Sequence[str] = ()
    since: datetime | None = None
    until: datetime | None = None
    channel: str | None = None
    metadata_text: tuple[str, str] | None = None
    after_id: int | None = None

    def predicate(self, at: Column | None = None) -> Column:
        when = entry_date() if at is None else at
        conds: list[Column] = []
        for name, values in (
            ("account_id", self.accounts), ("source_kind", self.source_kinds), ("entry_uid", self.entry_uids),
            ("raw_status", self.raw_status), ("summary_status", self.summary_status),
        ):
            if values:
                conds.append(F.col(name).isin(*values))
        if self.since is not None:
            conds.append(when >= F.lit(self.since))
        if self.until is not None:
            conds.append(when < F.lit(self.until))
        if self.channel is not None:
            name = self.channel.lstrip("#")
            conds.append((jsonx.get("metadata", "channel_name") == name) | (jsonx.get("metadata", "channel_id") == name))
        if self.metadata_text is not None:
            key, value = self.metadata_text
            conds.append(jsonx.get("metadata", key) == value)
        if self.after_id is not None:
            conds.append(F.col("id") > self.after_id)
        out = F.lit(True)
        for c in conds:
            out = out & c
        return out


def clamp(limit: int, low: int, high: int) -> int:
    return max(low, min(limit, high))


def list_entries(entries: DataFrame, f: EntryFilter, limit: int | None = None, ascending_id: bool = False) -> DataFrame:
    """Matching entries, newest first with the id as tie-break, or by ascending id."""
    out = entries.where(f.predicate())
    out = out.orderBy("id") if ascending_id else out.orderBy(entry_date().desc(), F.col("id").desc())
    return out.limit(limit) if limit is not None else out


def with_summary(entries: DataFrame, summaries: DataFrame, model: str | None = None, provider: str | None = None) -> DataFrame:
    """Entries that have a summary, optionally by a model or provider (semi join)."""
    s = summaries
    if model is not None:
        s = s.where(F.col("model") == model)
    if provider is not None:
        s = s.where(F.col("provider") == provider)
    return entries.join(s.select(F.col("entry_id").alias("id")), "id", "left_semi")


def without_summary(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    return entries.join(summaries.select(F.col("entry_id").alias("id")), "id", "left_anti")


def with_labels(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``account_label``: the label, or the id for an account without one (or an unknown account)."""
    a = accounts.select(F.col("id").alias("account_id"), F.col("label").alias("_label"))
    return df.join(a, "account_id", "left").withColumn("account_label", F.coalesce("_label", "account_id")).drop("_label")


def with_cite_url(entries: DataFrame, raw_objects: DataFrame) -> DataFrame:
    """Adds ``cite_url``: the source URL, else the transcript URL, else the first raw path."""
    first = first_by(raw_objects.select(F.col("entry_id").alias("id"), "role", "seq", "path"), ["id"], F.struct("role", "seq"))
    return entries.join(first.select("id", "path"), "id", "left").withColumn(
        "cite_url", F.coalesce("source_url", jsonx.get("metadata", "transcript_url"), "path")
    ).drop("path")


def recent(
    entries: DataFrame, sections: DataFrame, summaries: DataFrame, limit: int, since: datetime | None = None,
    until: datetime | None = None, kinds: Sequence[str] = ("overview", "decisions", "action_items"), excerpt: int = 400,
) -> DataFrame:
    """Newest entries by activity with their generated sections, or an excerpt of the details when unsummarized.

    One entry more than ``limit`` is read: ``truncated`` tells whether there are more.
    """
    f = EntryFilter(since=since, until=until)
    probe = entries.where(f.predicate(activity_at())).withColumn("activity_at", activity_at())
    probe = probe.orderBy(F.col("activity_at").desc(), F.col("id").desc()).limit(limit + 1)
    more = probe.agg((F.count(F.lit(1)) > limit).alias("m")).scalar()
    top = probe.orderBy(F.col("activity_at").desc(), F.col("id").desc()).limit(limit).withColumn("truncated", more)
    s = summaries.select(F.col("entry_id").alias("id"), "prompt_version", F.lit(True).alias("_has"))
    sec = sections.join(top.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    parts = sec.groupBy(F.col("entry_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(F.when((F.col("origin") == "generated") & F.col("kind").isin(*kinds), F.struct("position", "kind", "text")))
        ).alias("_gen"),
        F.min(F.when(F.col("kind") == "details", F.substring("text", 1, excerpt))).alias("_details"),
    )
    done = (F.col("summary_status") == "done") & F.coalesce("_has", F.lit(False))
    return top.join(s, "id", "left").join(parts, "id", "left").select(
        *top.columns,
        done.alias("summarized"),
        (done & F.coalesce(F.col("prompt_version").isin(*ITEM_PROMPTS), F.lit(False))).alias("items_available"),
        F.coalesce(F.transform("_gen", lambda g: F.struct(g["kind"], g["text"])), F.array()).alias("sections"),
        F.when(~done, F.col("_details")).alias("details_excerpt"),
    )


def show(entries: DataFrame, sections: DataFrame, summaries: DataFrame, raw_objects: DataFrame) -> DataFrame:
    """Entries with their sections (at most one per kind), summary and raw totals, for bulk output."""
    sec = sections.groupBy(F.col("entry_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("position", "kind", "origin", "text"))).alias("sections")
    )
    raw = raw_objects.groupBy(F.col("entry_id").alias("id")).agg(F.count(F.lit(1)).alias("raw_segments"), F.sum("size").alias("raw_size"))
    s = summaries.select(F.col("entry_id").alias("id"), "generator_kind", "provider", "model")
    return entries.join(sec, "id", "left").join(s, "id", "left").join(raw, "id", "left").na.fill(0, ["raw_segments", "raw_size"])


def review(entries: DataFrame, sections: DataFrame, lines: int | None) -> DataFrame:
    """Generated sections beside the first ``lines`` lines of the extracted source text, with its line count."""
    src = F.when((F.col("origin") == "extracted") & (F.col("kind") == "details"), F.col("text"))
    g = sections.groupBy(F.col("entry_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("origin") == "generated", F.struct("position", "kind", "text")))).alias("generated"),
        F.min(src).alias("_text"),
    )
    split = F.split(F.regexp_replace("_text", r"\n\z", ""), "\n")
    total = F.when(F.coalesce("_text", F.lit("")) == "", 0).otherwise(F.size(split))
    shown = F.col("_text") if lines is None else F.array_join(F.slice(split, 1, lines), "\n")
    return entries.join(g, "id", "left").select(
        *entries.columns, "generated", F.coalesce(shown, F.lit("")).alias("source_text"), total.alias("source_lines")
    )


def summarization_candidates(entries: DataFrame, max_attempts: int) -> DataFrame:
    due = F.col("summary_status").isin("pending", "failed") & (F.col("summary_attempts") < max_attempts)
    return entries.where(due).orderBy(entry_date().desc(), F.col("id").desc())


def legacy_hashes(summaries: DataFrame) -> DataFrame:
    """Model-written summaries whose input hash has neither the current prefix nor the unknown mark."""
    h = F.col("input_hash")
    return summaries.where((F.col("generator_kind") != "source_native") & (h != "") & ~h.startswith("b2:"))


def cache_get(cache: DataFrame, now: datetime, stale_ok: bool = False) -> DataFrame:
    return cache if stale_ok else cache.where(F.col("expires_at") > F.lit(now))


def source_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("account_id", "source_kind").agg(
        F.count(F.lit(1)).alias("count"), F.min(entry_date()).alias("oldest"), F.max(entry_date()).alias("newest")
    )


def status_counts(entries: DataFrame, column: str) -> DataFrame:
    return entries.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def model_counts(summaries: DataFrame) -> DataFrame:
    label = F.concat_ws("/", "generator_kind", "provider", "model").alias("label")
    return summaries.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "label")


def global_counts(**tables: DataFrame) -> DataFrame:
    """One row per table name with its row count."""
    rows = [df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(n).alias("name"), "count") for n, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def open_issues(issues: DataFrame) -> DataFrame:
    """Open issues: errors, warnings, the rest; last seen first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.where(F.col("resolved_at").isNull()).withColumn("rank", rank).orderBy("rank", F.col("last_seen_at").desc(), "id")


def runs(table: DataFrame, command_prefix: str | None, trigger: str | None, limit: int) -> DataFrame:
    out = table
    if command_prefix:
        out = out.where(F.col("command").startswith(command_prefix))
    if trigger:
        out = out.where(F.col("trigger") == trigger)
    return out.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


def cursors(table: DataFrame, account: str | None, source_kind: str | None, prefix: str) -> DataFrame:
    cond = F.col("key").startswith(prefix)
    if account is not None:
        cond = cond & (F.col("account_id") == account)
    if source_kind is not None:
        cond = cond & (F.col("source_kind") == source_kind)
    return table.where(cond)
