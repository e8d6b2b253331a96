"""Document links: discovery, first reference, due work, outcomes, listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions import urls as U
from lorekeep.functions.times import message_time
from lorekeep.operators.skew import first_by, global_prefix_sum
from lorekeep.schemas import LINK_BACKOFF_DAYS


def discover(messages: DataFrame) -> DataFrame:
    """Document links of messages ``(account_id, entry_id, message_id, ts, urls)``, with their position in the message."""
    rows = messages.select("account_id", "entry_id", "message_id", "ts", F.posexplode("urls").alias("pos", "u"))
    linked = U.with_document_link(rows, "u")
    return linked.select(
        "account_id", "entry_id", "message_id", "ts", "pos", F.col("link_kind").alias("source_kind"), "link_key",
        F.col("link_url").alias("url"), F.col("link_host").alias("host"),
    )


def first_references(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per account and key: the first reference by entry, message time and position; known keys are left out."""
    order = F.struct("entry_id", message_time(F.col("ts")), "message_id", "pos")
    first = first_by(found, ["account_id", "link_key"], order)
    return first if known is None else first.join(known.select("account_id", "link_key"), ["account_id", "link_key"], "left_anti")


def record(table: DataFrame, found: DataFrame, now: datetime) -> DataFrame:
    """Next link table: new keys appended as pending, existing rows left as they are."""
    new = first_references(found, table).select(
        "account_id", "link_key", "source_kind", "url", "host", F.col("entry_id").alias("first_entry_id"),
        F.lit(now).cast("timestamp").alias("first_seen_at"), F.lit("pending").alias("status"), F.lit(None).cast("long").alias("entry_id"),
        F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"),
    )
    return table.unionByName(new.select(*table.columns))


def is_due(now: datetime) -> Column:
    """Pending and not delayed, or unavailable with its delay over."""
    t = F.lit(now).cast("timestamp")
    passed = F.col("next_attempt_at") <= t
    pending = (F.col("status") == "pending") & (F.col("next_attempt_at").isNull() | passed)
    return pending | ((F.col("status") == "unavailable") & F.coalesce(passed, F.lit(False)))


def host_allowed(host: Column, patterns: Sequence[str]) -> Column:
    return F.lit(True) if not patterns else X.glob_match(host, patterns)


def select_due(links: DataFrame, accounts: DataFrame, now: datetime, max_per_run: int, hosts: Sequence[str] = ()) -> DataFrame:
    """Due links of enabled chat accounts in account order, newest first; ``selected`` marks the first ``max_per_run``.

    ``accounts(id, kind, status, config)``: the kinds an account ingests come from its ``ingest_links``. The rank over
    all accounts is a running count by account and day, so no task sees all links.
    """
    kinds = F.from_json(F.get_json_object("config", "$.ingest_links"), "array<string>")
    on = accounts.where((F.col("kind") == "slack") & (F.col("status") != "disabled")).select(F.col("id").alias("account_id"), kinds.alias("_kinds"))
    due = links.where(is_due(now) & host_allowed(F.col("host"), hosts)).join(on, "account_id")
    due = due.where(F.array_contains("_kinds", F.col("source_kind"))).drop("_kinds")
    day = -F.unix_date(F.to_date("first_seen_at"))
    order = [F.col("first_seen_at").desc(), F.col("link_key")]
    ranked = global_prefix_sum(due, [F.col("account_id"), day], order, F.lit(1), "rank")
    return ranked.withColumn("selected", F.col("rank") <= max_per_run)


def stage_counts(selected: DataFrame) -> DataFrame:
    return selected.agg(F.count(F.lit(1)).alias("due"), F.count_if(~F.col("selected")).alias("deferred_by_limit"))


def backoff_days(attempts: Column) -> Column:
    out = F.lit(LINK_BACKOFF_DAYS[-1])
    for n in range(len(LINK_BACKOFF_DAYS) - 1, 0, -1):
        out = F.when(attempts <= n, LINK_BACKOFF_DAYS[n - 1]).otherwise(out)
    return out


def apply_outcomes(links: DataFrame, outcomes: DataFrame, now: datetime, max_attempts: int) -> DataFrame:
    """Next link table. ``outcomes``: ``account_id, link_key, outcome, outcome_entry, error``, one per link."""
    o = F.col("outcome")
    t = F.lit(now).cast("timestamp")
    tries = F.col("attempts") + 1
    given_up = tries >= max_attempts
    ended = o.isin("ingested", "duplicate", "not_applicable")
    j = links.join(outcomes, ["account_id", "link_key"], "left")
    status = F.when(ended, o).when(o == "unavailable", F.when(given_up, "abandoned").otherwise("unavailable")).otherwise(F.col("status"))
    entry = F.when(o.isin("ingested", "duplicate"), F.col("outcome_entry")).otherwise(F.col("entry_id"))
    attempts = F.when(o == "unavailable", tries).otherwise(F.col("attempts"))
    wait = t + F.make_dt_interval(backoff_days(tries))
    again = F.when(ended | ((o == "unavailable") & given_up), F.lit(None)).when(o == "unavailable", wait).otherwise(F.col("next_attempt_at"))
    error = F.when(o.isin("ingested", "duplicate"), F.lit(None)).when(o.isNotNull(), F.col("error")).otherwise(F.col("last_error"))
    new = {"status": status, "entry_id": entry, "attempts": attempts, "next_attempt_at": again, "last_error": error}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in links.columns])


def outcome_counts(links: DataFrame, outcomes: DataFrame, max_attempts: int) -> DataFrame:
    """Counters of a link run; a failure that ends the tries counts as abandoned."""
    o = F.col("outcome")
    ended = (o == "unavailable") & (F.col("attempts") + 1 >= max_attempts)
    return links.join(outcomes, ["account_id", "link_key"]).groupBy(F.when(ended, "abandoned").otherwise(o).alias("outcome")).agg(
        F.count(F.lit(1)).alias("count")
    )


def retry(links: DataFrame) -> DataFrame:
    """Unavailable and abandoned links go back to pending with their tries reset."""
    back = F.col("status").isin("unavailable", "abandoned")
    new = {"status": F.lit("pending"), "attempts": F.lit(0), "next_attempt_at": F.lit(None).cast("timestamp")}
    return links.select(*[F.when(back, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in links.columns])


def status_counts(links: DataFrame, account: str | None = None) -> DataFrame:
    rows = links if account is None else links.where(F.col("account_id") == account)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def scan(found: DataFrame, table: DataFrame, entries: DataFrame) -> DataFrame:
    """Links of stored conversations with their state: ``status`` is ``new`` for a link the table does not hold.

    The title and id shown are those of the reference the table keeps; ``entries(id, entry_uid, title)``.
    """
    first = first_references(found)
    t = table.select(
        "account_id", "link_key", F.col("status").alias("_status"), F.col("first_entry_id").alias("_first"),
        F.col("entry_id").alias("_entry"), "last_error", "next_attempt_at",
    )
    ref = entries.select(F.col("id").alias("_from"), F.col("entry_uid").alias("from_uid"), F.col("title").alias("from_title"))
    made = entries.select(F.col("id").alias("_entry"), F.col("entry_uid").alias("made_uid"))
    j = first.join(t, ["account_id", "link_key"], "left").withColumn("_from", F.coalesce("_first", "entry_id"))
    return j.join(ref, "_from", "left").join(made, "_entry", "left").select(
        "account_id", "link_key", "source_kind", "url", "host", F.coalesce("_status", F.lit("new")).alias("status"),
        message_time(F.col("ts")).alias("message_at"), "from_uid", "from_title", F.col("made_uid").alias("entry_uid"), "last_error", "next_attempt_at",
    )


def listing(scanned: DataFrame, limit: int) -> DataFrame:
    """Newest message first, URL as tie-break, with the number of links that were not listed."""
    rest = scanned.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("n")).scalar()
    return scanned.orderBy(F.col("message_at").desc(), "url", "link_key", "account_id").limit(limit).withColumn("not_listed", rest)


def with_provenance(documents: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds where a document was found to its metadata: excerpt, and entry id, title and URL of the first reference.

    ``documents(account_id, link_key, metadata)``; ``links`` has ``excerpt`` and ``first_entry_id``.
    """
    from lorekeep.functions.jsonx import overlay

    e = entries.select(
        F.col("id").alias("first_entry_id"),
        F.struct("entry_uid", "title", F.col("source_url").alias("url")).alias("discovered_via"),
    )
    l = links.select("account_id", "link_key", "excerpt", "first_entry_id").join(e, "first_entry_id", "left")
    extra = F.to_json(F.struct(F.when(F.trim("excerpt") != "", F.col("excerpt")).alias("link_context"), "discovered_via"))
    j = documents.join(l, ["account_id", "link_key"], "left")
    return j.withColumn("metadata", overlay(F.col("metadata"), extra)).select(*documents.columns)


def waiting_for_account(links: DataFrame, accounts: DataFrame) -> DataFrame:
    """Pending links of kinds their account ingests while no active account can read them, and abandoned links."""
    kinds = F.from_json(F.get_json_object("config", "$.ingest_links"), "array<string>")
    chat = accounts.where(F.col("kind") == "slack").select(F.col("id").alias("account_id"), kinds.alias("_kinds"))
    have = accounts.where(F.col("status") == "active").agg(F.collect_set("kind").alias("h")).select("h").scalar()
    need = F.when(F.col("source_kind") == "microsoft.file", "microsoft").otherwise("google")
    j = links.join(chat, "account_id").withColumn("need", need)
    wait = (F.col("status") == "pending") & F.array_contains("_kinds", F.col("source_kind")) & ~F.array_contains(have, F.col("need"))
    return j.groupBy("need").agg(F.count_if(wait).alias("waiting"), F.count_if(F.col("status") == "abandoned").alias("abandoned"))


