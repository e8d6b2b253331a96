"""Table maintenance as pure functions ``(current, incoming, now) -> next``: entries, raw data, sections, queues, issues."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import jsonx, text as X
from lorekeep.operators.skew import first_by, joined_text, prefix_sum
from lorekeep.schemas import DEFAULTS, ORIGIN_RANK, SECTION_POSITION, Settings

KEY = ["account_id", "source_kind", "source_id"]


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def last_per_key(batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The last version of every key of a batch."""
    return first_by(batch, keys, F.col(version), descending=True)


def entry_uid() -> Column:
    """A stable identifier of an entry from its natural key."""
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat_ws("\u0001", *KEY), 256), 1, 26))


def new_ids(current: DataFrame, fresh: DataFrame, keys: Sequence[str], id_col: str = "id", top: int | None = None) -> DataFrame:
    """Ids for new keys, following ``top`` or the highest one: positions are counted bucket by bucket of the key's hash."""
    top = current.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("m")).scalar() if top is None else F.lit(top)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1024))
    n = prefix_sum(fresh.withColumn("_g", F.lit(0)), ["_g"], [bucket], [F.col(k) for k in keys], F.lit(1), "_n")
    return n.withColumn(id_col, top + F.col("_n")).drop("_g", "_n")


def upsert_entries(current: DataFrame, incoming: DataFrame, now: datetime, top: int | None = None) -> DataFrame:
    """Next entries by natural key. Dates and URL only fill in, the first origin stays, other given values win.

    ``incoming`` has the key and ``source_url, title, source_created_at, source_updated_at, metadata, origin``; a null
    title on a new entry becomes its source id. Duplicate keys in a batch must be reduced first (``last_per_key``). New ids
    follow ``top``, for a ``current`` that is a part of the table.
    """
    t = _at(now)
    values = ["source_url", "title", "source_created_at", "source_updated_at", "metadata", "origin"]
    inc = incoming.select(*KEY, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_in"))
    fresh = new_ids(current, incoming.join(current.select(*KEY), KEY, "left_anti").select(*KEY), KEY, top=top).withColumnRenamed("id", "_id")
    j = current.withColumn("_old", F.lit(True)).join(inc, KEY, "full_outer").join(fresh, KEY, "left")
    new, hit = F.col("_old").isNull(), F.col("_in").isNotNull()
    out = {
        "id": F.coalesce("id", "_id"),
        "entry_uid": F.coalesce("entry_uid", entry_uid()),
        "title": F.coalesce("_title", "title", "source_id"),
        "source_url": F.coalesce("_source_url", "source_url"),
        "source_created_at": F.coalesce("_source_created_at", "source_created_at"),
        "source_updated_at": F.coalesce("_source_updated_at", "source_updated_at"),
        "metadata": F.coalesce("_metadata", "metadata", F.lit("{}")),
        "origin": F.coalesce("origin", "_origin"),
        "ingested_at": F.coalesce("ingested_at", t),
        "updated_at": F.when(hit, t).otherwise(F.col("updated_at")),
        "raw_status": F.when(new, F.coalesce("raw_status", F.lit("missing"))).otherwise(F.col("raw_status")),
        "summary_status": F.when(new, F.coalesce("summary_status", F.lit("none"))).otherwise(F.col("summary_status")),
        "summary_attempts": F.coalesce("summary_attempts", F.lit(0)),
    }
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in current.columns])


def entry_outcomes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an upsert does with each incoming key: created or updated."""
    c = current.select(*KEY, F.lit(True).alias("_old"))
    return incoming.join(c, KEY, "left").select(*KEY, F.when(F.col("_old").isNull(), "created").otherwise("updated").alias("outcome"))


# -- raw data -------------------------------------------------------------------------------------------------


def next_segments(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Numbers new segments after the last one of their entry and role; ``batch`` is ordered by ``arrival``."""
    last = current.groupBy("entry_id", "role").agg(F.max("seq").alias("_last"))
    n = prefix_sum(batch, ["entry_id", "role"], [F.floor(F.col("arrival") / 1000)], [F.col("arrival")], F.lit(1), "_n")
    j = n.join(last, ["entry_id", "role"], "left")
    return j.withColumn("seq", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("_n") - 1).drop("_n", "_last")


def write_raw(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next raw objects and the paths that became stale.

    ``batch`` carries ``mode``: a replace drops all old segments of the entry, an append adds after them.
    """
    replaced = batch.where(F.col("mode") == "replace").select("entry_id").distinct()
    kept = current.join(replaced, "entry_id", "left_anti")
    added = next_segments(kept, batch).select(*current.columns)
    stale = current.join(replaced, "entry_id", "left_semi").select("path").join(added.select("path"), "path", "left_anti")
    return kept.unionByName(added), stale


def raw_hashes(raw: DataFrame) -> DataFrame:
    """``(entry_id, raw_hash)``: hash over the segment hashes in role and number order.

    The hash is one chain per entry: its rows are sorted (and spilled) by Spark and pass one task in constant memory.
    """
    from lorekeep.sources.streams import chain_hashes

    return chain_hashes(raw)


def assemble_segments(raw: DataFrame) -> DataFrame:
    """``(entry_id, role, n_pieces, text)``: segments joined by line breaks in order."""
    return joined_text(raw, ["entry_id", "role"], ["seq"], "payload")


def contiguity(raw: DataFrame) -> DataFrame:
    """Whether segment numbers per entry and role run from 0 without a gap or repeat."""
    return raw.groupBy("entry_id", "role").agg(
        ((F.min("seq") == 0) & (F.max("seq") + 1 == F.count(F.lit(1))) & (F.min("seq").isNotNull())).alias("contiguous"),
        F.count(F.lit(1)).alias("segments"),
    )


def raw_consistency(entries: DataFrame, raw: DataFrame, files: DataFrame) -> DataFrame:
    """Entries with raw data whose segments are missing, not contiguous or changed. ``files(path, sha256)`` is what exists."""
    f = files.select("path", F.col("sha256").alias("_found"))
    per = raw.join(f, "path", "left").groupBy("entry_id", "role").agg(
        F.count_if(F.col("_found").isNull()).alias("missing"),
        F.count_if(F.col("_found") != F.col("sha256")).alias("changed"),
        (F.max("seq") + 1 != F.count(F.lit(1))).alias("gap"),
    )
    g = per.groupBy("entry_id").agg(F.sum("missing").alias("missing"), F.sum("changed").alias("changed"), F.max("gap").alias("gap"))
    j = entries.where(F.col("raw_status") == "present").select(F.col("id").alias("entry_id")).join(g, "entry_id", "left")
    problem = (
        F.when(F.col("missing").isNull(), "no segments").when(F.col("missing") > 0, "missing").when(F.col("gap"), "not contiguous")
        .when(F.col("changed") > 0, "changed")
    )
    return j.select("entry_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def orphans(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Files no catalog row refers to."""
    return files.select("path").join(raw.select("path"), "path", "left_anti")


# -- sections -------------------------------------------------------------------------------------------------


def origin_rank(c: Column) -> Column:
    out = F.lit(0)
    for name, r in ORIGIN_RANK.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def position(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, p in SECTION_POSITION.items():
        out = F.when(c == name, p).otherwise(out)
    return out


def write_sections(current: DataFrame, drafts: DataFrame, origin: str, replace: bool) -> DataFrame:
    """Next sections after writing drafts of one origin: never over a higher origin, an equal one is overwritten.

    With ``replace`` the sections of that origin of the touched entries go first. ``drafts(entry_id, kind, text)``,
    later ones (``version``) win; blank ones are ignored. A table has one section of an entry and kind.
    """
    # Rows of a higher origin stay whatever the drafts say, and keep drafts of their kind out: their texts are not moved.
    ranked = origin_rank(F.col("origin"))
    above = ranked > ORIGIN_RANK[origin]
    columns = ["entry_id", "kind", "origin", "text"]
    higher = current.where(above).select(*columns)
    base = current.where(~above)
    if replace:
        touched = drafts.select("entry_id").distinct().withColumn("_t", F.lit(True))
        base = base.join(touched, "entry_id", "left").where(~(F.coalesce("_t", F.lit(False)) & (F.col("origin") == origin))).drop("_t")
    old = base.select(*columns, F.lit(-1).cast("long").alias("version"))
    new = drafts.where(F.trim("text") != "").select("entry_id", "kind", F.lit(origin).alias("origin"), "text", F.col("version").cast("long").alias("version"))
    open_ = old.unionByName(new).join(higher.select("entry_id", "kind").distinct(), ["entry_id", "kind"], "left_anti")
    win = first_by(open_, ["entry_id", "kind"], F.struct(ranked, "version"), descending=True).select(*columns)
    return higher.unionByName(win).select("entry_id", "kind", "origin", position(F.col("kind")).alias("position"), "text")


# -- summaries ------------------------------------------------------------------------------------------------


def commit_summaries(tables: dict[str, DataFrame], done: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Next ``entries, sections, items, summaries, ledger`` after finished summaries, to be published as one version.

    ``done``: ``entry_id, drafts array<struct<kind,text>>, items`` (item rows), summary columns and usage.
    """
    t = _at(now)
    ids = done.select("entry_id")
    drafts = done.select("entry_id", F.posexplode("drafts").alias("version", "d")).select("entry_id", "version", "d.kind", "d.text")
    sections = write_sections(tables["sections"], drafts, "generated", replace=True)
    items = tables["items"].join(ids, "entry_id", "left_anti").unionByName(
        done.select("entry_id", F.posexplode("items").alias("ordinal", "i")).select("entry_id", "ordinal", "i.*").select(*tables["items"].columns)
    )
    native = F.col("generator_kind") == "source_native"
    rows = done.withColumns({"prompt_version": F.when(~native, F.col("prompt_version")), "generated_at": t})
    summaries = tables["summaries"].join(ids, "entry_id", "left_anti").unionByName(rows.select(*tables["summaries"].columns))
    e = tables["entries"].join(ids.select(F.col("entry_id").alias("id"), F.lit(True).alias("_d")), "id", "left")
    hit = F.col("_d").isNotNull()
    new = {"summary_status": F.lit("done"), "summary_attempts": F.lit(0), "updated_at": t}
    entries = e.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tables["entries"].columns])
    used = done.withColumns({"at": t, "outcome": F.lit("ok")}).select(*tables["ledger"].columns)
    return {"entries": entries, "sections": sections, "items": items, "summaries": summaries, "ledger": tables["ledger"].unionByName(used)}


def record_failures(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed attempts counted. ``failed(id, attempts, error)``, one row per entry."""
    j = entries.join(failed.select("id", F.col("attempts").alias("_n"), F.col("error").alias("_e")), "id", "left")
    hit = F.col("_n").isNotNull()
    new = {"summary_status": F.lit("failed"), "summary_attempts": F.col("summary_attempts") + F.col("_n"), "summary_error": F.col("_e")}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in entries.columns])


def reset_attempts(entries: DataFrame, where: Column) -> DataFrame:
    hit = where & (F.col("summary_status") == "failed")
    return entries.withColumn("summary_attempts", F.when(hit, 0).otherwise(F.col("summary_attempts")))


# -- queue, cursors, issues, runs -----------------------------------------------------------------------------


def upsert_queue(current: DataFrame, enqueue: DataFrame, dequeue: DataFrame, now: datetime) -> DataFrame:
    """Next queue: a known row only takes the new hint; finished rows leave.

    ``enqueue`` may name a key several times (several discovery paths): the first reason and the last hint by ``ord`` count.
    """
    g = enqueue.groupBy(*KEY).agg(F.min_by("reason", "ord").alias("_reason"), F.max_by("hint", "ord").alias("_hint"))
    j = current.join(g, KEY, "full_outer")
    out = {
        "reason": F.coalesce("reason", "_reason"), "hint": F.coalesce("_hint", "hint"), "enqueued_at": F.coalesce("enqueued_at", _at(now)),
        "attempts": F.coalesce("attempts", F.lit(0)),
    }
    nxt = j.select(*[out[c].alias(c) if c in out else F.col(c) for c in current.columns])
    return nxt.join(dequeue.select(*KEY), KEY, "left_anti")


def fetchable(queue: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Keys a drain may fetch; those that failed too often wait for a person."""
    return queue.where(F.col("attempts") < settings.queue_max_attempts)


def fetch_batches(queue: DataFrame, size: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Fetchable keys with ``batch``, the number of the commit they belong to: per account the oldest first, ``size`` together."""
    order = [F.col(c) for c in ("enqueued_at", "source_kind", "source_id")]
    n = prefix_sum(fetchable(queue, settings), ["account_id"], [F.to_date("enqueued_at")], order, F.lit(1), "_n")
    return n.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def queue_failures(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed fetches counted. ``failed(key, failures, error)``."""
    j = queue.join(failed.select(*KEY, F.col("failures").alias("_n"), F.col("error").alias("_e")), KEY, "left")
    new = {"attempts": F.col("attempts") + F.coalesce("_n", F.lit(0)), "last_error": F.coalesce("_e", "last_error")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def upsert_cursors(current: DataFrame, updates: DataFrame, now: datetime) -> DataFrame:
    """Next cursors: a value replaces, a null deletes. One update per key."""
    keys = ["account_id", "source_kind", "key"]
    u = updates.select(*keys, F.col("value").alias("_v"), F.lit(True).alias("_u"))
    j = current.join(u, keys, "full_outer").where(F.col("_u").isNull() | F.col("_v").isNotNull())
    out = {"value": F.coalesce("_v", "value"), "updated_at": F.when(F.col("_u").isNotNull(), _at(now)).otherwise(F.col("updated_at"))}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in current.columns])


def refresh_issues(current: DataFrame, findings: DataFrame, now: datetime) -> DataFrame:
    """Next issues: an open one is refreshed, others are opened. One finding per code, account and entry."""
    t = _at(now)
    keys = ["code", "account_id", "entry_id"]
    open_ = current.where(F.col("resolved_at").isNull())
    closed = current.where(F.col("resolved_at").isNotNull())
    f = findings.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("severity").alias("_sev"), F.col("message").alias("_msg"), F.lit(True).alias("_f"))
    same = (F.col("code") == F.col("_code")) & F.col("account_id").eqNullSafe(F.col("_account_id")) & F.col("entry_id").eqNullSafe(F.col("_entry_id"))
    j = open_.join(f, same, "full_outer")
    out = {
        "code": F.coalesce("code", "_code"),
        "account_id": F.when(F.col("code").isNull(), F.col("_account_id")).otherwise(F.col("account_id")),
        "entry_id": F.when(F.col("code").isNull(), F.col("_entry_id")).otherwise(F.col("entry_id")),
        "severity": F.coalesce("_sev", "severity"), "message": F.coalesce("_msg", "message"),
        "first_seen_at": F.coalesce("first_seen_at", t), "last_seen_at": F.when(F.col("_f").isNotNull(), t).otherwise(F.col("last_seen_at")),
    }
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in current.columns]).unionByName(closed)


def resolve_issues(current: DataFrame, code: str, now: datetime, account: str | None = None, unseen_since: datetime | None = None) -> DataFrame:
    """Resolves open issues by code, by prefix (a code that ends in a dot), or those a check did not see again."""
    hit = F.col("resolved_at").isNull() & (F.col("code").startswith(code) if code.endswith(".") or unseen_since else F.col("code") == code)
    if account is not None:
        hit = hit & F.coalesce(F.col("account_id") == account, F.lit(False))
    if unseen_since is not None:
        hit = hit & (F.col("last_seen_at") < _at(unseen_since))
    return current.withColumn("resolved_at", F.when(hit, _at(now)).otherwise(F.col("resolved_at")))


def close_stale_runs(runs: DataFrame, prefix: str, older_than: datetime) -> DataFrame:
    """Runs that never finished become interrupted."""
    hit = (F.col("status") == "running") & (F.col("started_at") < _at(older_than)) & F.col("command").startswith(prefix)
    return runs.withColumns({
        "status": F.when(hit, "interrupted").otherwise(F.col("status")),
        "error": F.when(hit, F.coalesce("error", F.lit("no end was recorded"))).otherwise(F.col("error")),
    })


# -- deletion -------------------------------------------------------------------------------------------------


def purge_account(tables: dict[str, DataFrame], account: str) -> dict[str, DataFrame]:
    """All tables without one account: by ``account_id``, or by ``entry_id`` where a table only knows the entry."""
    gone = tables["entries"].where(F.col("account_id") == account).select(F.col("id").alias("entry_id"))
    out = {}
    for name, df in tables.items():
        if "account_id" in df.columns:
            out[name] = df.where(~F.coalesce(F.col("account_id") == account, F.lit(False)))
        elif name == "accounts":
            out[name] = df.where(F.col("id") != account)
        else:
            out[name] = df.join(gone, "entry_id", "left_anti")
    return out


def delete_entries(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without some entries, and the raw paths to remove."""
    gone = ids.select("entry_id").distinct()
    out = {
        n: df.join(gone.withColumnRenamed("entry_id", "id"), "id", "left_anti") if n == "entries" else df.join(gone, "entry_id", "left_anti")
        for n, df in tables.items()
    }
    return out, tables["raw_objects"].join(gone, "entry_id", "left_semi").select("path")


# -- duplicates and outcomes ----------------------------------------------------------------------------------


def content_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(source_id, sha256)`` with the first other document of the same content.

    Copies meet through one row per content, never pairwise: the smallest two ids are enough to name another one.
    """
    g = docs.groupBy("sha256").agg(F.min("source_id").alias("_first"), F.max("source_id").alias("_last"), F.count(F.lit(1)).alias("copies"))
    second = docs.join(g.where(F.col("copies") > 1).select("sha256", "_first"), "sha256").where(F.col("source_id") != F.col("_first"))
    nxt = second.groupBy("sha256").agg(F.min("source_id").alias("_second"))
    j = docs.join(g, "sha256").join(nxt, "sha256", "left")
    other = F.when(F.col("source_id") != F.col("_first"), F.col("_first")).otherwise(F.col("_second"))
    return j.select(*docs.columns, other.alias("duplicate_of"), "copies")


def cross_kind_duplicates(entries: DataFrame, kind: str, other_kinds: Sequence[str]) -> DataFrame:
    """Entries of a kind whose source id is known under another kind."""
    known = entries.where(F.col("source_kind").isin(*other_kinds)).select("source_id")
    return entries.where(F.col("source_kind") == kind).join(known, "source_id", "left_semi")


def ingest_outcomes(work: DataFrame, entries: DataFrame, dry_run: bool = False) -> DataFrame:
    """Outcome of each fetched document ``(account_id, source_kind, source_id, sha256, text_chars)``.

    Already an entry of the meeting kind: duplicate. No text: not_applicable. Same hash as stored: unchanged. A copy of
    another local file: duplicate. Otherwise updated or created (``would_`` in a dry run).
    """
    meet = entries.where(F.col("source_kind") == "google.meet").select("source_id", F.lit(True).alias("_meet")).distinct()
    known = entries.select(*KEY, jsonx.get("metadata", "original_sha256").alias("_sha"), F.lit(True).alias("_known"))
    local = entries.where(F.col("source_kind") == "local.file").select(
        jsonx.get("metadata", "original_sha256").alias("sha256"), F.col("source_id").alias("_sid"))
    local = local.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min("_sid").alias("_lo"), F.max("_sid").alias("_hi"))
    j = work.join(meet, "source_id", "left").join(known, KEY, "left").join(local, "sha256", "left")
    copy = (F.col("source_kind") == "local.file") & F.coalesce((F.col("_lo") != F.col("source_id")) | (F.col("_hi") != F.col("source_id")), F.lit(False))
    pre = "would_" if dry_run else ""
    names = ("update", "create") if dry_run else ("updated", "created")
    out = (
        F.when((F.col("source_kind") == "google.doc") & F.col("_meet").isNotNull(), "duplicate")
        .when(F.col("text_chars") == 0, "not_applicable")
        .when(F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False)), "unchanged")
        .when(F.col("_known").isNull() & copy, "duplicate")
        .when(F.col("_known").isNotNull(), pre + names[0]).otherwise(pre + names[1])
    )
    return j.select(*work.columns, out.alias("outcome"))


def outcome_counts(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return outcomes.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("count"))


def renormalize(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """User overrides ``(id, overrides JSON)`` laid over the metadata; title and date follow their precedence again."""
    from lorekeep.functions.times import safe_time

    o = overrides.select("id", F.col("overrides").alias("_o"))
    j = entries.join(o, "id", "left").withColumn("metadata", jsonx.overlay(F.col("metadata"), F.col("_o")))
    hit = F.col("_o").isNotNull()
    title = F.coalesce(jsonx.text("metadata", "title_override"), jsonx.text("metadata", "doc_title"), jsonx.text("metadata", "title_fallback"), F.col("title"))
    day = F.coalesce(safe_time(jsonx.text("metadata", "date_override")), F.col("source_created_at"))
    new = {"title": F.when(hit, title).otherwise(F.col("title")), "source_created_at": F.when(hit, day).otherwise(F.col("source_created_at"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in entries.columns])


