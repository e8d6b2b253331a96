"""Entry filters, joins, orders and statistics."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lorekeep.functions import jsonx, text as X
from lorekeep.functions.times import activity_at, entry_date, iso, parse_date, parse_when
from lorekeep.operators import entries as E
from lorekeep.plans import query
from lorekeep.plans.ctes import iso as SI

_DATE = "coalesce(source_created_at, ingested_at)"
_ACT = "coalesce(source_updated_at, source_created_at, ingested_at)"
NOW = datetime(2024, 2, 1, tzinfo=UTC)


@query(
    "p1_entry_filter",
    f"""SELECT id, entry_uid, account_id, source_kind, {SI(_DATE)} AS date FROM entries
WHERE account_id IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src8') AND source_kind IN ('slack.thread', 'google.meet', 'web.page')
  AND raw_status = 'present' AND summary_status IN ('done', 'skipped', 'none')
  AND {_DATE} >= TIMESTAMP '2024-02-01' AND {_DATE} < TIMESTAMP '2025-02-01'""",
    ("entries",),
)
def entry_filter(v):
    """IN lists and a half-open date range over the entry date, newest first."""
    f = E.EntryFilter(
        accounts=["src1", "src2", "src3", "src4", "src5", "src8"], source_kinds=["slack.thread", "google.meet", "web.page"],
        raw_status=["present"], summary_status=["done", "skipped", "none"],
        since=parse_date("2024-02-01"), until=parse_date("2025-01-31", end_of_day=True),
    )
    return E.list_entries(v.entries, f).select("id", "entry_uid", "account_id", "source_kind", iso(entry_date()).alias("date"))


@query(
    "p5_channel_filter",
    """SELECT id, entry_uid FROM entries WHERE json_extract_string(metadata, '$.channel_name') = 'room-3'
  OR json_extract_string(metadata, '$.channel_id') = 'room-3'""",
    ("entries",),
)
def channel_filter(v):
    """P5: channel by name or id, a leading # is dropped."""
    return E.list_entries(v.entries, E.EntryFilter(channel="#room-3")).select("id", "entry_uid")


@query(
    "p5_metadata_text",
    "SELECT id, source_kind FROM entries WHERE json_extract_string(metadata, '$.recurring_event_id') = 'r9'",
    ("entries",),
)
def metadata_text(v):
    """P5: equality of a metadata text key."""
    return v.entries.where(E.EntryFilter(metadata_text=("recurring_event_id", "r9")).predicate()).select("id", "source_kind")


@query(
    "p6_cite_url",
    """SELECT e.id, coalesce(source_url, json_extract_string(metadata, '$.transcript_url'), p.path) AS cite_url
FROM entries e LEFT JOIN (SELECT entry_id, arg_min(path, seq) AS path FROM raw_objects GROUP BY 1) p ON p.entry_id = e.id""",
    ("entries", "raw_objects"),
)
def cite_url(v):
    """Source URL, else transcript URL, else the first raw path by role and number."""
    return E.with_cite_url(v.entries, v.raw_objects).select("id", "cite_url")


@query(
    "p17_prefix_runs",
    f"""SELECT id, command, {SI('started_at')} AS started_at FROM runs WHERE starts_with(command, 'sync') AND trigger = 'schedule'
ORDER BY started_at DESC, id DESC LIMIT 100""",
    ("runs",),
)
def prefix_runs(v):
    """Runs by command prefix and trigger, newest first."""
    return E.runs(v.runs, "sync", "schedule", 100).select("id", "command", iso(F.col("started_at")).alias("started_at"))


@query(
    "p17_cursor_prefix",
    "SELECT account_id, source_kind, key FROM cursors WHERE starts_with(key, 'watch:') AND source_kind = 'slack.thread'",
    ("cursors",),
)
def cursor_prefix(v):
    """Cursors of a source by key prefix."""
    return E.cursors(v.cursors, None, "slack.thread", "watch:").select("account_id", "source_kind", "key")


@query(
    "p20_summarization_candidates",
    "SELECT id, summary_status, summary_attempts FROM entries WHERE summary_status IN ('pending', 'failed') AND summary_attempts < 3",
    ("entries",),
)
def candidates(v):
    """P20: pending or failed entries below the attempt limit, newest first."""
    return E.summarization_candidates(v.entries, 3).select("id", "summary_status", "summary_attempts")


@query(
    "p21_legacy_hashes",
    "SELECT entry_id, input_hash FROM summaries WHERE generator_kind <> 'source_native' AND input_hash <> '' AND NOT starts_with(input_hash, 'b2:')",
    ("summaries",),
)
def legacy(v):
    """Summaries with an input hash of the old form."""
    return E.legacy_hashes(v.summaries).select("entry_id", "input_hash")


@query(
    "p22_cache_reads",
    """SELECT 'fresh' AS read, account_id, key, value FROM c WHERE expires_at > TIMESTAMP '2024-02-01'
UNION ALL SELECT 'stale', account_id, key, value FROM c""".replace(
        " c", " (SELECT 'acct' || c_nationkey AS account_id, 'k' || c_custkey AS key, c_mktsegment AS value, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 60 AS INT)) AS expires_at FROM customer) c"
    ),
)
def cache_reads(v):
    """Unexpired values, and the read that accepts stale ones."""
    cols = ["account_id", "key", "value"]
    fresh = E.cache_get(v.cache, NOW).select(F.lit("fresh").alias("read"), *cols)
    return fresh.unionByName(E.cache_get(v.cache, NOW, stale_ok=True).select(F.lit("stale").alias("read"), *cols))


@query(
    "j4_summarized_by_model",
    "SELECT id FROM entries e WHERE EXISTS (SELECT 1 FROM summaries s WHERE s.entry_id = e.id AND s.model = 'm1' AND s.provider = 'p2')",
    ("entries", "summaries"),
)
def by_model(v):
    """Semi join on summaries by model and provider."""
    return E.with_summary(v.entries, v.summaries, model="m1", provider="p2").select("id")


@query(
    "j5_without_summary",
    "SELECT id, summary_status FROM entries e WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.entry_id = e.id)",
    ("entries", "summaries"),
)
def no_summary(v):
    """Anti join."""
    return E.without_summary(v.entries, v.summaries).select("id", "summary_status")


@query(
    "j20_account_labels",
    "SELECT e.id, coalesce(a.label, e.account_id) AS account_label FROM entries e LEFT JOIN accounts a ON a.id = e.account_id",
    ("entries", "accounts"),
)
def labels(v):
    """Account label, falling back to the id."""
    return E.with_labels(v.entries, v.accounts).select("id", "account_label")


@query(
    "j21_show_entries",
    """SELECT e.id, string_agg(s.position || ':' || s.kind || ':' || s.origin || ':' || length(s.text), ',' ORDER BY s.position) AS sections,
  any_value(m.generator_kind) AS generator_kind, any_value(m.model) AS model, any_value(r.n) AS raw_segments, CAST(any_value(r.size) AS BIGINT) AS raw_size
FROM entries e LEFT JOIN sections s ON s.entry_id = e.id LEFT JOIN summaries m ON m.entry_id = e.id
LEFT JOIN (SELECT entry_id, count(*) AS n, sum(size) AS size FROM raw_objects GROUP BY 1) r ON r.entry_id = e.id GROUP BY e.id""",
    ("entries", "sections", "summaries", "raw_objects"),
)
def show_entries(v):
    """Entries with sections, summary and raw totals."""
    part = lambda x: F.concat_ws(":", x["position"].cast("string"), x["kind"], x["origin"], F.length(x["text"]).cast("string"))
    return E.show(v.entries, v.sections, v.summaries, v.raw_objects).select(
        "id", F.array_join(F.transform("sections", part), ",").alias("sections"), "generator_kind", "model", "raw_segments", "raw_size"
    )


@query(
    "j22_review",
    """SELECT e.id, g.generated, array_to_string(list_slice(string_split(d.text, chr(10)), 1, 3), chr(10)) AS source_text,
  len(string_split(d.text, chr(10))) AS source_lines
FROM entries e JOIN sections d ON d.entry_id = e.id AND d.kind = 'details'
LEFT JOIN (SELECT entry_id, string_agg(kind || '=' || text, '|' ORDER BY position) AS generated FROM sections WHERE origin = 'generated' GROUP BY 1) g ON g.entry_id = e.id
WHERE EXISTS (SELECT 1 FROM summaries s WHERE s.entry_id = e.id)""",
    ("entries", "sections", "summaries"),
)
def review(v):
    """Generated sections beside the first source lines, with the total line count."""
    r = E.review(E.with_summary(v.entries, v.summaries), v.sections, 3)
    gen = F.array_join(F.transform("generated", lambda g: F.concat(g["kind"], F.lit("="), g["text"])), "|")
    return r.select("id", gen.alias("generated"), "source_text", F.col("source_lines").cast("long").alias("source_lines"))


@query(
    "o10_recent_entries",
    f"""WITH top AS (SELECT *, {_ACT} AS act FROM entries WHERE {_ACT} < TIMESTAMP '2025-06-01' ORDER BY act DESC, id DESC LIMIT 31)
SELECT t.id, {SI('t.act')} AS activity_at, (SELECT count(*) > 30 FROM top) AS truncated, t.summary_status = 'done' AND s.entry_id IS NOT NULL AS summarized,
  t.summary_status = 'done' AND s.entry_id IS NOT NULL AND coalesce(s.prompt_version IN ('conversation-summary/v2', 'meeting-summary/v2', 'document-summary/v4'), false) AS items_available,
  coalesce(g.sections, '') AS sections,
  CASE WHEN NOT (t.summary_status = 'done' AND s.entry_id IS NOT NULL) THEN d.x END AS details_excerpt
FROM (SELECT * FROM top ORDER BY act DESC, id DESC LIMIT 30) t LEFT JOIN summaries s ON s.entry_id = t.id
LEFT JOIN (SELECT entry_id, string_agg(kind || '=' || text, '|' ORDER BY position) AS sections FROM sections WHERE origin = 'generated' GROUP BY 1) g ON g.entry_id = t.id
LEFT JOIN (SELECT entry_id, substr(text, 1, 400) AS x FROM sections WHERE kind = 'details') d ON d.entry_id = t.id""",
    ("entries", "sections", "summaries"),
)
def recent(v):
    """Newest by activity with a truncation probe; an excerpt stands in for a missing summary."""
    r = E.recent(v.entries, v.sections, v.summaries, E.clamp(30, 1, 200), until=parse_date("2025-06-01"))
    sec = F.array_join(F.transform("sections", lambda g: F.concat(g["kind"], F.lit("="), g["text"])), "|")
    return r.select("id", iso(F.col("activity_at")).alias("activity_at"), "truncated", "summarized", "items_available", sec.alias("sections"), "details_excerpt")


@query(
    "o2_keyset_page",
    "SELECT id, entry_uid FROM entries WHERE id > 120 ORDER BY id LIMIT 50",
    ("entries",),
)
def keyset(v):
    """O2: the page after an id, oldest first."""
    return E.list_entries(v.entries, E.EntryFilter(after_id=120), limit=E.clamp(50, 1, 1000), ascending_id=True).select("id", "entry_uid")


@query(
    "o1_latest_entries",
    f"SELECT id, title, {SI(_DATE)} AS date FROM entries ORDER BY {_DATE} DESC, id DESC LIMIT 200",
    ("entries",),
)
def latest(v):
    """Newest first with a clamped limit."""
    return E.list_entries(v.entries, E.EntryFilter(), limit=E.clamp(500, 1, 200)).select("id", "title", iso(entry_date()).alias("date"))


@query(
    "o5_issue_order",
    f"""SELECT id, severity, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank, {SI('last_seen_at')} AS last_seen_at
FROM issues WHERE resolved_at IS NULL""",
    ("issues",),
)
def issue_order(v):
    """Open issues by severity, then last seen."""
    return E.open_issues(v.issues).select("id", "severity", "rank", iso(F.col("last_seen_at")).alias("last_seen_at"))


@query(
    "a1_source_stats",
    f"SELECT account_id, source_kind, count(*) AS count, {SI(f'min({_DATE})')} AS oldest, {SI(f'max({_DATE})')} AS newest FROM entries GROUP BY 1, 2",
    ("entries",),
)
def source_stats(v):
    """A1: count and date range by account and kind."""
    return E.source_stats(v.entries).select("account_id", "source_kind", "count", iso(F.col("oldest")).alias("oldest"), iso(F.col("newest")).alias("newest"))


@query(
    "a2_status_counts",
    """SELECT 'raw' AS field, raw_status AS value, count(*) AS count FROM entries GROUP BY 2
UNION ALL SELECT 'summary', summary_status, count(*) FROM entries GROUP BY 2""",
    ("entries",),
)
def status_counts(v):
    """A2: entries by raw and by summary status."""
    raw = E.status_counts(v.entries, "raw_status").select(F.lit("raw").alias("field"), "value", "count")
    return raw.unionByName(E.status_counts(v.entries, "summary_status").select(F.lit("summary").alias("field"), "value", "count"))


@query(
    "a3_model_counts",
    "SELECT generator_kind || '/' || provider || '/' || model AS label, count(*) AS count FROM summaries GROUP BY 1",
    ("summaries",),
)
def model_counts(v):
    """A3: summaries by generator label, largest first."""
    return E.model_counts(v.summaries)


@query(
    "a4_global_counts",
    """SELECT 'entries' AS name, count(*) AS count FROM entries UNION ALL SELECT 'sections', count(*) FROM sections
UNION ALL SELECT 'summaries', count(*) FROM summaries UNION ALL SELECT 'queue', count(*) FROM queue""",
    ("entries", "sections", "summaries", "queue"),
)
def global_counts(v):
    """A4: table sizes."""
    return E.global_counts(entries=v.entries, sections=v.sections, summaries=v.summaries, queue=v.queue)


@query(
    "a25_entry_count",
    f"SELECT count(*) AS count FROM entries WHERE source_kind = 'google.doc' AND {_DATE} >= TIMESTAMP '2024-06-01'",
    ("entries",),
)
def entry_count(v):
    """Number of entries for a filter."""
    f = E.EntryFilter(source_kinds=["google.doc"], since=parse_date("2024-06-01"))
    return v.entries.where(f.predicate()).agg(F.count(F.lit(1)).alias("count"))


@query(
    "c31_section_bullets",
    r"""SELECT entry_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(trim(x), '^- ', '')), lambda x: trim(x) <> ''), '|') AS bullets
FROM sections WHERE kind = 'overview'""",
    ("sections",),
)
def section_bullets(v):
    """A section as an array of its lines (here the words of the overview, one per line)."""
    lines = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    return v.sections.where(F.col("kind") == "overview").select("entry_id", F.array_join(X.bullets(lines), "|").alias("bullets"))


@query(
    "c7_scope_keys",
    r"""SELECT id, CASE WHEN source_kind IN ('slack.thread', 'slack.day') THEN 'slack:' || coalesce(json_extract_string(metadata, '$.channel_id'), split_part(source_id, ':', 1))
  WHEN source_kind = 'google.meet' AND json_extract_string(metadata, '$.recurring_event_id') IS NOT NULL THEN 'meet:' || json_extract_string(metadata, '$.recurring_event_id')
  WHEN source_kind = 'google.meet' THEN 'meet:title:' || trim(regexp_replace(regexp_replace(lower(replace(title, '…', '...')), '[*_`~]', '', 'g'), '\s+', ' ', 'g'))
  ELSE source_kind || ':' || source_id END AS scope_key FROM entries""",
    ("entries",),
)
def scope_keys(v):
    """Scope of an entry by source kind."""
    from lorekeep.operators.items import scope_key

    return v.entries.select("id", scope_key().alias("scope_key"))


@query(
    "s11_json_results",
    f"""SELECT id, '{{"schema":"catalog.list/v1","id":' || id || ',"uid":"' || entry_uid || '","kind":"' || source_kind || '","date":"' || {SI(_DATE)} || '"}}' AS json FROM entries""",
    ("entries",),
)
def json_results(v):
    """Answers as JSON objects with a schema tag."""
    from lorekeep.sources.io import as_json

    rows = v.entries.select(F.col("id"), F.col("entry_uid").alias("uid"), F.col("source_kind").alias("kind"), iso(entry_date()).alias("date"))
    return as_json(rows, "catalog.list/v1", keep=["id"])


@query(
    "c24_truncated_titles",
    "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS short FROM documents",
)
def truncated(v):
    """At most 120 characters with an ellipsis."""
    return v.table("documents").select("doc_id", X.truncate_chars(F.col("text"), 120).alias("short"))


@query(
    "c33_relative_times",
    """SELECT 'days' AS age, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' UNION ALL SELECT 'weeks', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-18 12:00:00'
UNION ALL SELECT 'today', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-31 15:00:00' - INTERVAL 2 DAY UNION ALL SELECT 'date', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-20'""",
)
def relative_times(v):
    """Events since an age, a local midnight or a date."""
    now = datetime(2024, 2, 1, 12, tzinfo=UTC)
    since = {"days": parse_when("7d", now), "weeks": parse_when("2w", now), "today": parse_when("today", now, "Asia/Tokyo") - timedelta(days=2), "date": parse_when("2024-01-20", now)}
    marks = F.array(*[F.when(F.col("ts") >= F.lit(at), k) for k, at in since.items()])
    ages = v.events.select(F.explode(F.array_compact(marks)).alias("age"))
    return ages.groupBy("age").agg(F.count(F.lit(1)).alias("events"))


@query(
    "s6_raw_sink",
    f"""SELECT r.account_id, source_kind, CAST(year({_DATE}) AS INT) AS year, CAST(month({_DATE}) AS INT) AS month, entry_id, role, seq, path, sha256(payload) AS content
FROM raw_objects r JOIN entries e ON e.id = r.entry_id""",
    ("raw_objects", "entries"),
)
def raw_sink(v):
    """Raw segments written by account, kind, year and month, and read back."""
    from lorekeep.session import work_dir
    from lorekeep.sources.io import write_raw

    e = v.entries.select(F.col("id").alias("entry_id"), "source_kind", "source_created_at", "ingested_at")
    path = work_dir(v.spark, "raw")
    write_raw(v.raw_objects.join(e, "entry_id"), path)
    back = v.spark.read.parquet(path)
    return back.select("account_id", "source_kind", "year", "month", "entry_id", "role", "seq", "path", F.sha2("payload", 256).alias("content"))
