"""Snapshot maintenance over documents, raw segments, queues and issues; import round trip."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lorekeep.functions import jsonx, text as X
from lorekeep.functions.times import iso
from lorekeep.operators import entries as E
from lorekeep.operators import normalize as N
from lorekeep.operators import upserts as M
from lorekeep.operators.catalog_store import CatalogStore
from lorekeep.operators.messages import directory_labels
from lorekeep.plans import query
from lorekeep.plans.ctes import cte, iso as SI
from lorekeep.plans.views import days
from lorekeep.session import work_dir
from lorekeep.sources import imports as P
from lorekeep.sources.partitions import PartitionStore

NOW = datetime(2024, 7, 1, tzinfo=UTC)
_NOW = "'2024-07-01T00:00:00Z'"


def stored(v):
    """The entries of even documents, as a catalog that an incoming batch of all documents meets."""
    return v.entries.where(F.col("id") % 2 == 0).withColumns({"origin": F.lit("sync"), "updated_at": days("2024-02-01", F.lit(0))})


def incoming(v):
    """Every document again: a new title, some dates and URLs missing."""
    i = F.col("id")
    return v.entries.select(
        "account_id", "source_kind", "source_id", F.when(i % 4 != 3, F.concat("source_url", F.lit("?v=2"))).alias("source_url"), "id",
        F.when(i % 9 != 0, F.concat(F.lit("T "), "title")).alias("title"), F.when(i % 2 == 1, F.col("source_created_at")).alias("source_created_at"),
        days("2024-06-01", i % 20).alias("source_updated_at"), F.when(i % 3 == 0, F.lit('{"v":2}')).alias("metadata"), F.lit("ingest").alias("origin"),
    )


_UPSERTED = f"""SELECT source_id, CASE WHEN id % 2 = 0 THEN id END AS kept_id, id % 2 = 1 AS above_all, 1 AS same_id, coalesce(CASE WHEN id % 9 <> 0 THEN 'T ' || title END, CASE WHEN id % 2 = 0 THEN title ELSE source_id END) AS title,
  coalesce(CASE WHEN id % 4 <> 3 THEN source_url || '?v=2' END, CASE WHEN id % 2 = 0 THEN source_url END) AS source_url, {SI('source_created_at')} AS source_created_at,
  {SI("TIMESTAMP '2024-06-01' + to_days(CAST(id % 20 AS INT))")} AS source_updated_at, CASE WHEN id % 3 = 0 THEN '{{"v":2}}' WHEN id % 2 = 0 THEN metadata ELSE '{{}}' END AS metadata,
  CASE WHEN id % 2 = 0 THEN 'sync' ELSE 'ingest' END AS origin, {_NOW} AS updated_at, CASE WHEN id % 2 = 0 THEN raw_status ELSE 'missing' END AS raw_status FROM entries"""


@query("m1_entry_upsert", _UPSERTED, ("entries",))
def upsert(v):
    """M1: known keys are refreshed, new ones get ids after the highest; dates and URL only fill in."""
    cur = stored(v)
    return _upserted(M.upsert_entries(cur, incoming(v).drop("id"), NOW), cur.agg(F.max("id")).scalar())


def _upserted(entries, top):
    new = F.col("id") > top
    return entries.select(
        "source_id", F.when(~new, F.col("id")).alias("kept_id"), new.alias("above_all"), F.count(F.lit(1)).over(W.partitionBy("id")).cast("int").alias("same_id"), "title", "source_url", iso(F.col("source_created_at")).alias("source_created_at"),
        iso(F.col("source_updated_at")).alias("source_updated_at"), "metadata", "origin", iso(F.col("updated_at")).alias("updated_at"), "raw_status",
    )


@query("m1_upsert_commit", _UPSERTED, ("entries",))
def upsert_commit(v):
    """M1: the same, in two commits to the buckets that each half of the batch touches."""
    cur, batch = stored(v), incoming(v)
    store = CatalogStore(PartitionStore(v.spark, work_dir(v.spark, "catalog")))
    store.create({"entries": cur}, 16)
    for half in (0, 1):
        store.upsert(batch.where(F.floor(F.col("id") / 2) % 2 == half).drop("id"), NOW)
    return _upserted(store.read("entries"), cur.agg(F.max("id")).scalar())


@query("a15_run_counters", "SELECT account_id, source_kind, CASE WHEN id % 2 = 0 THEN 'updated' ELSE 'created' END AS outcome, count(*) AS count FROM entries GROUP BY 1, 2, 3", ("entries",))
def run_counters(v):
    """Outcomes of a run by account and kind."""
    return M.outcome_counts(M.entry_outcomes(stored(v), incoming(v)), ["account_id", "source_kind"])


def _batch(v):
    """Two new segments per document; every fourth document replaces its segments, the others append."""
    d = v.table("documents")
    rows = d.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("account_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    payload = F.concat(F.lit("new "), F.col("entry_id").cast("string"), F.lit("."), F.col("n").cast("string"))
    return rows.select(
        "entry_id", "account_id", F.lit("primary").alias("role"), (F.col("entry_id") * 2 + F.col("n")).alias("arrival"),
        F.when(F.col("entry_id") % 4 == 0, "replace").otherwise("append").alias("mode"),
        F.when((F.col("entry_id") % 8 == 0) & (F.col("n") == 0), F.concat(F.lit("raw/"), F.col("entry_id").cast("string"), F.lit("/primary.0.txt")))
        .otherwise(F.concat(F.lit("new/"), F.col("entry_id").cast("string"), F.lit("/"), F.col("n").cast("string"))).alias("path"),
        F.sha2(F.encode(payload, "UTF-8"), 256).alias("sha256"), F.octet_length(payload).cast("long").alias("size"), payload.alias("payload"),
    )


@query(
    "m2_raw_write",
    """SELECT entry_id, seq, payload FROM raw_objects WHERE entry_id % 4 <> 0
UNION ALL SELECT d.doc_id, n + CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END, 'new ' || d.doc_id || '.' || n FROM documents d, (VALUES (0), (1)) t(n)""",
    ("raw_objects",),
)
def raw_write(v):
    """Segments replaced or appended with the next numbers."""
    return M.write_raw(v.raw_objects, _batch(v))[0].select("entry_id", "seq", "payload")


@query("m2_stale_paths", "SELECT path FROM raw_objects WHERE entry_id % 4 = 0 AND NOT (entry_id % 8 = 0 AND seq = 0)", ("raw_objects",))
def stale(v):
    """M2: paths that a replacement leaves behind."""
    return M.write_raw(v.raw_objects, _batch(v))[1]


@query(
    "a14_raw_hashes",
    """SELECT entry_id, sha256(unhex(string_agg('4000000000000000' || hex(encode(sha256)), '' ORDER BY seq))) AS raw_hash FROM raw_objects GROUP BY 1""",
    ("raw_objects",),
)
def raw_hashes(v):
    """Length-prefixed hash over ordered segment hashes."""
    return M.raw_hashes(v.raw_objects)


@query("s5_assembled_segments", "SELECT doc_id AS entry_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_pieces, text FROM documents")
def assembled(v):
    """Segments of an entry joined in order."""
    return M.assemble_segments(v.raw_objects).drop("role")


@query(
    "w9_contiguity",
    "SELECT entry_id, NOT (entry_id % 5 = 0 AND n > 2) AS contiguous FROM (SELECT doc_id AS entry_id, len(string_split(text, chr(10))) AS n FROM documents)",
)
def contiguous(v):
    """Segment numbers without a gap (the second segment of every fifth document is taken away)."""
    raw = v.raw_objects.where(~((F.col("entry_id") % 5 == 0) & (F.col("seq") == 1)))
    return M.contiguity(raw).select("entry_id", "contiguous")


@query(
    "m26_raw_audit",
    """SELECT r.entry_id, CASE WHEN bool_or(r.entry_id % 7 = 0 AND seq = 0) THEN 'missing' WHEN bool_or(r.entry_id % 5 = 0 AND seq = 0) THEN 'changed' END AS problem
FROM raw_objects r JOIN entries e ON e.id = r.entry_id WHERE e.raw_status = 'present' GROUP BY 1 HAVING problem IS NOT NULL""",
    ("raw_objects", "entries"),
)
def raw_audit(v):
    """Entries whose files are missing or changed, over all rows."""
    e = F.col("entry_id")
    files = v.raw_objects.where(~((e % 7 == 0) & (F.col("seq") == 0))).select(
        "path", F.when((e % 5 == 0) & (F.col("seq") == 0), "other").otherwise(F.col("sha256")).alias("sha256"))
    return M.raw_consistency(v.entries, v.raw_objects, files)


@query("j15_orphaned_files", "SELECT path FROM raw_objects WHERE entry_id % 3 = 0", ("raw_objects",))
def orphaned(v):
    """Files without a catalog row (a third of the documents is unknown here)."""
    return M.orphans(v.raw_objects.select("path"), v.raw_objects.where(F.col("entry_id") % 3 != 0))


@query("a19_storage_sizes", "SELECT account_id, role, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS segments FROM raw_objects GROUP BY 1, 2", ("raw_objects",))
def sizes(v):
    """Stored bytes by account."""
    return v.raw_objects.groupBy("account_id", "role").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("segments"))


_WRITTEN = """WITH d AS (SELECT DISTINCT ON (entry_id, kind) * FROM (
    SELECT entry_id, CASE WHEN kind = 'decisions' THEN 'overview' ELSE kind END AS kind, 'x ' || text AS text, position AS version FROM sections WHERE kind <> 'details' OR entry_id % 2 = 0) ORDER BY entry_id, kind, version DESC),
b AS (SELECT entry_id, kind, CASE WHEN kind = 'overview' AND entry_id % 3 = 0 THEN 'user' ELSE origin END AS origin, text FROM sections)
SELECT coalesce(b.entry_id, d.entry_id) AS entry_id, coalesce(b.kind, d.kind) AS kind, CASE WHEN b.origin IN ('user', 'extracted') THEN b.origin ELSE 'generated' END AS origin,
  CASE WHEN b.origin IN ('user', 'extracted') THEN b.text ELSE d.text END AS text
FROM b FULL JOIN d ON b.entry_id = d.entry_id AND b.kind = d.kind WHERE b.origin IN ('user', 'extracted') OR d.text IS NOT NULL"""


def _section_drafts(v):
    cur = v.sections.withColumn("origin", F.when((F.col("kind") == "overview") & (F.col("entry_id") % 3 == 0), "user").otherwise(F.col("origin")))
    drafts = v.sections.where((F.col("kind") != "details") | (F.col("entry_id") % 2 == 0)).select(
        "entry_id", F.when(F.col("kind") == "decisions", "overview").otherwise(F.col("kind")).alias("kind"), F.concat(F.lit("x "), "text").alias("text"), F.col("position").alias("version"))
    return cur.select("entry_id", "kind", "origin", "position", "text"), drafts


@query("m3_section_write", _WRITTEN, ("sections",))
def section_write(v):
    """Generated sections replaced; user and extracted ones stay, the later draft of a kind wins."""
    cur, drafts = _section_drafts(v)
    return M.write_sections(cur, drafts, "generated", replace=True).select("entry_id", "kind", "origin", "text")


@query("m3_section_commit", _WRITTEN, ("sections",))
def section_commit(v):
    """The same in commits, one for the entries of each third; other buckets keep their files."""
    cur, drafts = _section_drafts(v)
    store = CatalogStore(PartitionStore(v.spark, work_dir(v.spark, "catalog")))
    store.create({"sections": cur}, 16)
    for part in range(3):
        store.write_sections(drafts.where(F.col("entry_id") % 3 == part), "generated", replace=True)
    return store.read("sections").select("entry_id", "kind", "origin", "text")


@query(
    "m6_failed_attempts",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' ELSE summary_status END AS summary_status, CAST(CASE WHEN (id % 3 = 0 OR summary_status = 'failed') AND id % 4 = 0 THEN 0 ELSE summary_attempts + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END END AS INT) AS summary_attempts FROM entries""",
    ("entries",),
)
def failures(v):
    """M6: a failure counted for every third entry, then counters of some failed ones reset."""
    e = v.entries.withColumn("summary_error", F.lit(None).cast("string"))
    failed = v.entries.where(F.col("id") % 3 == 0).select("id", F.lit(1).alias("attempts"), F.lit("e").alias("error"))
    n = M.reset_attempts(M.record_failures(e, failed), F.col("id") % 4 == 0)
    return n.select("id", "summary_status", "summary_attempts")


@query(
    "m13_queue_upsert",
    f"""SELECT account_id, source_kind, source_id, reason, hint, {SI('enqueued_at')} AS enqueued_at, attempts FROM (
  SELECT account_id, source_kind, source_id, reason, CASE WHEN n % 3 = 0 THEN '{{"last":' || n || '}}' ELSE hint END AS hint, enqueued_at, attempts, n FROM (SELECT *, CAST(substr(source_id, 2) AS BIGINT) AS n FROM queue)
  UNION ALL SELECT account_id, source_kind, 'n' || n, 'history', '{{"last":' || n || '}}', TIMESTAMP '2024-07-01', 0, n FROM (SELECT *, CAST(substr(source_id, 2) AS BIGINT) AS n FROM queue) WHERE n % 3 = 1)
WHERE NOT (n % 5 = 0 AND starts_with(source_id, 'q'))""",
    ("queue",),
)
def queue_upsert(v):
    """Discovery paths united by key (first reason, last hint), known rows take the hint, finished ones leave."""
    n = F.substring("source_id", 2, 20).cast("long")
    q = v.queue.withColumn("n", n)
    key = [F.col("account_id"), F.col("source_kind"), F.when(F.col("n") % 3 == 0, F.col("source_id")).otherwise(F.concat(F.lit("n"), F.col("n").cast("string"))).alias("source_id")]
    hint = F.concat(F.lit('{"last":'), F.col("n").cast("string"), F.lit("}"))
    some = q.where(F.col("n") % 3 != 2)
    paths = some.select(*key, F.lit("history").alias("reason"), F.lit("{}").alias("hint"), F.lit(0).alias("ord")).unionByName(
        some.select(*key, F.lit("watched").alias("reason"), hint.alias("hint"), F.lit(1).alias("ord")))
    done = q.where(F.col("n") % 5 == 0).select("account_id", "source_kind", "source_id")
    nxt = M.upsert_queue(v.queue, paths, done, NOW)
    return nxt.select("account_id", "source_kind", "source_id", "reason", "hint", iso(F.col("enqueued_at")).alias("enqueued_at"), "attempts")


@query(
    "m14_cursor_upsert",
    """SELECT account_id, source_kind, key, CASE WHEN n % 4 = 1 THEN 'v' || n ELSE 'old' END AS value FROM (SELECT *, CAST(regexp_replace(key, '^[a-z:C]+', '') AS BIGINT) AS n FROM cursors) WHERE n % 4 <> 2""",
    ("cursors",),
)
def cursor_upsert(v):
    """Cursors replaced and, by a null, deleted."""
    n = F.regexp_replace("key", "^[a-z:C]+", "").cast("long")
    cur = v.cursors.withColumns({"value": F.lit("old"), "updated_at": F.lit(NOW).cast("timestamp")})
    upd = v.cursors.withColumn("n", n).where(F.col("n") % 4 != 3).where(F.col("n") % 4 != 0).select(
        "account_id", "source_kind", "key", F.when(F.col("n") % 4 == 1, F.concat(F.lit("v"), F.col("n").cast("string"))).alias("value"))
    return M.upsert_cursors(cur, upd, NOW).select("account_id", "source_kind", "key", "value")


@query(
    "m15_issue_refresh",
    f"""WITH o AS (SELECT * FROM issues WHERE resolved_at IS NULL)
SELECT coalesce(o.code, f.code) AS code, CASE WHEN o.code IS NULL THEN f.account_id ELSE o.account_id END AS account_id, coalesce(o.entry_id, f.entry_id) AS entry_id, coalesce(f.severity, o.severity) AS severity,
  coalesce(f.message, o.message) AS message, coalesce({SI('o.first_seen_at')}, {_NOW}) AS first_seen_at, CASE WHEN f.code IS NOT NULL THEN {_NOW} ELSE {SI('o.last_seen_at')} END AS last_seen_at,
  CASE WHEN starts_with(coalesce(o.code, f.code), 'area3.') THEN {_NOW} END AS resolved_at
FROM o FULL JOIN findings f ON o.code = f.code AND o.account_id IS NOT DISTINCT FROM f.account_id AND o.entry_id = f.entry_id
UNION ALL SELECT code, account_id, entry_id, severity, message, {SI('first_seen_at')}, {SI('last_seen_at')}, {SI('resolved_at')} FROM issues WHERE resolved_at IS NOT NULL""",
    ("issues", "findings"),
)
def issue_refresh(v):
    """Open issues refreshed or opened by new findings, then one area resolved by its prefix."""
    n = M.resolve_issues(M.refresh_issues(v.issues, v.findings, NOW), "area3.", NOW)
    times = {c: iso(F.col(c)) for c in ("first_seen_at", "last_seen_at", "resolved_at")}
    return n.withColumns(times).select("code", "account_id", "entry_id", "severity", "message", *times)


@query(
    "m16_stale_runs",
    """SELECT id, CASE WHEN hit THEN 'interrupted' ELSE status END AS status, CASE WHEN hit THEN coalesce(error, 'no end was recorded') ELSE error END AS error
FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '2024-01-20' AND starts_with(command, 'sync') AS hit FROM runs)""",
    ("runs",),
)
def stale_runs(v):
    """Runs that never ended are closed."""
    return M.close_stale_runs(v.runs, "sync", datetime(2024, 1, 20, tzinfo=UTC)).select("id", "status", "error")


@query(
    "m20_purged_account",
    """SELECT 'entries' AS name, count(*) AS count FROM entries WHERE account_id <> 'src3' UNION ALL SELECT 'sections', count(*) FROM sections s JOIN entries e ON e.id = s.entry_id WHERE e.account_id <> 'src3'
UNION ALL SELECT 'summaries', count(*) FROM summaries s JOIN entries e ON e.id = s.entry_id WHERE e.account_id <> 'src3' UNION ALL SELECT 'raw_objects', count(*) FROM raw_objects WHERE account_id <> 'src3'
UNION ALL SELECT 'queue', count(*) FROM queue WHERE account_id <> 'src3'""",
    ("entries", "sections", "summaries", "raw_objects", "queue"),
)
def purged(v):
    """One account removed from every table."""
    return E.global_counts(**M.purge_account({"entries": v.entries, "sections": v.sections, "summaries": v.summaries, "raw_objects": v.raw_objects, "queue": v.queue}, "src3"))


@query(
    "m21_deleted_entries",
    "SELECT path FROM raw_objects r JOIN entries e ON e.id = r.entry_id WHERE e.summary_status = 'failed'",
    ("raw_objects", "entries"),
)
def deleted(v):
    """Paths to remove with deleted entries."""
    ids = v.entries.where(F.col("summary_status") == "failed").select(F.col("id").alias("entry_id"))
    return M.delete_entries({"entries": v.entries, "raw_objects": v.raw_objects}, ids)[1]


@query(
    "j12_content_duplicates",
    """SELECT doc_id, n AS copies, CASE WHEN doc_id <> lo THEN lo ELSE (SELECT min(o.doc_id) FROM documents o WHERE o.text = d.text AND o.doc_id <> d.doc_id) END AS duplicate_of
FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS lo FROM documents) d""",
)
def duplicates(v):
    """Documents of the same content, each with one other copy."""
    docs = v.table("documents").select(F.col("doc_id").alias("source_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return M.content_duplicates(docs).select(F.col("source_id").alias("doc_id"), "copies", "duplicate_of")


@query(
    "j13_cross_kind_duplicates",
    "SELECT id FROM entries e WHERE source_kind = 'google.doc' AND EXISTS (SELECT 1 FROM entries m WHERE m.source_kind = 'google.meet' AND split_part(m.source_id, 'f', 2)::BIGINT // 2 = split_part(e.source_id, 'f', 2)::BIGINT // 2)",
    ("entries",),
)
def cross_kind(v):
    """Documents also known as meetings (ids halved, so that kinds share some)."""
    half = F.floor(F.regexp_extract("source_id", r"(\d+)$", 1).cast("long") / 2).cast("string")
    return M.cross_kind_duplicates(v.entries.withColumn("source_id", half), "google.doc", ["google.meet"]).select("id")


cte(
    "ingest",
    """SELECT e.*, d.text, CASE WHEN e.id % 2 = 0 THEN CASE WHEN e.id % 4 = 0 THEN sha256(encode(d.text)) ELSE 'stale' END END AS known_sha FROM entries e JOIN documents d ON d.doc_id = e.id""",
    ("entries",),
)


@query(
    "m27_ingest_outcomes",
    """SELECT id, CASE WHEN source_kind = 'google.doc' AND id % 10 = 5 THEN 'duplicate' WHEN id % 13 = 0 THEN 'not_applicable' WHEN id % 4 = 0 THEN 'unchanged' WHEN id % 2 = 0 THEN 'updated' ELSE 'created' END AS outcome,
  CASE WHEN source_kind = 'google.doc' AND id % 10 = 5 THEN 'duplicate' WHEN id % 13 = 0 THEN 'not_applicable' WHEN id % 4 = 0 THEN 'unchanged' WHEN id % 2 = 0 THEN 'would_update' ELSE 'would_create' END AS preview FROM ingest""",
    ("ingest",),
)
def ingest(v):
    """Outcome of every document against the stored half of the catalog, and its dry run."""
    d = v.table("documents").select(F.col("doc_id").alias("id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    e = v.entries.join(d, "id")
    work = e.select("id", *M.KEY, "sha256", F.when(F.col("id") % 13 == 0, 0).otherwise(F.lit(9)).alias("text_chars"))
    sha = F.when(F.col("id") % 4 == 0, F.col("sha256")).otherwise("stale")
    known = e.where(F.col("id") % 2 == 0).select(*M.KEY, F.concat(F.lit('{"original_sha256":"'), sha, F.lit('"}')).alias("metadata"))
    meet = e.where((F.col("source_kind") == "google.doc") & (F.col("id") % 10 == 5)).select(
        "account_id", F.lit("google.meet").alias("source_kind"), "source_id", F.lit("{}").alias("metadata"))
    known = known.unionByName(meet)
    real = M.ingest_outcomes(work, known).select("id", "outcome")
    return real.join(M.ingest_outcomes(work, known, dry_run=True).select("id", F.col("outcome").alias("preview")), "id")


@query(
    "u7_metadata_overlay",
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'N' ELSE json_extract_string(metadata, '$.channel_name') END AS channel_name, json_extract_string(metadata, '$.channel_id') AS channel_id, CASE WHEN id % 2 = 0 THEN '[1,2]' END AS extra FROM entries""",
    ("entries",),
)
def overlay(v):
    """JSON overlay; the right side wins, null keeps the left."""
    top = F.when(F.col("id") % 2 == 0, '{"channel_name":"N","extra":[1,2]}')
    m = v.entries.select("id", jsonx.overlay(F.col("metadata"), top).alias("m"))
    return m.select("id", *[F.get_json_object("m", f"$.{k}").alias(k) for k in ("channel_name", "channel_id", "extra")])


@query(
    "m25_user_overrides",
    f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'Mine ' || id ELSE title END AS title, CASE WHEN id % 3 = 0 THEN '2023-05-06T00:00:00Z' ELSE {SI('source_created_at')} END AS source_created_at FROM entries""",
    ("entries",),
)
def overrides(v):
    """A user's title and date laid over unchanged entries."""
    o = v.entries.where(F.col("id") % 3 == 0).select("id", F.concat(F.lit('{"title_override":"Mine '), F.col("id").cast("string"), F.lit('","date_override":"2023-05-06"}')).alias("overrides"))
    return M.renormalize(v.entries, o).select("id", "title", iso(F.col("source_created_at")).alias("source_created_at"))


@query(
    "c27_file_slugs",
    """SELECT doc_id, CASE WHEN s = i AND length(i) <= 64 AND NOT starts_with(i, '.') THEN i ELSE substr(s, 1, 40) || '-' || substr(sha256(encode(i)), 1, 12) END AS slug
FROM (SELECT doc_id, i, regexp_replace(i, '[^A-Za-z0-9._-]', '_', 'g') AS s FROM (SELECT doc_id, lang || '-' || CASE WHEN doc_id % 2 = 0 THEN source ELSE substr(text, 1, 90) END AS i FROM documents))""",
)
def slugs(v):
    """File-safe ids."""
    i = F.concat("lang", F.lit("-"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.substring("text", 1, 90)))
    return v.table("documents").select("doc_id", X.slug(i).alias("slug"))


# -- import ---------------------------------------------------------------------------------------------------


def import_lines(v):
    """Documents written as import records, with every kind of mistake in some of them."""
    i = F.col("doc_id")
    kind = F.when(F.col("lang") == "en", "slack.thread").when(F.col("lang") == "fr", "google.meet").when(F.col("lang") == "de", "google.doc").otherwise("web.page")
    sec = F.array(F.struct(F.lit("details").alias("kind"), F.lit("extracted").alias("origin"), F.col("text")))
    raw = F.array(F.struct(F.lit("primary").alias("role"), F.when(i % 23 == 0, "../x.md").otherwise(F.concat(F.lit("raw/"), i.cast("string"), F.lit(".md"))).alias("path")))
    summary = F.struct(F.lit("llm_api").alias("generator_kind"), F.lit("p").alias("provider"), F.lit("m-imported").alias("model"))
    rec = F.to_json(F.struct(
        F.when(i % 29 == 0, "nobody").otherwise(F.concat(F.lit("acct-"), kind)).alias("account"),
        F.when(i % 17 == 0, "fax").otherwise(kind).alias("source_kind"),
        F.concat(F.lit("d"), i.cast("string")).alias("source_id"), F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("Title "), i.cast("string"))).alias("title"),
        F.lit("2024-01-05T00:00:00Z").alias("ingested_at"), F.when(i % 13 != 0, sec).alias("sections"), F.when(i % 2 == 0, raw).alias("raw"), F.when(i % 5 == 0, summary).alias("summary"),
    ))
    return v.table("documents").select(i.alias("line_id"), F.when(i % 19 == 0, F.concat(F.lit("x"), rec)).otherwise(rec).alias("line"))


def import_accounts(v):
    k = F.when(F.col("lang") == "en", F.array(F.lit("slack.thread"), F.lit("slack"))).when(F.col("lang") == "fr", F.array(F.lit("google.meet"), F.lit("google"))) \
        .when(F.col("lang") == "de", F.array(F.lit("google.doc"), F.lit("microsoft"))).otherwise(F.array(F.lit("web.page"), F.lit("web")))
    return v.table("documents").select(k.alias("k")).distinct().select(F.concat(F.lit("acct-"), F.col("k")[0]).alias("id"), F.col("k")[1].alias("kind"))


cte(
    "imported",
    """SELECT doc_id AS line_id, lang, text, CASE WHEN doc_id % 19 = 0 OR doc_id % 17 = 0 THEN 'not a record' WHEN doc_id % 11 = 0 THEN 'blank title' WHEN doc_id % 13 = 0 THEN 'no sections'
  WHEN doc_id % 29 = 0 THEN 'account nobody is unknown' WHEN lang = 'de' THEN 'account acct-google.doc has kind microsoft' WHEN doc_id % 2 = 0 AND doc_id % 23 = 0 THEN 'raw path leaves the bundle' END AS error FROM documents""",
)


@query("s2_import_validation", "SELECT line_id, error FROM imported WHERE error IS NOT NULL", ("imported",))
def validation(v):
    """Mistakes per line; good lines go on."""
    return P.bad_lines(P.validate(import_lines(v), import_accounts(v)))


@query(
    "m17_import_merge",
    """SELECT 'd' || line_id AS source_id, CASE WHEN line_id % 3 <> 0 THEN 'created' WHEN line_id % 9 = 0 THEN CASE WHEN line_id % 2 = 0 THEN 'merged' ELSE 'merged' END WHEN line_id % 6 = 3 THEN 'unchanged' ELSE 'updated' END AS outcome,
  CASE WHEN line_id % 3 = 0 AND line_id % 9 <> 0 AND line_id % 6 = 3 THEN '2024-02-01T00:00:00Z' ELSE '2024-01-05T00:00:00Z' END AS ingested_at, 'Title ' || line_id AS title FROM imported WHERE error IS NULL""",
    ("imported",),
)
def import_merge(v):
    """Created, updated, unchanged, or merged into an entry with raw data; the earliest ingest time stays."""
    lines = import_lines(v)
    val = P.validate(lines, import_accounts(v))
    n = F.col("line_id")
    cur = val.where(F.col("error").isNull() & (n % 3 == 0)).select(
        n.alias("id"), "account_id", F.col("r.source_kind").alias("source_kind"), F.col("r.source_id").alias("source_id"), F.lit(None).cast("string").alias("source_url"),
        F.col("r.title").alias("title"), F.lit(None).cast("timestamp").alias("source_created_at"), F.lit(None).cast("timestamp").alias("source_updated_at"),
        F.lit("2024-02-01").cast("timestamp").alias("ingested_at"), F.lit("{}").alias("metadata"), F.when(n % 9 == 0, "present").otherwise("missing").alias("raw_status"), F.lit("none").alias("summary_status"),
    )
    sec = val.where(F.col("error").isNull()).select(n.alias("entry_id"), F.explode("r.sections").alias("s")).select("entry_id", "s.kind", "s.origin", "s.text")
    m = P.merge(val, cur, sec, NOW)
    return m.select("source_id", "outcome", iso(F.col("ingested_at")).alias("ingested_at"), "title")


@query(
    "m17_import_tables",
    """WITH i AS (SELECT line_id AS n, documents.text, line_id % 3 <> 0 OR line_id % 9 <> 0 AND line_id % 6 = 0 AS w, line_id % 2 = 0 AS r FROM imported JOIN documents ON doc_id = line_id WHERE error IS NULL)
SELECT 'd' || n AS source_id, n % 3 <> 0 AS made, 1 AS same_id, 'details:extracted:' || sha256(CASE WHEN n % 9 = 0 THEN 'kept' ELSE text END) AS sections,
  CASE WHEN n % 9 = 0 THEN 'primary.0:old/' || n WHEN w AND r THEN 'primary.0:raw/' || n || '.md' END AS raw,
  CASE WHEN n % 9 = 0 THEN 'hash' WHEN w AND r THEN sha256(unhex('4000000000000000') || encode(sha256(text))) END AS raw_hash,
  CASE WHEN n % 9 = 0 OR w AND r THEN 'present' ELSE 'missing' END AS raw_status, CASE WHEN w AND n % 5 = 0 THEN 'done' WHEN w THEN 'none' ELSE 'kept' END AS summary_status,
  CASE WHEN NOT w THEN 'm-old:old:2024-01-01T00:00:00Z' WHEN n % 5 = 0 THEN 'm-imported:import:2024-01-05T00:00:00Z' END AS summary, CASE WHEN w THEN 0 ELSE 1 END AS items FROM i""",
    ("imported",),
)
def import_tables(v):
    """Sections, raw rows, hashes, summaries, items and entries of an import change together."""
    val = P.validate(import_lines(v), import_accounts(v))
    n = F.col("line_id")
    good = val.where(F.col("error").isNull() & (n % 3 == 0)).select(n.alias("n"), "account_id", "r")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    k = F.col("n")
    entries = good.select(
        k.alias("id"), "account_id", F.col("r.source_kind").alias("source_kind"), F.col("r.source_id").alias("source_id"), none("source_url", "string"), F.col("r.title").alias("title"),
        none("source_created_at", "timestamp"), none("source_updated_at", "timestamp"), F.lit("2024-02-01").cast("timestamp").alias("ingested_at"), F.lit("{}").alias("metadata"),
        F.when(k % 9 == 0, "present").otherwise("missing").alias("raw_status"), F.when(k % 9 == 0, "hash").alias("raw_hash"), F.lit("kept").alias("summary_status"))
    text = F.when(k % 9 == 0, "kept").when(k % 6 == 0, "old").otherwise(F.col("r.sections")[0]["text"])
    sections = good.select(k.alias("entry_id"), F.lit("details").alias("kind"), F.lit("extracted").alias("origin"), F.lit(4).alias("position"), text.alias("text"))
    raw = good.where(k % 9 == 0).select(k.alias("entry_id"), "account_id", F.lit("primary").alias("role"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("old/"), k.cast("string")).alias("path"),
                                        F.lit("text/markdown").alias("media_type"), F.lit("x").alias("sha256"), F.lit(1).cast("long").alias("size"))
    summaries = good.select(k.alias("entry_id"), F.lit("m-old").alias("model"), F.lit("old").alias("input_hash"), F.lit("llm_api").alias("generator_kind"), F.lit("2024-01-01").cast("timestamp").alias("generated_at"))
    items = good.select(k.alias("entry_id"), F.lit("x").alias("text"))
    files = v.table("documents").select(F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    top = entries.agg(F.max("id")).scalar()
    t = P.apply_import({"entries": entries, "sections": sections, "raw_objects": raw, "summaries": summaries, "items": items}, P.merge(val, entries, sections, NOW), files, NOW)
    of = lambda df, what, name: df.groupBy(F.col("entry_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(what)), "|").alias(name))
    parts = [
        of(t["sections"], F.concat_ws(":", "kind", "origin", F.sha2("text", 256)), "sections"), of(t["raw_objects"], F.concat("role", F.lit("."), F.col("seq").cast("string"), F.lit(":"), "path"), "raw"),
        of(t["summaries"], F.concat_ws(":", "model", "input_hash", iso(F.col("generated_at"))), "summary"), t["items"].groupBy(F.col("entry_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("items")),
    ]
    out = t["entries"]
    for part in parts:
        out = out.join(part, "id", "left")
    return out.select("source_id", (F.col("id") > top).alias("made"), F.count(F.lit(1)).over(W.partitionBy("id")).cast("int").alias("same_id"), "sections", "raw", "raw_hash", "raw_status", "summary_status",
                      "summary", F.coalesce("items", F.lit(0)).alias("items"))


@query(
    "a26_import_report",
    """SELECT CASE WHEN error IS NULL THEN 'valid' ELSE 'invalid' END AS outcome, count(*) AS count FROM imported GROUP BY 1""",
    ("imported",),
)
def import_report(v):
    """Counters of a dry import."""
    return P.report(P.validate(import_lines(v), import_accounts(v)))


@query(
    "s3_media_types",
    """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/x-ndjson' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/html' WHEN 4 THEN 'text/html' WHEN 5 THEN 'text/plain' ELSE 'application/octet-stream' END AS media_type FROM part""",
)
def media_types(v):
    """S3: media type by extension."""
    exts = F.array(*[F.lit(x) for x in (".md", ".JSONL", ".json", ".html", ".htm", ".txt", "")])
    path = F.concat(F.lit("a.b/"), "p_name", exts[F.col("p_size") % 7])
    return v.table("part").select("p_partkey", P.media_type(path).alias("media_type"))


def raw_by_kind(v):
    """The lines of documents stored as each source stores them: JSON messages, notes, HTML, or text."""
    words = F.trim(F.regexp_replace(F.regexp_replace("payload", "[^a-z ]", ""), " +", " "))
    said = F.concat(F.lit("n"), F.length("payload").cast("string"), F.lit(" "), words)
    first = F.col("seq") == 0
    message = F.to_json(F.struct(F.concat((F.lit(1704067200) + F.col("seq")).cast("string"), F.lit(".0")).alias("ts"), F.concat(F.lit("U"), F.col("seq") % 3).alias("user"), F.trim(said).alias("text")))
    note = F.concat(F.when(first, "### Summary\n").when(F.col("seq") == 1, "### Decisions\n").otherwise(""), F.trim(said))
    html = F.concat(F.when(first, "<html><head><title>T</title></head><body><article>").otherwise(""), F.lit("<p>"), F.trim(said), F.lit("</p>"))
    kind = F.col("source_kind")
    payload = F.when(kind.startswith("slack."), message).when(kind == "google.meet", note).when(kind == "web.page", html).otherwise(F.concat("payload", F.lit("  \r")))
    rows = v.raw_objects.join(v.entries.select(F.col("id").alias("entry_id"), "source_kind"), "entry_id")
    return rows.withColumn("payload", payload).drop("source_kind")


_RENORMALIZED = """WITH l AS (SELECT e.id AS entry_id, e.source_kind, i - 1 AS seq, p[i] AS line,
    trim('n' || length(p[i]) || ' ' || trim(regexp_replace(regexp_replace(p[i], '[^a-z ]', '', 'g'), ' +', ' ', 'g'))) AS said
  FROM (SELECT e.*, string_split(d.text, chr(10)) AS p FROM entries e JOIN documents d ON d.doc_id = e.id WHERE e.raw_status = 'present') e, range(1, 100000) r(i) WHERE i <= len(p)),
n AS (
  SELECT entry_id, 'details' AS kind, 'extracted' AS origin, string_agg(strftime(TIMESTAMP '2024-01-01' + to_seconds(seq), '%H:%M') || ' '
    || CASE seq % 3 WHEN 1 THEN 'U1' ELSE coalesce(nullif(trim(d.real_name), ''), nullif(trim(d.display_name), ''), nullif(trim(d.name), ''), 'U' || seq % 3) END || ': ' || said, chr(10) ORDER BY seq) AS text
  FROM l LEFT JOIN directory d ON d.user_id = 'U' || (seq % 3) WHERE source_kind LIKE 'slack.%' GROUP BY 1
  UNION ALL SELECT entry_id, 'details', 'extracted', string_agg(said, chr(10) || chr(10) ORDER BY seq) FROM l WHERE source_kind = 'web.page' GROUP BY 1
  UNION ALL SELECT entry_id, 'overview', 'generated', said FROM l WHERE source_kind = 'google.meet' AND seq = 0
  UNION ALL SELECT entry_id, 'decisions', 'generated', string_agg(said, chr(10) ORDER BY seq) FROM l WHERE source_kind = 'google.meet' AND seq > 0 GROUP BY 1
  UNION ALL SELECT entry_id, kind, origin, text FROM (SELECT entry_id, 'details' AS kind, 'extracted' AS origin, regexp_replace(regexp_replace(
      string_agg(regexp_replace(line, '[ \\t]+$', ''), chr(10) ORDER BY seq), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS text
    FROM l WHERE source_kind NOT LIKE 'slack.%' AND source_kind NOT IN ('web.page', 'google.meet') GROUP BY 1) WHERE trim(text) <> '')"""


@query("m18_reextracted_entries", _RENORMALIZED + " SELECT entry_id, kind, origin, sha256(text) AS text_sha256, length(text) AS n FROM n", ("entries", "directory"))
def reextract(v):
    """Sections recomputed from raw segments by the transform of each kind, text by text."""
    registry = N.normalizers(directory_labels(v.directory), "UTC")
    out = N.reextract(v.entries, raw_by_kind(v), registry)
    return out.select("entry_id", "kind", "origin", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n"))


@query(
    "m18_reextracted_tables",
    _RENORMALIZED + """, t AS (SELECT DISTINCT entry_id FROM n), b AS (SELECT entry_id, kind, origin, text FROM sections),
k AS (SELECT entry_id, kind, origin, text FROM b WHERE NOT (origin IN ('generated', 'extracted') AND entry_id IN (SELECT entry_id FROM n WHERE n.origin = b.origin)) UNION ALL SELECT * FROM n),
w AS (SELECT *, row_number() OVER (PARTITION BY entry_id, kind ORDER BY CASE origin WHEN 'user' THEN 3 WHEN 'extracted' THEN 2 ELSE 1 END DESC) AS r FROM k)
SELECT e.id AS entry_id, (SELECT string_agg(kind || ':' || origin || ':' || sha256(text), '|' ORDER BY kind) FROM w WHERE w.entry_id = e.id AND r = 1) AS sections, e.id IN (SELECT entry_id FROM t) AS renewed FROM entries e""",
    ("entries", "sections", "directory"),
)
def reextract_tables(v):
    """Sections replaced by origin, and the entries concerned decided on anew."""
    tables = {"entries": v.entries.withColumn("updated_at", F.lit(None).cast("timestamp")), "sections": v.sections.drop("id"), "raw_objects": raw_by_kind(v), "summaries": v.summaries}
    after = N.reextract_tables(tables, v.entries, N.normalizers(directory_labels(v.directory), "UTC"), NOW)
    parts = F.array_sort(F.collect_list(F.struct("kind", F.concat_ws(":", "kind", "origin", F.sha2("text", 256)).alias("s"))))
    sec = after["sections"].groupBy("entry_id").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "|").alias("sections"))
    e = after["entries"].select(F.col("id").alias("entry_id"), F.coalesce(F.col("updated_at") == F.lit(NOW).cast("timestamp"), F.lit(False)).alias("renewed"))
    return e.join(sec, "entry_id", "left").select("entry_id", "sections", "renewed")


_COMMITTED = f"""SELECT e.id, CASE WHEN d THEN 'done' ELSE summary_status END AS summary_status, CASE WHEN d THEN 0 ELSE summary_attempts END AS summary_attempts,
  CASE WHEN d THEN 'overview:sum ' || e.id ELSE (SELECT string_agg(kind || ':' || text, '|' ORDER BY position) FROM sections s WHERE s.entry_id = e.id AND s.origin = 'generated') END AS generated,
  CASE WHEN d THEN 1::BIGINT ELSE 0::BIGINT END AS items, CASE WHEN d THEN 'm-new' ELSE (SELECT model FROM summaries s WHERE s.entry_id = e.id) END AS model, CASE WHEN d THEN 0.5::DOUBLE END AS spent
FROM (SELECT *, summary_status IN ('pending', 'failed') AS d FROM entries) e"""


@query("m5_summary_commit", _COMMITTED, ("entries", "sections", "summaries"))
def summary_commit(v):
    """M5: sections, items, summary, status and ledger row of finished summaries change together."""
    tables, done = _summary_tables(v)
    return _committed(M.commit_summaries(tables, done, NOW))


@query("m5_commit_tables", _COMMITTED, ("entries", "sections", "summaries"))
def commit_tables(v):
    """M5: the same in commits to the touched buckets of five tables, one for the entries of each half."""
    tables, done = _summary_tables(v)
    store = CatalogStore(PartitionStore(v.spark, work_dir(v.spark, "catalog")))
    store.create(tables, 16)
    for half in (0, 1):
        store.commit_summaries(done.where(F.col("entry_id") % 2 == half), NOW)
    return _committed({n: store.read(n) for n in tables})


def _summary_tables(v):
    e = v.entries.withColumn("updated_at", F.lit(None).cast("timestamp"))
    items = v.spark.createDataFrame([], "entry_id long, ordinal int, kind string, text string")
    ledger = v.spark.createDataFrame([], "entry_id long, at timestamp, model string, cost_usd double, outcome string")
    done = e.where(F.col("summary_status").isin("pending", "failed")).select(
        F.col("id").alias("entry_id"),
        F.array(F.struct(F.lit("overview").alias("kind"), F.concat(F.lit("sum "), F.col("id").cast("string")).alias("text"))).alias("drafts"),
        F.array(F.struct(F.lit("decision").alias("kind"), F.lit("x").alias("text"))).alias("items"), F.lit("llm_api").alias("generator_kind"), F.lit("p").alias("provider"),
        F.lit("m-new").alias("model"), F.lit("default").alias("profile"), F.lit("document-summary/v4").alias("prompt_version"), F.lit("b2:x").alias("input_hash"), F.lit(0.5).alias("cost_usd"))
    return {"entries": e, "sections": v.sections.drop("id"), "items": items, "summaries": v.summaries, "ledger": ledger}, done


def _committed(t):
    gen = t["sections"].where(F.col("origin") == "generated").groupBy(F.col("entry_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "kind", "text"))), lambda s: F.concat_ws(":", s["kind"], s["text"])), "|").alias("generated"))
    n = t["items"].groupBy(F.col("entry_id").alias("id")).agg(F.count(F.lit(1)).alias("items"))
    spent = t["ledger"].groupBy(F.col("entry_id").alias("id")).agg(F.sum("cost_usd").alias("spent"))
    out = t["entries"].join(gen, "id", "left").join(n, "id", "left").join(spent, "id", "left").join(t["summaries"].select(F.col("entry_id").alias("id"), "model"), "id", "left")
    return out.select("id", "summary_status", "summary_attempts", "generated", F.coalesce("items", F.lit(0)).alias("items"), "model", "spent")
