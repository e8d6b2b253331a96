"""Document links over pages and line items."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from lorekeep.functions import urls as U
from lorekeep.functions.times import iso
from lorekeep.operators import links as L
from lorekeep.plans import query
from lorekeep.plans.ctes import cte, iso as SI

NOW = datetime(1998, 9, 1, tzinfo=UTC)
_NOW = "TIMESTAMP '1998-09-01'"

cte(
    "links",
    r"""
SELECT 'src' || (l_suppkey % 20) AS account_id, 'key' || l_suppkey || '-' || l_partkey AS link_key,
  CASE WHEN l_partkey % 3 = 0 THEN 'microsoft.file' ELSE 'google.doc' END AS source_kind, 'https://h' || (l_partkey % 5) || '.example.org/' || l_partkey AS url,
  'h' || (l_partkey % 5) || '.example.org' AS host, k // 3 AS first_entry_id, seen AS first_seen_at,
  CASE WHEN k % 7 <= 2 THEN 'pending' WHEN k % 7 = 3 THEN 'unavailable' WHEN k % 7 = 4 THEN 'ingested' WHEN k % 7 = 5 THEN 'abandoned' ELSE 'not_applicable' END AS status,
  CASE WHEN k % 7 = 4 THEN k END AS entry_id, CAST(k % 6 AS INT) AS attempts, CASE WHEN k % 4 <> 0 THEN seen + to_days(CAST(k % 40 AS INT)) END AS next_attempt_at,
  CASE WHEN k % 7 = 3 THEN 'no access' END AS last_error
FROM (SELECT l_suppkey, l_partkey, min(l_shipdate) AS seen, min(l_orderkey) AS k FROM lineitem GROUP BY 1, 2)""",
)
cte(
    "outcomes",
    """SELECT account_id, link_key, CASE (length(link_key) + attempts) % 5 WHEN 0 THEN 'ingested' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'unavailable' ELSE 'waiting' END AS outcome,
  'e' || (length(link_key) + attempts) AS error FROM links""",
    ("links",),
)


def _found(v):
    m = v.link_messages.withColumn("urls", U.text_urls(F.col("text")))
    return L.discover(m)


@query(
    "c10_message_urls",
    """SELECT message_id, page_url || ' https://team.sharepoint.com/s/' || (message_id // 3) || '?e=1&x=2 https://docs.google.com/document/d/doc' || (message_id // 4) || '/edit#h' || message_id AS urls FROM lm""",
    ("lm",),
)
def urls(v):
    """URLs of a message, wrapped before bare, entities resolved, each one once."""
    return v.link_messages.select("message_id", F.array_join(U.text_urls(F.col("text")), " ").alias("urls"))


@query("c11_document_links", "SELECT message_id, kind AS source_kind, link_key, url, host FROM link_refs", ("link_refs",))
def classified(v):
    """C11: document links among the URLs of a message."""
    return _found(v).select("message_id", "source_kind", "link_key", "url", "host")


cte(
    "firsts",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, link_key ORDER BY entry_id, ts, message_id, ord) AS r FROM link_refs) WHERE r = 1",
    ("link_refs",),
)


@query("w3_first_references", "SELECT account_id, link_key, entry_id, message_id FROM firsts", ("firsts",))
def firsts(v):
    """The first reference of every link of an account."""
    return L.first_references(_found(v)).select("account_id", "link_key", "entry_id", "message_id")


@query(
    "m12_link_scan",
    f"""WITH t AS (SELECT account_id, link_key, entry_id AS first_entry_id, CASE WHEN kind = 'google.doc' THEN 'pending' ELSE 'ingested' END AS status,
  CASE WHEN kind <> 'google.doc' THEN message_id END AS made FROM firsts WHERE contains('02468', substr(link_key, -1)))
SELECT f.account_id, f.link_key, coalesce(t.status, 'new') AS status, e.entry_uid AS from_uid, m.entry_uid AS entry_uid, {SI('to_timestamp(CAST(split_part(f.ts, chr(46), 1) AS BIGINT))::TIMESTAMP')} AS message_at
FROM firsts f LEFT JOIN t USING (account_id, link_key) LEFT JOIN entries e ON e.id = coalesce(t.first_entry_id, f.entry_id) LEFT JOIN entries m ON m.id = t.made""",
    ("firsts", "entries"),
)
def scan(v):
    """Links of stored conversations with their state; the table here holds the links whose key ends in an even digit."""
    found = _found(v)
    first = L.first_references(found)
    google = F.col("source_kind") == "google.doc"
    table = first.where(F.substring("link_key", -1, 1).isin(*"02468")).select(
        "account_id", "link_key", F.when(google, "pending").otherwise("ingested").alias("status"), F.col("entry_id").alias("first_entry_id"),
        F.when(~google, F.col("message_id")).alias("entry_id"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("next_attempt_at"),
    )
    s = L.scan(found, table, v.entries)
    return s.select("account_id", "link_key", "status", "from_uid", "entry_uid", iso(F.col("message_at")).alias("message_at"))


@query(
    "o8_link_listing",
    """SELECT account_id, link_key, url, (SELECT greatest(count(*) - 40, 0) FROM firsts) AS not_listed FROM firsts
ORDER BY ts DESC, url, link_key, account_id LIMIT 40""",
    ("firsts",),
)
def listing(v):
    """Newest message first with the number of links left out."""
    found = _found(v)
    none = L.first_references(found).select("account_id", "link_key", F.lit("new").alias("status"), F.col("entry_id").alias("first_entry_id"), F.lit(None).cast("long").alias("entry_id"),
                                            F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("next_attempt_at"))
    return L.listing(L.scan(found, none, v.entries), 40).select("account_id", "link_key", "url", "not_listed")


@query(
    "p19_due_links",
    f"""SELECT account_id, link_key, status FROM links WHERE (status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW}))
  OR (status = 'unavailable' AND next_attempt_at <= {_NOW})""",
    ("links",),
)
def due(v):
    """Links that may be tried now."""
    return v.links.where(L.is_due(NOW)).select("account_id", "link_key", "status")


@query(
    "w17_links_per_run",
    f"""SELECT account_id, link_key, row_number() OVER (ORDER BY account_id, first_seen_at DESC, link_key) AS rank, row_number() OVER (ORDER BY account_id, first_seen_at DESC, link_key) <= 50 AS selected
FROM links l JOIN accounts a ON a.id = l.account_id WHERE a.kind = 'slack' AND a.status <> 'disabled' AND contains(a.config, '"' || l.source_kind || '"') AND l.host IN ('h1.example.org', 'h2.example.org', 'h3.example.org')
  AND ((l.status = 'pending' AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW})) OR (l.status = 'unavailable' AND next_attempt_at <= {_NOW}))""",
    ("links", "accounts"),
)
def per_run(v):
    """The first links of a run over all accounts; the rest is deferred."""
    r = L.select_due(v.links, v.accounts, NOW, 50, hosts=["H1.example.*", "h2.*", "h3.example.org"])
    return r.select("account_id", "link_key", "rank", "selected")


@query(
    "m10_link_outcomes",
    f"""SELECT l.account_id, l.link_key, CASE WHEN outcome IN ('ingested', 'duplicate', 'not_applicable') THEN outcome WHEN outcome = 'unavailable' THEN CASE WHEN attempts + 1 >= 5 THEN 'abandoned' ELSE 'unavailable' END ELSE status END AS status,
  CASE WHEN outcome IN ('ingested', 'duplicate') THEN 7 ELSE entry_id END AS entry_id, CASE WHEN outcome = 'unavailable' THEN attempts + 1 ELSE attempts END AS attempts,
  {SI(f"CASE WHEN outcome IN ('ingested', 'duplicate', 'not_applicable') THEN NULL WHEN outcome = 'unavailable' THEN CASE WHEN attempts + 1 >= 5 THEN NULL ELSE {_NOW} + to_days(CASE attempts + 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 14 ELSE 30 END) END ELSE next_attempt_at END")} AS next_attempt_at,
  CASE WHEN outcome IN ('ingested', 'duplicate') THEN NULL ELSE error END AS last_error FROM links l JOIN outcomes o ON o.account_id = l.account_id AND o.link_key = l.link_key""",
    ("links", "outcomes"),
)
def outcomes(v):
    """Link state after a run, with backoff and abandonment."""
    n = L.apply_outcomes(v.links, v.link_outcomes, NOW, 5)
    return n.select("account_id", "link_key", "status", "entry_id", "attempts", iso(F.col("next_attempt_at")).alias("next_attempt_at"), "last_error")


@query(
    "a27_link_outcome_counts",
    "SELECT CASE WHEN outcome = 'unavailable' AND attempts + 1 >= 5 THEN 'abandoned' ELSE outcome END AS outcome, count(*) AS count FROM links JOIN outcomes USING (account_id, link_key) GROUP BY 1",
    ("links", "outcomes"),
)
def counts(v):
    """Counters of a link run."""
    return L.outcome_counts(v.links, v.link_outcomes, 5)


@query(
    "m11_link_retry",
    "SELECT link_key, CASE WHEN b THEN 'pending' ELSE status END AS status, CASE WHEN b THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT b THEN "
    + SI("next_attempt_at") + " END AS next_attempt_at FROM (SELECT *, status IN ('unavailable', 'abandoned') AS b FROM links)",
    ("links",),
)
def retried(v):
    """Failed links go back to pending."""
    return L.retry(v.links).select("link_key", "status", "attempts", iso(F.col("next_attempt_at")).alias("next_attempt_at"))


@query(
    "a12_link_counts",
    "SELECT 'all' AS scope, status, count(*) AS count FROM links GROUP BY 2 UNION ALL SELECT 'src3', status, count(*) FROM links WHERE account_id = 'src3' GROUP BY 2",
    ("links",),
)
def link_counts(v):
    """Links by status, for all accounts and for one."""
    one = L.status_counts(v.links, "src3").select(F.lit("src3").alias("scope"), "status", "count")
    return L.status_counts(v.links).select(F.lit("all").alias("scope"), "status", "count").unionByName(one)


@query(
    "a28_links_waiting",
    """SELECT need, count(*) FILTER (WHERE status = 'pending' AND contains(config, '"' || source_kind || '"') AND need NOT IN (SELECT kind FROM accounts WHERE status = 'active' AND kind <> 'google')) AS waiting,
  count(*) FILTER (WHERE status = 'abandoned') AS abandoned
FROM (SELECT l.*, a.config, CASE WHEN source_kind = 'microsoft.file' THEN 'microsoft' ELSE 'google' END AS need FROM links l JOIN accounts a ON a.id = l.account_id WHERE a.kind = 'slack') GROUP BY 1""",
    ("links", "accounts"),
)
def waiting(v):
    """Links that wait for an account kind nobody has (here: no active google account), and abandoned ones."""
    acc = v.accounts.withColumn("status", F.when(F.col("kind") == "google", "disabled").otherwise(F.col("status")))
    return L.waiting_for_account(v.links, acc)


@query(
    "j23_link_provenance",
    """SELECT f.account_id, f.link_key, 'ctx ' || f.message_id AS link_context, e.entry_uid AS via_uid, e.source_url AS via_url, '1' AS kept FROM firsts f LEFT JOIN entries e ON e.id = f.entry_id""",
    ("firsts", "entries"),
)
def provenance(v):
    """Where a document was found, added to its metadata."""
    first = L.first_references(_found(v))
    links = first.select("account_id", "link_key", F.concat(F.lit("ctx "), F.col("message_id").cast("string")).alias("excerpt"), F.col("entry_id").alias("first_entry_id"))
    docs = first.select("account_id", "link_key", F.lit('{"kept":1,"link_context":"old"}').alias("metadata"))
    p = L.with_provenance(docs, links, v.entries)
    g = lambda k: F.get_json_object("metadata", f"$.{k}")
    return p.select("account_id", "link_key", g("link_context").alias("link_context"), g("discovered_via.entry_uid").alias("via_uid"), g("discovered_via.url").alias("via_url"), g("kept").alias("kept"))


@query(
    "c12_canonical_urls",
    r"""SELECT page_id, CASE WHEN contains(u, '?') THEN u ELSE u END AS canonical FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_source=feed$', '') AS u FROM pages)""",
)
def canonical(v):
    """Page identity without fragment and tracking parameters."""
    return v.table("pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(
    "c13_locator_routes",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'google' WHEN 1 THEN 'rejected' WHEN 2 THEN 'microsoft' WHEN 3 THEN 'rejected' WHEN 4 THEN 'local' WHEN 5 THEN 'rejected' WHEN 6 THEN 'local' ELSE 'web' END AS route,
 CASE page_id % 8 WHEN 0 THEN 'id' || page_id WHEN 1 THEN 'a folder, not a file' WHEN 2 THEN 'https://x.sharepoint.com/' || page_id WHEN 3 THEN 'conversations are synced' WHEN 4 THEN '/tmp/' || page_id
   WHEN 5 THEN 'unsupported scheme ftp' WHEN 6 THEN 'notes/' || page_id || '.md' ELSE url END AS detail FROM pages""",
)
def routes(v):
    """Document, drive, web, local and rejected locators."""
    i = F.col("page_id").cast("string")
    forms = [
        F.concat(F.lit("https://docs.google.com/document/u/0/d/id"), i, F.lit("/edit")), F.concat(F.lit("https://drive.google.com/drive/folders/"), i),
        F.concat(F.lit("https://x.sharepoint.com/"), i), F.concat(F.lit("https://t.slack.com/archives/C1/p"), i),
        F.concat(F.lit("file:///tmp/"), i), F.concat(F.lit("ftp://h/"), i), F.concat(F.lit("notes/"), i, F.lit(".md")), F.col("url"),
    ]
    loc = F.array(*forms)[(F.col("page_id") % 8).cast("int")]
    return v.table("pages").select("page_id", U.route(loc).alias("r")).select("page_id", "r.route", "r.detail")
