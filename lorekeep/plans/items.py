"""Item queries over orders, and drafts checked against documents."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions.times import iso, parse_date
from lorekeep.operators import items as I
from lorekeep.operators.search_index import SearchIndex
from lorekeep.operators.skew import cut
from lorekeep.plans import query
from lorekeep.plans.ctes import cte, grams, iso as SI, name_norm, norm
from lorekeep.session import work_dir
from lorekeep.sources.partitions import PartitionStore

NOW = datetime(2001, 9, 1, tzinfo=UTC)
_AT = "coalesce(i.occurred_at, e.source_updated_at, e.source_created_at, e.ingested_at)"
_RANK = "CASE {c} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"

cte(
    "eff",
    f"""
SELECT i.*, CASE WHEN status IS NULL OR status <> 'open' THEN status WHEN sup THEN 'superseded'
    WHEN res THEN CASE kind WHEN 'question' THEN 'answered' ELSE 'done' END ELSE 'open' END AS effective_status
FROM (SELECT t.*, EXISTS (SELECT 1 FROM item_links l LEFT JOIN items f ON f.id = l.from_item WHERE l.to_item = t.id AND l.relation = 'supersedes'
          AND {_RANK.format(c='l.confidence')} >= 1 AND (f.occurred_at IS NULL OR t.occurred_at IS NULL OR f.occurred_at > t.occurred_at)) AS sup,
        EXISTS (SELECT 1 FROM item_links l LEFT JOIN items f ON f.id = l.from_item WHERE l.to_item = t.id AND l.relation = 'resolves'
          AND {_RANK.format(c='l.confidence')} >= 1 AND (f.occurred_at IS NULL OR t.occurred_at IS NULL OR f.occurred_at > t.occurred_at)) AS res
      FROM items t) i""",
    ("items", "item_links"),
)
cte(
    "full_items",
    f"""
SELECT i.*, e.account_id, e.source_kind, e.title, s.model, {_AT} AS item_at, {_RANK.format(c='i.confidence')} AS conf_rank,
  coalesce(i.effective_status = 'open' AND greatest(i.occurred_at, l.latest) < TIMESTAMP '2001-09-01' - INTERVAL 30 DAY, false) AS stale
FROM eff i JOIN item_entries e ON e.id = i.entry_id LEFT JOIN item_summaries s ON s.entry_id = e.id
LEFT JOIN (SELECT scope_key, max(occurred_at) AS latest FROM items GROUP BY 1) l ON l.scope_key = i.scope_key""",
    ("eff", "item_entries", "item_summaries"),
)


@query(
    "j3_items_with_entries",
    f"SELECT i.id, i.kind, e.account_id, e.source_kind, s.model, {SI(_AT)} AS item_at FROM items i JOIN item_entries e ON e.id = i.entry_id LEFT JOIN item_summaries s ON s.entry_id = e.id",
    ("items", "item_entries", "item_summaries"),
)
def joined(v):
    """Items with their entry and summary; item time with its fallbacks."""
    from lorekeep.functions.times import item_at

    return I.joined(v.items, v.item_entries, v.item_summaries).select("id", "kind", "account_id", "source_kind", "model", iso(item_at()).alias("item_at"))


@query(
    "p7_item_filter",
    f"""SELECT i.id, i.kind, i.confidence FROM items i JOIN item_entries e ON e.id = i.entry_id
WHERE i.kind = 'action' AND e.source_kind IN ('slack.thread', 'slack.day') AND e.account_id IN ('acct1', 'acct2', 'acct3', 'acct7')
  AND {_AT} >= TIMESTAMP '1996-01-01' AND {_AT} < TIMESTAMP '2001-01-01' AND i.due IS NOT NULL AND i.due <= DATE '2000-06-30' AND i.confidence IN ('medium', 'high')""",
    ("items", "item_entries"),
)
def item_filter(v):
    """Kinds, accounts, sources, time range, due date and confidence floor."""
    q = I.ItemQuery(
        kinds=["action"], source_kinds=["slack.thread", "slack.day"], accounts=["acct1", "acct2", "acct3", "acct7"],
        since=parse_date("1996-01-01"), until=parse_date("2001-01-01"), due_by=date(2000, 6, 30),
    )
    rows = I.joined(v.items, v.item_entries, v.item_summaries).where(I.item_predicate(q))
    return rows.where(I.rank(F.col("confidence")) >= 1).select("id", "kind", "confidence")


@query("j9_effective_status", "SELECT id, kind, status, effective_status FROM eff", ("eff",))
def effective(v):
    """Own status, then strong later links folded per target."""
    return I.with_effective_status(v.items, v.item_links).select("id", "kind", "status", "effective_status")


@query(
    "a13_scope_latest",
    f"SELECT scope_key, {SI('max(occurred_at)')} AS latest FROM items GROUP BY 1",
    ("items",),
)
def latest(v):
    """Latest time of every scope."""
    return I.scope_latest(v.items).select("scope_key", iso(F.col("scope_latest")).alias("latest"))


@query("a10_stale_items", "SELECT id, effective_status, stale FROM full_items", ("full_items",))
def stale(v):
    """Open items with nothing newer in their scope for 30 days."""
    items = I.with_effective_status(v.items, v.item_links)
    return I.with_stale(items, v.items, 30, NOW).select("id", "effective_status", "stale")


def _ask(v, q, aliases=None):
    return I.query_items(v.items, v.item_entries, v.item_summaries, v.item_links, q, NOW, aliases)


@query(
    "p8_status_filter",
    """SELECT id, kind, effective_status FROM full_items WHERE conf_rank >= 1 AND CASE WHEN effective_status IS NULL
  THEN kind IN ('resolved', 'accomplishment') ELSE effective_status IN ('done', 'superseded') END""",
    ("full_items",),
)
def status_filter(v):
    """Derived status filter; kinds without a status count as done when they report finished work."""
    return _ask(v, I.ItemQuery(statuses=["done", "superseded"])).where("shown").select("id", "kind", "effective_status")


@query("p10_stale_filter", "SELECT id FROM full_items WHERE stale AND conf_rank >= 0", ("full_items",))
def stale_filter(v):
    """P10: stale items only, any confidence."""
    return _ask(v, I.ItemQuery(stale=True, min_confidence="low")).where("shown").select("id")


@query(
    "p11_hidden_low_confidence",
    """SELECT count(*) FILTER (WHERE conf_rank >= 2) AS total, count(*) FILTER (WHERE conf_rank < 2) AS hidden_low_confidence
FROM full_items WHERE kind IN ('action', 'question') AND effective_status = 'open'""",
    ("full_items",),
)
def hidden(v):
    """Matches shown, and those hidden by the floor alone."""
    return I.answer_counts(_ask(v, I.ItemQuery(kinds=["action", "question"], statuses=["open"], min_confidence="high")))


@query(
    "o4_action_order",
    f"""SELECT id, CAST(due AS VARCHAR) AS due, {SI('occurred_at')} AS occurred_at FROM full_items WHERE kind = 'action' AND effective_status = 'open' AND conf_rank >= 1
ORDER BY full_items.due ASC NULLS LAST, full_items.occurred_at DESC NULLS LAST, id DESC""",
    ("full_items",),
)
def action_order(v):
    """Open actions by due date, undated last."""
    rows = _ask(v, I.ItemQuery(kinds=["action"], statuses=["open"])).where("shown")
    return rows.orderBy(*I.answer_order(["action"])).select("id", F.col("due").cast("string").alias("due"), iso(F.col("occurred_at")).alias("occurred_at"))


_ALIASES = """
SELECT DISTINCT lower(trim(n)) AS n FROM (SELECT unnest(list_concat(CAST(json_extract(config, '$.aliases.names') AS VARCHAR[]),
  coalesce(CAST(json_extract(config, '$.extra_aliases.names') AS VARCHAR[]), []))) AS n FROM accounts WHERE status <> 'disabled')"""


@query(
    "u1_alias_union",
    """SELECT field, lower(value) AS key, arg_min(value, pos) AS value FROM (
  SELECT 'names' AS field, unnest(CAST(json_extract(config, '$.aliases.names') AS VARCHAR[])) AS value, id || '0' || unnest(range(len(CAST(json_extract(config, '$.aliases.names') AS VARCHAR[])))) AS pos FROM accounts WHERE status <> 'disabled'
  UNION ALL SELECT 'names', unnest(CAST(json_extract(config, '$.extra_aliases.names') AS VARCHAR[])), id || '1' || unnest(range(len(CAST(json_extract(config, '$.extra_aliases.names') AS VARCHAR[])))) FROM accounts WHERE status <> 'disabled'
  UNION ALL SELECT 'emails', unnest(CAST(json_extract(config, '$.aliases.emails') AS VARCHAR[])), id || '0' FROM accounts WHERE status <> 'disabled') GROUP BY 1, 2""",
    ("accounts",),
)
def alias_union(v):
    """Names and emails of enabled accounts, case-insensitively distinct."""
    return I.alias_union(v.accounts).select("field", "key", "value")


@query(
    "p9_mine",
    f"""WITH al AS ({_ALIASES})
SELECT id, kind, CASE WHEN kind IN ('action', 'question') THEN 'owner' ELSE 'actor' END AS match_field, 'name' AS match_basis FROM full_items i
WHERE conf_rank >= 1 AND EXISTS (SELECT 1 FROM al WHERE (i.kind IN ('action', 'question') AND al.n = lower(i.owner))
  OR (i.kind NOT IN ('action', 'question') AND list_contains(list_transform(i.actors, lambda a: lower(a)), al.n)))""",
    ("full_items", "accounts"),
)
def mine(v):
    """Items of the user: the owner of an action or question, any actor otherwise."""
    return _ask(v, I.ItemQuery(who="mine"), I.alias_union(v.accounts)).where("shown").select("id", "kind", "match_field", "match_basis")


@query(
    "p9_asked_by_me",
    f"""WITH al AS ({_ALIASES}) SELECT id, requester FROM full_items i WHERE conf_rank >= 1 AND lower(requester) IN (SELECT n FROM al)""",
    ("full_items", "accounts"),
)
def asked(v):
    """Items the user asked for."""
    return _ask(v, I.ItemQuery(who="asked_by_me"), I.alias_union(v.accounts)).where("shown").select("id", "requester")


@query("p9_owned_by", "SELECT id, owner FROM full_items WHERE conf_rank >= 1 AND owner = 'Customer 7'", ("full_items",))
def owned(v):
    """Items owned by a name, written in any spelling."""
    return _ask(v, I.ItemQuery(who="owner", owner="7, CUSTOMER")).where("shown").select("id", "owner")


@query(
    "a11_items_coverage",
    """SELECT count(*) AS entries_in_range, count(*) FILTER (WHERE has) AS entries_with_items, count(*) FILTER (WHERE un) AS unsummarized,
  count(*) FILTER (WHERE old) AS predate_items, count(*) FILTER (WHERE nat) AS native, count(*) FILTER (WHERE un OR old OR nat) AS entries_without_items
FROM (SELECT EXISTS (SELECT 1 FROM items i WHERE i.entry_id = e.id AND i.kind = 'action') AS has, summary_status IN ('pending', 'skipped', 'failed') AS un,
   summary_status = 'done' AND coalesce(generator_kind, '') <> 'source_native' AND NOT coalesce(prompt_version IN ('conversation-summary/v2', 'meeting-summary/v2', 'document-summary/v4'), false) AS old,
   summary_status = 'done' AND coalesce(generator_kind = 'source_native', false) AS nat
  FROM item_entries e LEFT JOIN item_summaries s ON s.entry_id = e.id
  WHERE coalesce(source_updated_at, source_created_at, ingested_at) >= TIMESTAMP '1996-01-01')""",
    ("items", "item_entries", "item_summaries"),
)
def coverage(v):
    """Entries that can and cannot answer item questions (items here: actions)."""
    actions = v.items.where(F.col("kind") == "action")
    return I.items_coverage(v.item_entries, v.item_summaries, actions, I.in_range(parse_date("1996-01-01"), None))


_G = grams("lower(t.text)")
_GP = grams("lower(p.text)")


@query(
    "j10_candidates",
    f"""WITH tx AS (SELECT text, {grams("text")} AS g FROM (SELECT DISTINCT lower(text) AS text FROM items)),
sim AS (SELECT a.text AS x, b.text AS y, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s FROM tx a, tx b),
t AS (SELECT id, entry_id, scope_key, lower(text) AS text, occurred_at, list_distinct(list_filter(list_concat(actors, [owner, requester]), lambda x: x IS NOT NULL)) AS people FROM eff
  WHERE effective_status = 'open' AND kind IN ('action', 'question') AND occurred_at IS NOT NULL),
p AS (SELECT id, entry_id, scope_key, lower(text) AS text, occurred_at, list_distinct(list_filter(list_concat(actors, [owner, requester]), lambda x: x IS NOT NULL)) AS people FROM items
  WHERE (kind IN ('resolved', 'accomplishment', 'decision') OR (kind = 'action' AND status IN ('done', 'dropped'))) AND occurred_at IS NOT NULL),
k AS (SELECT DISTINCT t.id AS tid, p.id AS pid FROM t JOIN p ON t.scope_key = p.scope_key
  UNION SELECT DISTINCT a.id, b.id FROM (SELECT id, unnest(people) AS who FROM t) a JOIN (SELECT id, unnest(people) AS who FROM p) b ON a.who = b.who),
c AS (SELECT t.id AS target_id, p.id AS candidate_id, s.s AS similarity, t.scope_key = p.scope_key AS same_scope, list_has_any(t.people, p.people) AS shared_person,
   row_number() OVER (PARTITION BY t.id ORDER BY s.s DESC, p.occurred_at, p.id) AS rank
  FROM k JOIN t ON t.id = k.tid JOIN p ON p.id = k.pid JOIN sim s ON s.x = t.text AND s.y = p.text
  WHERE t.entry_id <> p.entry_id AND p.occurred_at > t.occurred_at AND p.occurred_at <= t.occurred_at + INTERVAL 60 DAY AND s.s >= 0.2)
SELECT target_id, candidate_id, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity, same_scope, shared_person FROM c WHERE rank <= 3""",
    ("eff",),
)
def candidates(v):
    """Up to three later closers per open item, by scope or person and text similarity."""
    eff = I.with_effective_status(v.items, v.item_links)
    c = I.candidates(I.open_targets(eff), I.closure_pool(v.items))
    return c.withColumn("similarity", F.round("similarity", 6))


_CONTAINED = f"SELECT b.item_id AS quote_id, d.doc_id AS text_id FROM benchmark b, documents d WHERE contains({norm('d.text')}, {norm('b.text')})"


@query("j11_indexed_containment", _CONTAINED)
def indexed_containment(v):
    """The same by the rarest grams of each passage in the postings of a maintained index."""
    none = [F.lit(None).cast("string").alias(c) for c in ("account_id", "source_kind")]
    docs = v.table("documents").select(
        F.col("doc_id").alias("section_id"), F.col("doc_id").alias("entry_id"), F.lit("details").alias("kind"), F.lit(0).alias("position"), F.lit("").alias("title"), *none,
        F.lit(None).cast("timestamp").alias("date"), X.match_norm(F.col("text")).alias("text"))
    index = SearchIndex(PartitionStore(v.spark, work_dir(v.spark, "norm-index")), gram_buckets=16, row_buckets=8)
    index.rebuild(cut(docs, "norm-texts"))
    q = v.table("benchmark").select(F.col("item_id").alias("quote_id"), X.match_norm(F.col("text")).alias("quote"))
    return index.containing(cut(q, "norm-quotes")).select("quote_id", F.col("section_id").alias("text_id"))


@query("j11_evidence_containment", _CONTAINED)
def containment(v):
    """Benchmark passages that occur in a document after match normalization."""
    q = v.table("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    t = v.table("documents").select(F.col("doc_id").alias("text_id"), "text")
    return I.evidence_containment(q, t)


@query("c1_match_norm", f"SELECT doc_id, sha256({norm('text')}) AS norm_hash FROM documents")
def match_norm(v):
    """Match normalization of whole documents (compared by hash)."""
    return v.table("documents").select("doc_id", F.sha2(X.match_norm(F.col("text")), 256).alias("norm_hash"))


@query("c4_name_norm", f"SELECT doc_id, {name_norm('split_part(text, chr(10), 1)')} AS name FROM documents")
def name_normal(v):
    """C4: name normalization of first lines."""
    return v.table("documents").select("doc_id", X.name_norm(F.split_part("text", F.lit("\n"), F.lit(1))).alias("name"))


@query(
    "c3_consecutive_similarity",
    f"""SELECT a.conv_id, a.turn, round(CASE WHEN len({grams('a.t')}) = 0 OR len({grams('b.t')}) = 0 THEN 0 ELSE
  len(list_intersect({grams('a.t')}, {grams('b.t')})) / len(list_distinct(list_concat({grams('a.t')}, {grams('b.t')}))) END, 6) AS similarity
FROM (SELECT conv_id, turn, {norm('text')} AS t FROM conversations) a JOIN (SELECT conv_id, turn, {norm('text')} AS t FROM conversations) b
  ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def similarity(v):
    """Trigram similarity of every turn with the next one."""
    c = v.table("conversations").select("conv_id", "turn", X.match_norm(F.col("text")).alias("n"))
    c = c.select("conv_id", "turn", X.grams(F.col("n")).alias("g"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


# -- drafts ---------------------------------------------------------------------------------------------------


def draft_outputs(v):
    """A model answer per document: five drafts whose evidence is and is not in the text, wrapped in prose."""
    d = v.table("documents").select("doc_id", "text")
    i = F.col("doc_id")

    def draft(**kw):
        return F.struct(*[c.alias(k) for k, c in kw.items()])

    n = F.lit(None).cast("string")
    part = F.substring("text", 5, 40)
    drafts = F.array(
        draft(kind=F.lit("Action"), text=F.concat(F.lit("do "), i.cast("string")), status=F.lit("done"), evidence=part, due=F.lit("2024-02-30"), owner=F.lit(" Ann "), confidence=F.lit("HIGH")),
        draft(kind=F.lit("action"), text=F.lit("next"), status=n, evidence=F.lit("nowhere at all"), due=F.lit("2024-03-05"), owner=F.lit(""), confidence=F.lit("high")),
        draft(kind=F.lit("resolved"), text=F.lit("fixed"), status=n, evidence=F.concat(F.lit("**"), part, F.lit("** ~")), due=n, owner=F.lit("Bob"), confidence=F.lit("medium")),
        draft(kind=F.lit("question"), text=F.lit("why"), status=F.lit("answered"), evidence=F.substring("text", 1, 3), due=n, owner=n, confidence=F.lit("sure")),
        draft(kind=F.lit("idea"), text=F.lit("x"), status=n, evidence=part, due=n, owner=n, confidence=F.lit("high")),
    )
    body = F.to_json(F.struct(F.substring("text", 1, 20).alias("overview"), drafts.alias("items")))
    return d.select("doc_id", F.col("text").alias("body"), F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")).alias("output"))


def _parsed(v):
    return I.parse_output(draft_outputs(v)).select(F.col("doc_id").alias("entry_id"), "body", "drafts")


def _validated(v):
    e = v.entries.select(F.col("id").alias("entry_id"), "source_kind", "source_id", "title", "metadata", "source_created_at", "source_updated_at")
    return I.validate(_parsed(v).join(e, "entry_id"))


_NB = norm("d.text")
_NP = norm("substr(d.text, 5, 40)")
_NS = norm("substr(d.text, 1, 3)")
cte(
    "valid",
    f"""
SELECT * FROM (
SELECT doc_id AS entry_id, 0 AS pos, 'kept' AS outcome, NOT ok AS downgraded, 'action' AS kind, 'do ' || doc_id AS text, CASE WHEN ok THEN 'done' ELSE 'open' END AS status,
  'Ann' AS owner, NULL AS due, CASE WHEN ok THEN 'high' ELSE 'low' END AS confidence FROM base
UNION ALL SELECT doc_id, 1, 'kept', true, 'action', 'next', 'open', NULL, '2024-03-05', 'low' FROM base
UNION ALL SELECT doc_id, 2, CASE WHEN ok THEN 'kept' ELSE 'dropped' END, false, 'resolved', 'fixed', NULL, NULL, NULL, CASE WHEN ok THEN 'medium' ELSE 'low' END FROM base
UNION ALL SELECT doc_id, 3, 'kept', true, 'question', 'why', 'open', NULL, NULL, 'low' FROM base
UNION ALL SELECT doc_id, 4, 'dropped', false, 'idea', 'x', NULL, NULL, NULL, 'high' FROM base)""",
    ("base",),
)
cte("base", f"SELECT doc_id, length({_NP}) >= 6 AND contains({_NB}, {_NP}) AS ok FROM documents d")


@query(
    "m8_validate_items",
    "SELECT entry_id, pos, outcome, downgraded, kind, text, status, owner, due, confidence FROM valid",
    ("valid",),
)
def validate(v):
    """Lenient parsing, then evidence, status, due and owner rules (the last draft keeps its confidence)."""
    r = _validated(v)
    return r.select(
        "entry_id", "pos", "outcome", "downgraded", "kind", "text", "status", "owner", F.col("due").cast("string").alias("due"),
        F.when(F.col("kind") == "idea", "high").otherwise(F.col("confidence")).alias("confidence"),
    )


@query(
    "a24_validation_counts",
    "SELECT entry_id, count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE downgraded) AS downgraded, count(*) FILTER (WHERE outcome = 'dropped') AS dropped FROM valid GROUP BY 1",
    ("valid",),
)
def counts(v):
    """Kept, downgraded and dropped drafts per entry."""
    return I.validation_counts(I.judge(_parsed(v)))


@query(
    "w7_item_cap",
    """SELECT id, entry_scope, CAST(row_number() OVER (PARTITION BY entry_scope ORDER BY id) - 1 AS INT) AS ordinal FROM (
  SELECT id, scope_key AS entry_scope, row_number() OVER (PARTITION BY scope_key ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, id) AS r FROM items) WHERE r <= 30""",
    ("items",),
)
def cap(v):
    """The most confident items of a group, renumbered in their original order."""
    from pyspark.sql.window import Window as W

    from lorekeep.operators.skew import top_n

    kept = top_n(v.items, ["scope_key"], [I.rank(F.col("confidence")).desc(), F.col("id")], 30)
    n = F.row_number().over(W.partitionBy("scope_key").orderBy("id")) - 1
    return kept.select("id", F.col("scope_key").alias("entry_scope"), n.alias("ordinal"))


@query(
    "c14_render_sections",
    """SELECT entry_id, CASE kind WHEN 'decision' THEN 'decisions' ELSE 'action_items' END AS kind,
  string_agg('- ' || CASE WHEN kind = 'decision' THEN '' ELSE CASE status WHEN 'done' THEN '[done] ' WHEN 'dropped' THEN '[dropped] ' ELSE '' END END || text, chr(10) ORDER BY ordinal) AS text
FROM items WHERE kind IN ('decision', 'action') GROUP BY 1, 2""",
    ("items",),
)
def rendered(v):
    """C14: decision and action sections from items."""
    return I.render_sections(v.items).select("entry_id", "kind", "text")


@query(
    "m7_replace_items",
    """SELECT id, entry_id, text FROM items WHERE entry_id NOT IN (SELECT entry_id FROM items WHERE kind = 'decision')
UNION ALL SELECT id, entry_id, 'new ' || text FROM items WHERE kind = 'decision'""",
    ("items",),
)
def replace(v):
    """M7: entries that have a decision get their decisions as their only items."""
    new = v.items.where(F.col("kind") == "decision").withColumn("text", F.concat(F.lit("new "), "text"))
    return I.replace_items(v.items, new, new).select("id", "entry_id", "text")


@query(
    "a22_frequent_names",
    """SELECT account_id, CAST(rank AS INT) AS rank, name, n FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, seen) AS rank FROM (
  SELECT 'n' || c_nationkey AS account_id, count(*) AS n, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN upper(c_mktsegment || ' ' || (c_custkey % 5)) ELSE lower(c_mktsegment || ' ' || (c_custkey % 5)) END, o_orderkey) AS name, min(o_orderkey) AS seen
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey, lower(c_mktsegment || ' ' || (c_custkey % 5)))) WHERE rank <= 3""",
)
def names(v):
    """Most frequent names per account, first spelling kept."""
    j = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 5).cast("string"))
    people = j.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("account_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.upper(raw)).otherwise(F.lower(raw)).alias("name"), F.col("o_orderkey").alias("seen"),
    )
    return I.frequent_names(people)


@query(
    "m23_alias_refresh",
    """WITH a AS (SELECT c_custkey AS k, 'g' || c_custkey AS id, c_custkey % 2 = 0 AS mail, 'u' || c_custkey || '@x.org' AS address FROM customer),
own AS (SELECT id, CASE WHEN o_orderkey % 2 = 0 THEN upper('Name ' || (o_orderkey % 4)) ELSE 'Name ' || (o_orderkey % 4) END AS name, o_orderkey AS seen FROM a JOIN orders ON o_custkey = k WHERE mail AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0)),
g AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY c DESC, seen) AS r FROM (SELECT id, count(*) AS c, arg_min(name, seen) AS name, min(seen) AS seen FROM own GROUP BY id, lower(name))),
m AS (SELECT a.id, coalesce((SELECT string_agg(name, ',' ORDER BY r) FROM g WHERE g.id = a.id AND r <= 3), '') AS names, address AS emails, k % 4 = 0 AS stored FROM a WHERE mail),
d AS (SELECT user_id, list_filter([trim(real_name), trim(display_name), trim(name)], lambda x: x IS NOT NULL AND x <> '') AS s, lower(name) || '@d.org' AS email FROM directory),
c AS (SELECT a.id, array_to_string(list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i), ',') AS names, coalesce(email, '') AS emails FROM a JOIN d ON d.user_id = 'U' || (k % 60) WHERE NOT mail)
SELECT id, names, emails FROM m WHERE NOT (stored AND names = '') UNION ALL SELECT id, names, emails FROM c WHERE names <> '' OR emails <> ''""",
    ("directory",),
)
def alias_refresh(v):
    """Names and addresses of the accounts' owners, where they differ from what the accounts hold."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    address = lambda c: F.concat(F.lit("u"), c.cast("string"), F.lit("@x.org"))
    none = F.array().cast("array<string>")
    accounts = v.table("customer").select(
        F.concat(F.lit("g"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "google").otherwise("slack").alias("kind"),
        F.when(k % 2 == 0, address(k)).otherwise(F.concat(F.lit("team:U"), (k % 60).cast("string"))).alias("identity"), none.alias("names"), F.when(k % 4 == 0, F.array(address(k))).otherwise(none).alias("emails"))
    name = F.concat(F.lit("Name "), (o % 4).cast("string"))
    people = v.table("orders").select(
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("account_id"), F.when(o % 2 == 0, F.upper(name)).otherwise(name).alias("name"),
        F.when(o % 3 == 0, F.upper(address(F.col("o_custkey")))).otherwise("other@x.org").alias("email"), (o % 5 == 0).alias("is_self"), o.alias("seen"))
    directory = v.directory.select("user_id", "real_name", "display_name", "name", F.concat(F.lower("name"), F.lit("@d.org")).alias("email"))
    out = I.refresh_aliases(accounts, directory, people)
    return out.select("id", F.array_join("names", ",").alias("names"), F.array_join("emails", ",").alias("emails"))


@query(
    "c5_whole_emails",
    "SELECT c_custkey, c_custkey % 4 IN (0, 3) AS hit FROM customer",
)
def whole_emails(v):
    """An address counts only as a whole."""
    c = F.col("c_custkey")
    mail = F.concat(F.lit("u"), c.cast("string"), F.lit("@x.org"))
    text = F.when(c % 4 == 0, F.concat(F.lit("Ann <"), mail, F.lit(">"))).when(c % 4 == 1, F.concat(F.lit("a"), mail)).when(c % 4 == 2, F.concat(mail, F.lit(".uk"))).otherwise(F.concat(mail, F.lit(".")))
    return v.table("customer").select("c_custkey", X.contains_email(text, mail).alias("hit"))
