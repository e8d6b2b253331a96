"""Spend over events, estimates and summary decisions over documents."""

from __future__ import annotations

from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions import text as X
from lorekeep.functions.times import entry_date, iso
from lorekeep.operators import ledger as B
from lorekeep.operators import policy as Y
from lorekeep.operators.skew import cut, newest_first
from lorekeep.plans import query
from lorekeep.plans.ctes import body_hash, cte, iso as SI, le64
from lorekeep.schemas import DEFAULTS

NOW = datetime(2024, 1, 17, 12, tzinfo=UTC)
TOKYO = "Asia/Tokyo"
_SPEND = """round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls,
  CAST(coalesce(sum(CASE WHEN cost_usd IS NULL THEN calls ELSE 0 END), 0) AS BIGINT) AS unpriced_calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens"""
_TOK = "CAST(ceil(length(text) / 4.0) AS BIGINT)"


def _money(df):
    return df.withColumn("cost_usd", F.round("cost_usd", 6))


@query("a5_spend_between", f"SELECT {_SPEND} FROM ledger WHERE used_at >= TIMESTAMP '2024-01-05' AND used_at < TIMESTAMP '2024-01-20'", ("ledger",))
def between(v):
    """A5: spend over a half-open range."""
    return _money(B.spend_between(v.ledger, datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC)))


@query("a6_spend_by_model", f"SELECT model, provider, {_SPEND} FROM ledger GROUP BY 1, 2", ("ledger",))
def by_model(v):
    """Spend per model and provider."""
    return _money(B.spend_by_model(v.ledger))


@query("a7_spend_total", f"SELECT {_SPEND}, {SI('min(used_at)')} AS since FROM ledger", ("ledger",))
def total(v):
    """Total spend and the first ledger time."""
    return _money(B.spend_total(v.ledger)).withColumn("since", iso(F.col("since")))


_PERIOD = """SELECT '{k}' AS kind, CAST(CAST(date_trunc('{k}', used_at + INTERVAL 9 HOUR) AS DATE) AS VARCHAR) AS period_start,
  strftime(date_trunc('{k}', used_at + INTERVAL 9 HOUR) - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS starts_at,
  strftime(date_trunc('{k}', used_at + INTERVAL 9 HOUR) + INTERVAL {i} - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS ends_at, """


@query(
    "a8_spend_by_period",
    _PERIOD.format(k="week", i="7 DAY") + _SPEND + " FROM ledger GROUP BY 1, 2, 3, 4 UNION ALL " + _PERIOD.format(k="month", i="1 MONTH") + _SPEND + " FROM ledger GROUP BY 1, 2, 3, 4",
    ("ledger",),
)
def by_period(v):
    """Spend per local week and month in a time zone."""
    p = _money(B.spend_by_period(v.ledger, ["week", "month"], TOKYO))
    return p.withColumns({"period_start": F.col("period_start").cast("string"), "starts_at": iso(F.col("starts_at")), "ends_at": iso(F.col("ends_at"))})


@query(
    "j16_period_report",
    f"""SELECT kind, period_start, cap_usd, {_SPEND}, round(coalesce(sum(cost_usd), 0) / cap_usd * 100, 4) AS used_percent, coalesce(sum(cost_usd), 0) >= cap_usd AS cap_reached FROM (
  SELECT 'week' AS kind, CAST(CAST(date_trunc('week', used_at + INTERVAL 9 HOUR) AS DATE) AS VARCHAR) AS period_start, 3000.0::DOUBLE AS cap_usd, * FROM ledger
  UNION ALL SELECT 'month', CAST(CAST(date_trunc('month', used_at + INTERVAL 9 HOUR) AS DATE) AS VARCHAR), 900000.0::DOUBLE, * FROM ledger) GROUP BY 1, 2, 3""",
    ("ledger",),
)
def report(v):
    """Ledger rows inside stored period bounds, with cap and used share."""
    seen = B.periods_of(v.ledger, ["week", "month"], TOKYO).withColumn("cap_usd", F.when(F.col("kind") == "week", 3000.0).otherwise(900000.0))
    none = seen.limit(0).withColumns({"cap_updated_at": F.lit(None).cast("timestamp"), "stopped_at": F.lit(None).cast("timestamp")})
    p = _money(B.period_report(v.ledger, B.upsert_periods(none, seen, NOW)))
    return p.select("kind", F.col("period_start").cast("string").alias("period_start"), "cap_usd", *B.SPEND, F.round("used_percent", 4).alias("used_percent"), "cap_reached")


@query(
    "a32_budget_status",
    f"""SELECT CASE WHEN (SELECT count(*) FROM ledger WHERE cost_usd IS NULL AND model = 'error' AND false) > 0 THEN 'error' WHEN max(r) THEN 'warning' ELSE 'ok' END AS status, max(r) AS cap_reached FROM (
  SELECT coalesce(sum(cost_usd), 0) >= 500 AS r FROM ledger WHERE used_at >= TIMESTAMP '2024-01-15' AND used_at < TIMESTAMP '2024-01-22'
  UNION ALL SELECT coalesce(sum(cost_usd), 0) >= 1e9 FROM ledger WHERE used_at >= TIMESTAMP '2024-01-01' AND used_at < TIMESTAMP '2024-02-01')""",
    ("ledger",),
)
def budget_status(v):
    """Whether a cap of the current week or month is reached."""
    return B.budget_flag(B.current_budget(v.ledger, NOW, {"week": 500.0, "month": 1e9}, "UTC"), F.lit(False))


@query("c21_token_estimates", f"SELECT doc_id, {_TOK} AS tokens FROM documents")
def tokens(v):
    """Token estimate of whole documents."""
    return v.table("documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


_LIMIT = 6000


def _chunks_sql(text: str, limit: int) -> str:
    """The list of chunks: units joined as long as they fit, without white space at their ends."""
    stretches = f"list_transform(range(1, greatest(length(x), 1) + 1, {limit - 1}), lambda s: substr(x, s, {limit - 1}) || chr(10))"
    lines = f"list_concat(flatten(list_transform(string_split(p, chr(10)), lambda x: CASE WHEN length(x) < {limit} THEN [x || chr(10)] ELSE {stretches} END)), [chr(10)])"
    units = f"flatten(list_transform(string_split({text}, chr(10) || chr(10)), lambda p: CASE WHEN length(p) <= {limit} THEN [p || chr(10) || chr(10)] ELSE {lines} END))"
    packed = f"""list_reduce(list_concat([['']], list_transform({units}, lambda u: [u])), lambda acc, u: CASE WHEN acc[1] <> '' AND length(acc[1]) + length(u[1]) > {limit}
      THEN list_concat([u[1]], acc[2:], [acc[1]]) ELSE list_concat([acc[1] || u[1]], acc[2:]) END)"""
    ended = f"list_transform({packed}, lambda c: regexp_replace(c, '\\s+$', ''))"
    return f"""CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE (SELECT CASE WHEN r[1] = '' THEN r[2:] ELSE list_concat(r[2:], [r[1]]) END FROM (SELECT {ended} AS r)) END"""


cte(
    "called",
    f"SELECT doc_id, text, CASE WHEN k > 1 THEN k + 1 ELSE 1 END AS n_calls FROM (SELECT doc_id, text, len({_chunks_sql('text', DEFAULTS.max_input_chars)}) AS k FROM documents)",
)
cte(
    "units",
    f"""SELECT e.id AS entry_id, coalesce(e.source_created_at, e.ingested_at) AS date, CASE WHEN e.id % 2 = 0 THEN 'default' ELSE 'deep' END AS profile, 'm' || (e.id % 3) AS model,
  n_calls, {_TOK} + 400 * n_calls AS in_tokens, 700 * n_calls AS out_tokens, (({_TOK} + 400 * n_calls) * (1.0 + e.id % 3) + 700 * n_calls * 5.0) / 1000000 AS cost
FROM entries e JOIN called d ON d.doc_id = e.id""",
    ("entries", "called"),
)


def _prices(v):
    """Prices of the models, derived from the entries' model names."""
    e = v.entries.select((F.col("id") % 3).alias("n")).distinct()
    return e.select(F.concat(F.lit("m"), F.col("n").cast("string")).alias("model"), (F.lit(1.0) + F.col("n")).alias("input"), F.lit(5.0).alias("output"))


def _units(v, settings=DEFAULTS):
    i = F.col("id")
    e = v.entries.select(i.alias("entry_id"), entry_date().alias("date"), F.when(i % 2 == 0, "default").otherwise("deep").alias("profile"),
                         F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"))
    d = v.table("documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("body"))
    return B.unit_costs(B.unit_estimates(e.join(d, "entry_id"), settings), _prices(v))


@query("c22_unit_costs", "SELECT entry_id, n_calls, in_tokens, out_tokens, round(cost, 9) AS cost FROM units", ("units",))
def costs(v):
    """Calls, tokens and cost of summarizing every document."""
    return _units(v).select("entry_id", "n_calls", "in_tokens", "out_tokens", F.round("cost", 9).alias("cost"))


@query(
    "w5_admission_prefix",
    "SELECT entry_id, admitted FROM (SELECT entry_id, sum(cost) OVER (ORDER BY date DESC, entry_id DESC ROWS UNBOUNDED PRECEDING) <= 0.35 AS admitted FROM units)",
    ("units",),
)
def prefix(v):
    """Newest first, admitted while the running cost fits."""
    u = B.admission(cut(_units(v).select("entry_id", "date", "cost"), "units"), *newest_first("date", "entry_id"), 0.35)
    return u.select("entry_id", "admitted")


@query(
    "w6_budget_gate",
    """WITH g AS (SELECT *, cost > 0.012 + 1e-9 AS large, CASE WHEN cost > 0.012 + 1e-9 THEN 0 ELSE cost END AS c FROM units),
r AS (SELECT *, sum(c) OVER (ORDER BY date DESC, entry_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT entry_id, CASE WHEN large THEN 'too_large' WHEN run <= 0.011 + 1e-9 AND run - c < 0.011 - 1e-9 THEN 'go' ELSE 'stop' END AS gate FROM r""",
    ("units",),
)
def gate(v):
    """Units over the cap are passed over; the first other misfit stops the rest."""
    u = B.budget_gate(cut(_units(v).select("entry_id", "date", "cost"), "units"), *newest_first("date", "entry_id"), [(0.012, 0.001), (10.0, 1.0)])
    return u.select("entry_id", "gate")


@query(
    "a20_cost_estimate",
    """SELECT coalesce(profile, 'total') AS profile, count(*) AS entries, CAST(sum(n_calls) AS BIGINT) AS calls, CAST(sum(in_tokens) AS BIGINT) AS input_tokens,
  round(CASE WHEN count(*) FILTER (WHERE model = 'm1' AND profile = 'deep') = 0 THEN sum(cost) END, 6) AS cost_usd,
  CASE WHEN count(*) FILTER (WHERE model = 'm1' AND profile = 'deep') > 0 THEN 'm1' ELSE '' END AS unpriced_models FROM units GROUP BY ROLLUP (profile)""",
    ("units",),
)
def estimate(v):
    """Estimate per profile and in total; a model without a price (m1 in one profile) leaves its totals unknown."""
    no_price = (F.col("model") == "m1") & (F.col("profile") == "deep")
    u = _units(v).withColumns({"free": F.lit(False), "cost": F.when(~no_price, F.col("cost"))})
    e = B.estimate(u).withColumn("profile", F.coalesce("profile", F.lit("total")))
    return e.select("profile", "entries", "calls", "input_tokens", F.round("cost_usd", 6).alias("cost_usd"), "unpriced_models")


@query(
    "c23_chunks",
    f"""SELECT doc_id, CAST(i - 1 AS INT) AS chunk_no, sha256(c[i]) AS chunk_sha256 FROM (SELECT doc_id, {_chunks_sql("text", _LIMIT)} AS c FROM documents), range(1, 10000) t(i) WHERE i <= len(c)""",
)
def chunk(v):
    """Every chunk of every body, by its place and content."""
    d = v.table("documents").select("doc_id", F.posexplode(B.chunks(F.col("text"), _LIMIT)).alias("chunk_no", "t"))
    return d.select("doc_id", "chunk_no", F.sha2("t", 256).alias("chunk_sha256"))


_SUMMARY = T.StructType([
    T.StructField("entry_id", T.LongType()), T.StructField("chunk_no", T.IntegerType()), T.StructField("n_chunks", T.IntegerType()),
    T.StructField("chars", T.LongType()), T.StructField("calls", T.IntegerType()),
])


def _count_chars(batches):
    for pdf in batches:
        chars = pdf["text"].str.replace(r"\s", "", regex=True).str.len()
        yield pd.DataFrame({"entry_id": pdf["entry_id"], "chunk_no": pdf["chunk_no"], "n_chunks": pdf["n_chunks"], "chars": chars, "calls": 1})


def _add_up(pdf):
    return pd.DataFrame({"entry_id": [pdf["entry_id"].iloc[0]], "chunk_no": [0], "n_chunks": [int(pdf["n_chunks"].iloc[0])],
                         "chars": [int(pdf["chars"].sum())], "calls": [int(pdf["calls"].sum()) + 1]})


@query(
    "e3_map_reduce_summaries",
    f"SELECT doc_id AS entry_id, length(regexp_replace(text, '\\s', '', 'g')) AS chars, length(text) > {_LIMIT} AS merged FROM documents",
)
def map_reduce(v):
    """A caller's function over chunks and a merge per document (here it counts characters)."""
    d = v.table("documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("body"))
    return B.summarize(d, _count_chars, _add_up, _SUMMARY, _LIMIT).select("entry_id", "chars", (F.col("calls") > 1).alias("merged"))


# -- decisions ------------------------------------------------------------------------------------------------

cte(
    "inputs",
    """SELECT e.id AS entry_id, e.summary_status, e.source_kind, e.raw_status, d.text AS body, s.generator_kind, s.input_hash, s.profile AS used_profile, s.prompt_version AS used_version,
  CASE WHEN e.source_kind = 'slack.thread' THEN len(string_split(d.text, chr(10))) END AS message_count,
  CASE e.source_kind WHEN 'slack.thread' THEN 'conversation' WHEN 'google.meet' THEN 'meeting' ELSE 'document' END AS prompt,
  CASE WHEN e.source_kind = 'google.meet' THEN 'native' WHEN e.id % 2 = 0 THEN 'default' ELSE 'none' END AS profile, e.id % 3 = 0 AS has_native
FROM entries e JOIN documents d ON d.doc_id = e.id LEFT JOIN summaries s ON s.entry_id = e.id""",
    ("entries", "summaries"),
)
_BELOW = "CASE WHEN message_count IS NOT NULL THEN message_count < 3 OR length(body) < 400 WHEN prompt = 'document' THEN length(body) < 400 ELSE trim(body) = '' END"


def _inputs(v):
    kind, i = F.col("source_kind"), F.col("id")
    d = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    s = v.summaries.select(F.col("entry_id").alias("id"), "generator_kind", "input_hash")
    return v.entries.join(d, "id").join(s, "id", "left").select(
        i.alias("entry_id"), "summary_status", "source_kind", "body", "generator_kind", "input_hash",
        F.when(kind == "slack.thread", F.size(F.split("body", "\n"))).alias("message_count"),
        F.when(kind == "slack.thread", "conversation").when(kind == "google.meet", "meeting").otherwise("document").alias("prompt"),
        F.when(kind == "google.meet", "native").when(i % 2 == 0, "default").otherwise("none").alias("profile"),
        (i % 2 == 0).alias("profile_usable"), (i % 3 == 0).alias("has_native"),
    )


@query("p18_thresholds", f"SELECT entry_id, {_BELOW} AS below FROM inputs", ("inputs",))
def thresholds(v):
    """Conversations by messages and length, documents by length, the rest when blank."""
    return _inputs(v).select("entry_id", Y.below_thresholds().alias("below"))


_NATIVE_HASH = f"sha256({le64('6')} || encode('native') || {le64('0')} || {le64('octet_length(encode(body))')} || encode(body))"


@query(
    "m4_summary_decisions",
    f"""WITH h AS (SELECT *, {body_hash('body')} AS hash, {_BELOW} AS below FROM inputs),
x AS (SELECT *, CASE WHEN profile = 'native' THEN CASE WHEN has_native THEN 'native' ELSE 'none' END WHEN below THEN 'skipped'
  WHEN profile = 'default' AND summary_status = 'done' THEN CASE WHEN generator_kind IS NULL OR generator_kind = 'source_native' THEN 'pending' WHEN input_hash = '' THEN 'adopt'
    WHEN input_hash = hash OR NOT starts_with(input_hash, 'b2:') THEN 'keep' ELSE 'pending' END
  WHEN profile = 'default' THEN 'pending' WHEN summary_status = 'done' THEN 'keep' ELSE 'pending' END AS decision FROM h)
SELECT entry_id, decision, CASE decision WHEN 'adopt' THEN hash WHEN 'native' THEN {_NATIVE_HASH} END AS new_hash FROM x""",
    ("inputs",),
)
def decisions(v):
    """Keep, adopt, pending, skipped, none or native."""
    return Y.decide(_inputs(v)).select("entry_id", "decision", "new_hash")


@query(
    "m24_resummarize",
    f"""SELECT entry_id, CASE WHEN raw_status <> 'present' THEN 'no_raw' WHEN used_profile = 'deep' AND used_version = 'document-summary/v4' AND input_hash = {body_hash('body')} THEN 'already_current' ELSE 'selected' END AS state FROM inputs""",
    ("inputs",),
)
def resummarize(v):
    """Entries to summarize again for a profile."""
    d = v.table("documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("body"), F.lit("document-summary/v4").alias("prompt_version"))
    return Y.resummarize(v.entries, v.summaries, d, "deep")


@query(
    "m19_hash_upgrade",
    f"""SELECT entry_id, CASE WHEN entry_id % 7 = 0 THEN 'deferred' WHEN raw_status <> 'present' THEN 'unknown' ELSE 'upgraded' END AS outcome,
  CASE WHEN entry_id % 7 = 0 THEN input_hash WHEN raw_status <> 'present' THEN '' ELSE {body_hash('body')} END AS input_hash
FROM inputs WHERE generator_kind <> 'source_native' AND input_hash <> '' AND NOT starts_with(input_hash, 'b2:')""",
    ("inputs",),
)
def hash_upgrade(v):
    """Old input hashes rewritten from rebuilt inputs."""
    d = v.table("documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("body"))
    r = v.entries.select(F.col("id").alias("entry_id"), "raw_status", (F.col("id") % 7 == 0).alias("failed")).join(d, "entry_id")
    r = r.select("entry_id", F.when(F.col("raw_status") == "present", F.col("body")).alias("body"), "failed")
    return Y.upgrade_hashes(v.summaries, r).select("entry_id", "outcome", "input_hash")
