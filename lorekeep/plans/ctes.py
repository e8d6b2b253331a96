"""The same catalog views as SQL, for the side-by-side check."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, sql)


def with_ctes(sql: str, needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def iso(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%dT%H:%M:%SZ')"


def le64(e: str) -> str:
    h = f"printf('%016x', CAST({e} AS BIGINT))"
    return "unhex(" + " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8)) + ")"


def body_hash(e: str) -> str:
    return f"('b2:' || sha256({le64(f'octet_length(encode({e}))')} || encode({e})))"


def grams(e: str) -> str:
    return (
        f"(CASE WHEN length({e}) = 0 THEN [] WHEN length({e}) < 3 THEN [{e}] "
        f"ELSE list_distinct(list_transform(range(1, length({e}) - 1), lambda i: substr({e}, i, 3))) END)"
    )


def norm(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({e}), '[*_`~]', '', 'g'), '\\s+', ' ', 'g'))"


def name_norm(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^\\p{{L}}\\p{{N}}@]+', ' ', 'g'))"


cte(
    "entries",
    r"""
SELECT d.doc_id AS id, 'doc-' || d.doc_id AS entry_uid, source AS account_id,
  CASE lang WHEN 'en' THEN 'slack.thread' WHEN 'fr' THEN 'google.meet' WHEN 'de' THEN 'google.doc' ELSE 'web.page' END AS source_kind,
  CASE WHEN lang = 'en' THEN 'C' || (d.doc_id % 40) || ':' || d.doc_id ELSE 'f' || d.doc_id END AS source_id,
  CASE WHEN d.doc_id % 5 <> 0 THEN 'https://example.org/d/' || d.doc_id END AS source_url,
  CASE WHEN length(split_part(text, chr(10), 1)) > 46 THEN substr(split_part(text, chr(10), 1), 1, 45) || '…'
       ELSE split_part(text, chr(10), 1) END AS title,
  CASE WHEN d.doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 365 AS INT)) END AS source_created_at,
  CASE WHEN d.doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-02' + to_days(CAST(d.doc_id % 365 + d.doc_id % 11 AS INT)) END AS source_updated_at,
  TIMESTAMP '2025-01-01' + to_hours(d.doc_id % 24) AS ingested_at,
  CASE d.doc_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'fetch_failed' ELSE 'present' END AS raw_status,
  CASE WHEN quality = 1 THEN 'done' WHEN quality = 0 AND toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'pending'
       WHEN d.doc_id % 2 = 0 THEN 'skipped' ELSE 'none' END AS summary_status,
  CAST(d.doc_id % 5 AS INT) AS summary_attempts,
  '{"channel_id":"C' || (d.doc_id % 40) || '","channel_name":"room-' || (d.doc_id % 8) || '"'
    || CASE WHEN d.doc_id % 4 = 0 THEN ',"transcript_url":"https://example.org/t/' || d.doc_id || '"' ELSE '' END
    || CASE WHEN d.doc_id % 6 = 0 THEN ',"has_transcript":true' ELSE '' END
    || CASE WHEN d.doc_id % 9 = 0 THEN ',"recurring_event_id":"r' || (d.doc_id % 30) || '"' ELSE '' END || '}' AS metadata
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
cte(
    "sections",
    r"""
SELECT entry_id * 8 + position AS id, entry_id, kind, origin, position, text FROM (
  SELECT doc_id AS entry_id, 'overview' AS kind, 'generated' AS origin, 1 AS position, split_part(text, chr(10), 1) AS text FROM documents
  UNION ALL SELECT doc_id, 'decisions', 'generated', 2, split_part(text, chr(10), 2) FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, 'details', 'extracted', 4, text FROM documents) WHERE trim(text) <> ''""",
)
cte(
    "summaries",
    rf"""
SELECT l.doc_id AS entry_id,
  CASE WHEN toxic = 1 THEN 'source_native' WHEN l.doc_id % 3 = 0 THEN 'llm_api' WHEN l.doc_id % 3 = 1 THEN 'llm_cli' ELSE 'local_llm' END AS generator_kind,
  'p' || (l.doc_id % 3) AS provider, 'm' || (l.doc_id % 4) AS model,
  CASE WHEN toxic = 1 THEN 'native' WHEN l.doc_id % 2 = 0 THEN 'default' ELSE 'deep' END AS profile,
  CASE WHEN toxic = 1 THEN NULL WHEN l.doc_id % 3 = 0 THEN 'conversation-summary/v2' WHEN l.doc_id % 3 = 1 THEN 'document-summary/v4'
       ELSE 'document-summary/v3' END AS prompt_version,
  CASE l.doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN {body_hash("d.text")} WHEN 2 THEN 'b2:stale' ELSE 'legacy-' || l.doc_id END AS input_hash,
  TIMESTAMP '2024-06-01' + to_days(CAST(l.doc_id % 90 AS INT)) AS generated_at
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
)
cte(
    "accounts",
    r"""
SELECT source AS id, CASE n % 4 WHEN 0 THEN 'slack' WHEN 1 THEN 'google' WHEN 2 THEN 'microsoft' ELSE 'web' END AS kind,
  CASE WHEN n % 5 <> 0 THEN 'Account ' || n END AS label,
  CASE WHEN n % 7 = 0 THEN 'disabled' WHEN n % 11 = 0 THEN 'needs_reauth' ELSE 'active' END AS status,
  '{"aliases":{"names":[' || CASE WHEN n % 3 = 0 THEN '"Customer ' || n || '","customer ' || n || '"' ELSE '' END
   || '],"emails":[' || CASE WHEN n % 4 = 1 THEN '"u' || n || '@example.org"' ELSE '' END
   || ']},"extra_aliases":{"names":[' || CASE WHEN n % 6 = 2 THEN '"Customer ' || (n + 100) || '"' ELSE '' END
   || ']},"ingest_links":[' || CASE WHEN n % 8 = 0 THEN '"google.doc","microsoft.file"' WHEN n % 8 = 4 THEN '"google.doc"' ELSE '' END || ']}' AS config
FROM (SELECT DISTINCT source, CAST(substr(source, 4, 9) AS INT) AS n FROM documents)""",
)
cte(
    "raw_objects",
    r"""
SELECT entry_id, account_id, 'primary' AS role, CAST(seq - 1 AS BIGINT) AS seq, 'raw/' || entry_id || '/primary.' || (seq - 1) || '.txt' AS path,
  sha256(encode(payload)) AS sha256, octet_length(encode(payload)) AS size, payload
FROM (SELECT doc_id AS entry_id, source AS account_id, unnest(string_split(text, chr(10))) AS payload,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seq FROM documents)""",
)
cte(
    "items",
    r"""
SELECT o_orderkey AS id, o_orderkey // 3 AS entry_id, CAST(o_orderkey % 3 AS INT) AS ordinal, kind, p.text,
  CASE WHEN kind = 'action' THEN CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'dropped' END
       WHEN kind = 'question' THEN CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'answered' END END AS status,
  CASE WHEN kind IN ('action', 'question') THEN 'Customer ' || o_custkey END AS owner,
  CASE WHEN kind = 'action' THEN 'Customer ' || (o_custkey + 1) END AS requester,
  CASE WHEN kind = 'action' AND o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 14 END AS due,
  ['Customer ' || o_custkey, 'clerk ' || (o_orderkey % 1000)] AS actors,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS occurred_at,
  CASE WHEN o_orderkey % 5 = 0 THEN 'low' WHEN o_orderkey % 5 <= 2 THEN 'medium' ELSE 'high' END AS confidence,
  'scope:' || (o_custkey // 4) AS scope_key
FROM (SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'action' WHEN '2' THEN 'question' WHEN '3' THEN 'decision'
        WHEN '4' THEN 'resolved' ELSE 'accomplishment' END AS kind FROM orders) o
JOIN (SELECT p_partkey, lower(p_name) AS text FROM part) p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)""",
)
cte(
    "item_entries",
    r"""
SELECT id, 'acct' || (cust % 20) AS account_id,
  CASE id % 4 WHEN 0 THEN 'slack.thread' WHEN 1 THEN 'google.meet' WHEN 2 THEN 'google.doc' ELSE 'slack.day' END AS source_kind,
  'Entry ' || id AS title, lo AS source_created_at, CASE WHEN id % 3 <> 0 THEN hi END AS source_updated_at,
  TIMESTAMP '2002-01-01' AS ingested_at,
  CASE id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'skipped' ELSE 'done' END AS summary_status
FROM (SELECT o_orderkey // 3 AS id, min(o_orderdate) AS lo, max(o_orderdate) AS hi, min(o_custkey) AS cust FROM orders GROUP BY 1)""",
)
cte(
    "item_summaries",
    r"""
SELECT id AS entry_id, CASE WHEN id % 6 = 2 THEN 'source_native' ELSE 'llm_api' END AS generator_kind, 'm' || (id % 4) AS model,
  'default' AS profile, CASE id % 6 WHEN 2 THEN NULL WHEN 3 THEN 'document-summary/v3' ELSE 'document-summary/v4' END AS prompt_version
FROM item_entries WHERE summary_status = 'done'""",
    ("item_entries",),
)
cte(
    "item_links",
    r"""
SELECT o_orderkey AS from_item, o_orderkey - o_orderkey % 7 + (o_orderkey * 3) % 7 AS to_item,
  CASE o_orderkey % 4 WHEN 0 THEN 'resolves' WHEN 1 THEN 'supersedes' ELSE 'same_as' END AS relation,
  CASE WHEN o_orderkey % 5 = 1 THEN 'low' WHEN o_orderkey % 5 <= 3 THEN 'medium' ELSE 'high' END AS confidence
FROM orders""",
)
cte(
    "messages",
    r"""
SELECT source_id, channel, ts, secs, turn, thread_ts, usr, text, reply_count, subtype FROM (
SELECT 'C' || (conv_id % 9) || ':' || conv_id AS source_id, 'C' || (conv_id % 9) AS channel,
  (1704067200 + conv_id * 3600 + turn * 1500) AS secs, turn,
  (1704067200 + conv_id * 3600 + turn * 1500) || '.' || lpad(CAST(turn AS VARCHAR), 6, '0') AS ts,
  (1704067200 + conv_id * 3600) || '.000000' AS thread_ts,
  'U' || ((conv_id * 2 + CASE WHEN role = 'user' THEN 0 ELSE 1 END) % 60) AS usr,
  CASE WHEN turn % 3 = 1 THEN text || ' (edited)' ELSE text END AS text,
  CASE WHEN turn = 0 THEN 1 ELSE 0 END AS reply_count, CASE WHEN turn = 5 THEN 'thread_broadcast' END AS subtype
FROM conversations)""",
)
cte(
    "directory",
    r"""
SELECT 'U' || (n_nationkey * 2) AS user_id, lower(n_name) AS name,
  CASE WHEN n_nationkey % 3 = 0 THEN upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) ELSE '' END AS display_name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'Person ' || n_name ELSE ' ' END AS real_name, n_nationkey % 5 = 0 AS is_bot
FROM nation""",
)
cte(
    "link_refs",
    r"""
SELECT account_id, entry_id, message_id, ts, 'google.doc' AS kind, 'google:doc' || (message_id // 4) AS link_key,
  'https://docs.google.com/document/d/doc' || (message_id // 4) || '/edit' AS url, 'docs.google.com' AS host, 1 AS ord FROM lm
UNION ALL
SELECT account_id, entry_id, message_id, ts, 'microsoft.file', 'ms:' || sha256('https://team.sharepoint.com/s/' || (message_id // 3) || '?e=1&x=2'),
  'https://team.sharepoint.com/s/' || (message_id // 3) || '?e=1&x=2', 'team.sharepoint.com', 0 FROM lm""",
    ("lm",),
)
cte(
    "lm",
    r"""
SELECT 'acct' || (page_id % 6) AS account_id, page_id // 2 AS entry_id, page_id AS message_id, url AS page_url,
  (1704067200 + (page_id // 2) * 100 + page_id % 2) || '.000100' AS ts FROM pages""",
)
cte(
    "ledger",
    r"""
SELECT event_id AS id, date_trunc('second', ts) AS used_at, user_id AS entry_id, event_type AS model, 'p' || (event_id % 3) AS provider,
  100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, 10 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS output_tokens,
  1 + event_id % 3 AS calls, CASE WHEN event_id % 10 <> 0 THEN value END AS cost_usd FROM events""",
)
cte(
    "runs",
    r"""
SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'sync' WHEN 'click' THEN 'sync --deep' WHEN 'signup' THEN 'import'
    WHEN 'error' THEN 'scan-links' ELSE 'summarize' END AS command,
  CASE event_id % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'manual' ELSE 'mcp' END AS trigger, date_trunc('second', ts) AS started_at,
  CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) + to_minutes(CAST(floor(value) AS INT)) END AS finished_at,
  CASE WHEN event_id % 13 = 0 THEN 'running' ELSE CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' WHEN 2 THEN 'interrupted' ELSE 'ok' END END AS status,
  '{"queue_remaining":' || k || ',"pending_summaries":' || (k % 5) || '}' AS stats,
  CASE WHEN event_id % 6 = 0 THEN 'error ' || k END AS error, user_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
cte(
    "cursors",
    r"""
SELECT 'acct' || c_nationkey AS account_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'google.meet' ELSE 'slack.thread' END AS source_kind,
  CASE WHEN c_custkey % 3 = 0 THEN 'watch:' ELSE 'conv:' END || 'C' || c_custkey AS key,
  1704067200 + (c_custkey % 500) * 3600 AS until_s, 1704067200 + (c_custkey % 500) * 3600 - (c_custkey % 90) * 86400 AS active_s,
  CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 300 AS INT)) END AS covered_since
FROM customer""",
)
cte(
    "queue",
    r"""
SELECT 'src' || (o_custkey % 20) AS account_id, CASE WHEN o_orderkey % 2 = 0 THEN 'slack.thread' ELSE 'google.doc' END AS source_kind,
  'q' || o_orderkey AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new_thread' ELSE 'watched' END AS reason, '{"n":' || o_orderkey || '}' AS hint,
  o_orderdate AS enqueued_at, CAST(o_orderkey % 7 AS INT) AS attempts, CASE WHEN o_orderkey % 7 > 3 THEN 'timeout ' || o_orderkey END AS last_error
FROM orders""",
)
cte(
    "issues",
    r"""
SELECT c_custkey AS id, 'area' || (c_custkey % 5) || '.check' AS code,
  CASE c_custkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN c_custkey % 6 <> 0 THEN 'acct' || (c_custkey % 25) END AS account_id, c_custkey AS entry_id, 'message ' || c_custkey AS message,
  TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 50 AS INT)) AS first_seen_at, TIMESTAMP '2024-03-01' + to_days(CAST(c_custkey % 50 AS INT)) AS last_seen_at,
  CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-05-01' + to_days(CAST(c_custkey % 50 AS INT)) END AS resolved_at
FROM customer""",
)
cte(
    "findings",
    r"""
SELECT 'area' || (c % 5) || '.check' AS code, CASE WHEN k % 2 = 0 THEN 'error' ELSE 'warning' END AS severity,
  CASE WHEN c % 6 <> 0 THEN 'acct' || (c % 25) END AS account_id, c AS entry_id, 'found ' || k AS message
FROM (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY 1)""",
)
