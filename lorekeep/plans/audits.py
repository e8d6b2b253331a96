"""Health checks."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from lorekeep.operators import audits as A
from lorekeep.plans import query

NOW = datetime(2001, 1, 1, tzinfo=UTC)


@query(
    "a16_queue_health",
    """SELECT count(*) AS queued, count(*) FILTER (WHERE enqueued_at < TIMESTAMP '2000-12-25') AS stale, count(*) FILTER (WHERE attempts >= 5) AS stuck,
  arg_min(last_error, (enqueued_at, source_id)) FILTER (WHERE attempts >= 5 AND last_error IS NOT NULL) AS example_error FROM queue""",
    ("queue",),
)
def queue_health(v):
    """Old rows, rows at the attempt limit and an example error."""
    return A.queue_health(v.queue, NOW)


@query(
    "a17_summary_backlog",
    """SELECT *, CASE WHEN failed > 0 THEN 'warning' WHEN pending > 0 THEN 'info' ELSE 'ok' END AS level FROM (SELECT count(*) FILTER (WHERE summary_status = 'pending') AS pending, count(*) FILTER (WHERE summary_status = 'failed') AS failed,
  count(*) FILTER (WHERE summary_status = 'failed' AND summary_attempts >= 3) AS at_limit FROM entries)""",
    ("entries",),
)
def backlog(v):
    """Pending and failed summaries."""
    return A.summary_backlog(v.entries)


@query(
    "a18_meetings_without_transcript",
    """SELECT count(*) AS meetings, count(*) FILTER (WHERE coalesce(json_extract_string(metadata, '$.has_transcript'), '') <> 'true') AS without_transcript FROM entries WHERE source_kind = 'google.meet' AND raw_status = 'present'""",
    ("entries",),
)
def transcripts(v):
    """Meetings without a transcript."""
    return A.meetings_without_transcript(v.entries)


@query(
    "a30_run_health",
    """SELECT user_id, id, status, CASE WHEN status = 'failed' THEN 'error' WHEN TIMESTAMP '2024-01-30' - coalesce(finished_at, started_at) > INTERVAL 36 HOUR THEN 'old' WHEN status = 'ok' THEN 'ok' ELSE 'incomplete' END AS health,
  CAST(json_extract_string(stats, '$.queue_remaining') AS BIGINT) AS queue_remaining, CAST(json_extract_string(stats, '$.pending_summaries') AS BIGINT) AS pending_summaries
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS r FROM runs WHERE starts_with(command, 'sync') AND trigger = 'schedule') WHERE r = 1""",
    ("runs",),
)
def run_health(v):
    """The latest scheduled run of every user."""
    return A.run_health(v.runs, datetime(2024, 1, 30, tzinfo=UTC), by=("user_id",))


@query(
    "a31_accounts_without_alias",
    """SELECT count(*) AS accounts, count(*) FILTER (WHERE NOT known) AS without_alias, min(CASE WHEN NOT known THEN id END) AS example, false AS nobody_known FROM (
  SELECT id, contains(config, 'ustomer') OR contains(config, '@') AS known FROM accounts WHERE kind IN ('slack', 'google', 'microsoft') AND status <> 'disabled')""",
    ("accounts",),
)
def aliases(v):
    """Accounts without any alias."""
    return A.alias_health(v.accounts, F.lit(True))


@query(
    "a33_sync_plan",
    """SELECT a.id, a.kind, a.status, CASE WHEN a.status = 'active' THEN CASE a.kind WHEN 'slack' THEN 'slack.thread,slack.day' WHEN 'google' THEN 'google.meet' WHEN 'microsoft' THEN 'microsoft.file' END END AS sources, coalesce(q.n, 0) AS queued,
  CASE WHEN a.status = 'disabled' THEN 'disabled' WHEN a.status = 'needs_reauth' THEN 'needs re-authentication' WHEN a.kind = 'web' THEN 'on-demand source only' END AS skipped_reason,
  (SELECT count(*) FROM entries WHERE summary_status IN ('pending', 'failed') AND summary_attempts < 3) AS pending_summaries
FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS n FROM queue GROUP BY 1) q ON q.account_id = a.id""",
    ("accounts", "queue", "entries"),
)
def plan(v):
    """What a run would do per account."""
    due = F.col("summary_status").isin("pending", "failed") & (F.col("summary_attempts") < 3)
    pending = v.entries.agg(F.count_if(due).alias("n")).scalar()
    return A.sync_plan(v.accounts, v.queue, {"slack": "slack.thread,slack.day", "google": "google.meet", "microsoft": "microsoft.file"}, pending)
