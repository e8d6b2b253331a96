"""Streams over events and pages, run to the end of what is there and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.times import iso
from lorekeep.operators import upserts as M
from lorekeep.plans import query
from lorekeep.plans.ctes import iso as SI
from lorekeep.session import work_dir
from lorekeep.sources.io import append_ledger
from lorekeep.sources.partitions import Change, PartitionStore
from lorekeep.streaming import jobs as J


def _events(v):
    return J.read_table(J.stateful(v.spark), v.dir, "events.parquet")


@query(
    "r5_stream_day_counts",
    f"SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS messages, {SI('max(ts)')} AS last_ts FROM events GROUP BY 1, 2",
)
def day_counts(v):
    """Tumbling days under a watermark."""
    d = J.run(J.day_counts(_events(v), "user_id", "UTC"), "day-counts", "update", ["user_id", "day"])
    return d.select("user_id", F.col("day").cast("string").alias("day"), "messages", iso(F.col("last_ts")).alias("last_ts"))


@query("r13_stream_dedupe", "SELECT event_id, user_id FROM events")
def dedupe(v):
    """Two overlapping fetches of the same messages leave each of them once."""
    both = _events(v).union(_events(v)).select("event_id", "user_id", "ts")
    return J.run(J.drop_repeats(both, ["event_id"]), "dedupe").select("event_id", "user_id")


@query(
    "r15_stream_weekly_spend",
    """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period_start, round(sum(CASE WHEN event_id % 10 <> 0 THEN value END), 6) AS cost_usd, CAST(sum(1 + event_id % 3) AS BIGINT) AS calls,
  CAST(sum(CASE WHEN event_id % 10 = 0 THEN 1 + event_id % 3 ELSE 0 END) AS BIGINT) AS unpriced_calls FROM events GROUP BY 1""",
)
def weekly(v):
    """Running ledger totals per Monday week."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    ledger = _events(v).select(
        F.col("ts").alias("at"), F.when(i % 10 != 0, F.col("value")).alias("cost_usd"), (F.lit(1) + i % 3).alias("calls"),
        (F.lit(100) + k).alias("input_tokens"), (F.lit(10) + k % 7).alias("output_tokens"))
    w = J.run(J.weekly_spend(ledger), "weekly-spend", "update", ["period_start"])
    return w.select(F.col("period_start").cast("string").alias("period_start"), F.round("cost_usd", 6).alias("cost_usd"), "calls", "unpriced_calls")


@query(
    "r7_stream_high_water",
    "SELECT user_id, event_id FROM events WHERE user_id % 2 = 0 OR ts > TIMESTAMP '2024-01-10'",
)
def high_water(v):
    """Events past the stored mark of their user; users without a mark keep all of theirs."""
    s = _events(v).select(F.col("user_id").alias("scope"), F.col("event_id").alias("row_id"), F.unix_micros("ts").alias("micros"))
    marks = v.events.where(F.col("user_id") % 2 != 0).select(F.col("user_id").alias("scope")).distinct().withColumn(
        "mark", F.unix_micros(F.lit("2024-01-10").cast("timestamp")))
    return J.run(J.high_water(s, marks), "high-water").select(F.col("scope").alias("user_id"), F.col("row_id").alias("event_id"))


@query(
    "r9_stream_forgotten",
    "SELECT user_id, epoch_us(max(ts)) // 1000 AS last_millis FROM events GROUP BY 1 HAVING epoch_us(max(ts)) // 1000 + 86400000 < (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)",
)
def forgotten(v):
    """Scopes without activity for a day are reported once and dropped from the state."""
    s = _events(v).select(F.col("user_id").alias("scope"), "ts")
    return J.run(J.forgotten_threads(s, 1.0), "watch").select(F.col("scope").alias("user_id"), "last_millis")


@query(
    "r16_stream_page_changes",
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'unchanged' ELSE 'changed' END AS change FROM pages",
)
def page_changes(v):
    """Pages against the hash their state holds."""
    J.stateful(v.spark)
    sha = F.sha2(F.encode("html", "UTF-8"), 256)
    s = J.read_table(v.spark, v.dir, "pages.parquet").select(F.col("page_id").alias("doc"), F.lit(2).cast("long").alias("micros"), sha.alias("sha"))
    i = F.col("page_id")
    known = v.table("pages").where(i % 3 != 0).select(i.alias("doc"), F.lit(1).cast("long").alias("micros"), F.when(i % 3 == 1, sha).otherwise("old").alias("sha"))
    return J.run(J.document_changes(s, known), "page-changes").select(F.col("doc").alias("page_id"), "change")


@query(
    "r11_fetch_batches",
    """SELECT source_id, CAST((row_number() OVER (PARTITION BY account_id ORDER BY enqueued_at, source_kind, source_id) - 1) // 20 AS BIGINT) AS batch FROM queue WHERE attempts < 5""",
    ("queue",),
)
def fetch_batches(v):
    """What a drain fetches, in commits of twenty."""
    return M.fetch_batches(v.queue, 20).select("source_id", "batch")


@query("s10_ledger_append", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 6) AS cost_usd FROM events GROUP BY 1")
def ledger_append(v):
    """Two appends to the ledger by day, read back."""
    path = work_dir(v.spark, "ledger")
    rows = v.events.select("event_id", F.col("ts").alias("at"), F.col("value").alias("cost_usd"))
    for half in (0, 1):
        append_ledger(rows.where(F.col("event_id") % 2 == half), path)
    days = v.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query(
    "r12_stream_commits",
    """SELECT 'src' || (o_custkey % 20) AS account_id, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS failed, count(*) AS queued, (SELECT max(event_id) FROM events) AS cursor
FROM orders WHERE NOT (o_orderkey IN (SELECT event_id FROM events) AND o_orderkey % 4 <> 0) GROUP BY 1""",
)
def commits(v):
    """Fetch results drain the queue; queue and cursor move together, batch by batch."""
    n = F.substring("source_id", 2, 20).cast("long")
    queue = v.queue.withColumn("attempts", F.lit(0))
    cursors = v.spark.createDataFrame([("events", -1)], "key string, value long")

    def step(store, batch):
        ids = batch.select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("source_id"), "event_id")

        def drained(held):
            rows = held.join(ids, "source_id")
            ok = rows.where(F.col("event_id") % 4 != 0).select(*M.KEY)
            bad = rows.where(F.col("event_id") % 4 == 0).select(*M.KEY, F.lit(1).alias("failures"), F.lit("timeout").alias("error"))
            return M.queue_failures(held, bad).join(ok, M.KEY, "left_anti").select(*held.columns)

        top = batch.agg(F.max("event_id").alias("m")).scalar()
        return {"queue": store.update("queue", ids, drained), "cursors": Change(store.read("cursors").withColumn("value", F.greatest("value", top)))}

    store = PartitionStore(v.spark, work_dir(v.spark, "commits"))
    J.commit_stream(_events(v).select("event_id"), store, {"queue": (queue, ["source_id"], 16), "cursors": (cursors, ["key"], 1)}, step, work_dir(v.spark, "commits-checkpoint"))
    cursor = store.read("cursors").agg(F.max("value").alias("v")).scalar()
    q = store.read("queue").withColumn("n", n)
    return q.groupBy("account_id").agg(F.count_if(F.col("n") % 4 == 0).alias("failed"), F.count(F.lit(1)).alias("queued")).withColumn("cursor", cursor)
