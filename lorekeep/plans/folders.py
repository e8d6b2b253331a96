"""Folder listings over parts and suppliers, coverage over customers and conversations."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from lorekeep.functions.times import iso
from lorekeep.operators import coverage as C
from lorekeep.operators import folders as D
from lorekeep.plans import query
from lorekeep.plans.ctes import cte, iso as SI
from lorekeep.plans.messages import _messages
from lorekeep.plans.views import days

NOW = datetime(2024, 2, 10, tzinfo=UTC)

cte(
    "children",
    r"""SELECT CASE WHEN c_custkey < 5 THEN 'root' ELSE 'd' || (c_custkey // 5) END AS parent_id, 'd' || c_custkey AS id, 'folder' AS type, 'Dir ' || c_custkey AS name, NULL AS modified, NULL AS size FROM customer
UNION ALL SELECT 'd' || c_custkey, 'root', 'folder', 'back', NULL, NULL FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'd' || (o_orderkey % (SELECT count(*) FROM customer)), 'f' || o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unsupported' ELSE 'file' END,
  CASE o_orderstatus WHEN 'P' THEN '~$lock' || o_orderkey || '.docx' WHEN 'F' THEN 'Report ' || o_orderkey || '.docx' ELSE 'note ' || o_orderkey || '.TXT' END, o_orderdate, o_custkey FROM orders""",
)


def listing(v):
    """A folder tree over customers with links back to the root, and orders as the files in it."""
    c = v.table("customer")
    k = F.col("c_custkey")
    none = [F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("long").alias("size")]
    d = lambda x: F.concat(F.lit("d"), x.cast("string"))
    tree = c.select(F.when(k < 5, "root").otherwise(d(F.floor(k / 5))).alias("parent_id"), d(k).alias("id"), F.lit("folder").alias("type"),
                    F.concat(F.lit("Dir "), k.cast("string")).alias("name"), *none)
    back = c.where(F.col("c_nationkey") == 3).select(d(k).alias("parent_id"), F.lit("root").alias("id"), F.lit("folder").alias("type"), F.lit("back").alias("name"), *none)
    o = F.col("o_orderkey")
    n = c.agg(F.count(F.lit(1)).alias("n")).scalar()
    num = o.cast("string")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("~$lock"), num, F.lit(".docx"))).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("Report "), num, F.lit(".docx"))).otherwise(F.concat(F.lit("note "), num, F.lit(".TXT")))
    files = v.table("orders").select(d(o % n).alias("parent_id"), F.concat(F.lit("f"), num).alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", "unsupported").otherwise("file").alias("type"),
                                     name.alias("name"), F.col("o_orderdate").alias("modified"), num.alias("etag"), F.col("o_custkey").alias("size"))
    return tree.unionByName(back).unionByName(files)


def roots(v):
    return v.table("region").where(F.col("r_regionkey") == 0).select(F.lit("root").alias("root_id"), F.lit("Home").alias("root_name"))


_WHOLE = """WITH RECURSIVE w AS (SELECT 'root' AS folder_id, ['Home'] AS names
  UNION ALL SELECT c.id, list_append(w.names, c.name) FROM w JOIN children c ON c.parent_id = w.folder_id AND c.type = 'folder' AND c.id <> 'root')"""
_INCLUDED = "(starts_with(lower(c.name), 'report') OR ends_with(lower(c.name), '.txt'))"


@query(
    "s8_folder_files",
    _WHOLE + """ SELECT c.id, array_to_string(names, ' / ') AS folder_path FROM children c JOIN w ON w.folder_id = c.parent_id WHERE c.type = 'file' AND NOT starts_with(c.name, '~$')""",
    ("children",),
)
def files(v):
    """Breadth-first walk of the whole tree with folder paths; links back to the root end."""
    out, _ = D.scan(listing(v), roots(v))
    return out.select("id", "folder_path")


@query(
    "s8_folder_counts",
    _WHOLE + f""" SELECT 'unsupported' AS why, count(*) AS count FROM children c JOIN w ON w.folder_id = c.parent_id WHERE c.type = 'unsupported'
UNION ALL SELECT 'excluded', count(*) FROM children c JOIN w ON w.folder_id = c.parent_id WHERE c.type = 'file' AND (starts_with(c.name, '~$') OR NOT {_INCLUDED})""",
    ("children",),
)
def left_out(v):
    """What a walk with an include leaves out."""
    return D.scan(listing(v), roots(v), include=["report*", "**/*.txt"])[1].select("why", "count")


@query(
    "s8_whole_files",
    _WHOLE + """ SELECT c.id, array_to_string(names, ' / ') AS folder_path FROM children c JOIN w ON w.folder_id = c.parent_id
WHERE c.type = 'file' AND NOT starts_with(c.name, '~$') AND (starts_with(lower(c.name), 'report') OR ends_with(lower(c.name), '.txt')) AND NOT (c.name LIKE 'note %7.TXT')""",
    ("children",),
)
def whole_files(v):
    """The walk goes on until no new folder is found."""
    out, _ = D.scan(listing(v), roots(v), include=["report*", "**/*.txt"], exclude=["NOTE *7.txt"])
    return out.select("id", "folder_path")


@query(
    "s8_whole_counts",
    _WHOLE + """ SELECT 'unsupported' AS why, count(*) AS count FROM children c JOIN w ON w.folder_id = c.parent_id WHERE c.type = 'unsupported'
UNION ALL SELECT 'excluded', count(*) FROM children c JOIN w ON w.folder_id = c.parent_id WHERE c.type = 'file' AND starts_with(c.name, '~$')""",
    ("children",),
)
def whole_left_out(v):
    """What a walk without a depth limit leaves out."""
    return D.scan(listing(v), roots(v))[1].select("why", "count")


@query(
    "c34_long_paths",
    """SELECT conv_id, turn, CASE WHEN length(f) <= 300 THEN f ELSE 'Root / ... / ' || t END AS path FROM (SELECT conv_id, turn, 'Root / ' || substr(a, 1, 250) || ' / ' || substr(a, 1, 40) AS f, substr(a, 1, 40) AS t
FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-z]', '', 'g') AS a FROM conversations) WHERE length(a) > 0)""",
)
def paths(v):
    """Paths shortened to 300 characters."""
    a = F.regexp_replace("text", "[^a-z]", "")
    c = v.table("conversations").select("conv_id", "turn", a.alias("a")).where(F.length("a") > 0)
    return c.select("conv_id", "turn", D.join_path(F.array(F.lit("Root"), F.substring("a", 1, 250), F.substring("a", 1, 40))).alias("path"))


@query(
    "j14_listing_diff",
    """SELECT id, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 4 = 0 THEN 'unchanged' ELSE 'changed' END WHEN n % 3 = 1 THEN 'duplicate' ELSE 'new' END AS state
FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS n FROM children WHERE type = 'file')""",
    ("children",),
)
def listing_diff(v):
    """Listed files against stored fetch states; the source's own rule compares etags."""
    f = listing(v).where(F.col("type") == "file")
    n = F.expr("try_cast(substring(id, 2) as bigint)")
    known = f.where(n % 3 == 0).select("id", F.when(n % 4 == 0, F.col("etag")).when(n % 4 != 1, "old").alias("state_etag"), F.lit(None).cast("timestamp").alias("state_modified"))
    other = f.where(n % 3 == 1).select("id")
    return D.diff(f, known, other, F.col("etag") != F.col("state_etag")).select("id", "state")


@query("a21_largest_files", "SELECT id, size, (SELECT CAST(sum(size) AS BIGINT) FROM children WHERE type = 'file') AS bytes FROM children WHERE type = 'file' ORDER BY children.size DESC, name, id LIMIT 5", ("children",))
def largest(v):
    """The five largest files and the total."""
    total, top = D.size_report(listing(v).where(F.col("type") == "file"))
    return top.select("id", "size").withColumn("bytes", total.select("bytes").scalar())


@query(
    "s12_change_feed",
    f"SELECT o_orderkey AS id, {SI('(SELECT max(o_orderdate) FROM orders)')} AS next_cursor FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'",
)
def feed(v):
    """Changes past a cursor and the next cursor."""
    o = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("modified"))
    rows, nxt = D.after_cursor(o, F.lit(datetime(2000, 1, 1, tzinfo=UTC)).cast("timestamp"))
    return rows.select("id").withColumn("next_cursor", iso(nxt.select("cursor").scalar()))


# -- coverage -------------------------------------------------------------------------------------------------

cte(
    "scopes",
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 4 >= 2 THEN TIMESTAMP '2024-01-01' - to_days(CAST(c_custkey % 40 AS INT)) END AS covered_since,
  CASE WHEN c_custkey % 4 >= 1 THEN TIMESTAMP '2024-01-20' + to_days(CAST(c_custkey % 30 AS INT)) END AS until, TIMESTAMP '2024-02-10' AS run_start, TIMESTAMP '2024-01-11' AS initial_start,
  CASE WHEN c_custkey % 3 >= 1 THEN TIMESTAMP '2023-11-01' + to_days(CAST(c_custkey % 100 AS INT)) END AS since, CASE WHEN c_custkey % 3 = 2 THEN TIMESTAMP '2023-12-01' + to_days(CAST(c_custkey % 90 AS INT)) END AS until_arg FROM customer""",
)


def scopes(v):
    k = F.col("c_custkey")
    return v.table("customer").select(
        k.alias("k"), F.when(k % 4 >= 2, days("2024-01-01", -(k % 40))).alias("covered_since"), F.when(k % 4 >= 1, days("2024-01-20", k % 30)).alias("until"),
        F.lit("2024-02-10").cast("timestamp").alias("run_start"), F.lit("2024-01-11").cast("timestamp").alias("initial_start"),
        F.when(k % 3 >= 1, days("2023-11-01", k % 100)).alias("since"), F.when(k % 3 == 2, days("2023-12-01", k % 90)).alias("until_arg"),
    )


cte(
    "planned",
    """SELECT *, CASE WHEN f < run_start THEN f END AS forward_from, CASE WHEN f < run_start THEN run_start END AS forward_to,
  CASE WHEN back THEN since END AS backward_from, CASE WHEN back THEN CASE WHEN until_arg IS NULL THEN cov ELSE y END END AS backward_to, back AND (until_arg IS NULL OR (y >= cov AND since < cov)) AS record
FROM (SELECT *, coalesce(CASE WHEN until_arg IS NULL THEN since < cov ELSE since < y END, false) AS back FROM (
  SELECT *, coalesce(until, initial_start) AS f, CASE WHEN until IS NULL THEN initial_start ELSE coalesce(covered_since, until) END AS cov, least(until_arg, run_start) AS y FROM scopes))""",
    ("scopes",),
)
_RANGE = ("forward_from", "forward_to", "backward_from", "backward_to")


@query("r1_range_plan", "SELECT k, " + ", ".join(f"{SI(c)} AS {c}" for c in _RANGE) + ", record FROM planned", ("planned",))
def ranges(v):
    """Forward and backward range of every scope."""
    return C.plan_ranges(scopes(v)).select("k", *[iso(F.col(c)).alias(c) for c in _RANGE], "record")


@query(
    "r2_next_cursors",
    f"""SELECT k, {SI("greatest(run_start - INTERVAL 300 SECOND, coalesce(until, initial_start))")} AS cursor, {SI("CASE WHEN until IS NULL THEN initial_start ELSE until - INTERVAL 3 DAY END")} AS look_back FROM scopes""",
    ("scopes",),
)
def cursors(v):
    """The overlap cursor and the look-back of a listing."""
    frm = F.coalesce("until", "initial_start")
    return scopes(v).select("k", iso(C.next_cursor(frm, F.col("run_start"))).alias("cursor"), iso(C.look_back(frm, F.col("until").isNotNull())).alias("look_back"))


@query(
    "r3_folder_windows",
    f"""SELECT k, {SI('CASE WHEN b OR l THEN since ELSE base END')} AS window_from, {SI('CASE WHEN b THEN until_arg END')} AS window_until,
  {SI('CASE WHEN l THEN since WHEN b AND until_arg >= base THEN least(base, since) ELSE base END')} AS covered_since
FROM (SELECT *, since IS NOT NULL AND until_arg IS NOT NULL AS b, coalesce(since IS NOT NULL AND until_arg IS NULL AND since < base, false) AS l FROM (SELECT *, coalesce(covered_since, run_start - INTERVAL 30 DAY) AS base FROM scopes))""",
    ("scopes",),
)
def windows(v):
    """Window and coverage of folders."""
    s = scopes(v).withColumnRenamed("covered_since", "stored").withColumn("initial_days", F.lit(30))
    return C.folder_window(s).select("k", *[iso(F.col(c)).alias(c) for c in ("window_from", "window_until", "covered_since")])


@query(
    "r4_coverage_extension",
    f"""SELECT k, {SI('CASE WHEN covered_since IS NULL OR (backward_to >= covered_since AND backward_from < covered_since) THEN backward_from ELSE covered_since END')} AS covered_since FROM planned WHERE backward_from IS NOT NULL""",
    ("planned",),
)
def extension(v):
    """Only a window that touches the covered interval extends it."""
    p = C.plan_ranges(scopes(v)).where(F.col("backward_from").isNotNull())
    return p.select("k", iso(C.extend(F.col("covered_since"), F.col("backward_from"), F.col("backward_to"))).alias("covered_since"))


@query(
    "r6_backfill_windows",
    f"""SELECT k, {SI('w_from')} AS window_from, {SI('w_to')} AS window_to FROM (
  SELECT k, greatest(date_trunc('day', backward_to + INTERVAL 9 HOUR) - INTERVAL 9 HOUR - to_days(CAST(7 * (n + 1) AS INT)), backward_from) AS w_from,
    CASE WHEN n = 0 THEN backward_to ELSE date_trunc('day', backward_to + INTERVAL 9 HOUR) - INTERVAL 9 HOUR - to_days(CAST(7 * n AS INT)) END AS w_to
  FROM planned, range(0, 60) r(n) WHERE backward_from < backward_to) WHERE w_to > w_from""",
    ("planned",),
)
def backfill(v):
    """Seven-day windows of the backward ranges at local midnights."""
    w = C.backfill_windows(C.plan_ranges(scopes(v)).select("k", "backward_from", "backward_to"), "Asia/Tokyo")
    return w.select("k", iso(F.col("window_from")).alias("window_from"), iso(F.col("window_to")).alias("window_to"))


@query("u5_union_range", f"SELECT {SI('min(backward_from)')} AS lo, {SI('max(backward_to)')} AS hi FROM planned", ("planned",))
def union_range(v):
    """Bounding range of all backward ranges."""
    r = C.union_range(C.plan_ranges(scopes(v)))
    return r.select(iso(F.col("from")).alias("lo"), iso(F.col("to")).alias("hi"))


@query(
    "a9_coverage_fold",
    f"SELECT account_id, 'slack' AS source, {SI('max(covered_since)')} AS covered_since, {SI('min(to_timestamp(until_s)::TIMESTAMP)')} AS covered_until FROM cursors WHERE starts_with(key, 'conv:') GROUP BY 1",
    ("cursors",),
)
def fold(v):
    """The coverage that holds for every scope of an account."""
    f = C.fold(C.chat_scopes(v.cursors))
    return f.select("account_id", "source", iso(F.col("covered_since")).alias("covered_since"), iso(F.col("covered_until")).alias("covered_until"))


@query(
    "r9_watched_threads",
    """SELECT account_id, key, CASE WHEN age > 45 * 86400 THEN 'forget' WHEN age <= 7 * 86400 AND c % 2 = 0 THEN 'fetch' ELSE 'none' END AS action FROM (
  SELECT account_id, key, CAST(regexp_replace(key, '^watch:C', '') AS BIGINT) AS c, 1707523200 - active_s - 0.0001 AS age FROM cursors WHERE starts_with(key, 'watch:'))""",
    ("cursors",),
)
def watched(v):
    """Threads that are fetched, kept or forgotten by age."""
    e = v.table("customer").where(F.col("c_custkey") % 2 == 0).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("source_id"))
    return C.watched_threads(v.cursors, e, NOW, deep=False).select("account_id", "key", "action")


@query(
    "r10_dormant_scopes",
    """SELECT key, NOT c % 10 = 1 AND 1707523200 - active_s - 0.0001 > 30 * 86400 AS dormant FROM (SELECT key, active_s, CAST(regexp_replace(key, '^[a-z]+:C', '') AS BIGINT) AS c FROM cursors)""",
    ("cursors",),
)
def dormant_scopes(v):
    """Conversations without activity for 30 days, full ones excepted."""
    from lorekeep.functions.times import message_time

    full = F.regexp_replace("key", "^[a-z]+:C", "").cast("long") % 10 == 1
    d = C.dormant(message_time(F.get_json_object("value", "$.last_activity")), F.lit(NOW).cast("timestamp"), full)
    return v.cursors.select("key", d.alias("dormant"))


@query(
    "r5_day_entries",
    """SELECT channel || ':day:' || strftime(at, '%Y-%m-%d') AS source_id, strftime(date_trunc('day', at) - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS created_at, count(*) AS messages, arg_max(ts, (secs, turn)) AS last_ts FROM (
  SELECT *, to_timestamp(secs)::TIMESTAMP + INTERVAL 9 HOUR AS at FROM messages) WHERE coalesce(subtype, '') <> 'thread_broadcast' AND reply_count = 0 GROUP BY 1, 2""".replace(" at,", " x,").replace("(at,", "(x,").replace("at)", "x)").replace("AS at", "AS x"),
    ("messages",),
)
def day_entries(v):
    """Messages of a conversation by local day (every reply taken for a top-level message)."""

    m = _messages(v).withColumns({"channel": F.split_part("source_id", F.lit(":"), F.lit(1)), "thread_ts": F.lit(None).cast("string")})
    none = m.select("source_id", F.col("ts").alias("last_ts")).limit(0)
    d = C.day_entries(m, none, "Asia/Tokyo")
    return d.select("source_id", iso(F.col("created_at")).alias("created_at"), "messages", "last_ts")


@query(
    "r7_high_water_append",
    "SELECT source_id, ts FROM messages WHERE turn > CAST(split_part(source_id, ':', 2) AS BIGINT) % 4",
    ("messages",),
)
def high_water(v):
    """Messages past the stored mark; late ones wait for a refetch."""

    m = _messages(v)
    conv = F.split_part("source_id", F.lit(":"), F.lit(2)).cast("long")
    mark = F.concat((F.lit(1704067200) + conv * 3600 + (conv % 4) * 1500).cast("string"), F.lit("."), F.lpad((conv % 4).cast("string"), 6, "0"))
    state = m.select("source_id").distinct().select("source_id", mark.alias("last_ts"))
    return C.high_water(m, state).select("source_id", "ts")


@query(
    "r8_thread_discovery",
    """SELECT channel || ':' || ts AS source_id, CASE c % 3 WHEN 0 THEN 'new_thread' WHEN 1 THEN 'new_replies' END AS reason FROM (SELECT *, CAST(split_part(source_id, ':', 2) AS BIGINT) AS c FROM messages WHERE turn = 0)""",
    ("messages",),
)
def threads(v):
    """New threads, threads with new replies, and those up to date."""

    m = _messages(v).withColumn("channel", F.split_part("source_id", F.lit(":"), F.lit(1)))
    conv = F.split_part("source_id", F.lit(":"), F.lit(2)).cast("long")
    par = m.where(F.col("ts") == F.col("thread_ts")).withColumn("latest_reply", F.concat((F.lit(1704067200) + conv * 3600 + 60).cast("string"), F.lit(".5")))
    state = par.where(conv % 3 != 0).select(F.concat_ws(":", "channel", "ts").alias("source_id"), F.when(conv % 3 == 1, F.col("ts")).otherwise(F.col("latest_reply")).alias("last_ts"), F.lit(True).alias("exists"))
    return C.discover_threads(par, state, F.col("reply_count") > 0).select("source_id", "reason")
