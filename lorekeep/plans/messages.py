"""Chat threads over conversations, calendar events over orders, drive items over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions.times import iso
from lorekeep.operators import items as I
from lorekeep.operators import meetings as G
from lorekeep.operators import messages as M
from lorekeep.operators.skew import cut
from lorekeep.plans import query
from lorekeep.plans.ctes import cte, iso as SI

cte(
    "spoken",
    """SELECT m.*, to_timestamp(secs)::TIMESTAMP + to_microseconds(turn) AS msg_at, coalesce(nullif(trim(real_name), ''), nullif(trim(display_name), ''), nullif(trim(name), ''), usr) AS who
FROM messages m LEFT JOIN directory d ON d.user_id = m.usr""",
    ("messages", "directory"),
)


def _messages(v):
    return M.parse_messages(v.message_segments.withColumnRenamed("turn", "line_no"))


def _spoken(v, messages=None):
    labels = M.directory_labels(v.directory)
    return M.with_speaker(M.render_bodies(_messages(v) if messages is None else messages, labels), labels)


@query(
    "s4_parse_messages",
    f"""SELECT source_id, {SI('msg_at')} AS "at", ts, usr AS "user", text FROM spoken""",
    ("spoken",),
)
def parse(v):
    """JSON lines to messages; a message stored twice keeps its last form."""
    return _messages(v).select("source_id", iso(F.col("at")).alias("at"), "ts", "user", "text")


@query(
    "s4_failed_entries",
    """SELECT 'c:' || conv_id AS source_id, 'failed' AS outcome, count(*) AS n_lines FROM conversations WHERE conv_id % 3 = 1 AND turn % 2 = 1 OR conv_id % 3 = 2 AND turn % 3 = 1 GROUP BY conv_id""",
)
def failed(v):
    """Entries with lines that are no JSON message with a stamp; blank lines don't count."""
    k, turn = F.col("conv_id") % 3, F.col("turn")
    good = F.to_json(F.struct(F.concat((turn + 1).cast("string"), F.lit(".0")).alias("ts"), F.col("text").alias("text")))
    line = F.when((k == 1) & (turn % 2 == 1), F.to_json(F.struct("text"))).when((k == 2) & (turn % 3 == 1), "{ no json").when((k == 0) & (turn % 2 == 1), " ").otherwise(good)
    seg = v.table("conversations").select(F.concat(F.lit("c:"), F.col("conv_id").cast("string")).alias("source_id"), F.lit(0).alias("seq"), turn.alias("line_no"), line.alias("line"))
    return M.failed_entries(seg)


@query("c16_speakers", "SELECT source_id, ts, who FROM spoken", ("spoken",))
def speakers(v):
    """Speaker names from the directory, the id as a last resort."""
    return M.with_speaker(_messages(v), M.directory_labels(v.directory)).select("source_id", "ts", "who")


@query(
    "c9_render_text",
    """SELECT conv_id, turn, '@' || coalesce(nullif(trim(real_name), ''), nullif(trim(display_name), ''), nullif(trim(name), ''), 'U' || (turn * 6 % 60)) || ' see page ' || turn
  || ' (https://x.example/' || conv_id || ') & @here #general a@b.c https://y.example/ @Bo ' || length(text) AS text
FROM conversations LEFT JOIN directory d ON d.user_id = 'U' || (turn * 6 % 60)""",
    ("directory",),
)
def render(v):
    """Mentions, channels, specials, mail and web links, entities."""
    t, c = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    text = F.concat(
        F.lit("<@U"), (F.col("turn") * 6 % 60).cast("string"), F.lit("> see <https://x.example/"), c, F.lit("|page "), t,
        F.lit("> &amp; <!here> <#C1|general> <mailto:a@b.c> <https://y.example/> <@U99|Bo> "), F.length("text").cast("string"),
    )
    m = v.table("conversations").select("conv_id", "turn", text.alias("text"))
    return M.render_text(m, ["conv_id", "turn"], "text", M.directory_labels(v.directory))


cte(
    "lines",
    """SELECT s.*, CASE WHEN x.multi THEN strftime(msg_at, '%Y-%m-%d %H:%M') ELSE strftime(msg_at, '%H:%M') END || ' ' || who || ': ' || trim(text) AS line
FROM spoken s JOIN (SELECT source_id, min(CAST(msg_at AS DATE)) <> max(CAST(msg_at AS DATE)) AS multi FROM spoken GROUP BY 1) x USING (source_id)""",
    ("spoken",),
)


@query("c15_conversation_lines", "SELECT source_id, ts, line FROM lines", ("lines",))
def lines(v):
    """One stamped line per message."""
    return M.conversation_lines(_spoken(v), "UTC").select("source_id", "ts", "line")


@query(
    "c15_conversation_text",
    "SELECT source_id, count(*) AS n_pieces, string_agg(line, chr(10) ORDER BY msg_at) AS text FROM lines GROUP BY 1",
    ("lines",),
)
def text(v):
    """The rendered conversation in order."""
    return M.conversation_text(M.conversation_lines(_spoken(v), "UTC"))


@query(
    "w13_titles",
    f"""WITH l AS (SELECT source_id, msg_at, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM spoken),
f AS (SELECT source_id, arg_min(trim(l), (msg_at, i)) AS l FROM l WHERE length(trim(l)) >= 4 GROUP BY 1)
SELECT source_id, '#room-' || substr(split_part(source_id, ':', 1), 2) || ' ' || CASE WHEN length(l) > 46 THEN substr(l, 1, 45) || '…' ELSE l END AS title,
  {SI('first_at')} AS first_at, {SI('last_at')} AS last_at
FROM f JOIN (SELECT source_id, min(msg_at) AS first_at, max(msg_at) AS last_at FROM spoken GROUP BY 1) USING (source_id)""",
    ("spoken",),
)
def titles(v):
    """Channel label and first meaningful line."""
    m = _spoken(v)
    bodies = M.title_bodies(m, M.directory_labels(v.directory))
    name = F.concat(F.lit("room-"), F.substring(F.split_part("source_id", F.lit(":"), F.lit(1)), 2, 9))
    conv = m.select("source_id").distinct().select(
        "source_id", M.conversation_label(F.lit("channel"), name, F.lit(None), F.lit(None), F.lit(None)).alias("conv_label"), F.lit(False).alias("is_day")
    )
    t = M.titles(m, bodies, conv, "UTC")
    return t.select("source_id", "title", iso(F.col("first_at")).alias("first_at"), iso(F.col("last_at")).alias("last_at"))


@query(
    "a23_participants",
    f"SELECT source_id, who, {SI('min(msg_at)')} AS first_at, count(*) AS messages FROM spoken GROUP BY 1, 2",
    ("spoken",),
)
def people(v):
    """Speakers of every conversation by first appearance."""
    p = M.participants(M.with_speaker(_messages(v), M.directory_labels(v.directory)))
    return p.select("source_id", "who", iso(F.col("first_at")).alias("first_at"), "messages")


@query(
    "a29_activity_marker",
    "SELECT channel, max(ts) AS last_ts FROM (SELECT channel, arg_max(ts, (secs, turn)) AS ts FROM messages GROUP BY 1) GROUP BY 1",
    ("messages",),
)
def activity(v):
    """Latest message stamp of every channel."""
    m = _messages(v).withColumn("channel", F.split_part("source_id", F.lit(":"), F.lit(1)))
    return m.groupBy("channel").agg(F.max_by("ts", "at").alias("last_ts"))


@query(
    "p14_day_messages",
    "SELECT source_id, ts FROM messages WHERE reply_count = 0 AND thread_ts = ts AND coalesce(subtype, '') <> 'thread_broadcast' UNION ALL "
    "SELECT source_id, ts || '-top' FROM messages WHERE reply_count = 0 AND coalesce(subtype, '') <> 'thread_broadcast'",
    ("messages",),
)
def day_messages(v):
    """Messages of day entries, as stored and with every reply taken for a top-level message."""
    m = _messages(v)
    top = m.withColumns({"thread_ts": F.lit(None).cast("string")}).where(M.is_day_message())
    return m.where(M.is_day_message()).select("source_id", "ts").unionByName(top.select("source_id", F.concat("ts", F.lit("-top")).alias("ts")))


@query(
    "p15_involvement",
    "SELECT source_id, ts FROM messages WHERE usr = 'U4' OR contains(text, '<@U4') OR turn = 3",
    ("messages",),
)
def involvement(v):
    """Broadcast, written by me, or mentioning me (turn 3 is taken for a broadcast)."""
    m = _messages(v)
    third = F.col("ts").endswith(".000003")
    m = m.withColumn("text", F.when(third, F.concat(F.lit("<!here> "), "text")).otherwise(F.col("text")))
    return m.where(M.involves("U4")).select("source_id", "ts")


@query(
    "p16_conversation_classes",
    """SELECT id, channel_kind, CASE WHEN c.name IN ('room-3', 'noise') THEN NULL WHEN channel_kind = 'dm' AND coalesce(is_bot, false) THEN NULL
  WHEN channel_kind IN ('dm', 'group_dm') THEN 'full' WHEN c.name = 'room-5' THEN 'full' WHEN member THEN 'involvement' END AS class
FROM (SELECT 'D' || c_custkey AS id, 'room-' || (c_custkey % 12) AS name, CASE c_custkey % 4 WHEN 0 THEN 'dm' WHEN 1 THEN 'group_dm' WHEN 2 THEN 'private' ELSE 'channel' END AS channel_kind,
  c_custkey % 7 <> 0 AS member, 'U' || (c_nationkey * 2) AS usr FROM customer) c LEFT JOIN directory d ON d.user_id = c.usr""",
    ("directory",),
)
def classes(v):
    """Excluded, full and involvement-only conversations."""
    c = F.col("c_custkey")
    convs = v.table("customer").select(
        F.concat(F.lit("D"), c.cast("string")).alias("id"), F.concat(F.lit("room-"), (c % 12).cast("string")).alias("name"),
        F.concat(F.lit("U"), (F.col("c_nationkey") * 2).cast("string")).alias("user"),
        (c % 4 == 0).alias("is_im"), (c % 4 == 1).alias("is_mpim"), (c % 4 == 2).alias("is_private"), (c % 7 != 0).alias("is_member"),
    )
    out = M.classify_conversations(convs, v.directory, full=["#room-5"], exclude=["room-3", "noise"])
    return out.select("id", "channel_kind", "class")


@query(
    "j18_harvested_profiles",
    """SELECT user_id, coalesce(nullif(trim(real_name), ''), nullif(trim(display_name), ''), nullif(trim(name), '')) AS label FROM directory
UNION ALL SELECT usr, arg_min('Guest ' || conv, (msg_at, 'Guest ' || conv)) FROM (SELECT *, split_part(source_id, ':', 2) AS conv FROM spoken) WHERE usr NOT IN (SELECT user_id FROM directory) GROUP BY 1""",
    ("spoken", "directory"),
)
def harvest(v):
    """Profiles embedded in messages fill the gaps of the directory only."""
    m = _messages(v)
    guest = F.concat(F.lit("Guest "), F.split_part("source_id", F.lit(":"), F.lit(2)))
    m = m.withColumn("user_profile", F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("display_name"), F.lit("").alias("real_name"), guest.alias("first_name")))
    return M.harvest_profiles(m, v.directory)


def _excerpt_sql(max_chars: int) -> str:
    """The link's message, the first one, two before and one after in turn, each taken, cut or left by the room that is left."""
    near = {0: "i", 1: "0 AND i <> 0", 2: "i - 1 AND i > 1", 3: "i - 2 AND i > 2", 4: "i + 1"}
    joins = " ".join(f"LEFT JOIN l l{p} ON l{p}.source_id = c.source_id AND l{p}.no = {at}" for p, at in near.items())
    out = f"""SELECT c.*, {max_chars} - length(header) - 1 AS b0, {", ".join(f"l{p}.line AS t{p}" for p in near)} FROM c {joins}"""
    for p in near:
        fits, cut = f"length(t{p}) + 1 <= b{p}", f"length(t{p}) + 1 > b{p} AND b{p} >= 80"
        short = f"CASE WHEN length(t{p}) > b{p} - 1 THEN substr(t{p}, 1, b{p} - 2) || '…' ELSE t{p} END"
        out = f"""SELECT *, CASE WHEN {fits} THEN t{p} WHEN {cut} THEN {short} END AS x{p}, CASE WHEN {fits} THEN b{p} - length(t{p}) - 1 WHEN {cut} THEN 0 ELSE b{p} END AS b{p + 1} FROM ({out})"""
    return f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY msg_at) - 1 AS no FROM spoken),
l AS (SELECT source_id, no, who || ': ' || CASE WHEN length(b) > 600 THEN substr(b, 1, 599) || '…' ELSE b END AS line FROM (
   SELECT source_id, no, who, trim('[linked document] ' || text) AS b FROM n)),
c AS (SELECT source_id, no AS i, '#c, ' || strftime(msg_at, '%Y-%m-%d') AS header FROM n)
SELECT source_id, i AS no, concat_ws(chr(10), header, x1, x3, x2, x0, x4) AS excerpt FROM ({out})"""


@query("w12_link_excerpts", _excerpt_sql(1_500), ("spoken",))
def excerpts(v):
    """Context around every message that holds a document link (here each one does)."""
    return _excerpts(v, 1_500)


def _excerpts(v, max_chars):
    link = F.concat(F.lit("https://docs.google.com/document/d/x"), F.regexp_replace("ts", "[.]", ""))
    m = M.numbered(_spoken(v)).withColumn("body", F.concat(link, F.lit(" "), "body")).withColumn("urls", F.array(link))
    links = m.select("source_id", "no", F.lit("k").alias("link_key"))
    conv = m.select("source_id").distinct().select("source_id", F.lit("#c").alias("conv_label"), F.lit(True).alias("is_thread"))
    return M.excerpts(links, m, conv, "UTC", max_chars).select("source_id", "no", "excerpt")


@query("w12_short_excerpts", _excerpt_sql(200), ("spoken",))
def short_excerpts(v):
    """The same with a small budget, so that lines are cut or left out."""
    return _excerpts(v, 200)


def _calendar(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    guest = F.struct(
        F.concat(F.lit("u"), c.cast("string"), F.lit("@example.org")).alias("email"),
        F.when(k % 3 != 0, F.concat(F.lit("User "), c.cast("string"))).alias("displayName"),
        (k % 2 == 0).alias("self"), F.when(k % 5 == 0, "declined").otherwise("accepted").alias("responseStatus"), F.lit(False).alias("resource"),
    )
    room = F.struct(F.lit("room@example.org").alias("email"), F.lit("Room").alias("displayName"), F.lit(False).alias("self"),
                    F.lit("accepted").alias("responseStatus"), F.lit(True).alias("resource"))
    doc = F.struct(F.when(k % 4 != 3, G.DOC_MIME).otherwise("text/plain").alias("mimeType"),
                   F.when(k % 2 == 0, F.concat(F.lit("f"), k.cast("string"))).alias("fileId"),
                   F.concat(F.lit("https://docs.google.com/document/d/u"), k.cast("string"), F.lit("/edit")).alias("fileUrl"))
    event = F.struct(
        F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("confirmed").alias("status"),
        F.concat(F.lit("Meeting "), c.cast("string")).alias("summary"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("start"),
        F.when(k % 7 == 0, F.concat(F.lit("rec"), c.cast("string"))).alias("recurringEventId"),
        F.array(guest, room).alias("attendees"), F.array(doc).alias("attachments"),
    )
    return v.table("orders").select(k.alias("event_id"), F.to_json(event).alias("event"))


@query(
    "s9_calendar_attachments",
    """SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey ELSE 'u' || o_orderkey END AS source_id, 'Meeting ' || o_custkey AS event_title,
  strftime(o_orderdate, '%Y-%m-%d') AS event_start, o_orderkey % 7 = 0 AS recurring,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CASE WHEN o_orderkey % 3 <> 0 THEN 'User ' || o_custkey ELSE 'u' || o_custkey || '@example.org' END END AS people
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 4 <> 3 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 = 0)""",
)
def calendar(v):
    """Attached documents of events that were neither cancelled nor declined; rooms and decliners are dropped."""
    w = G.calendar_work(_calendar(v))
    names = F.array_join(F.transform("attendees", lambda a: a["name"]), ",")
    return w.select("event_id", "source_id", "event_title", "event_start", "recurring", names.alias("people"))


@query(
    "p24_drive_items",
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 OR p_partkey % 10 = 3 THEN 'not_found' WHEN p_partkey % 10 IN (1, 2) OR p_size % 5 = 0 THEN 'not_applicable' ELSE 'file' END AS outcome,
  CASE p_partkey % 10 WHEN 0 THEN 'deleted at its source' WHEN 1 THEN 'a folder, not a file' WHEN 2 THEN 'a package, not a file'
    WHEN 3 THEN 'drive or item number missing' ELSE CASE WHEN p_size % 5 = 0 THEN 'no reader for .one' END END AS reason,
  'i' || p_partkey AS item_id, CASE p_size % 3 WHEN 0 THEN 'export' WHEN 1 THEN 'download' ELSE 'unsupported' END AS plan FROM part""",
)
def drive_items(v):
    """Deleted, folder, package, unreadable and unsupported items; a remote item is followed."""
    k = F.col("p_partkey")
    ident = k.cast("string")
    target = F.struct(
        F.concat(F.lit("i"), ident).alias("id"),
        F.when(k % 10 != 3, F.struct(F.concat(F.lit("d"), ident).alias("driveId"))).alias("parentReference"),
        F.concat("p_name", F.when(F.col("p_size") % 5 == 0, ".one").otherwise(".docx")).alias("name"),
        F.when(k % 10 == 1, F.struct(F.lit(1).alias("childCount"))).alias("folder"),
        F.when(k % 10 == 2, F.struct(F.lit("x").alias("type"))).alias("package"),
        F.when(k % 10 == 0, F.struct(F.lit("deleted").alias("state"))).alias("deleted"),
    )
    plain = F.to_json(target)
    remote = F.to_json(F.struct(F.lit("shortcut").alias("id"), target.alias("remoteItem")))
    mime = F.when(F.col("p_size") % 3 == 0, G.DOC_MIME).when(F.col("p_size") % 3 == 1, "text/csv").otherwise("image/png")
    items = v.table("part").select("p_partkey", F.when(k % 2 == 0, plain).otherwise(remote).alias("item"), mime.alias("mime"))
    out = G.classify_drive_items(items, ["one", "onetoc2", "loop"])
    return out.select("p_partkey", "outcome", "reason", "item_id", G.export_plan(F.col("mime")).alias("plan"))


def notes_markdown(v):
    """Meeting notes written around the lines of a document: title, people, four sections, a transcript."""
    i = F.col("doc_id").cast("string")
    first, second = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(2))
    md = F.concat(
        F.lit("## Sync "), i, F.lit(" (recurring)\n\nInvited [Ann](mailto:a"), i, F.lit("@x.org) ~~[Bob](mailto:b@x.org)~~ [Cy](mailto:c@x.org)\n"),
        F.lit("[cal](https://calendar.google.com/e"), i, F.lit(") [t](https://docs.google.com/t"), i, F.lit(")\n\n### Summary\n\n"),
        F.regexp_replace(first, r"[^\p{L} ]", ""), F.lit("\n\n### Decisions\n\n- "), F.trim(F.regexp_replace(second, r"[^\p{L} ]", "")),
        F.lit("\n\n### Suggested next steps\n- step [1:02](#x) \\[ok\\]\n\n\n\n- last\n### Details\n## inner\nbody "), i,
        F.lit("\n*How is the quality of these notes?*\n# 📖 Transcript\nsaid "), i, F.lit("\n"),
    )
    meta = F.concat(F.lit('{"event_title":"Event '), i, F.lit('","event_start":"2024-03-05T10:00:00Z"}'))
    return v.table("documents").select(F.concat(F.lit("n"), i).alias("source_id"), md.alias("markdown"), meta.alias("metadata"))


_T1 = r"trim(regexp_replace(split_part(text, chr(10), 1), '[^\p{L} ]', '', 'g'))"
_T2 = r"trim(regexp_replace(split_part(text, chr(10), 2), '[^\p{L} ]', '', 'g'))"


@query(
    "c36_notes_sections",
    f"""SELECT 'n' || doc_id AS source_id, kind, text FROM (
  SELECT doc_id, 'overview' AS kind, {_T1} AS text FROM documents UNION ALL SELECT doc_id, 'decisions', trim('- ' || {_T2}) FROM documents
  UNION ALL SELECT doc_id, 'action_items', '- step 1:02 [ok]' || chr(10) || chr(10) || '- last' FROM documents
  UNION ALL SELECT doc_id, 'details', '### inner' || chr(10) || 'body ' || doc_id FROM documents) WHERE text <> ''""",
)
def notes_sections(v):
    """Notes cut at their headings and cleaned."""
    return G.parse_notes(notes_markdown(v).drop("metadata"))[1].select("source_id", "kind", "text")


@query(
    "c37_meetings",
    f"""SELECT 'n' || doc_id AS source_id, 'Sync ' || doc_id AS meeting_title, true AS recurring, 'Ann,Cy' AS participants, 'Bob' AS absentees,
  'https://docs.google.com/t' || doc_id AS transcript_url, 'said ' || doc_id AS transcript, '2024-03-05T10:00:00Z' AS created FROM documents""",
)
def meetings(v):
    """Title, recurrence, people, transcript and time of a meeting."""
    notes = notes_markdown(v)
    docs, _ = G.parse_notes(notes.drop("metadata"))
    m = G.resolve_meeting(docs.join(notes.select("source_id", "metadata"), "source_id"))
    names = lambda c: F.array_join(F.transform(c, lambda p: p["name"]), ",")
    return m.select("source_id", "meeting_title", "recurring", names("participants").alias("participants"), names("absentees").alias("absentees"),
                    "transcript_url", "transcript", iso(F.col("created")).alias("created"))


def _lines(v):
    """Numbered lines of the rendered conversations, by their number."""
    return _by_entry(M.numbered_lines(M.conversation_lines(_spoken(v), "UTC")))


def _by_entry(rows):
    return rows.select(F.split_part("source_id", F.lit(":"), F.lit(2)).cast("long").alias("entry_id"), "line_no", "line")


@query(
    "w10_message_blocks",
    """SELECT CAST(split_part(source_id, ':', 2) AS BIGINT) AS entry_id, row_number() OVER (PARTITION BY source_id ORDER BY msg_at) AS block, strftime(msg_at, '%H:%M') AS hm, ' ' || who || ': ' || trim(text) AS text FROM spoken""",
    ("spoken",),
)
def message_blocks(v):
    """Rendered conversations cut back into messages at their stamps."""
    return I.message_blocks(_lines(v)).select("entry_id", "block", "hm", "text")


_N = r"trim(regexp_replace(regexp_replace(lower({}), '[*_`~]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "w11_occurred_times",
    f"""WITH b AS (SELECT source_id, turn, msg_at, x.multi, {_N.format("' ' || who || ': ' || trim(text)")} AS n, {_N.format("substr(text, 1, 40)")} AS q FROM spoken JOIN (SELECT source_id, min(CAST(msg_at AS DATE)) <> max(CAST(msg_at AS DATE)) AS multi FROM spoken GROUP BY 1) x USING (source_id))
SELECT CAST(split_part(a.source_id, ':', 2) AS BIGINT) AS entry_id, CAST(a.turn AS INT) AS ordinal, CASE WHEN any_value(a.multi) THEN strftime(min(c.msg_at), '%Y-%m-%dT%H:%M:00Z') ELSE '2024-01-01' || strftime(min(c.msg_at), 'T%H:%M:00Z') END AS occurred_at
FROM b a JOIN b c ON c.source_id = a.source_id AND contains(c.n, a.q) GROUP BY 1, 2""",
    ("spoken",),
)
def occurred_times(v):
    """Time of the first message that holds a quote; without dates in the stamps the entry's day counts."""
    # Each step is written once: where one plan held them all, it rendered the messages a dozen times over, and analysing and
    # compiling that took more memory of the driver than any table does.
    messages = cut(_messages(v), "messages")
    spoken = cut(_spoken(v, messages).select("source_id", "at", "who", "body"), "spoken")
    stamped = cut(M.conversation_lines(spoken, "UTC").select("source_id", "at", "line"), "stamped-lines")
    lines = cut(_by_entry(M.numbered_lines(stamped)), "lines")
    q = messages.select(
        F.split_part("source_id", F.lit(":"), F.lit(2)).cast("long").alias("entry_id"), F.split_part("ts", F.lit("."), F.lit(2)).cast("int").alias("ordinal"),
        X.match_norm(F.substring("text", 1, 40)).alias("quote_norm"))
    bodies = q.select("entry_id").distinct().withColumn("source_created_at", F.lit("2024-01-01").cast("timestamp"))
    return I.occurred_times(q, bodies, "UTC", lines).select("entry_id", "ordinal", iso(F.col("at")).alias("occurred_at"))


@query(
    "c18_block_text",
    """SELECT conv_id, turn, 'Turn ' || turn || ' @' || coalesce(nullif(trim(real_name), ''), nullif(trim(display_name), ''), nullif(trim(name), ''), 'U0') || chr(10) || length(text) || ' chars' || chr(10) || '- one (http://x)' || chr(10) || '> T / @here' AS body
FROM conversations LEFT JOIN directory d ON d.user_id = 'U0'""",
    ("directory",),
)
def block_text(v):
    """Text of layout blocks, rich text, lists and attachments; a repeated fragment counts once."""
    turn = F.col("turn").cast("string")
    sec = F.concat(F.lit('{"type":"section","text":{"text":"Turn '), turn, F.lit(' <@U0>"}}'))
    rich = F.concat(
        F.lit('{"type":"rich_text","elements":[{"type":"rich_text_section","elements":[{"type":"text","text":"'), F.length("text").cast("string"),
        F.lit(' chars"}]},{"type":"rich_text_list","elements":[{"elements":[{"type":"link","url":"http://x","text":"one"}]}]}]}'))
    blocks = F.concat(F.lit("["), F.concat_ws(",", sec, rich, sec), F.lit("]"))
    line = F.to_json(F.struct(
        F.concat((F.col("turn") + 1).cast("string"), F.lit(".0")).alias("ts"), F.lit(" ").alias("text"), blocks.alias("blocks"),
        F.array(F.struct(F.lit("T").alias("title"), F.lit("<!here>").alias("text"))).alias("attachments")))
    seg = v.table("conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.lit(0).alias("seq"), F.col("turn").alias("line_no"), line.alias("line"))
    m = M.render_bodies(M.parse_messages(seg), M.directory_labels(v.directory))
    return m.select(F.col("source_id").cast("long").alias("conv_id"), (F.split_part("ts", F.lit("."), F.lit(1)).cast("long") - 1).alias("turn"), "body")
