"""Operators on literal rows: edge cases, order independence, skew, brute force."""

import hashlib
import json
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.functions import times as TM
from lorekeep.functions import urls as U
from lorekeep.operators import coverage as C
from lorekeep.operators import folders as D
from lorekeep.operators import items as I
from lorekeep.operators import ledger as B
from lorekeep.operators import links as L
from lorekeep.operators import messages as M
from lorekeep.operators import search as S
from lorekeep.operators import upserts as P
from lorekeep.operators.skew import joined_text, prefix_sum, top_n
from lorekeep.sources import pages as G


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], schema).select(expr.alias("r")).first()["r"]


def t(s):
    return datetime.fromisoformat(s).replace(tzinfo=UTC)


# -- functions ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [("Ｆｕｌｌ  *Width*\n_x_ ", "full width x"), ("  ", ""), ("~~a~~　b", "a b"), ("ﬁne", "fine")])
def test_match_norm(spark, raw, want):
    assert one(spark, X.match_norm(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [("", []), ("ab", ["ab"]), ("abcab", ["abc", "bca", "cab"]), ("日本語", ["日本語"]), ("a😀bc", ["a😀b", "😀bc"])])
def test_grams(spark, raw, want):
    assert one(spark, X.grams(F.col("t")), t=raw) == want


@pytest.mark.parametrize("term, want", [("aa", 3), ("b", 0), (".", 0)])
def test_occurrences_count_overlaps(spark, term, want):
    assert one(spark, X.occurrences(F.col("t"), term), t="aaaa") == want


@pytest.mark.parametrize("text, hit", [("write mira@tulip.test; thanks", True), ("almira@tulip.test", False), ("mira@tulip.test.fake", False), ("(mira@tulip.test)", True), ("mira@tulip.tests", False)])
def test_whole_email(spark, text, hit):
    assert one(spark, X.contains_email(F.col("t"), F.lit("mira@tulip.test")), t=text) is hit


@pytest.mark.parametrize("p, path, want", [
    ("*.md", "a/b.MD", True), ("a/*.md", "a/b/c.md", False), ("**/c.md", "c.md", True), ("**/c.md", "a/b/c.md", True), ("a?c", "abc", True), ("~$*", "x/~$doc", True), ("a+b.(c)", "a+b.(c)", True),
])
def test_globs(spark, p, path, want):
    assert one(spark, X.glob_match(F.col("t"), [p], path=True), t=path) is want


def test_clean_text(spark):
    assert one(spark, X.clean_text(F.col("t")), t="﻿\na \t\r\n\r\n\r\n\r\n\r\nb\u0007c  \n\n") == "a\n\n\nbc"


@pytest.mark.parametrize("url, kind, key", [
    ("https://docs.google.com/document/d/AbC_1-2/edit?x=1#h", "google.doc", "google:AbC_1-2"), ("https://docs.google.com/a/x.com/spreadsheets/u/1/d/Z9", "google.doc", "google:Z9"),
    ("https://drive.google.com/open?usp=s&id=Q1", "google.doc", "google:Q1"), ("https://docs.google.com/document/d/e/2PACX/pub", None, None),
    ("https://drive.google.com/drive/folders/F1", None, None), ("https://example.com/document/d/x", None, None), ("https://Team.SharePoint.com/s/a#b", "microsoft.file", None), ("https://notsharepoint.com/x", None, None),
])
def test_document_links(spark, url, kind, key):
    r = U.with_document_link(spark.createDataFrame([(url,)], "u string"), "u").collect()
    assert (r[0]["link_kind"] if r else None) == kind
    if key:
        assert r[0]["link_key"] == key
    if kind == "microsoft.file":
        assert r[0]["link_url"] == "https://team.sharepoint.com/s/a"


@pytest.mark.parametrize("url, want", [
    ("HTTP://u:p@Ex.com:80?utm_source=a&b=1&GCLID=2#f", "http://ex.com/?b=1"), ("https://ex.com:8443/a", "https://ex.com:8443/a"), ("ftp://x", None),
])
def test_canonical(spark, url, want):
    assert one(spark, U.canonical(F.col("t")), t=url) == want


@pytest.mark.parametrize("kind, at, tz, start, lo, hi", [
    ("week", "2024-03-31T12:00:00", "Europe/Berlin", "2024-03-25", "2024-03-24T23:00:00", "2024-03-31T22:00:00"),
    ("month", "2024-01-31T20:00:00", "Asia/Tokyo", "2024-02-01", "2024-01-31T15:00:00", "2024-02-29T15:00:00"),
    ("week", "2018-11-04T12:00:00", "America/Sao_Paulo", "2018-10-29", "2018-10-29T03:00:00", "2018-11-05T02:00:00"),
    ("month", "2024-12-31T23:59:59", "UTC", "2024-12-01", "2024-12-01T00:00:00", "2025-01-01T00:00:00"),
])
def test_periods(spark, kind, at, tz, start, lo, hi):
    p = one(spark, TM.period(kind, F.col("t").cast("timestamp"), tz), t=at)
    assert p["period_start"] == date.fromisoformat(start)
    assert spark.range(1).select(TM.iso(F.lit(p["starts_at"])).alias("a"), TM.iso(F.lit(p["ends_at"])).alias("b")).first() == (lo + "Z", hi + "Z")


def test_gap_midnight(spark):
    got = spark.range(1).select(TM.iso(TM.local_midnight(F.lit(date(2018, 11, 4)), "America/Sao_Paulo"))).first()[0]
    assert got == "2018-11-04T03:00:00Z"


def test_time_parameters():
    now = t("2024-05-10T12:00:00")
    assert TM.parse_when("2w", now) == now - timedelta(days=14)
    assert TM.parse_when("today", now, "Asia/Tokyo") == t("2024-05-09T15:00:00")
    assert TM.parse_date("2024-05-01", end_of_day=True) == t("2024-05-02T00:00:00")
    assert TM.parse_date("2024-05-01T01:00:00+01:00", end_of_day=True) == t("2024-05-01T00:00:00")
    with pytest.raises(ValueError):
        TM.parse_when("soon", now)


@pytest.mark.parametrize("title, want", [("Weekly Sync (recurring) 2024/05/01", "weekly sync"), ("定例 (定期)", "定例"), ("2024-05-01", ""), ("Plan B2", "plan b2")])
def test_meeting_titles(spark, title, want):
    assert one(spark, I.meeting_title(F.col("t")), t=title) == want


# -- skew helpers ---------------------------------------------------------------------------------------------


def test_prefix_sum_equals_window_on_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=37 * (i % 900)), i, i % 7) for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at timestamp, id int, v int")
    got = prefix_sum(df, ["k"], [F.date_trunc("day", "at"), F.date_trunc("hour", "at")], [F.col("at"), F.col("id")], F.col("v"), "run")
    run, want = {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        run[k] = run.get(k, 0) + v
        want[i] = run[k]
    assert {r["id"]: r["run"] for r in got.collect()} == want


def test_joined_text_is_one_row_in_order(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), "id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("x")).repartition(7)
    (row,) = joined_text(df, ["k"], ["id"], "x").collect()
    assert row["n_pieces"] == 5000 and row["text"] == "\n".join(f"line {i}" for i in range(5000))


def test_blocks_of_a_long_conversation(spark):
    # Several stretches of lines, with a second line in some messages.
    lines = [f"{h:02d}:{m:02d} a: {h} {m}" + ("\nmore" if m % 7 == 0 else "") for h in range(24) for m in range(60)]
    got = I.message_blocks(I.body_lines(spark.createDataFrame([(1, "head\n" + "\n".join(lines))], "entry_id long, body string"))).orderBy("block").collect()
    assert [f"{r['hm']}{r['text']}" for r in got] == lines


def test_many_quotes_of_one_conversation(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(2000)] + ["ab", "xyz ab"]
    quotes = [(1, k, rnd.choice(texts)[3 : 3 + rnd.randrange(1, 40)]) for k in range(10_000)] + [(1, 10_000, "nowhere to be found"), (1, 10_001, "ab"), (2, 0, "ab"), (1, 10_002, "")]
    blocks = spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "entry_id long, block long, norm string")
    got = I.quoted_blocks(spark.createDataFrame(quotes, "entry_id long, ordinal int, quote_norm string"), blocks).groupBy("entry_id", "ordinal").agg(F.min("block").alias("b")).collect()
    have = {(r["entry_id"], r["ordinal"]): r["b"] for r in got}
    for e, k, x in quotes[::97] + quotes[-4:]:
        first = next((n for n, y in enumerate(texts) if x in y), None) if e == 1 and x else None
        assert have.get((e, k)) == first
    whole = "\n".join(texts)
    assert len(have) == sum(e == 1 and x != "" and x in whole for e, _, x in quotes)


def test_lines_that_are_no_message_are_reported(spark):
    rows = [("c", 0, 0, '{"ts": "1.5", "text": "a"}'), ("c", 0, 1, "no json"), ("c", 0, 2, '{"text": "no stamp"}'), ("c", 0, 3, " ")]
    seg = spark.createDataFrame(rows, "source_id string, seq int, line_no int, line string")
    assert M.parse_messages(seg).count() == 1
    assert sorted(r["line_no"] for r in M.unreadable(seg).collect()) == [1, 2]


def test_titles_whose_lower_case_is_longer(spark):
    docs = spark.createDataFrame([(1, 1, "İİab", "xyz")], "section_id long, entry_id long, title string, text string")
    got = {r["gram"]: (r["title_tf"], r["text_tf"]) for r in S.postings(docs).collect()}
    low = "İİab".lower()
    assert got == {low[i : i + 3]: (1 + (low[i : i + 3] == low[:3] and low[:3] == low[2:5]), 0) for i in range(len(low) - 2)} | {"xyz": (0, 1)}


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = top_n(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


# -- items ----------------------------------------------------------------------------------------------------


def items_df(spark, rows):
    cols = "id long, entry_id long, kind string, text string, status string, owner string, requester string, actors array<string>, occurred_at timestamp, scope_key string"
    return spark.createDataFrame(rows, cols)


def brute(targets, pool, days=60, minimum=0.2):
    g = lambda s: {s[i : i + 3] for i in range(max(len(s) - 2, 1))}
    who = lambda r: {x.lower() for x in [*r[7], r[5], r[6]] if x}
    out = {}
    for a in targets:
        found = []
        for b in pool:
            if b[1] == a[1] or not timedelta(0) < b[8] - a[8] <= timedelta(days=days) or (a[9] != b[9] and not who(a) & who(b)):
                continue
            sim = len(g(a[3]) & g(b[3])) / len(g(a[3]) | g(b[3]))
            if sim >= minimum:
                found.append((-sim, b[8], b[0], a[9] == b[9], bool(who(a) & who(b))))
        for r, f in enumerate(sorted(found)[:3]):
            out[(a[0], r + 1)] = (f[2], round(-f[0], 9), f[3], f[4])
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_candidates_equal_brute_force(spark, hot):
    """Also with one scope, one text and few moments for most of the rows, and entries of many items."""
    rnd = random.Random(7)
    texts = ["send the report", "report was sent", "fix login bug", "login bug fixed today", "ab", "call the bank"]
    def row(i):
        sure = hot and rnd.random() < 0.7
        at = t("2024-01-01T00:00:00") + (timedelta(seconds=rnd.randrange(5)) if sure and rnd.random() < 0.5 else timedelta(days=rnd.randrange(0, 100), seconds=rnd.randrange(0, 90000, 1800)))
        return (i, rnd.randrange(40) if sure else i // 3, rnd.choice(["action", "resolved"]), "send the report" if sure else rnd.choice(texts), None,
                rnd.choice([None, "Ann", "bob"]), None, [rnd.choice(["ANN", "Cy", "Di"])], at, "s0" if sure else f"s{rnd.randrange(6)}")
    rows = [row(i) for i in range(260)]
    targets, pool = [r for r in rows if r[2] == "action"], [r for r in rows if r[2] != "action"]
    got = I.candidates(items_df(spark, targets), items_df(spark, pool)).collect()
    assert {(r["target_id"], r["rank"]): (r["candidate_id"], round(r["similarity"], 9), r["same_scope"], r["shared_person"]) for r in got} == brute(targets, pool)


def test_effective_status(spark):
    at = t("2024-01-10T00:00:00")
    rows = [(i, i, k, "x", s, None, None, [], at, "s") for i, (k, s) in enumerate([("action", "open"), ("question", "open"), ("action", "open"), ("action", "done"), ("decision", None), ("action", "open")])]
    rows += [(10, 10, "resolved", "x", None, None, None, [], at + timedelta(days=1), "s"), (11, 11, "resolved", "x", None, None, None, [], at - timedelta(days=1), "s"), (12, 12, "resolved", "x", None, None, None, [], None, "s")]
    links = spark.createDataFrame(
        [(10, 0, "resolves", "high"), (12, 1, "resolves", "medium"), (11, 2, "supersedes", "high"), (10, 3, "supersedes", "high"), (10, 5, "supersedes", "low"), (10, 4, "resolves", "high")],
        "from_item long, to_item long, relation string, confidence string")
    got = {r["id"]: r["effective_status"] for r in I.with_effective_status(items_df(spark, rows), links).collect()}
    assert [got[i] for i in range(6)] == ["done", "answered", "open", "done", None, "open"]


@pytest.mark.parametrize("ref, basis", [("Tanaka, Taro", "name"), ("taro tanaka", "name"), ("TaroTanaka", "name"), ("taro", None), ("me <TARO@x.org>", "email"), ("xtaro@x.org", None)])
def test_alias_matches(spark, ref, basis):
    keys = I.alias_keys(spark.createDataFrame([("names", "Taro Tanaka"), ("emails", "taro@x.org")], "field string, value string"))
    refs = spark.createDataFrame([(1, 0, ref)], "id long, pos int, ref string")
    got = I.match_references(refs, keys).collect()
    assert (got[0]["basis"] if got else None) == basis


def test_items_need_aliases(spark):
    with pytest.raises(ValueError):
        e = spark.createDataFrame([], "id long, account_id string, source_kind string, title string, source_created_at timestamp, source_updated_at timestamp, ingested_at timestamp")
        s = spark.createDataFrame([], "entry_id long, model string, profile string, prompt_version string")
        i = items_df(spark, []).withColumns({"due": F.lit(None).cast("date"), "confidence": F.lit("low")})
        k = spark.createDataFrame([], "from_item long, to_item long, relation string, confidence string")
        I.query_items(i, e, s, k, I.ItemQuery(who="mine"), t("2024-01-01"), spark.createDataFrame([], "field string, value string"))


def test_message_times_of_items(spark):
    body = "2024-03-05 09:00 Ann: we ship it\nwith notes\n2024-03-06 10:30 Bob: the login bug\nis fixed\nfoo 11:00 x"
    b = spark.createDataFrame([(1, body, t("2024-03-05T00:00:00"))], "entry_id long, body string, source_created_at timestamp")
    q = spark.createDataFrame([(1, 0, "login bug is fixed"), (1, 1, "ship it with"), (1, 2, "nowhere")], "entry_id long, ordinal int, quote_norm string")
    got = {r["ordinal"]: r["s"] for r in I.occurred_times(q, b, "Asia/Tokyo").withColumn("s", TM.iso(F.col("at"))).collect()}
    assert got == {0: "2024-03-06T01:30:00Z", 1: "2024-03-05T00:00:00Z"}


def test_lenient_output(spark):
    out = [(1, 'x {"overview": "o", "items": [{"kind": 5, "text": " t ", "actors": "Ann"}, 7, {"actors": ["a", 1, " "]}]} y'), (2, "none"), (3, '{"overview": 1, "items": []}'), (4, '{"overview": "o"}'), (5, "{bad}")]
    got = {r["id"]: r for r in I.parse_output(spark.createDataFrame(out, "id long, output string")).collect()}
    assert [d["actors"] for d in got[1]["drafts"]] == [["Ann"], ["a"]] and got[1]["drafts"][0]["kind"] is None and got[1]["drafts"][0]["text"] == "t"
    assert [got[i]["parse_error"] for i in range(1, 6)] == [None, "no JSON object found", 'missing "overview" string', 'missing "items" array', "invalid JSON"]


# -- messages -------------------------------------------------------------------------------------------------

LINE = '{"ts": "%s", "user": "%s", "text": "%s"%s}'


def segments(spark, lines):
    return spark.createDataFrame([("C1:1", i // 10, i, x) for i, x in enumerate(lines)], "source_id string, seq int, line_no int, line string")


def test_bodies(spark):
    blocks = '[{"type":"section","text":{"text":"hi <@U1>"}},{"type":"rich_text","elements":[{"type":"rich_text_section","elements":[{"type":"text","text":"a <b> "},{"type":"user","user_id":"U9"}]},{"type":"rich_text_list","elements":[{"elements":[{"type":"link","url":"http://x","text":"X"}]}]}]}]'
    esc = blocks.replace('"', '\\"')
    lines = [
        LINE % ("1.0", "U1", "<@U1> &lt;x&gt; <!here> <http://y|http://y>", ""),
        LINE % ("2.0", "U2", "", ', "blocks": "%s"' % esc),
        LINE % ("3.0", "U3", "t", ', "attachments": [{"title": "T", "text": "a\\nb"}, {"fallback": "f"}], "files": [{"name": "n"}, {"title": "u"}, {}]'),
        LINE % ("4.0", "U3", "see", ', "attachments": [{"text": "<@U1|Bo> <#C1>"}]'),
    ]
    labels = spark.createDataFrame([("U1", "Ann")], "user_id string, label string")
    got = [r["body"] for r in M.render_bodies(M.parse_messages(segments(spark, lines)), labels).orderBy("at").collect()]
    assert got == ["@Ann <x> @here http://y", "hi @Ann\na <b> @U9\n- X (http://x)", "t\n> T / a\n> b\n> f\n[attachment: n]\n[attachment: u]\n[attachment: file]", "see\n> @Bo #C1"]


def test_excerpt_budget(spark):
    rows = [("C1:1", i, t("2024-01-01T00:00:00") + timedelta(minutes=i), "Ann", x, u) for i, (x, u) in enumerate([("first " + "a" * 90, []), ("two", []), ("three", []), ("see http://d", ["http://d"]), ("after", [])])]
    m = spark.createDataFrame(rows, "source_id string, no long, at timestamp, who string, body string, urls array<string>")
    conv = spark.createDataFrame([("C1:1", "#c", True)], "source_id string, conv_label string, is_thread boolean")
    link = spark.createDataFrame([("C1:1", 3, "k")], "source_id string, no long, link_key string")
    full = M.excerpts(link, m, conv, "UTC", 1000).first()["excerpt"].split("\n")
    assert full == ["#c, 2024-01-01", "Ann: first " + "a" * 90, "Ann: two", "Ann: three", "Ann: see [linked document]", "Ann: after"]
    cut = M.excerpts(link, m, conv, "UTC", 140).first()["excerpt"].split("\n")
    assert cut[1].endswith("…") and len("\n".join(cut)) <= 140 and cut[2:] == ["Ann: see [linked document]"]
    small = M.excerpts(link, m, conv, "UTC", 60).first()["excerpt"].split("\n")
    assert small == ["#c, 2024-01-01", "Ann: three", "Ann: see [linked document]"] or small[-1] != "Ann: after"


def test_titles(spark):
    b = spark.createDataFrame([("a", t("2024-01-01"), "http://x y\n> quoted words\n@Ann ok"), ("a", t("2024-01-02"), "@Bo  real title here @Cy"), ("b", t("2024-01-01"), "ok")], "source_id string, at timestamp, title_body string")
    assert {r["source_id"]: r["first_line"] for r in M.first_meaningful_lines(b).collect()} == {"a": "real title here"}


# -- coverage, ledger, links, folders -------------------------------------------------------------------------


def test_range_plan_cases(spark):
    d = lambda x: None if x is None else t(f"2024-01-{x:02d}T00:00:00")
    cases = [  # covered, until, since, until_arg -> forward, backward, record
        ((None, None, None, None), (5, 20), None, False), ((3, 15, None, None), (15, 20), None, False), ((3, 20, None, None), None, None, False),
        ((3, 15, 1, None), (15, 20), (1, 3), True), ((3, 15, 4, None), (15, 20), None, False), ((None, 15, 1, None), (15, 20), (1, 15), True),
        ((10, 15, 1, 4), (15, 20), (1, 4), False), ((10, 15, 1, 12), (15, 20), (1, 12), True), ((10, 15, 11, 30), (15, 20), (11, 20), False), ((10, 15, 9, 9), (15, 20), None, False),
    ]
    rows = [(i, *map(d, c[0]), d(20), d(5)) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, covered_since timestamp, until timestamp, since timestamp, until_arg timestamp, run_start timestamp, initial_start timestamp")
    for r in C.plan_ranges(df).select("k", *[F.dayofmonth(c).alias(c) for c in ("forward_from", "forward_to", "backward_from", "backward_to")], "record").collect():
        _, fw, bw, rec = cases[r["k"]]
        assert ((r["forward_from"], r["forward_to"]), (r["backward_from"], r["backward_to"]), r["record"]) == (fw or (None, None), bw or (None, None), rec), r["k"]


def test_backfill_across_a_clock_change(spark):
    r = spark.createDataFrame([(1, t("2024-03-20T00:00:00"), t("2024-04-05T10:00:00"))], "scope int, backward_from timestamp, backward_to timestamp")
    got = C.backfill_windows(r, "Europe/Berlin").orderBy(F.col("window_to").desc()).select(TM.iso(F.col("window_from")), TM.iso(F.col("window_to"))).collect()
    assert [tuple(x) for x in got] == [("2024-03-28T23:00:00Z", "2024-04-05T10:00:00Z"), ("2024-03-21T23:00:00Z", "2024-03-28T23:00:00Z"), ("2024-03-20T00:00:00Z", "2024-03-21T23:00:00Z")]


def test_empty_ledger_spends_nothing(spark):
    e = spark.createDataFrame([], "at timestamp, cost_usd double, calls long, input_tokens long, output_tokens long")
    assert tuple(B.spend_total(e).first()) == (0.0, 0, 0, 0, 0, None)


PAGE = """<html><head><title> A &amp; B </title><meta property="article:published_time" content="2024-01-02"></head><body><header>top</header><nav>menu</nav>
<article><header>kept</header><h2>Head <i>line</i></h2><p>One <a href="https://x.org/a">the <b>link</b></a>, two<br>three<p>next &lt;p&gt;
<ul><li>a<li>b <ul><li>deep</li></ul></li></ul><ol><li>first</li><li><p>second</p></li></ol><blockquote><p>said</p></blockquote><pre>
code  x
 y</pre><table><tr><th>k</th><th>v|w</th></tr><tr><td>1</td></tr></table><table><tr><td><p>layout</p></td></tr></table><hr><img alt="pic">tail <a href="#z">frag</a>
<div hidden>no</div><aside>no</aside></article><footer>f</footer></body></html>"""
MARKDOWN = [
    "kept", "## Head line", "One [the link](https://x.org/a), two\nthree", "next <p>", "- a\n- b\n  - deep", "1. first\n2. second", "> said", "```\ncode  x\n y\n```",
    "| k | v\\|w |\n| --- | --- |\n| 1 |  |", "layout", "---", "pictail frag",
]


def test_page_as_markdown(spark):
    deep = "<div>" * 600 + "<p>down here</p>"
    rows = [(1, PAGE), (2, None), (3, "<p>"), (4, deep)]
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", h) for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in G.extract_pages(pages).collect()}
    assert got[1]["text"].strip().split("\n\n") == MARKDOWN
    assert got[1]["title"] == "A & B" and got[1]["created"] is not None
    assert [got[i]["outcome"] for i in (1, 2, 3, 4)] == ["extracted", "not_applicable", "not_applicable", "extracted"]
    assert got[4]["text"].strip() == "down here"


def test_elements_of_rich_text(spark):
    text = [{"type": "emoji", "name": "wave", "unicode": "1f44b-1f3fd"}, {"type": "emoji", "name": "shipit"}, {"type": "broadcast"}, {"type": "usergroup"}, {"type": "channel", "channel_id": "C1"}]
    quote = {"type": "rich_text_quote", "elements": [{"type": "link", "url": "http://q"}, {"type": "link", "url": "http://r", "text": "r", "style": {"bold": True}}]}
    items = {"type": "rich_text_list", "elements": [{"type": "rich_text_section", "elements": [{"type": "text", "text": "one "}]}, {"elements": [{"type": "rich_text_section", "elements": [{"type": "text", "text": "deep"}]}]}]}
    blocks = [
        {"type": "rich_text", "elements": [{"type": "rich_text_section", "elements": text}, quote, items]},
        {"type": "context", "elements": [{"type": "mrkdwn", "text": "x"}, {"type": "image"}, {"type": "plain_text", "text": "y"}]},
        {"type": "section", "fields": [{"text": "f1"}, {"text": "f2"}], "accessory": {"type": "header", "text": {"text": "side"}}},
        {"type": "divider"},
    ]
    row = spark.createDataFrame([(json.dumps(blocks),)], "b string").select(M.block_fragments(F.col("b")).alias("f"), M.block_links(F.col("b")).alias("l")).first()
    want = "\U0001f44b\U0001f3fd:shipit:@here@group@C1\nhttp://qr (http://r)\n- one\n- deep"
    assert [(f["kind"], f["text"]) for f in row["f"]] == [("p", want), ("m", "x y"), ("m", "f1"), ("m", "f2"), ("m", "side")]
    assert sorted(row["l"]) == ["http://q", "http://r"]
    assert spark.createDataFrame([("no json",)], "b string").select(M.block_fragments(F.col("b"))).first()[0] in (None, [])


def test_deeply_nested_blocks_keep_their_text(spark):
    leaf = lambda t: {"type": "text", "text": t}
    section = lambda *e: {"type": "rich_text_section", "elements": list(e)}
    inner = {"type": "rich_text_list", "elements": [section(leaf("two"), {"type": "link", "url": "http://l"})]}
    blocks = [
        [{"type": "rich_text", "elements": [{"type": "rich_text_list", "elements": [{"elements": [section(leaf("one")), inner]}]}]}],
        [{"type": "context", "elements": [{"type": "mrkdwn", "text": "{x}"}, {"type": "plain_text", "text": {"type": "plain_text", "text": "no"}}, {"text": "y"}]}],
        [{"type": "section", "text": {"text": "a"}, "accessory": {"type": "section", "text": {"text": "b"}, "accessory": {"type": "header", "text": {"text": "c"}}}}],
        [{"type": "rich_text", "elements": [section(section(section(section(leaf("far")))))]}],
    ]
    rows = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(blocks)], "k int, b string")
    got = {r["k"]: r for r in rows.select("k", M.block_fragments(F.col("b")).alias("f"), M.block_links(F.col("b")).alias("l")).collect()}
    assert [[(f["kind"], f["text"]) for f in got[k]["f"]] for k in range(4)] == [[("p", "- one\n- two" + "http://l")], [("m", "{x} y")], [("m", "a"), ("m", "b"), ("m", "c")], [("p", "far")]]
    assert got[0]["l"] == ["http://l"]


def test_blocks_of_any_depth_and_bad_code_points(spark):
    leaf = lambda t: {"type": "text", "text": t}
    deep, names = leaf("end"), []
    for k in range(500):
        names.append(f"w{k}")
        deep = {"type": "rich_text_list", "elements": [{"type": "rich_text_section", "elements": [leaf(f"w{k}"), deep]}]}
    emoji = {"type": "rich_text", "elements": [{"type": "rich_text_section", "elements": [
        {"type": "emoji", "unicode": "1f44b-zz-d800-110000-99999999999-1f3fd"}, {"type": "emoji", "unicode": "", "name": "no"}, {"type": "emoji"}, {"type": "emoji", "name": "yes"}]}]}
    aside = [{"type": "context", "elements": [{"text": "c"}], "accessory": {"type": "section", "text": {"text": "not read"}}}]
    empty = [{"type": "rich_text", "elements": [{"type": "rich_text_list", "elements": [{"elements": [{"type": "rich_text_list", "elements": [{"elements": []}]}]}, leaf("x"), {"type": "other", "elements": [leaf("y")]}]},
                                                {"type": "unknown", "elements": [leaf("hidden")]}]}]
    blocks = [[{"type": "rich_text", "elements": [deep]}], [emoji], aside, empty]
    rows = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(blocks)], "k int, b string")
    got = {r["k"]: [f["text"] for f in r["f"]] for r in rows.select("k", M.block_fragments(F.col("b")).alias("f")).collect()}
    assert got[0] == ["".join(f"- {n}" for n in reversed(names)) + "end"]
    assert got[1] == ["\U0001f44b\U0001f3fd:yes:"]
    assert got[2] == ["c"]
    assert got[3] == ["- -\n- x\n- y"]


def test_chunks_lose_nothing(spark):
    rnd = random.Random(3)
    bodies = ["".join(rnd.choice(["word ", "\n", "\n\n", "x" * 30, "日本"]) for _ in range(rnd.randrange(1, 200))) for _ in range(50)] + ["", "short", "y" * 100]
    for r in spark.createDataFrame([(b,) for b in bodies], "b string").select("b", B.chunks(F.col("b"), 40).alias("c")).collect():
        assert all(len(c) <= 40 for c in r["c"]) or r["c"] == [r["b"]]
        assert "".join("".join(r["c"]).split()) == "".join(r["b"].split())
        assert len(r["b"]) > 40 or r["c"] == [r["b"]]
        # No two neighbours would fit into one chunk, had they been packed together.
        assert all(len(a) + len(b) > 30 for a, b in zip(r["c"], r["c"][1:]))


def test_chunk_boundaries(spark):
    body = "aaaa\n\nbbbb\n\n" + "c" * 8 + "\ndd\n\ne"
    row = spark.createDataFrame([(body,)], "b string").select(B.chunks(F.col("b"), 12).alias("c")).first()
    assert row["c"] == ["aaaa\n\nbbbb", "c" * 8 + "\ndd", "e"]


def test_an_exhausted_week_stops_before_the_month_is_asked(spark):
    units = spark.createDataFrame([(1, 4.0), (2, 50.0), (3, 1.0)], "id long, cost double")
    gate = lambda limits: [r["gate"] for r in B.budget_gate(units, [F.floor(F.col("id") / 10)], [F.col("id")], limits).orderBy("id").collect()]
    assert gate([(60.0, 56.0), (20.0, 0.0)]) == ["go", "stop", "stop"]
    assert gate([(40.0, 36.0), (20.0, 0.0)]) == ["go", "too_large", "stop"]
    assert gate([(60.0, 0.0), (20.0, 0.0)]) == ["go", "too_large", "go"]


@pytest.mark.parametrize("n, days", [(1, 1), (2, 3), (3, 7), (4, 14), (5, 30), (9, 30)])
def test_backoff(spark, n, days):
    assert spark.range(1).select(L.backoff_days(F.lit(n))).first()[0] == days


def test_walk_ends_on_loops(spark):
    rows = [("r", "a", "folder", "A"), ("a", "b", "folder", "B"), ("b", "a", "folder", "A2"), ("b", "r", "folder", "R2"), ("b", "c", "folder", "C"), ("c", "d", "folder", "D"),
            ("r", "f1", "file", "x.md"), ("b", "f2", "file", "~$y.md"), ("b", "f3", "file", "z.MD"), ("b", "u", "unsupported", "?")]
    ch = spark.createDataFrame([(*r, None, None, 1) for r in rows], "parent_id string, id string, type string, name string, modified timestamp, etag string, size long")
    root = spark.createDataFrame([("r", "Root")], "root_id string, root_name string")
    files, left = D.scan(ch, root, max_depth=2)
    assert {(r["id"], r["folder_path"]) for r in files.collect()} == {("f1", "Root"), ("f3", "Root / A / B")}
    assert {(r["why"], r["count"]) for r in left.collect()} == {("excluded", 1), ("unsupported", 1), ("too_deep", 1)}


def test_walk_reaches_the_deepest_folder(spark):
    rows = [("d0", "d1", "folder", "1"), ("d12", "d3", "folder", "loop"), *[(f"d{k}", f"d{k + 1}", "folder", str(k + 1)) for k in range(1, 12)], ("d12", "f", "file", "x.md")]
    ch = spark.createDataFrame([(*r, None, None, 1) for r in rows], "parent_id string, id string, type string, name string, modified timestamp, etag string, size long")
    files, left = D.scan(ch, spark.createDataFrame([("d0", "Root")], "root_id string, root_name string"))
    assert [(r["id"], r["folder_path"]) for r in files.collect()] == [("f", " / ".join(["Root", *map(str, range(1, 13))]))]
    assert left.count() == 0


def test_long_pages_are_whole(spark):
    pages = spark.createDataFrame([(1, "http://e.org/1", "<p>" + "word " * 70_000 + "end</p>")], "page_id long, url string, html string")
    r = G.extract_pages(pages).first()
    assert r["text"].strip().endswith("word end") and not r["truncated"]


# -- search ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, 1, "details", 4, "The 会議 minutes: deploy, deploy 100%_done", "Deploy plan"), (2, 1, "overview", 1, "short note", "Deploy plan"), (3, 2, "details", 4, "nothing here", "予算 review"), (4, 3, "details", 4, "DEPLOYED at last", "other")]
    return spark.createDataFrame([(*r, "a", "slack.day", t(f"2024-01-0{r[1]}")) for r in rows],
                                 "section_id long, entry_id long, kind string, position int, text string, title string, account_id string, source_kind string, date timestamp")


@pytest.mark.parametrize("terms, want", [
    (["deploy"], [1, 3]), (["ＤＥＰＬＯＹ"], [1, 3]), (["予算"], [2]), (["会議", "deploy"], [1]), (["100%_done"], [1]), (["100%xdone"], []), (["missing"], []),
])
def test_search_cases(docs, terms, want):
    q = S.SearchQuery(terms, limit=10)
    scan = [r["entry_id"] for r in S.search(docs, q).collect()]
    assert sorted(scan) == want
    assert scan == [r["entry_id"] for r in S.search(docs, q, index=S.postings(docs)).collect()]


def test_title_hit_makes_all_sections_hits(docs):
    assert {r["section_id"] for r in S.search(docs, S.SearchQuery(["deploy plan"], all_sections=True)).collect()} == {1, 2}


def test_short_terms_rank_by_date(docs):
    r = S.search(docs, S.SearchQuery(["e"], limit=10)).collect()
    assert [x["entry_id"] for x in r] == [3, 2, 1] and {x["score"] for x in r} == {0.0}


def test_bad_queries():
    for q in (S.SearchQuery([" "]), S.SearchQuery(["abc"], mode="vector")):
        with pytest.raises(ValueError):
            q.split_terms()
    assert S.SearchQuery(["abc"], limit=500).effective_limit() == 50


# -- maintenance ----------------------------------------------------------------------------------------------

ENTRY = "id long, entry_uid string, account_id string, source_kind string, source_id string, source_url string, title string, source_created_at timestamp, source_updated_at timestamp, ingested_at timestamp, updated_at timestamp, raw_status string, summary_status string, summary_attempts int, metadata string, origin string"


def test_upsert_is_idempotent_and_split_safe(spark):
    empty = spark.createDataFrame([], ENTRY)
    rows = [("a", "web.page", f"s{i}", None, f"T{i}", None, None, "{}", "sync") for i in range(20)]
    inc = lambda rs: spark.createDataFrame(rs, "account_id string, source_kind string, source_id string, source_url string, title string, source_created_at timestamp, source_updated_at timestamp, metadata string, origin string")
    now = t("2024-01-01T00:00:00")
    once = P.upsert_entries(empty, inc(rows), now)
    twice = P.upsert_entries(once, inc(rows), now)
    assert sorted(once.collect()) == sorted(twice.collect())
    split = P.upsert_entries(P.upsert_entries(empty, inc(rows[:7]), now), inc(rows[7:]), now)
    assert sorted(once.drop("id").collect()) == sorted(split.drop("id").collect())
    assert sorted(r["id"] for r in split.collect()) == list(range(20))


def test_section_precedence(spark):
    cur = spark.createDataFrame([(1, "overview", "user", "U"), (1, "details", "generated", "G"), (1, "decisions", "generated", "old")], "entry_id long, kind string, origin string, text string")
    d = spark.createDataFrame([(1, "overview", "x", 0), (1, "details", "a", 0), (1, "details", "b", 1), (1, "background", " ", 0)], "entry_id long, kind string, text string, version int")
    got = {r["kind"]: (r["origin"], r["text"]) for r in P.write_sections(cur, d, "generated", True).collect()}
    assert got == {"overview": ("user", "U"), "details": ("generated", "b")}


def test_raw_hash_is_one_chain(spark):
    raw = spark.range(60).select((F.col("id") % 4).alias("entry_id"), F.lit("primary").alias("role"), F.floor(F.col("id") / 4).alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    want = {}
    for e in range(4):
        parts = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(e, 60, 4)]
        want[e] = hashlib.sha256(b"".join((64).to_bytes(8, "little") + p.encode() for p in parts)).hexdigest()
    assert {r["entry_id"]: r["raw_hash"] for r in P.raw_hashes(raw).collect()} == want


def test_duplicates_of_a_large_group(spark):
    docs = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("sha256")).withColumnRenamed("id", "source_id")
    got = {r["source_id"]: (r["duplicate_of"], r["copies"]) for r in P.content_duplicates(docs).collect()}
    assert got[0] == (3, 100) and got[297] == (0, 100) and got[1] == (None, 1)
