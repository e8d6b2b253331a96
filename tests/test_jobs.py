"""Sinks, snapshots, page extraction and streams."""

import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import search as S
from lorekeep.operators import upserts as P
from lorekeep.operators.search_index import SearchIndex, TrigramBackend
from lorekeep.sources import imports as MP
from lorekeep.sources import pages as G
from lorekeep.sources.io import append_ledger, write_json, write_raw
from lorekeep.sources.partitions import Change, Conflict, PartitionStore
from lorekeep.streaming import jobs as J


def md(spark, html):
    parsed = G.parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))
    return "".join(r["md"] for r in G.blocks(parsed).orderBy("ord").collect())


@pytest.mark.parametrize("html, want", [
    ("<h2>A <b>b</b></h2><p>x\n y<br>z", "## A b\n\nx y\nz\n\n"), ("<ul><li>a<ol><li>b<li>c</ol><li>d</ul>", "- a\n  1. b\n  2. c\n- d\n\n"),
    ("<blockquote><p>q</p></blockquote>", "> q\n\n"), ("<pre>a\n b</pre>", "```\na\n b\n```\n\n"), ('<p><a href="http://x">t</a> <a href="#y">u</a></p>', "[t](http://x) u\n\n"),
    ("<table><tr><th>a<th>b<tr><td>1<td>x|y</table>", "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n\n"), ("<nav>no</nav><div hidden>no</div><header>no</header><article><header>yes</header></article>", "yes\n\n"),
])
def test_markdown(spark, html, want):
    assert md(spark, html) == want


def page(spark, html):
    return G.extract_pages(spark.createDataFrame([(1, "https://x.org/a?utm_source=q", html)], "page_id long, url string, html string")).first()


def test_scored_content(spark):
    para = "<p>" + "word " * 30 + "</p>"
    links = "<div>" + "<p><a href='http://l'>" + "link " * 40 + "</a></p>" * 1 + "</div>"
    r = page(spark, f"<html><head><title> A\n B </title><link rel=canonical href=''><meta property='og:site_name' content='Site'></head><body><div id=m>{para * 3}</div>{links * 4}<div>foot</div></body></html>")
    assert r["title"] == "A B" and "link" not in r["text"] and r["text"].count("word") == 90 and r["site_name"] == "Site" and r["source_id"] == "https://x.org/a"


def test_page_dates_and_canonical(spark):
    r = page(spark, '<html><head><link rel="canonical" href="https://c.org/x"><meta name="date" content="2024-02-03"></head><body><main><p>text</p><time datetime="2020-01-01">t</time></main><script>{"dateModified": "2024-05-06T07:08:09Z"}</script></body></html>')
    assert (r["canonical"], r["created"].isoformat()[:10], r["modified"] is not None, r["outcome"]) == ("https://c.org/x", "2024-02-03", True, "extracted")
    assert page(spark, "<html><body><nav>only chrome</nav></body></html>")["outcome"] == "not_applicable"


def test_text_cap(spark):
    p = spark.createDataFrame([(1, "u", "<p>" + "a" * 50 + "</p>")], "page_id long, url string, html string")
    r = G.extract_pages(p, limit=10).first()
    assert r["truncated"] and r["text"] == "a" * 10 + "\n\n[... text cut at 10 characters]"


def test_raw_sink_and_ledger(spark, tmp_path):
    at = datetime(2024, 3, 5, tzinfo=UTC)
    raw = spark.createDataFrame([(i, "acc", "web.page", at, None, f"p{i}") for i in range(5)], "entry_id long, account_id string, source_kind string, ingested_at timestamp, source_created_at timestamp, payload string")
    write_raw(raw, str(tmp_path / "raw"))
    assert os.path.isdir(tmp_path / "raw/account_id=acc/source_kind=web.page/year=2024/month=3")
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 5
    rows = spark.createDataFrame([(at, 1.0)], "at timestamp, cost_usd double")
    append_ledger(rows, str(tmp_path / "ledger"))
    append_ledger(rows, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    write_json(rows.select("cost_usd"), str(tmp_path / "json"), "x/v1")
    assert spark.read.json(str(tmp_path / "json")).first()["schema"] == "x/v1"


def test_import_bundle_twice(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text(
        '{"source_kind":"web.page","source_id":"a","title":"A","sections":[{"kind":"details","text":"x"}],"metadata":{"k":[1,2]}}\n\nnot json\n{"source_kind":"web.page","source_id":"b","title":" ","sections":[]}\n')
    accounts = spark.createDataFrame([("w", "web")], "id string, kind string")
    val = MP.validate(MP.read_bundle(spark, str(tmp_path / "e.jsonl")), accounts, {"web": "w"})
    assert sorted(r["error"] for r in MP.bad_lines(val).collect()) == ["blank title", "not a record"]
    none = spark.createDataFrame([], "id long, account_id string, source_kind string, source_id string, source_url string, title string, source_created_at timestamp, source_updated_at timestamp, ingested_at timestamp, metadata string, raw_status string, summary_status string")
    sec = spark.createDataFrame([], "entry_id long, kind string, origin string, text string")
    now = datetime(2024, 1, 1, tzinfo=UTC)
    first = MP.merge(val, none, sec, now)
    r = first.first()
    assert (r["outcome"], r["summary_status"], r["metadata"]) == ("created", "done", '{"k":[1,2]}')
    stored = first.select(F.lit(1).cast("long").alias("id"), *[c for c in none.columns if c in first.columns and c != "id"]).withColumn("raw_status", F.lit("missing"))
    sec = first.select(F.lit(1).cast("long").alias("entry_id"), F.explode("sections").alias("s")).select("entry_id", "s.kind", F.coalesce("s.origin", F.lit("generated")).alias("origin"), "s.text")
    assert MP.merge(val, stored, sec, now).first()["outcome"] == "unchanged"


DOC = "section_id long, entry_id long, kind string, position int, text string, title string, account_id string, source_kind string, date timestamp"


def _indexed(spark, path, n=40):
    words = ["alpha", "beta", "gamma", "aaaa", "ÄÖaÄÖ", "İx"]
    text = lambda i: " ".join(words[(i * k) % 6] for k in range(1, 1 + i % 9))
    rows = [(i, i // 2, ["details", "overview"][i % 2], i % 2, text(i), f"{words[i // 2 % 6]} {i // 2}", "a", "web.page", datetime(2024, 1, 1 + i % 20, tzinfo=UTC)) for i in range(n)]
    docs = spark.createDataFrame(rows, DOC)
    index = SearchIndex(PartitionStore(spark, str(path)), gram_buckets=8, row_buckets=8)
    index.rebuild(docs)
    return rows, docs, index


def _same(index, docs, *terms_of, **q):
    for terms in terms_of:
        query = S.SearchQuery(terms, limit=30, **q)
        flat = lambda df: [(r["entry_id"], r["section_id"], round(r["score"], 9), r["snippet"]) for r in df.collect()]
        assert flat(index.search(query)) == flat(S.search(docs, query)), terms


def test_index_gives_what_a_scan_gives(spark, tmp_path):
    rows, docs, index = _indexed(spark, tmp_path / "i")
    _same(index, docs, ["aaa"], ["ALPHA beta"], ["gamma", "be"], ["zzz"], ["a"])
    _same(index, docs, ["äöaäö"], ["i̇x"], ["eta", "alp"], all_sections=True, sections=["details"])
    changed = [(*r[:4], "new beta aaaa", *r[5:]) if r[1] == 3 else r for r in rows if r[1] not in (5, 6)]
    after = spark.createDataFrame(changed, DOC)
    index.replace(spark.createDataFrame([(3,), (5,), (6,), (99,)], "entry_id long"), after)
    _same(index, after, ["beta"], ["aaaa"])
    facts = index.store.manifest().facts
    size = sum(max(len(r[4]) - 2, 0) + max(len(r[5]) - 2, 0) for r in changed)
    assert facts == {"sections": len(changed), "length": size}
    assert index.compact(0) and index.compact(1) == []
    _same(index, after, ["aaaa", "new"])
    assert index.store.read("postings").count() == index.live_postings().count()


def test_a_changed_entry_rewrites_its_buckets_only(spark, tmp_path):
    _, docs, index = _indexed(spark, tmp_path / "i")
    before = index.store.manifest().tables
    one = spark.createDataFrame([(3,)], "entry_id long")
    index.replace(one, docs)
    after = index.store.manifest().tables
    own = {str(b) for b in index.store.touched("rows", one)}
    assert len(own) == 1 and {b for b in before["rows"]["parts"] if before["rows"]["parts"][b] != after["rows"]["parts"].get(b)} == own
    assert all(after["postings"]["parts"][b][: len(f)] == f for b, f in before["postings"]["parts"].items())


def test_indexed_search_reads_few_texts(spark, tmp_path, monkeypatch):
    _, docs, index = _indexed(spark, tmp_path / "i")
    plans = []
    read = index.store.read
    monkeypatch.setattr(index.store, "read", lambda table, version=None, buckets=None: (plans.append((table, buckets)), read(table, version, buckets))[1])
    got = index.search(S.SearchQuery(["gamma"], limit=2))
    assert 0 < got.count() <= 2
    # Postings are read from the buckets of the grams, and texts from the buckets of the hits.
    assert all(buckets is not None for table, buckets in plans if table == "postings")
    scans = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line or "ReadSchema" in line]
    assert scans and all(b is None or len(b) <= 3 for _, b in plans)
    hits = index._found(["gamma"], index.store.current())._jdf.queryExecution().toString()
    assert "text#" not in hits.partition("Optimized Logical Plan")[2].partition("Physical Plan")[2].replace("text_at#", "").replace("text_tf#", "")


def test_quotes_in_the_index(spark, tmp_path):
    rows, docs, index = _indexed(spark, tmp_path / "i")
    quotes = ["alpha be", "GAMMA", "aaaa aaaa", "eta g", "nowhere", "a", "İx", "zz", "", "ph", "äöa"]
    got = {(r["quote_id"], r["section_id"]) for r in index.containing(spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")).collect()}
    assert got == {(k, r[0]) for k, x in enumerate(quotes) for r in rows if x and x.lower() in r[4].lower()}


def test_search_backend(spark, tmp_path):
    e = [(i, f"Title {i}", "a", "web.page", datetime(2024, 1, 1 + i, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC)) for i in range(3)]
    entries = spark.createDataFrame(e, "id long, title string, account_id string, source_kind string, source_created_at timestamp, ingested_at timestamp")
    texts = {0: "alpha beta", 1: "beta gamma", 2: "delta"}
    sec = lambda: spark.createDataFrame([(i, i, "details", 4, x) for i, x in texts.items()], "id long, entry_id long, kind string, position int, text string")
    b = TrigramBackend(PartitionStore(spark, str(tmp_path / "idx")), lambda: (sec(), entries), gram_buckets=4, row_buckets=4)
    b.rebuild()
    find = lambda x: sorted(r["entry_id"] for r in b.search(S.SearchQuery([x])).collect())
    assert find("beta") == [0, 1]
    texts[2] = "delta beta"
    b.index(spark.createDataFrame([(2,)], "entry_id long"))
    assert find("beta") == [0, 1, 2]
    del texts[0]
    b.remove(spark.createDataFrame([(0,)], "entry_id long"))
    assert find("beta") == [1, 2] and b.kept.store.manifest().facts["sections"] == 2
    b.rebuild()
    assert find("beta") == [1, 2]


# -- import bundles --------------------------------------------------------------------------------------------


def test_manifest_of_a_bundle(spark, tmp_path):
    m = tmp_path / "manifest.json"
    m.write_text('{\n "format": "bundle/1",\n "accounts": {"slack": "work", "google": "me"}, "more": 1}')
    assert MP.read_manifest(spark, str(m), "bundle/1") == {"slack": "work", "google": "me"}
    assert MP.read_manifest(spark, str(m), "bundle/1", {"slack": "home"})["slack"] == "home"
    with pytest.raises(ValueError, match="unsupported bundle format"):
        MP.read_manifest(spark, str(m), "bundle/2")
    with pytest.raises(ValueError, match="no account kind fax"):
        MP.read_manifest(spark, str(m), "bundle/1", {"fax": "x"})
    for text in ("no json", "{}"):
        m.write_text(text)
        with pytest.raises(ValueError, match="no manifest"):
            MP.read_manifest(spark, str(m), "bundle/1")


# -- buckets with versions ------------------------------------------------------------------------------------


def _store(spark, path):
    store = PartitionStore(spark, str(path))
    assert store.create({"t": (spark.range(100).withColumn("v", F.lit(0)), ["id"], 8), "log": (spark.range(0), ["id"], 2)}, {"top": 99})
    return store


def test_two_writers_have_one_winner(spark, tmp_path):
    a, b = _store(spark, tmp_path / "s"), PartitionStore(spark, str(tmp_path / "s"))
    assert not b.create({"t": (spark.range(1), ["id"], 1)})
    key = spark.createDataFrame([(7,)], "id long")
    change = lambda s, v: {"t": s.update("t", key, lambda rows: rows.withColumn("v", F.when(F.col("id") == 7, v).otherwise(F.col("v"))))}
    first, second = change(a, 1), change(b, 2)
    assert a.commit(0, first) == 1
    with pytest.raises(Conflict):
        b.commit(0, second)
    assert [r.v for r in b.read("t").where("id = 7").collect()] == [1] and b.read("t").count() == 100
    # The loser has left nothing behind.
    assert len(list((tmp_path / "s" / "data" / "t").iterdir())) == 2
    assert b.commit(1, change(b, 2)) == 2 and [r.v for r in a.read("t").where("id = 7").collect()] == [2]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = _store(spark, tmp_path / "s")
    key = spark.createDataFrame([(7,)], "id long")
    before = store.manifest().tables["t"]["parts"]
    store.commit(0, {"t": store.update("t", key, lambda rows: rows.where("id <> 7")), "log": Change(spark.range(3), append=True)}, {"top": 100})
    after, touched = store.manifest(), {str(b) for b in store.touched("t", key)}
    assert {b for b in before if before[b] != after.tables["t"]["parts"].get(b)} == touched and len(before) == 8
    assert after.facts == {"top": 100} and store.read("log").count() == 3 and store.read("t").count() == 99 and store.read("t", 0).count() == 100
    with pytest.raises(ValueError, match="buckets"):
        store.commit(1, {"t": Change(spark.range(100).withColumn("v", F.lit(1)), [0])})


def test_vacuum_removes_unread_versions(spark, tmp_path):
    store = _store(spark, tmp_path / "s")
    for v in range(3):
        store.commit(v, {"t": Change(store.read("t").withColumn("v", F.lit(v)))})
    assert store.vacuum(keep=2) == 0, "young folders stay"
    assert store.vacuum(keep=2, grace_seconds=-5) > 0
    assert store.versions() == [2, 3] and store.read("t").count() == store.read("t", 2).count() == 100
    assert store.vacuum(keep=1, grace_seconds=-5) > 0 and {r.v for r in store.read("t").collect()} == {2}


# -- streams --------------------------------------------------------------------------------------------------


@pytest.fixture()
def arrivals(spark, tmp_path):
    """Three files that arrive one after the other; the last one brings late rows."""
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    batches = [[(1, i, t0 + timedelta(hours=i)) for i in range(5)], [(1, 10 + i, t0 + timedelta(hours=5 + i)) for i in range(5)] + [(2, 20, t0)], [(1, 30, t0 + timedelta(hours=2)), (1, 31, t0 + timedelta(hours=20)), (2, 32, t0 + timedelta(hours=1))]]
    folder = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "scope long, row_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        folder.mkdir(exist_ok=True)
        part = next(f for f in os.listdir(tmp_path / f"b{n}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"b{n}" / part, folder / f"f{n}.parquet")
        os.utime(folder / f"f{n}.parquet", (1_700_000_000 + n * 100,) * 2)
    return str(folder)


def test_high_water_drops_late_rows(spark, arrivals):
    s = J.read_table(J.stateful(spark), arrivals, "*.parquet", files_per_trigger=1)
    got = J.run(J.high_water(s.select("scope", "row_id", F.unix_micros("ts").alias("micros"))), "hw")
    assert sorted(r["row_id"] for r in got.collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 20, 31, 32]


def test_batches_give_what_one_batch_gives(spark, arrivals):
    one = J.run(J.day_counts(J.read_table(J.stateful(spark), arrivals, "*.parquet"), "scope", "UTC", "2 days"), "d1", "update", ["scope", "day"])
    many = J.run(J.day_counts(J.read_table(spark, arrivals, "*.parquet", 1), "scope", "UTC", "2 days"), "d2", "update", ["scope", "day"])
    assert sorted(one.collect()) == sorted(many.collect())


def test_versions_follow_their_time_in_any_order(spark, tmp_path):
    rows = [(1, 30, "c"), (1, 10, "a"), (1, 20, "b"), (1, 20, "b"), (2, 5, "old"), (2, 9, "k"), (3, 1, "x")]
    known = spark.createDataFrame([(2, 7, "k"), (2, 6, "j")], "doc long, micros long, sha string")
    answers = set()
    for k in range(2):
        folder = str(tmp_path / f"v{k}")
        spark.createDataFrame(rows[:: 1 - 2 * k], "doc long, micros long, sha string").repartition(3).write.parquet(folder)
        got = J.run(J.document_changes(J.read_table(J.stateful(spark), folder, "*.parquet"), known), f"versions-{k}").collect()
        answers.add(tuple(sorted((r["doc"], r["micros"], r["sha"], r["change"]) for r in got)))
    assert answers == {((1, 10, "a", "new"), (1, 20, "b", "changed"), (1, 20, "b", "unchanged"), (1, 30, "c", "changed"), (2, 5, "old", "late"), (2, 9, "k", "unchanged"), (3, 1, "x", "new"))}


def test_interrupted_commits_equal_uninterrupted_ones(spark, arrivals, tmp_path):
    def step(store, batch):
        top = batch.agg(F.max("row_id").alias("v")).union(store.read("cursor").select("v")).agg(F.lit("all").alias("k"), F.max("v").alias("v"))
        return {"rows": Change(batch.select("row_id"), append=True), "cursor": Change(top)}

    start = {"rows": (spark.createDataFrame([], "row_id long"), ["row_id"], 4), "cursor": (spark.createDataFrame([("all", -1)], "k string, v long"), ["k"], 1)}
    s = lambda: J.read_table(J.stateful(spark), arrivals, "*.parquet", 1)
    a = PartitionStore(spark, str(tmp_path / "a"))
    J.commit_stream(s(), a, start, step, str(tmp_path / "ca"))
    calls = []

    def failing(store, batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return step(store, batch)

    b = PartitionStore(spark, str(tmp_path / "b"))
    with pytest.raises(Exception, match="executor lost"):
        J.commit_stream(s(), b, start, failing, str(tmp_path / "cb"))
    J.commit_stream(s(), b, start, step, str(tmp_path / "cb"))
    for name in start:
        assert sorted(a.read(name).collect()) == sorted(b.read(name).collect())
    assert a.read("rows").count() == 14


def test_repeated_batches_are_skipped(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path / "s"))
    store.create({"t": (spark.range(1), ["id"], 2)}, {"batch": -1})
    w = J.BatchCommitter(store, lambda store, batch: {"t": Change(batch, append=True)})
    w(spark.range(5), 0)
    w(spark.range(5), 0)
    assert store.read("t").count() == 6


def test_a_batch_that_touches_one_key_keeps_other_files(spark, tmp_path):
    store = PartitionStore(spark, str(tmp_path / "s"))
    store.create({"t": (spark.range(200), ["id"], 16)}, {"batch": -1})
    before = store.manifest().tables["t"]["parts"]
    J.BatchCommitter(store, lambda store, batch: {"t": store.update("t", batch, lambda rows: rows.join(batch, "id", "left_anti"))})(spark.range(5, 6), 0)
    after = store.manifest().tables["t"]["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("t").count() == 199


def test_queue_paths_unite(spark):
    q = spark.createDataFrame([], "account_id string, source_kind string, source_id string, reason string, hint string, enqueued_at timestamp, attempts int, last_error string")
    e = spark.createDataFrame([("a", "k", "1", "history", "h0", 0), ("a", "k", "1", "watched", "h1", 1)], "account_id string, source_kind string, source_id string, reason string, hint string, ord int")
    r = P.upsert_queue(q, e, q, datetime(2024, 1, 1, tzinfo=UTC)).collect()
    assert [(x["reason"], x["hint"]) for x in r] == [("history", "h1")]
