"""Cases of the third review."""

from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import folders as D
from lorekeep.operators import items as I
from lorekeep.operators import search as S
from lorekeep.operators.search_index import SearchIndex
from lorekeep.plans import messages as PM
from lorekeep.sources import imports as MP
from lorekeep.sources.partitions import PartitionStore
from lorekeep.streaming import jobs as J


def test_a_streamed_table_may_be_a_folder(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    s = J.read_table(J.stateful(spark), str(tmp_path), "pages.parquet", 1)
    assert sorted(r.id for r in J.run(s, "folder-table").collect()) == list(range(20))


class Documents:
    def __init__(self, df):
        self.df = df

    def table(self, name):
        return self.df


def test_a_second_line_that_starts_with_marks(spark):
    d = spark.createDataFrame([(1, "One two\n12 -- Three four 5 ")], "doc_id long, text string")
    md = PM.notes_markdown(Documents(d)).first().markdown
    assert "\n- Three four\n" in md


def _docs(spark, texts):
    rows = [(i, i, "details", 4, t, "Éa b", "a", "web.page") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "section_id long, entry_id long, kind string, position int, text string, title string, account_id string, source_kind string")
    return d.withColumn("date", F.current_timestamp())


def test_postings_are_made_without_a_shuffle(spark):
    texts = ["aaaa", "", "x\U0001f600yx\U0001f600y", "ab"]
    docs = _docs(spark, texts)
    rows = S.postings(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {(t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2)} | {(g, i) for i in range(4) for g in ("éa ", "a b")}
    assert {(r.gram, r.section_id) for r in rows.collect()} == want
    tf = {r.gram: (r.sections, r.title_tf, r.text_tf) for r in S.gram_totals(docs).collect()}
    assert tf["aaa"] == (1, 0, 2) and tf["a b"] == (4, 4, 0) and tf["x\U0001f600y"] == (1, 0, 2)


def test_generations_that_live_whole_in_part_or_not_at_all(spark, tmp_path):
    index = SearchIndex(PartitionStore(spark, str(tmp_path / "i")), gram_buckets=2, row_buckets=2)
    index.rebuild(_docs(spark, ["one two", "two three", "four"]))
    places = lambda: {(r.gram, r.section_id): sorted(r.places) for r in index.postings().collect()}
    index.replace(spark.range(1, 2).withColumnRenamed("id", "entry_id"), _docs(spark, ["one two", "two two", "four"]))
    part = places()
    assert part["two", 1] == [0, 4] and part["two", 0] == [4] and part["éa ", 2] == [-1] and ("thr", 1) not in part
    index.compact(0)
    assert places() == part
    index.replace(spark.range(3).withColumnRenamed("id", "entry_id"), _docs(spark, ["new", "new", "new"]))
    assert {s for g, s in places() if g == "new"} == {0, 1, 2} and not [g for g, _ in places() if g == "two"]


def test_lines_of_one_account_stay_where_they_are(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line = '{"account":"a","source_kind":"web.page","source_id":"s","title":"T","sections":[{"kind":"details","text":"x"}]}'
        lines = spark.range(5).select(F.col("id").alias("line_id"), F.lit(line).alias("line"))
        done = MP.validate(lines, spark.createDataFrame([("a", "web")], "id string, kind string"))
        assert "hashpartitioning(account_id" not in done._jdf.queryExecution().executedPlan().toString()
        assert [r.error for r in done.collect()] == [None] * 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_normalization_of_odd_characters_and_the_cost_of_plain_ones(spark):
    import re
    import unicodedata

    texts = ["ÀÉ×ÞßÿÖØ", "a  b\t\tc\x0bd\x85e\x1ff", " x  *y*", "ﬁ  　 Σας", "µ ª ½", " ~*_` ", "", "é É", "\U0001f600  İ"]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.match_norm(F.col("t")).alias("n"))
    blank = "[\\s\\x85\\xa0]+"
    want = [re.sub(blank, " ", re.sub(r"[*_`~]", "", unicodedata.normalize("NFKC", t).lower()).replace("\x1f", "\x00")).strip(" ").replace("\x00", "\x1f") for t in texts]
    assert [r.n for r in d.orderBy("i").collect()] == want
    # What decides on Python is asked once, below the step in Python, and in two quick patterns.
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2


def test_quotes_are_found_by_few_places(spark):
    one = spark.range(1).select(F.lit("ab cd efgh ij").alias("t"))
    assert one.select(X.windows(F.col("t"), 3, " ").alias("w")).first().w == [" cd", " ef", " ij"]
    texts = ["The quick brown fox jumps", "brown foxes", "xquick brown fo", "thequickbrownfoxjumps", "a.b", ""]
    quotes = ["uick brown fo", "brown fox", "QUICKBROWNFOX", "b", "x jumps", "", "kbrownfo", " fox"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    norm = lambda x: x.lower().strip()
    want = {(i, j) for i, a in enumerate(quotes) for j, b in enumerate(texts) if norm(a) and norm(a) in norm(b)}
    assert {tuple(r) for r in I.evidence_containment(q, t).collect()} == want
    assert I.evidence_containment(q.where("false"), t).collect() == []


def _drafts(spark):
    draft = "kind string, text string, owner string, requester string, due string, status string, confidence string, evidence string, actors array<string>"
    d = lambda *a: (*a, [])
    rows = [(1, "09:00 Ann: we shipped the thing", [d("resolved", "x", None, None, None, None, "high", "shipped the thing"), d("resolved", "y", None, None, None, None, "high", "not there"),
                                                     d("action", "z", None, None, None, "done", "high", "nowhere")])]
    return spark.createDataFrame(rows, f"entry_id long, body string, drafts array<struct<{draft.replace(' ', ':').replace(',:', ',')}>>")


def test_counts_of_drafts_need_no_times(spark, monkeypatch):
    from lorekeep.plans import items as PI

    def no(*_):
        raise AssertionError("the times of drafts were asked for")

    monkeypatch.setattr(I, "occurred_times", no)
    monkeypatch.setattr(PI, "draft_outputs", lambda v: v)
    monkeypatch.setattr(I, "parse_output", lambda d: d.withColumnRenamed("entry_id", "doc_id"))
    assert [tuple(r) for r in PI.counts(_drafts(spark)).collect()] == [(1, 2, 1, 1)]


def test_bodies_are_searched_once_for_all_drafts(spark):
    e = _drafts(spark).select(
        "*", F.lit("slack.thread").alias("source_kind"), F.lit("C1:1").alias("source_id"), F.lit("t").alias("title"), F.lit("{}").alias("metadata"),
        F.lit("2024-01-01").cast("timestamp").alias("source_created_at"), F.lit(None).cast("timestamp").alias("source_updated_at"))
    out = I.validate(e)
    assert "contains(nb" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = {r.pos: (r.outcome, r.downgraded, r.ordinal, str(r.occurred_at)) for r in out.collect()}
    assert rows[0] == ("kept", False, 0, "2024-01-01 09:00:00") and rows[1][:3] == ("dropped", False, None) and rows[2][:3] == ("kept", True, 1)


def test_texts_of_a_higher_origin_are_not_moved(spark, tmp_path, monkeypatch):
    from lorekeep.operators import upserts as U
    from lorekeep.operators.catalog_store import CatalogStore

    cur = spark.createDataFrame(
        [(1, "overview", "user", 1, "mine"), (1, "details", "extracted", 4, "text"), (2, "overview", "generated", 1, "old"), (2, "decisions", "generated", 2, "gone"), (3, "overview", "generated", 1, "stays")],
        "entry_id long, kind string, origin string, position int, text string")
    drafts = spark.createDataFrame([(1, "overview", "a", 0), (1, "details", "b", 0), (1, "decisions", " ", 0), (2, "overview", "c", 0), (2, "overview", "d", 1)], "entry_id long, kind string, text string, version int")
    kept = {}
    write = PartitionStore._write
    monkeypatch.setattr(PartitionStore, "_write", lambda self, table, keys, n, rows, local=False: (kept.setdefault(table, []).append(local), write(self, table, keys, n, rows, local))[1])
    store = CatalogStore(PartitionStore(spark, str(tmp_path / "c")))
    store.create({"sections": cur}, 4)
    store.write_sections(drafts, "generated", replace=True)
    want = {(1, "overview", "user", 1, "mine"), (1, "details", "extracted", 4, "text"), (2, "overview", "generated", 1, "d"), (3, "overview", "generated", 1, "stays")}
    assert sorted(tuple(r) for r in store.read("sections").select(*cur.columns).collect()) == sorted(want)
    assert kept == {"sections": [True, True]}
    top = U.write_sections(cur, drafts, "generated", True)._jdf.queryExecution().optimizedPlan().toString()
    # The first part of the union is the higher origins: no join or aggregate between it and the table.
    assert "Join" not in top.split("LeftAnti")[0].split("Aggregate")[0].replace("Union", "")


def test_a_body_is_cut_once_and_merged_across_batches(spark, monkeypatch):
    import pandas as pd
    from pyspark.sql.types import StructType

    from lorekeep.operators import ledger as B

    plans, cut = [], B.cut
    monkeypatch.setattr(B, "cut", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df, name))[1])

    def lengths(batches):
        for pdf in batches:
            yield pdf.assign(s=pd.Series([t[:1] for t in pdf["text"]], dtype=object))[["entry_id", "chunk_no", "n_chunks", "s"]]

    def merge(pdf):
        return pd.DataFrame({"entry_id": [pdf["entry_id"].iloc[0]], "chunk_no": [0], "n_chunks": [pdf["n_chunks"].iloc[0]], "s": ["".join(pdf["s"])]})

    body = lambda n: "\n\n".join(chr(97 + i) * 8 for i in range(n))
    d = spark.createDataFrame([(i, body(n)) for i, n in enumerate([1, 7, 2, 20, 5])] + [(9, " " * 50)], "entry_id long, body string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = B.summarize(d, lengths, merge, StructType.fromDDL("entry_id long, chunk_no int, n_chunks int, s string"), 10, fan_in=3)
        got = {r.entry_id: r.s for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: v for k, v in got.items() if k < 9} == {i: "abcdefghijklmnopqrst"[:n] for i, n in enumerate([1, 7, 2, 20, 5])}
    assert plans[0].count("aggregate(") == 1


def test_messages_are_parsed_once_for_quotes_and_lines(spark, monkeypatch):
    from lorekeep.plans.views import Views

    calls, parse = [], PM.M.parse_messages
    monkeypatch.setattr(PM.M, "parse_messages", lambda df: (calls.append(1), parse(df))[1])
    assert PM.occurred_times(Views(spark, "/root/testdata/sf0.001")).count() > 0 and len(calls) == 1


def test_shuffles_start_in_many_parts(spark):
    from lorekeep.session import configure

    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = configure(spark).range(4_000_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        joined = rows.groupBy(F.floor(F.col("id") / 4).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("t")), "").alias("t"))
        assert joined.select(F.spark_partition_id().alias("p"), "t").agg(F.countDistinct("p"), F.count("t")).first()[0] > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)


def _closers(spark, rows):
    d = spark.createDataFrame(rows, "id long, entry_id long, text string, scope_key string, actors array<string>, owner string, requester string, day int")
    return d.withColumn("occurred_at", F.timestamp_add("DAY", F.col("day"), F.lit("2020-01-01").cast("timestamp")))


def test_closers_far_from_any_target_are_left_early(spark, monkeypatch):
    seen, earliest = [], I._earliest
    monkeypatch.setattr(I, "_earliest", lambda pool, keys, keep: (seen.append(pool.count()), earliest(pool, keys, keep))[1])
    pool = _closers(spark, [(i, i, "send it", "s", ["Ann"], None, None, 30 * i) for i in range(1, 100)])
    got = I.candidates(_closers(spark, [(0, 0, "send it", "s", ["ann"], None, None, 0)]), pool)
    assert [(r.candidate_id, r["rank"], r.same_scope, r.shared_person) for r in got.orderBy("rank").collect()] == [(1, 1, True, True), (2, 2, True, True)]
    # Two groups with the closers of one window and the next; each level is made once.
    assert len(seen) == 3 and max(seen) <= 10


def test_odd_names_and_items_without_actors(spark):
    targets = _closers(spark, [(0, 0, "send it", "a", None, "Jos\u00e9  \uff21nn", None, 0), (1, 1, "send it", "b", None, " BOB,b", None, 0), (2, 2, "send it", "c", [None, "?"], None, None, 0)])
    pool = _closers(spark, [(10, 10, "send it", "x", ["jos\u00e9 ann", "Jos\u00e9 Ann"], None, None, 1), (11, 11, "send it", "y", ["Bob b", "bob, b"], None, "zed", 1), (12, 12, "send it", "c", None, "!", None, 1)])
    got = {(r.target_id, r.candidate_id, r.same_scope, r.shared_person) for r in I.candidates(targets, pool).collect()}
    assert got == {(0, 10, False, True), (1, 11, False, True), (2, 12, True, False)}


def test_similar_texts_of_small_and_large_places(spark):
    words = ["send", "sent", "report", "reports", "fix", "login", "bug", "call"]
    texts = [f"{a} {b}" for a in words for b in words]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    d = spark.createDataFrame([(i, sorted(grams(t))) for i, t in enumerate(texts)], "txt long, grams array<string>")
    sides = {"l": [("big", 1, i) for i in range(0, 64, 2)] + [("small", 1, 3)], "r": [("big", 1, i) for i in range(0, 64, 3)] + [("small", 1, i) for i in range(9)] + [("small", 2, 3)]}
    left, right = (spark.createDataFrame(sides[k], f"grp string, slot long, {k}t long") for k in "lr")
    got = {(r.grp, r.slot, r.lt, r.rt): round(r.similarity, 9) for r in I._similar_texts(left, right, d, 0.2).collect()}
    want = {}
    for g, s, a in sides["l"]:
        for h, u, b in sides["r"]:
            x, y = grams(texts[a]), grams(texts[b])
            if (g, s) == (h, u) and len(x & y) / len(x | y) >= 0.2:
                want[g, s, a, b] = round(len(x & y) / len(x | y), 9)
    assert got == want and {k[0] for k in got} == {"big", "small"}


def test_globs_of_names_and_of_whole_paths(spark):
    import re

    def old(pattern, text):
        out = re.sub(r"\*\*/|\*\*|\*|\?|.", lambda m: {"**/": "(?:.*/|.*/.*|)", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0], re.escape(m[0])), pattern.lower())
        return re.fullmatch(out, text.lower(), re.S) is not None

    patterns = ["*", "**", "**/*", "**/*.txt", "**/A*", "a/**", "**/x/*.md", "a?c", "**b", "*/b", "b", "**/b", "**/**", "**/*/b", "b**", "**/*.t*t"]
    ends = ["", "b", "abc", "a.TXT", "xb", ".txt", "q/b"]
    rows = [(d + e, e) for d in ("", "a/", "a/x/", "/", "ab/b/") for e in ends]
    df = spark.createDataFrame(rows, "p string, e string")
    cols = [c.alias(f"{k}{i}") for i, g in enumerate(patterns) for k, c in (("w", X.glob_match(F.col("p"), [g], path=True)), ("n", X.glob_match(F.col("p"), [g], path=True, name=F.col("e"))))]
    for r in df.select("p", *cols).collect():
        for i, g in enumerate(patterns):
            want = old(g, r.p) or ("/" not in g and old(g, r.p.split("/")[-1]))
            assert (r[f"w{i}"], r[f"n{i}"]) == (want, want), (g, r.p)


def test_a_folder_makes_its_path_once(spark):
    rows = [("r", "a", "folder", "A"), ("a", "b", "folder", "B"), ("r", "f1", "file", "Report 1.md"), ("b", "f2", "file", "x.TXT"), ("b", "f3", "file", "x.md"), ("b", "f4", "file", "note 7.txt"), ("a", "f5", "file", None)]
    ch = spark.createDataFrame([(*r, None, None, 1) for r in rows], "parent_id string, id string, type string, name string, modified timestamp, etag string, size long")
    root = spark.createDataFrame([("r", "Root")], "root_id string, root_name string")
    out, left = D.scan(ch, root, include=["report*", "**/*.txt"], exclude=["NOTE *7.txt"])
    assert {(r.id, r.folder_path) for r in out.collect()} == {("f1", "Root"), ("f2", "Root / A / B")}
    assert [(r.why, r["count"]) for r in left.collect()] == [("excluded", 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Nothing above the join of files and folders works on the names of a path, and these globs do not ask for the path.
    assert "aggregate(" in plan and "aggregate(" not in plan.split("Join")[0] and "prefix" not in plan
    deep, _ = D.scan(ch, root, include=["A/*.md", "a/b/x.txt", "Report*.md"])
    assert {r.id for r in deep.collect()} == {"f1", "f2"}
