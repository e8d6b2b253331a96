"""Cases of the fourth review."""

from pyspark.sql import functions as F

from lorekeep import plans
from lorekeep.operators import items as I
from lorekeep.operators import search_index
from lorekeep.operators.search_index import SearchIndex
from lorekeep.plans import messages as PM
from lorekeep.sources.partitions import PartitionStore

SF = "/root/testdata/sf0.001"


def test_no_plan_of_occurred_times_repeats_the_rendering(spark, monkeypatch):
    nodes = []

    def counted(cut):
        def seen(df, name):
            nodes.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
            return cut(df, name)

        return seen

    for module in (I, PM):
        monkeypatch.setattr(module, "cut", counted(module.cut))
    plans.queries()["w11_occurred_times"](spark, SF)
    assert nodes and max(nodes) < 150, nodes


def _docs(spark, texts):
    rows = [(i, i, "details", 4, t, "Éa b", "a", "web.page") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "section_id long, entry_id long, kind string, position int, text string, title string, account_id string, source_kind string")
    return d.withColumn("date", F.current_timestamp())


def _places(index):
    return {(r.gram, r.section_id): sorted(r.places) for r in index.postings().collect()}


def test_a_rebuild_writes_texts_once(spark, tmp_path, monkeypatch):
    copies = []
    monkeypatch.setattr(search_index, "cut", lambda df, name: copies.append(name) or df)
    index = SearchIndex(PartitionStore(spark, str(tmp_path / "i")), gram_buckets=2, row_buckets=2)
    for texts in (["one two", "two three"], ["two", "", "four"]):
        index.rebuild(_docs(spark, texts))
        assert {s for g, s in _places(index) if g == "two"} == {i for i, t in enumerate(texts) if "two" in t}
        assert index.store.manifest().facts == {"sections": len(texts), "length": sum(max(len(t) - 2, 0) + 2 for t in texts)}
    assert copies == []


def test_dead_folders_go_without_a_rewrite(spark, tmp_path):
    index = SearchIndex(PartitionStore(spark, str(tmp_path / "i")), gram_buckets=2, row_buckets=2)
    index.rebuild(_docs(spark, ["one two", "two three", "four"]))
    index.replace(spark.range(3).withColumnRenamed("id", "entry_id"), _docs(spark, ["two five", "five", "six"]))
    before, batches = _places(index), len(list((tmp_path / "i/data/postings").iterdir()))
    assert index.compact(1) == [] and _places(index) == before
    parts = index.store.manifest().tables["postings"]["parts"]
    assert parts and all(len(p) == 1 for p in parts.values()) and len(list((tmp_path / "i/data/postings").iterdir())) == batches
    # Of a generation that lives in part the folders stay, and are rewritten where they are too many.
    index.replace(spark.range(1, 2).withColumnRenamed("id", "entry_id"), _docs(spark, ["two five", "seven", "six"]))
    before = _places(index)
    assert index.compact(2) == [] and _places(index) == before
    assert index.compact(1) and _places(index) == before and index.compact(1) == []


def test_packed_rows_stay_in_their_tasks_when_rewritten(spark, tmp_path, monkeypatch):
    index = SearchIndex(PartitionStore(spark, str(tmp_path / "i")), gram_buckets=2, row_buckets=2)
    index.rebuild(_docs(spark, ["one two", "two three", "four"]))
    index.replace(spark.range(1, 2).withColumnRenamed("id", "entry_id"), _docs(spark, ["one two", "seven", "four"]))
    local = []
    write = index.store._write
    monkeypatch.setattr(index.store, "_write", lambda table, keys, buckets, rows, own=False: local.append((table, own)) or write(table, keys, buckets, rows, own))
    assert index.compact(0) and local == [("postings", True)]
