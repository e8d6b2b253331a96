"""The pipeline, stage by stage, against plain answers; and the registry."""

import collections

import corpus_pipeline
from lorekeep.llm import queries, toxic_segments
from lorekeep.llm.common import table

from .data import SF, shingle_groups, size
from .test_native import plain_targets


def test_a_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    inputs, outputs = [docs], []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, inputs[-1], SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        outputs.append(out)
        inputs.append(out)
    rows = [[(r.doc_id, r.text, r.source) for r in d.collect()] for d in inputs[:-1]]
    clean = {i for i, *_ in rows[1]}
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    # The smallest table labels few documents, some of them wrongly; the stage agrees with the query on all.
    told = [labels[i] for i, *_ in rows[0] if i in labels]
    assert sum(labels[i] == (i not in clean) for i, *_ in rows[0] if i in labels) / len(told) > 0.8
    assert clean == {r.doc_id for r in toxic_segments.op1(spark, SF).collect() if r.predicted == 0}
    last = {}
    for i, t, _ in rows[1]:
        last[t or ""] = max(last.get(t or "", i), i)
    assert sorted(i for i, *_ in rows[2]) == sorted(last.values())
    assert sorted(i for i, *_ in rows[3]) == sorted(i for i, _, c in shingle_groups(rows[2], 5, 4, 5) if i == c)
    _, target = plain_targets(rows[3])
    taken, times = collections.Counter(), collections.Counter(i for i, *_ in rows[4])
    for _, t, s in rows[4]:
        taken[s] += size(t)
    assert max(times.values()) <= 3
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.1
    assert sorted(r.doc_id for r in outputs[-1].collect()) == sorted(i for i, *_ in rows[4])


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
