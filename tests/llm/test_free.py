"""The other operators, against the libraries, brute force, exact round trips or held-out labels."""

import collections
import hashlib
import html as entities
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from lorekeep.llm import metric_join, page_text, piece_codec, quality_mil, shingle_join, token_files, toxic_segments
from lorekeep.llm.common import table
from lorekeep.session import work_dir

from .data import SF, awkward, documents, shingle_groups, union

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a  b ", "a\tb\nc\n\n d", "\xa0x", "ﬁ é é", "▁a ▁", "😀👍🏽", "a\x00b\x01", "<|endoftext|> <|STARTOFTEXT|>", "'S don't 'VE it's.", "ΑΣ ΑΣ. ΣΑ", "aaaa" * 50, " " * 70, "日本語テスト" * 9, "İ_x|y", "word.,;'%%% 1.5"]


def scrambled(n, seed):
    rng = random.Random(seed)
    parts = ["a", "Bc", "the", "'s", "'ll", "é", ".", ",", "%%%", "1", "_", "|", "-", "\n", "\t", " ", "  ", " ", "İ", "<", "日", "▁", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 50))) for _ in range(n)]


def test_token_files_hold_what_the_library_encodes(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = [*awkward(), *[(500 + k, t, None) for k, t in enumerate(ODD + scrambled(300, 1))]]
    files = token_files.write(documents(spark, rows), work_dir(spark, "tokens"), WORD_BPE, files=4)
    got = token_files.read(spark, files).collect()
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    none_first = lambda i: (i is not None, i or 0)
    assert sorted((none_first(r.doc_id), bytes(r.ids)) for r in got) == sorted((none_first(i), ids(t)) for i, t, *_ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [none_first(r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order)


def test_a_reader_touches_only_the_frames_it_needs(tmp_path):
    import zstandard

    path = str(tmp_path / "a.zst")
    out = token_files.Writer(path)
    texts = [np.arange(k, dtype="<u4").tobytes() for k in (1, 0, 5000, 3)]
    for k, t in enumerate(texts):
        out.add(None if k == 3 else 10 * k, t)
    out.close()
    reader = token_files.Reader(path)
    assert list(reader.ids[:3]) == [0, 10, 20] and list(reader.known) == [True, True, True, False]
    assert reader.document(2) == texts[2] and reader.document(1) == b""
    assert list(reader.start[:4]) == [0, 1, 1, 5001]
    # An ordinary decompressor reads the frames one after another and skips the rest.
    raw = open(path, "rb").read()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
        assert f.read() == b"".join(texts)
    # Damage in one frame is noticed there and nowhere else.
    spoilt = bytearray(raw)
    spoilt[int(reader.offset[3]) + 9] ^= 1
    open(path, "wb").write(spoilt)
    assert token_files.Reader(path).document(2) == texts[2]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(path).document(3)


def test_pieces_equal_the_library(spark):
    pieces = piece_codec.Pieces(PIECES)
    texts = ODD + scrambled(1500, 2) + [t or "" for _, t, *_ in awkward()]
    for t, (ids, said) in zip(texts, pieces.encode(texts)):
        assert ids == pieces.model.encode(t), t
        assert said == " ".join(map(str, ids))
    rows = awkward()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*pieces.model.encode(t or ""), 2]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.model.decode(ids).encode()).hexdigest()] += 1
    docs = documents(spark, rows)
    assert collections.Counter(map(tuple, piece_codec.digests(docs, PIECES).collect())) == want
    back = {(r.doc_id, r.decoded) for r in piece_codec.encode(docs.where("doc_id < 100"), PIECES).collect()}
    assert back == {(i, t) for i, t, *_ in rows if i is not None and i < 100}
    assert piece_codec.digests(docs.where("false"), PIECES).count() == 0


def brute_segments(scores):
    """Maximal segments by their definition: the best one, then the best ones on both sides of it."""
    best, where = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-9:
                best, where = total, (a, b + 1)
    if not where:
        return []
    a, b = where
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in right]


def test_segments_equal_their_definition():
    rng = np.random.default_rng(4)
    for _ in range(300):
        scores = rng.normal(-0.3, 1, rng.integers(0, 40))
        got = toxic_segments.segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(list(scores))]


def held_out_accuracy(spark, found, label, folder="/root/testdata/sf0.01"):
    labels = table(spark, folder, "labels").where(f"{label} IS NOT NULL")
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "score", label).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == r[label] for r in rows])


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    assert held_out_accuracy(spark, toxic_segments.op1(spark, folder), "toxic", folder) > 0.9


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    assert held_out_accuracy(spark, quality_mil.op8(spark, folder), "quality", folder) > 0.95


@pytest.mark.parametrize("op", [toxic_segments, quality_mil])
def test_classifiers_take_every_kind_of_row(spark, op):
    rows = awkward()
    docs = documents(spark, rows)
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "toxic", "quality")])
    no_labels = spark.createDataFrame([], kind)
    labels = spark.createDataFrame([(i, int("Idiot1" in (t or "")), int("Idiot1" in (t or ""))) for i, t, *_ in rows if i is not None], kind)
    for model in (op.fit(docs, no_labels), op.fit(docs, labels), op.fit(docs.where("false"), labels)):
        got = op.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert op.score(docs.where("false"), model).count() == 0
    kept = toxic_segments.without_toxic(docs, toxic_segments.fit(docs, no_labels))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_attention_gradients(monkeypatch):
    """The written-out gradients of the first step equal numeric ones, and training fits its bags."""
    rng = np.random.default_rng(0)
    x, count, y = rng.normal(size=(12, quality_mil.WIDTH)), np.array([3, 1, 5, 3]), np.array([0.0, 1, 1, 0])
    w = quality_mil.train(x, count, y)
    first = np.cumsum(count) - count
    assert np.abs(quality_mil._forward(w, x, first, count)[0] - y).max() < 0.1
    loss = lambda w: -np.mean(np.log(np.where(y > 0, p := quality_mil._forward(w, x, first, count)[0], 1 - p)))
    monkeypatch.setattr(quality_mil, "ROUNDS", 1)
    monkeypatch.setattr(quality_mil, "DECAY", 0.0)
    start = quality_mil.train(x, count, y)
    monkeypatch.setattr(quality_mil, "ROUNDS", 0)
    before = quality_mil.train(x, count, y)
    # The first step of the method moves every weight by the rate against the sign of its gradient.
    for k, (a, b) in enumerate(zip(before, start)):
        for at in list(np.ndindex(a.shape))[:: max(1, a.size // 15)]:
            up, down = [c.copy() for c in before], [c.copy() for c in before]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-7:
                assert np.sign(a[at] - b[at]) == np.sign(slope), (k, at)


def test_quality_of_long_texts_in_slices(monkeypatch):
    rng = np.random.default_rng(1)
    shapes = [(quality_mil.WIDTH, 24), (24,), (24, 12), (24, 12), (12,), (24,), (1,)]
    model = quality_mil.Model(np.zeros(quality_mil.WIDTH), np.ones(quality_mil.WIDTH), [rng.normal(size=s) for s in shapes])
    texts = ["Some words, and more. " * 900, "", "x" * 5_000, "é9 " * 4_000]
    whole = model.scores(texts)
    monkeypatch.setattr(quality_mil, "BLOCK", 3 * quality_mil.PASSAGE)
    assert np.allclose(model.scores(texts), whole)
    x, _ = quality_mil.passages(["gamma# delta$ eps%", "gamma delta eps"])
    marked = quality_mil.WIDTH - quality_mil.EXTRA + 7
    assert x[0, marked] == 1 and x[1, marked] == 0


def test_every_passage_of_the_sample_trains(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k} " * (10 + 400 * (k % 7))) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_mil, "train", lambda x, count, y: seen.append(count) or [np.zeros(1)])
    quality_mil.fit(docs, labels)
    quality_mil.fit(docs, labels, bags=20)
    texts = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert sorted(seen[0]) == sorted(-(-len(t) // quality_mil.PASSAGE) for t in texts) and 0 < sum(seen[1]) <= 20


def plain_pages(html):
    body = html[html.index("<article>") + 9 : html.index("</article>")]
    blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_pages_give_their_article(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in page_text.op4(spark, SF).collect()}
    assert got == {r.page_id: plain_pages(r.html) for r in pages.collect()}


def test_frames_never_seen_in_training(spark):
    pages = table(spark, SF, "pages")
    model = page_text.fit(pages)
    rng, good, every = np.random.default_rng(123), 0, 0
    for r in pages.collect():
        texts = plain_pages(r.html).split("\n")[:12]
        tree = page_text.Tree(page_text.reframed(texts, rng))
        want = {t for k, t in tree.texts if tree.nodes[k].label == 1}
        got = set(tree.decode(model.odds(tree.features())).split("\n"))
        good += len(want & got)
        every += len(want | got)
    assert good / every > 0.9


def test_nesting_takes_time_by_its_length():
    def seconds(n):
        start = time.process_time()
        page_text.Tree("<b></i>" * n + "<div>" * n + "</span>" * n)
        return time.process_time() - start

    assert seconds(20_000) < 30 * max(seconds(2_000), 0.02)


def test_broken_and_empty_pages(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<p>a<p>b &amp; c<br>d<script>'</p>'<", "x"), (4, "u", "</div></p>text<article><b>x</article>", "x"), (1, "u", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = page_text.fit(table(spark, SF, "pages"))
    got = page_text.main_text(pages, model).collect()
    assert len(got) == 5 and all(r.text == "" for r in got if r.page_id in (1, 2))
    assert page_text.main_text(pages.where("false"), page_text.fit(pages.where("false"))).count() == 0
    tree = page_text.Tree(rows[2][2])
    assert [t for _, t in tree.texts] == ["a", "b & c d"]


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<html><head><title>T</title><article><p>text</p></article>", ["text"]),
        ("<html><head><title>T</title><meta charset=x><script>s</script><link rel=y>\n text <b>on</b>", ["text on"]),
        ("<head><noscript><p>n</p></noscript><style>c</style><img src=i>a<p>b</head>c", ["a", "bc"]),
        ("<head><title>T</title></head><body><p>a</p></body>", ["a"]),
        ("<head><title>T<body><p>a<head><p>b", ["a", "b"]),
    ],
)
def test_a_head_ends_without_its_end_tag(html, texts):
    found = page_text.Tree(html)
    assert [" ".join(t.split()) for _, t in found.texts] == texts and not found.unseen


def brute_vectors(rows, cosine=0.9):
    ok = []
    for k, (_, v) in enumerate(rows):
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(0)
        if len(a) and np.isfinite(a).all() and a.any():
            a = a / np.abs(a).max()
            ok.append((k, a / np.linalg.norm(a)))
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(ok, 2) if len(a) == len(b) and a @ b >= cosine]
    root, n = union(len(rows), links), collections.Counter(k for pair in links for k in pair)
    return {r[0]: (n[k], rows[root[k]][0]) for k, r in enumerate(rows)}


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(8)
    rows, centre = [], rng.normal(size=(20, 8))
    for k in range(240):
        v = centre[0 if k % 3 == 0 else k % 20] + rng.normal(size=8) * rng.choice([0, 0.1, 0.4])
        rows.append((k, [float(x) for x in v * 10.0 ** rng.integers(-3, 4)]))
    rows += [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 8), (908, [1e300] * 8), (909, [1e-300] * 8)]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()), T.StructField("cell", T.LongType())])
    vectors = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], kind)
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(vectors, n_pivots=6, block=block).collect()}
    assert got == brute_vectors(rows)
    assert metric_join.near_duplicates(vectors.where("false")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    from lorekeep.llm.components import components

    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(5, 5)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(200, 300)]}


def test_components_of_versions_need_few_rounds(spark):
    from lorekeep.llm.components import components

    n, rounds = 5_000, []
    links = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    got = components(links, rounds)
    assert got.count() == n + 1 and got.where("component <> 0").count() == 0
    assert rounds[0] <= 2 * np.log2(n)


@pytest.mark.parametrize("settings", [{}, {"FREQUENT": 2, "FEW": 3, "BLOCK_SETS": 4, "COMBINED": 6, "CELLS": 1 << 10}])
@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 4, 5)])
def test_shingle_groups_equal_brute_force(spark, monkeypatch, settings, width, num, den):
    for k, v in settings.items():
        monkeypatch.setattr(shingle_join, k, v)
    rng = random.Random(6)
    rows = awkward()
    base = [f"w{k}" for k in range(90)]
    for k in range(60):  # copies with more and more changes, around both thresholds
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(90)] = rng.choice(["zz", "yy", f"q{k}"])
        rows.append((1000 + k, " ".join(w[: 90 - k % 4]).upper(), "s"))
    docs = documents(spark, rows)
    got = shingle_join.near_groups(docs, width, num, den).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == shingle_groups(rows, width, num, den)


def test_one_document_of_each_group_stays(spark):
    rows = awkward()
    docs = documents(spark, rows)
    kept = shingle_join.first_of_groups(docs)
    groups = shingle_groups(rows, 5, 4, 5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in groups if i == c} | {None}
    assert shingle_join.first_of_groups(docs.where("false")).count() == 0
