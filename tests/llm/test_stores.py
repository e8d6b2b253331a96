"""Vector codes, archives and framed texts against brute force, literal files and round trips."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import types as T

from lorekeep.llm import framed_fim as FF
from lorekeep.llm import vector_codes as V
from lorekeep.llm import warc_convert as W
from tests.llm.data import awkward, documents

EXTRA = [T.StructField(n, T.StringType()) for n in ("v", "label_error", "code", "error", "_label", "key", "path", "seq", "first", "digest", "bytes", "refers", "text", "blob", "_metadata")]


# --- vector codes ----------------------------------------------------------------------------------------------------------


def vectors(spark, rows, extra=()):
    kinds = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), *extra]
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], T.StructType(kinds)).repartition(3)


def brute_codes(rows, parts, entries, rounds):
    """Codes and errors by comparing every part with every entry, in Python's integers."""
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next((len(v) for _, v in kept if v), 0)
    top = V.limit(width)
    size = -(-width // parts)
    fits = [[max(-top, min(top, int(np.floor(256 * x)))) for x in v] + [0] * (size * parts - width) for _, v in kept if len(v) == width]
    cuts = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in fits]
    books = [[c[p] for c in cuts[:entries]] for p in range(parts)]
    best = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            near = [best(p, c[p])[1] for c in cuts]
            for k in set(near):
                mine = [c[p] for c, at in zip(cuts, near) if at == k]
                books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    out, left = [], iter(cuts)
    for i, v in kept:
        if len(v) != width:
            out.append((i, None, None))
            continue
        got = [best(p, x) for p, x in enumerate(next(left))]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() for _ in range(12)], rng.choice([1, 1, 2, None])) for i in range(150)]
    rows += [(300 + i, list(rows[5][1]), 1) for i in range(40)]  # copies: ties between equal entries
    rows += [(2, list(rows[9][1]), 1), (None, list(rows[4][1]), None)]
    rows += [(400, None, 1), (401, [None] * 12, 1), (402, [float("nan")] * 12, 1), (403, [float("-inf")] * 12, 2), (404, [0.0] * 12, 2), (405, [1e300] * 12, 3), (406, [], 3), (407, [1.0] * 5, 3)]
    for parts, entries in ((4, 16), (5, 7)):
        df = vectors(spark, rows, EXTRA)
        books = V.fit(df, parts=parts, entries=entries, rounds=2)
        got = V.with_label_errors(V.encode(df, books, label_col="label")).collect()
        want, digest = brute_codes(rows, parts, entries, 2)
        key = lambda r: (str(r[0]), str(r[1]))
        assert sorted(((r.vec_id, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
        assert books.digest() == digest
        for label in (1, 2, 3, None):
            mine = [r for r in got if r.label == label]
            assert {r.label_error for r in mine} == {sum(r.error or 0 for r in mine)}


def test_orchard_search_skips_entries():
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-300, 300, (64, 4)), rng.integers(-300, 300, (500, 4))
    search = V.Orchard(entries)
    place, dist = search.nearest(x)
    all_of = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (place == all_of.argmin(1)).all() and (dist == all_of.min(1)).all()
    assert (np.diff(search.gap, axis=1) >= 0).all()


def test_few_and_no_vectors(spark):
    few = vectors(spark, [(7, [1.0, 2.0], 1), (9, [1.0, 2.5], 1)])
    books = V.fit(few, parts=2, entries=8, rounds=1)
    assert [r.code for r in V.encode(few, books).orderBy("vec_id").collect()] == ["0000", "0001"]
    assert books.decode("0000") == pytest.approx([1.0, 2.0], abs=0.003)
    none = vectors(spark, [])
    assert V.fit(none) is None and V.encode(none, None).count() == 0
    assert V.encode(vectors(spark, [(1, [], 1)]), V.fit(vectors(spark, [(1, [], 1)]))).collect()[0].code is None


# --- archives --------------------------------------------------------------------------------------------------------------


def pages(spark, rows, extra=()):
    kinds = [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *extra]
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], T.StructType(kinds)).repartition(4)


@pytest.fixture
def from_pages(spark, tmp_path):
    def run(rows, extra=()):
        arcs = W.write_arc(pages(spark, rows, extra), f"{tmp_path}/arc")
        return W.read_warc(W.convert(arcs, f"{tmp_path}/warc")).collect()

    return run


def test_pages_through_both_formats(from_pages):
    long = "<p>é</p>" * 100_000
    rows = [(k, f"http://h/{k}", "x" * 99 if k % 2 else "same page, " * 20) for k in range(1, 9)]
    rows += [(20, None, None), (21, "http://h/a b\nc é", ""), (22, "http://h/", long), (23, "http://h/", long), (24, "u", "a\r\n\r\nb" * 40), (None, "n", long), (22, "http://h/", long)]
    got = from_pages(rows, EXTRA)
    ids = {r.record_id: r.key for r in got if r.record_type == "response"}
    assert len(ids) + sum(r.record_type == "revisit" for r in got) == len(rows) == len({r.record_id for r in got})
    want = []
    for key, _, html in rows:
        body = (html or "").encode()
        twins = [i for i, _, h in rows if h == html and i is not None]
        first = min(twins)
        again = len(body) >= 100 and (key != first or len([i for i in twins if i == first]) > 1)
        want.append((key, len(body), hashlib.sha256(body).hexdigest(), first if again else None))
    same = lambda r: r[:3]
    found = [(r.key, r.bytes, r.digest, ids.get(r.refers_to)) for r in got]
    assert sorted(map(str, map(same, found))) == sorted(map(str, map(same, want)))
    # Of the two equal rows 22 one is the response.
    once = lambda rows: sorted(str(r) for r in rows if r[0] != 22)
    assert once(found) == once(want)
    assert sorted(str(r[3]) for r in found if r[0] == 22) == ["22", "None"]


def test_empty_table(from_pages):
    assert from_pages([]) == []


ARC1 = b"""filedesc://old.arc 0.0.0.0 19960923142103 text/plain 77
1 0 Someone
URL IP-address Archive-date Content-type Archive-length

stray line
http://a.b/with space 10.1.2.3 19961104142103 text/html 41
HTTP/1.0 200 OK
Server: x

<b>one</b>
two

dns:a.b 10.1.2.4 199611041421 text/dns 5
abcde
ftp://a.b/f 0.0.0.0 19961104142103 text/plain 500
cut"""
ARC2 = b"""filedesc://new.arc 0.0.0.0 19980101000000 text/plain 200 - - 0 new.arc 14
2 0 Some One

\n
http://a.b/x 10.1.2.3 19981104142103 text/html 200 - - 99 new.arc 22
HTTP/1.0 200 OK\n\nhello
"""


def test_arc_versions():
    one = list(W.captures(io.BytesIO(ARC1)))
    assert [(c.url, c.ip, c.date, c.kind, c.cut) for c in one[1:]] == [
        ("http://a.b/with space", "10.1.2.3", "19961104142103", "text/html", False),
        ("dns:a.b", "10.1.2.4", "199611041421", "text/dns", False),
        ("ftp://a.b/f", "0.0.0.0", "19961104142103", "text/plain", True),
    ]
    assert one[1].split() == (b"HTTP/1.0 200 OK\nServer: x\n\n", b"<b>one</b>\ntwo")
    two = list(W.captures(io.BytesIO(ARC2)))
    assert [(c.url, c.split()[1]) for c in two[1:]] == [("http://a.b/x", b"hello")]


def test_converted_records(spark, tmp_path):
    for name, data in (("old.arc", ARC1), ("new.arc.gz", gzip.compress(ARC2))):
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(f"{tmp_path}/old.arc", 0), (f"{tmp_path}/new.arc.gz", 0)], W.FILES)
    out = W.convert(files, f"{tmp_path}/warc", least=3).collect()
    assert sorted((r.path.rpartition("/")[2], r.records) for r in out) == [("new.warc.gz", 2), ("old.warc.gz", 4)]
    with gzip.open(tmp_path / "warc" / "old.warc.gz") as f:
        got = [(r.fields["WARC-Type"], r.fields["WARC-Date"], r.fields.get("WARC-Target-URI"), r.fields["Content-Type"], r.fields.get("WARC-Truncated")) for r in W.records(f)]
    assert got == [
        ("warcinfo", "1996-09-23T14:21:03Z", None, "application/warc-fields", None),
        ("response", "1996-11-04T14:21:03Z", "http://a.b/with space", "application/http; msgtype=response", None),
        ("resource", "1996-11-04T14:21:00Z", "dns:a.b", "text/dns", None),
        ("resource", "1996-11-04T14:21:03Z", "ftp://a.b/f", "text/plain", "unspecified"),
    ]
    again = W.convert(files, f"{tmp_path}/second", least=3)
    ids = lambda df: sorted(r.record_id for r in W.read_warc(df).collect())
    assert ids(again) == ids(spark.createDataFrame(out)), "reruns agree"


# --- framed texts ----------------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_strings(spark):
    rows = awkward() + [(500 + k, "日é𝄞x" * k, "s") for k in range(1, 60)] + [(600, "a <P> b", "s"), (601, "<M>", "s"), (602, "é" * 400_000, "s"), (603, "<P <S< M>", "s")]
    stored = FF.store(documents(spark, rows))
    want = sorted((str(i), *map(str, brute_fim(i, t))) for i, t, _ in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = FF.digests(stored).collect()
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256) for r in got) == sorted((*w[:-1], sha(w[-1])) for w in want)
    assert sorted((str(r.doc_id), r.restored_sha256) for r in got) == sorted((str(i), sha(t or "")) for i, t, _ in rows)
    outputs = FF.transform(stored).collect()
    assert sorted((str(r.doc_id), r.form, r.output) for r in outputs) == sorted((w[0], w[2], w[5]) for w in want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert FF.digests(FF.store(documents(spark, []))).count() == 0


def test_frames_are_independent():
    text = ("日本語 text, " * 5_000).encode()
    blob = FF.pack(text, 1000)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True).read() == text
    framed = FF.Framed(blob)
    whole = text.decode()
    assert framed.units == len(whole) and framed.n > 60
    for unit in (0, 1, 777, len(whole) // 2, len(whole) - 1, len(whole)):
        framed.opened = 0
        assert framed.byte_at(unit) == len(whole[:unit].encode())
        assert framed.opened <= 1
    a, b = framed.byte_at(30_000), framed.byte_at(30_010)
    framed.opened = 0
    assert b"".join(framed.stream(a, b)).decode() == whole[30_000:30_010] and framed.opened <= 2
    broken = bytearray(blob)
    broken[200] ^= 255
    with pytest.raises(Exception):
        b"".join(FF.Framed(bytes(broken)).stream(0, len(text)))


def test_broken_bytes_are_cut_where_they_are():
    for text in (b"\x80" * 5000, b"a" + b"\xff\x80" * 3000, b""):
        framed = FF.Framed(FF.pack(text, 100))
        assert b"".join(framed.stream(0, len(text))) == text
