"""Small tables with every awkward case, and the plain answers they are compared with."""

import collections
import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: The columns of documents, and more whose names an operator might use itself.
DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    + [T.StructField(n, T.StringType()) for n in ("size", "target", "copies", "row", "n", "digest", "component", "node", "rank", "score", "part", "src", "file", "h1", "keep_id", "gone", "_gone", "_f", "_r", "_metadata", "c1")]
)


def documents(spark, rows):
    """rows of (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t), *["x"] * 21) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def awkward(n=40, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "Idiot", "tion", "été", "日本", "x1", "<b>", "a", "lorem"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(k))
    rows = [(k, text(rng.randrange(3, 40)), rng.choice(["s1", "s2", "é", "S3"])) for k in range(n)]
    long = text(20_000)
    rows += [(100, None, "s1"), (101, "", None), (102, " \n\t ", "s2"), (103, "one", None), (104, long, "s1"), (105, long + " end", "s1"), (106, rows[0][1], "s2"), (107, rows[0][1], "s1")]
    near = text(60).split()
    for k in range(30):  # a group of near copies of one another
        w = list(near)
        w[k] = "other"
        rows.append((200 + k, " ".join(w), "hot"))
    rows += [(None, "no id here", "s1"), (None, None, None), (103, "one", None), (107, rows[0][1], "s1")]
    return rows


def union(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_groups(rows, width, num, den):
    """{doc_id: (n, component)} by comparing all pairs; rows without an id are left out."""
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and (den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) or rows[i][0] == rows[j][0])]
    root = union(len(rows), links)
    return collections.Counter((r[0], len(s), rows[k][0]) for r, s, k in zip(rows, sets, root))


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
