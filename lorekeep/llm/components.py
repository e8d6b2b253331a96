"""Connected components of links between rows, by contraction.

Each round every node takes as its name the first, by a hash, of itself and its neighbours; links are rewritten to names,
and links within one name vanish. By a hash some constant share of the names is expected to go in every round, whatever
the order of the ids, so a chain of versions needs rounds by the logarithm of its length; a hash serves two rounds, in
which a star is gone. At the end each group is named by its smallest node. Rounds are written tables; the joins are
equality joins whose large keys Spark splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.skew import cut


def components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node it reaches.

    ``rounds``, where given, receives the number of rounds.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names: list[DataFrame] = []
    while not edges.isEmpty():
        place = lambda c, seed=len(names) // 2: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("hash"), F.col(c).alias("at"))
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("node"), F.least(place("a"), "m")["at"].alias("name"))
        step = cut(step, "names")
        names.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("name").alias("x")), "a")
        named = left.join(step.select(F.col("node").alias("b"), F.col("name").alias("y")), "b")
        edges = cut(named.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if rounds is not None:
        rounds.append(len(names))
    if not names:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = names[-1]
    # From the last round back: a node's name is looked up among the nodes of the next round.
    for step in reversed(names[:-1]):
        later = out.select(F.col("node").alias("name"), F.col("name").alias("later"))
        out = cut(step.join(later, "name", "left").select("node", F.coalesce("later", "name").alias("name")), "names")
    least = out.groupBy("name").agg(F.min("node").alias("component"))
    return out.join(least, "name").select("node", "component")


class Forest:
    """Links between the rows of one block, as the smallest id that each row leads to."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.sort(ids)
        self.root = np.empty(len(ids), np.int64)
        self.root[np.argsort(ids, kind="stable")] = np.arange(len(ids))

    def link(self, i: int, others: np.ndarray) -> None:
        met = np.unique(np.append(self.root[others], self.root[i]))
        if len(met) > 1:
            self.root[np.isin(self.root, met[1:])] = met[0]

    def roots(self) -> np.ndarray:
        return self.ids[self.root]
