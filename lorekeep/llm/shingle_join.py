"""Jaccard join of word shingles by token-combination prefixes (operator 7).

Texts with equal shingle sets are one set. All shingles have one global order: those of a fixed quarter that one set
alone holds, then the quarter's rare and its frequent ones, then all others; by hash within each. Two sets within reach share their first two common shingles in
prefixes extended by one. If one of the two is rare, they meet under it alone; if both are frequent, under their
combination. Long sets, whose prefix has too many combinations, meet under single shingles instead, as do all sets that
can have a long partner. A key with few sets gives its pairs, of which those stay whose quarters leave the bound in reach. These
and the sets that meet under a key with many form clusters, a large cluster is cut into blocks of like size, and pairs of
blocks verify exact intersections of whole sets and return a spanning forest instead of pairs: no link between different
sets is lost, and no group of near copies is written out pair by pair.

Which shingles are shared or frequent is counted over all sets and reaches the tasks as bit maps of fixed size; a shingle
that has its bit in common with a frequent one counts as frequent, which changes the route and not the result.

Defined results: shingles are 64-bit hashes of the words; a null text counts as empty; empty sets link with nothing;
rows with a null id link with nothing and have a null component; rows with equal ids are one node with the links of
each of their texts; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table, unused
from lorekeep.llm.components import Forest, components
from lorekeep.operators.skew import cut

FREQUENT = 24  # sets that hold a shingle
CELLS = 1 << 25  # bits of the maps of shared and of frequent shingles
FEW = 24  # sets under one key that give their pairs
COMBINED = 40  # longest prefix that is combined
BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 1_000, 400_000, 4_096
ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD[1]
    return h ^ (h >> np.uint64(29))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, or of all words where there are fewer."""
    import xxhash

    # On bytes, lower() and split() know ASCII alone.
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * ODD[0] + h[k : len(words) - width + 1 + k])
    return np.unique(out.view(np.int64))


class Bound:
    """Jaccard >= num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 2 * num > den >= num > 0:
            raise ValueError("the threshold lies above one half and not above one")
        self.num, self.den = num, den

    def prefix(self, n: int, k: int) -> int:
        """Length of the prefix that holds the first ``k`` shingles shared with any partner."""
        return min(n, n - -(-self.num * n // self.den) + k)

    def long_from(self) -> int:
        """The smallest size whose prefix is not combined."""
        n = 1
        while self.prefix(n, 2) <= COMBINED:
            n += 1
        return n

    def linked(self, common, n1, n2):
        return common * (self.num + self.den) >= self.num * (n1 + n2)


def _chosen(h: np.ndarray) -> np.ndarray:
    return (h & 3) == 0


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> 2) & (cells - 1)


def _sets(docs: DataFrame, width: int, bound: Bound) -> DataFrame:
    """(doc_id, n, digest, picked, rest): the chosen quarter of each set, and what the prefix needs beyond it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, digest, picked, rest = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, width)
                some = _chosen(h)
                more = bound.prefix(len(h), 2) - int(some.sum())
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                picked.append(h[some])
                rest.append(h[~some][: max(more, 0)])
            lists = lambda a: pa.array(a, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(picked), lists(rest)], ["doc_id", "n", "digest", "picked", "rest"])

    return docs.mapInArrow(task, "doc_id long, n long, digest binary, picked array<long>, rest array<long>")


def _full(docs: DataFrame, width: int, wanted: bytes) -> DataFrame:
    """(node, n, tokens) of the documents whose bit is set, and of few others; their texts stay where they are."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[_cell(_mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64), len(bits))], pa.bool_()))
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "tokens"])

    return docs.mapInArrow(task, "node long, n long, tokens array<long>")


def _bits(cells: DataFrame, *flags: str) -> list[bytes]:
    """A bit map for each of ``flags`` from (cell, flags...), at most a row for each cell; made of blocks that tasks pack."""
    width = min(CELLS, 1 << 15)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((len(flags), width), bool)
        bits[:, (rows.cell % width).to_numpy()] = rows[list(flags)].to_numpy(bool).T
        return pd.DataFrame({"block": [int(rows.cell.iloc[0]) // width], "bits": [np.packbits(bits, axis=1).tobytes()]})

    packed = cells.withColumn("block", (F.col("cell") / width).cast("int")).groupBy("block").applyInPandas(pack, "block int, bits binary")
    out = np.zeros((CELLS // width, len(flags), width // 8), np.uint8)
    for r in packed.collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8).reshape(len(flags), -1)
    return [out[:, k].tobytes() for k in range(len(flags))]


def _maps(sets: DataFrame) -> tuple[bytes, bytes]:
    """Bits of the chosen shingles that more than one set, and more than ``FREQUENT`` sets hold."""
    counts = sets.select(F.explode("picked").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    cell = F.shiftright("h", 2).bitwiseAND(CELLS - 1)
    shared, often = _bits(counts.groupBy(cell.alias("cell")).agg(F.lit(True).alias("shared"), (F.max("c") > FREQUENT).alias("often")), "shared", "often")
    return shared, often


def _wanted(nodes: DataFrame) -> bytes:
    size = CELLS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cell(_mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(cell).astype(np.int32))], ["cell"])

    cells = nodes.mapInArrow(task, "cell int").distinct().withColumn("on", F.lit(True))
    return _bits(cells, "on")[0]


def _index(sets: DataFrame, bound: Bound, maps: tuple[bytes, bytes]) -> DataFrame:
    """(key, node, n): the keys under which each set meets others."""
    held = sets.sparkSession.sparkContext.broadcast(maps)
    long_from = bound.long_from()
    may_meet_long = math.ceil(bound.num * long_from / bound.den)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_bits, often_bits = (np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool) for m in held.value)
        for batch in batches:
            keys: list[np.ndarray] = []
            picked, rest = batch.column("picked"), batch.column("rest")
            sizes = batch.column("n").to_numpy()
            for k in range(batch.num_rows):
                n = int(sizes[k])
                h = picked[k].values.to_numpy()
                cell = _cell(h, len(shared_bits))
                shared, often = shared_bits[cell], often_bits[cell]
                rare, usual = h[shared & ~often], np.concatenate([h[often], rest[k].values.to_numpy()])
                # Shingles of this set alone come first and lead to no other set.
                alone = len(h) - int(shared.sum())
                one, two = bound.prefix(n, 1) - alone, bound.prefix(n, 2) - alone
                out = [_mixed(rare[: max(two, 0)].view(np.uint64))]
                usual2 = usual[: max(two - len(rare), 0)].view(np.uint64)
                if n < long_from and len(usual2) > 1:
                    # Stored order is the global order, so both sets name a combination alike.
                    i, j = np.triu_indices(len(usual2), 1)
                    out.append(_mixed(_mixed(usual2[i]) * ODD[0] + usual2[j]))
                if n >= may_meet_long:
                    out.append(_mixed(usual[: max(one - len(rare), 0)].view(np.uint64) * ODD[2] + ODD[0]))
                keys.append(np.concatenate(out).view(np.int64))
            if keys:
                length = [len(x) for x in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), length)), pa.array(np.repeat(sizes, length))], ["key", "node", "n"]
                )

    return sets.select("doc_id", "n", "picked", "rest").mapInArrow(task, "key long, node long, n long")


def _pairs(few: DataFrame, bound: Bound) -> DataFrame:
    """Distinct pairs (a, b) of sets of like size under a key; a key has at most ``FEW`` sets."""
    lists = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    a = lists.select("m", F.posexplode("m").alias("i", "x"))
    b = a.select("x", F.explode(F.slice("m", F.col("i") + 2, F.lit(FEW))).alias("y"))
    like = F.least("x.n", "y.n") * bound.den >= F.greatest("x.n", "y.n") * bound.num
    return b.where(like & (F.col("x.node") != F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _possible(pairs: DataFrame, reps: DataFrame, bound: Bound, maps: tuple[bytes, bytes]) -> DataFrame:
    """The pairs whose chosen shingles leave the bound in reach.

    Two sets share at most what they share of the chosen quarter, and there only shingles that several sets hold, and all
    that the smaller rest of the two could have in common.
    """
    held = reps.sparkSession.sparkContext.broadcast(maps[0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            picked = [p.values.to_numpy() for p in batch.column("picked")]
            n = batch.column("n")
            rest = pa.array(n.to_numpy() - np.array([len(h) for h in picked], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, rest, pa.array([h[bits[_cell(h, len(bits))]] for h in picked], pa.list_(pa.int64()))], ["node", "n", "rest", "some"])

    known = reps.select("doc_id", "n", "picked").mapInArrow(task, "node long, n long, rest long, some array<long>")
    side = lambda c: known.select(F.col("node").alias(c), F.struct("n", "rest", "some").alias(f"of_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.size(F.array_intersect("of_a.some", "of_b.some")) + F.least("of_a.rest", "of_b.rest")
    return both.where(bound.linked(most, F.col("of_a.n"), F.col("of_b.n"))).select("a", "b")


def _cluster_links(clusters: DataFrame, full: DataFrame, bound: Bound) -> DataFrame:
    """Links (a, b) inside clusters of sets, as a forest for each pair of blocks."""
    # Partners lie in the same or the next class of sizes. A cluster that is one block by itself is one class.
    step = math.log(bound.den / bound.num) if bound.num < bound.den else 1e-9
    # Sets are dealt by their sizes alone; the shingles follow when it is settled where they are needed.
    sized = clusters.join(full.select("node", "n"), "node")
    small = sized.groupBy("cluster").agg(((F.count(F.lit(1)) <= BLOCK_SETS) & (F.sum("n") <= BLOCK_TOKENS)).alias("small"))
    kind = F.when(F.col("small"), 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
    sets = cut(sized.join(small, "cluster").withColumn("kind", kind).drop("small"), "cluster-sets")
    sizes = sets.groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    blocks = sizes.select("cluster", "kind", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).alias("blocks"))
    own = sets.join(blocks, ["cluster", "kind"]).withColumn("b1", F.pmod(F.xxhash64("node", "n"), F.col("blocks"))).withColumnRenamed("blocks", "own")
    # A set goes to every block of its class and of the two next to it; the lower block names the pair first.
    near = own.select("*", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)).alias("k2"))
    near = near.join(blocks.select("cluster", F.col("kind").alias("k2"), F.col("blocks").alias("other")), ["cluster", "k2"])
    near = near.withColumn("b2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)))
    ahead = (F.col("kind") < F.col("k2")) | ((F.col("kind") == F.col("k2")) & (F.col("b1") <= F.col("b2")))
    swap = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    dealt = near.select(
        "cluster", swap("kind", "k2").alias("p"), swap("b1", "b2").alias("q"), swap("k2", "kind").alias("r"), swap("b2", "b1").alias("s"), F.when(ahead, 0).otherwise(1).alias("side"), "node", "n"
    ).join(full, ["node", "n"])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        alone = key[1:3] == key[3:5]
        rows = rows.sort_values(["side", "node"], kind="stable")
        left = len(rows) if alone else int((rows.side == 0).sum())
        right = np.arange(len(rows)) if alone else np.arange(left, len(rows))
        n = rows.n.to_numpy()
        if not left or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        row = np.repeat(np.arange(len(rows)), n)
        column, count = np.unique(np.concatenate(list(rows.tokens)), return_inverse=True, return_counts=True)[1:]
        # A shingle of one set adds nothing.
        used = np.cumsum(count > 1) - 1
        row, column = row[count[column] > 1], used[column[count[column] > 1]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((left, len(right)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            held = np.zeros((len(rows), COLUMNS), np.float32)
            held[row[a:b], column[a:b] - at] = 1
            common += held[:left] @ held[right].T
        hit = bound.linked(np.rint(common).astype(np.int64), n[:left, None], n[None, right])
        if alone:
            np.fill_diagonal(hit, False)
        forest = Forest(rows.node.to_numpy())
        for i in np.flatnonzero(hit.any(1)):
            forest.link(i, right[hit[i]])
        out = pd.DataFrame({"a": rows.node.to_numpy(), "b": forest.roots()})
        return out[out.a != out.b]

    return dealt.groupBy("cluster", "p", "q", "r", "s").applyInPandas(meet, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``: linked when the Jaccard similarity is num / den or more."""
    arrow_batches(docs.sparkSession)
    bound = Bound(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = cut(_sets(rows, width, bound), "shingle-sets")
    filled = sets.where("n > 0 AND doc_id IS NOT NULL")
    first = cut(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "shingle-reps")
    # One row for each different set, with all that the index needs.
    kept = filled.join(first.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest"])
    reps = cut(kept, "shingle-distinct")

    maps = _maps(reps)
    index = _index(reps, bound, maps)
    keys = index.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("lead")).where("sets > 1")
    met = cut(index.join(keys, "key"), "shingle-keys")
    pairs = _possible(_pairs(met.where(F.col("sets") <= FEW), bound), reps, bound, maps)
    together = met.where((F.col("sets") > FEW) & (F.col("node") != F.col("lead"))).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    clusters = components(pairs.union(together)).withColumnRenamed("component", "cluster")
    full = cut(_full(rows.where("doc_id IS NOT NULL"), width, _wanted(clusters.select("node"))), "shingle-full")
    found = components(_cluster_links(clusters, full, bound)).select(F.col("node").alias("rep"), "component")

    named = sets.select("doc_id", "n", "digest").join(first, "digest", "left").join(found, "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def first_of_groups(docs: DataFrame, id_col="doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id; a row without an id stays."""
    name = unused(docs, "gone")
    gone = near_groups(docs, id_col=id_col, **how).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy groups of all ``documents``: 3-word shingles, Jaccard of nine tenths or more."""
    return near_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
