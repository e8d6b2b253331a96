"""Near-duplicate vectors by an exact metric range join (operator 6).

Cosine >= c between unit vectors means an angle of at most ``eps = acos(c)``, and angles obey the triangle inequality.
Pivots, farthest first from a bounded sample, cut the space into cells: a vector's home is its nearest pivot. A vector is
replicated into the cell of pivot q only if it can have a partner there: ``angle(x, q) <= radius(q) + eps`` and
``angle(x, q) - angle(x, p) <= 2 eps`` for its own pivot p; both bounds hold for either end of a link, so each pair within
reach meets. A cell with many vectors is cut into blocks by a hash, and every pair of blocks is a task of its own of
bounded size. A task compares its vectors in double precision and returns, instead of pairs, the number of partners of
each vector and a spanning forest of its links.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do
vectors of different lengths with one another; equal ids are one vector each in the counts but share a component;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table
from lorekeep.llm.components import Forest, components
from lorekeep.operators.skew import cut

COSINE, PIVOTS, SAMPLE, BLOCK, STRIPE = 0.9, 32, 2_000, 4_096, 512
MARGIN = 1e-6  # added to every bound against rounding


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v): the valid vectors at length one, as the bytes of doubles."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vec_id, values in zip(batch.vec_id, batch.v):
                x = np.array(values, dtype=float) if values is not None else np.zeros(0)
                # Scaled first, so that the length of very large or small vectors is finite.
                top = np.abs(x).max() if len(x) else 0.0
                if np.isfinite(top) and top > 0:
                    x = x / top
                    rows.append((vec_id, len(x), (x / np.sqrt((x * x).sum())).tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "dim", "v"])

    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(task, "vec_id long, dim int, v binary")


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), float).reshape(-1, dim)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def choose_pivots(units: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """At most ``n`` pivots for each of the commonest lengths of vectors, from at most ``sample`` vectors."""
    got = units.orderBy(F.xxhash64("v")).limit(sample).toPandas()
    out = {}
    for dim, rows in got.groupby("dim"):
        x = np.unique(_matrix(rows.v, int(dim)), axis=0)
        chosen, near = [0], _angles(x, x[:1])[:, 0]
        while len(chosen) < min(n, len(x)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _angles(x, x[chosen[-1:]])[:, 0])
        out[int(dim)] = x[chosen]
    return out


def placed(units: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``units`` with home cell and angle to it; lengths without a pivot have one cell, of no pivot."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                p = pivots.get(int(dim))
                if p is None:
                    yield rows.assign(cell=-1, angle=0.0)
                else:
                    a = _angles(_matrix(rows.v, int(dim)), p)
                    cell = a.argmin(1)
                    yield rows.assign(cell=cell, angle=a[np.arange(len(a)), cell])

    return units.mapInPandas(task, "vec_id long, dim int, v binary, cell int, angle double")


def partners(homes: DataFrame, pivots: dict[int, np.ndarray], cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n, root) from every pair of blocks: links found there, and the smallest id they lead to."""
    eps = math.acos(min(1.0, cosine)) + MARGIN
    # A row for each cell; there are as many as pivots.
    cells = {(r.dim, r.cell): (r.n, r.radius) for r in homes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    blocks = {k: -(-n // block) for k, (n, _) in cells.items()}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, home), rows in batch.groupby(["dim", "cell"]):
                p = pivots.get(int(dim))
                own = (rows.salt % blocks[dim, home]).to_numpy()
                angles = _angles(_matrix(rows.v, int(dim)), p) if p is not None else np.zeros((len(rows), 1))
                for (d, cell), (_, radius) in cells.items():
                    if d != dim:
                        continue
                    far = angles[:, max(cell, 0)]
                    near = np.flatnonzero((far <= radius + eps) & (far - rows.angle.to_numpy() <= 2 * eps)) if cell != home else np.arange(len(rows))
                    if not len(near):
                        continue
                    some, mine = rows.iloc[near], own[near]
                    for other in range(blocks[d, cell]):
                        ahead = (cell > home) | ((cell == home) & (other >= mine))
                        yield pd.DataFrame(
                            {
                                "dim": dim, "c1": np.where(ahead, home, cell), "b1": np.where(ahead, mine, other), "c2": np.where(ahead, cell, home), "b2": np.where(ahead, other, mine),
                                "side": np.where(ahead, 0, 1), "vec_id": some.vec_id.to_numpy(), "v": some.v.to_numpy(),
                            }
                        )

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, c1, b1, c2, b2 = (int(k) for k in key)
        rows = rows.sort_values(["side", "vec_id"], kind="stable")
        ids, x = rows.vec_id.to_numpy(), _matrix(rows.v, dim)
        alone = (c1, b1) == (c2, b2)
        left = len(rows) if alone else int((rows.side == 0).sum())
        right = np.arange(len(rows)) if alone else np.arange(left, len(rows))
        n = np.zeros(len(rows), np.int64)
        forest = Forest(ids)
        for at in range(0, left, STRIPE):
            upto = min(at + STRIPE, left)
            hit = x[at:upto] @ x[right].T >= cosine
            if alone:
                hit[np.arange(upto - at), np.arange(at, upto)] = False
            count = hit.sum(1)
            n[at:upto] += count
            if not alone:
                n[right] += hit.sum(0)
            for i in np.flatnonzero(count):
                forest.link(at + i, right[hit[i]])
        keep = n > 0
        return pd.DataFrame({"vec_id": ids[keep], "n": n[keep], "root": forest.roots()[keep]})

    salted = homes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)))
    dealt = salted.mapInPandas(spread, "dim int, c1 int, b1 int, c2 int, b2 int, side int, vec_id long, v binary")
    return dealt.groupBy("dim", "c1", "b1", "c2", "b2").applyInPandas(meet, "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", cosine: float = COSINE, n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    arrow_batches(vectors.sparkSession)
    units = cut(unit_vectors(vectors, id_col, vector_col), "unit-vectors")
    pivots = choose_pivots(units, n_pivots)
    homes = cut(placed(units, pivots), "cells")
    met = cut(partners(homes, pivots, cosine, block), "partners")
    links = met.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comp = components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = rows.join(links, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every row of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
