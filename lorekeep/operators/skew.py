"""Grouped operators that stay correct and bounded when one key holds a large share of the rows.

* ``top_n`` and ``first_by`` rely on partial aggregation / the map-side group limit that Spark puts below
  ``row_number() <= n``, so a hot key never reaches one task whole.
* ``prefix_sum`` splits a running total over nested buckets of the order: only the bucket totals of a group
  are ordered together, never its rows.
* ``joined_text`` makes the one value that a text is; what works on lines or messages takes the rows instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lorekeep.session import work_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back: the lineage ends there and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in ``order``; ``rank`` keeps the 1-based position."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_by(df: DataFrame, keys: Sequence[str], order: Column, descending: bool = False) -> DataFrame:
    """One row per key: the smallest (or largest) by ``order``, as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    agg = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``.

    ``buckets`` are nested, coarse to fine, and must be monotone in ``order`` (day, then hour, of the order time).
    Rows are ordered only inside their finest bucket; every coarser level orders bucket totals.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    base = df.withColumns({n: b for n, b in zip(names, buckets)}).withColumn("_v", value)
    path = [*keys, *names]
    running = W.partitionBy(*path).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = base.withColumn(name, F.sum("_v").over(running))
    totals = base.groupBy(*path).agg(F.sum("_v").alias("_t"))
    offset = F.lit(0)
    added: list[str] = []
    for depth in range(len(names), 0, -1):
        group, level = [*keys, *names[: depth - 1]], [*keys, *names[:depth]]
        level_totals = totals.groupBy(*level).agg(F.sum("_t").alias("_t"))
        before = W.partitionBy(*group).orderBy(names[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        off = f"_o{depth}"
        offsets = level_totals.select(*level, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(off))
        cond = None
        right = offsets.select(*[F.col(c).alias(f"_k_{c}") for c in level], off)
        for c in level:
            eq = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
            cond = eq if cond is None else cond & eq
        out = out.join(right, cond, "inner").drop(*[f"_k_{c}" for c in level])
        offset = offset + F.col(off)
        added.append(off)
    return out.withColumn(name, F.col(name) + offset).drop("_v", *names, *added)


def newest_first(at: str, id_col: str) -> tuple[list[Column], list[Column]]:
    """Buckets and order of 'newest first, then highest id' for times of second precision: day, second, block of ids."""
    buckets = [-F.unix_date(F.to_date(at)), -F.unix_timestamp(at), -F.floor(F.col(id_col) / 65_536)]
    return buckets, [F.col(at).desc(), F.col(id_col).desc()]


def global_prefix_sum(
    df: DataFrame, buckets: Sequence[Column], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """``prefix_sum`` over the whole table."""
    return prefix_sum(df.withColumn("_g", F.lit(0)), ["_g"], buckets, order, value, name).drop("_g")


def joined_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "\n") -> DataFrame:
    """Ordered pieces joined into one text per key: ``(keys, n_pieces, text)``. A text is one value and so one task's."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pieces"), F.array_join(F.transform(pieces, lambda p: p["_text"]), sep).alias("text")
    )
