"""Vector codes from small codebooks, found by Orchard's search (operator 11).

A vector becomes integers, ``floor(256 * x)``, and is cut into equal consecutive parts; each part position has a codebook.
The nearest entry of a part is found by Orchard's search: every entry holds the others sorted by their distance to it. A
search stands at one entry and walks that entry's list; an entry that is nearer (or as near with a lower index) becomes the
new place and its list is walked from the start; entries once compared are marked and not compared again; the walk ends
where the list goes beyond twice the distance to the place, as by the triangle inequality nothing nearer can follow. All
distances are squared integers, so the answers and their ties are exact. A task walks the searches of a batch in step.

A round of fitting is one job: tasks add up the parts of each entry, Spark adds up the tasks, and only one row for each
entry and component, a number that the parameters fix, reaches the driver.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; an integer beyond
``limit(width)`` counts as that limit, so that errors fit a long; a length that the parts don't divide is filled up with
zeros; the smallest id with a non-empty vector sets the length, and vectors of another length stay with a null code and
error; with fewer rows than entries the codebooks are shorter; null ids count after all others, equal ids follow their
vector; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, table
from lorekeep.operators.skew import cut

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2


def limit(width: int) -> int:
    """Largest integer component for which four times the squared distance of two vectors fits a long."""
    return math.isqrt((1 << 62) // (16 * max(width, 1)))


class Orchard:
    """Exact nearest entries of one codebook, with the distance-sorted neighbour list of each entry."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        self.near = np.argsort(apart, axis=1, kind="stable")
        # Behind the last neighbour stands a gap that ends every walk.
        self.gap = np.full((len(entries), len(entries) + 1), np.iinfo(np.int64).max)
        self.gap[:, :-1] = np.take_along_axis(apart, self.near, 1)
        self.by_first = np.argsort(entries[:, 0], kind="stable")
        self.firsts = entries[self.by_first, 0]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of ``x``; ties go to the lower index."""
        # Any start is right; an entry that begins alike is often close.
        place = self.by_first[np.minimum(np.searchsorted(self.firsts, x[:, 0]), len(self.firsts) - 1)]
        dist = ((x - self.entries[place]) ** 2).sum(1)
        seen = np.zeros((len(x), len(self.entries)), bool)
        seen[np.arange(len(x)), place] = True
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            # Twice the distance is four times its square.
            live = live[self.gap[place[live], at[live]] <= 4 * dist[live]]
            met = self.near[place[live], at[live]]
            at[live] += 1
            fresh = ~seen[live, met]
            rows, met = live[fresh], met[fresh]
            seen[rows, met] = True
            d = ((x[rows] - self.entries[met]) ** 2).sum(1)
            closer = (d < dist[rows]) | ((d == dist[rows]) & (met < place[rows]))
            moved = rows[closer]
            place[moved], dist[moved], at[moved] = met[closer], d[closer], 0
        return place, dist


@dataclass(frozen=True)
class Codebooks:
    """The length of the vectors and, for each part position, an array (entries, components of a part)."""

    width: int
    parts: list[np.ndarray]

    def digest(self) -> str:
        """Hex SHA-256 of all components by part, entry and position, as decimals with commas between."""
        return hashlib.sha256(",".join(str(c) for p in self.parts for c in p.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for, in the units of the vectors: the middle of each integer step."""
        picked = [p[i] for p, i in zip(self.parts, bytes.fromhex(code))]
        return ((np.concatenate(picked)[: self.width] + 0.5) / SCALE).tolist()


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector has no null or non-finite component."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _integers(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """(rows, parts, components) of vectors of one length."""
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    x = np.clip(x, -limit(width), limit(width)).astype(np.int64)
    filled = -(-width // parts) * parts
    return np.pad(x, ((0, 0), (0, filled - width))).reshape(len(x), parts, filled // parts)


def _first(rows: DataFrame, entries: int, parts: int) -> Codebooks | None:
    """Codebooks of the rows with the smallest ids."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    lead = rows.where(F.size("v") > 0).orderBy(*order).limit(1).select(F.size("v").alias("n")).collect()
    if not lead:
        return None
    width = lead[0].n
    first = rows.where(F.size("v") == width).orderBy(*order).limit(entries).select("v").collect()
    x = _integers(pa.array([r.v for r in first], pa.list_(pa.float64())), width, parts)
    return Codebooks(width, [np.ascontiguousarray(x[:, p]) for p in range(parts)])


def _next(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floor of the mean of the parts that are nearest to it; an unused one stays."""
    width, parts = books.width, len(books.parts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(p) for p in books.parts]
        used = np.zeros((parts, len(books.parts[0])), np.int64)
        total = np.zeros((parts, *books.parts[0].shape), np.int64)
        for batch in batches:
            x = _integers(batch.column(0), width, parts)
            for p in range(parts):
                entry, _ = search[p].nearest(x[:, p])
                used[p] += np.bincount(entry, minlength=len(used[p]))
                np.add.at(total[p], entry, x[:, p])
        p, e, c = np.indices(total.shape).reshape(3, -1)
        columns = (p, e, c, np.repeat(used.ravel(), total.shape[2]), total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in columns], ["p", "e", "c", "used", "total"])

    sums = rows.where(F.size("v") == width).select("v").mapInArrow(task, "p long, e long, c long, used long, total long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("used", "total")]
    after = [p.copy() for p in books.parts]
    for r in sums.groupBy("p", "e", "c").agg(*exact).where("used > 0").collect():
        after[r.p][r.e, r.c] = int(r.total) // int(r.used)
    return Codebooks(width, after)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from all vectors; None where no vector is usable. ``entries`` is at most 256, a byte of code."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = kept(vectors, id_col, vector_col)
    arrow_batches(vectors.sparkSession)
    books = _first(rows, entries, parts)
    for _ in range(rounds if books else 0):
        books = _next(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """(vec_id, label, code, error): the nearest entry of each part and the squared distances summed over the parts."""
    rows = kept(vectors, id_col, vector_col, label_col)
    arrow_batches(vectors.sparkSession)
    if books is None:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    width, parts = books.width, len(books.parts)
    kinds = rows.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(p) for p in books.parts]
        for batch in batches:
            fits = np.array([n == width for n in batch.column(2).value_lengths().to_pylist()], bool)
            x = _integers(batch.column(2).filter(pa.array(fits)), width, parts)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], dist = search[p].nearest(x[:, p])
                error += dist
            code: list[str | None] = [None] * len(fits)
            off: list[int | None] = [None] * len(fits)
            for at, c, e in zip(np.flatnonzero(fits).tolist(), codes, error.tolist()):
                code[at], off[at] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(off, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"
    return rows.mapInArrow(task, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors summed over equal labels, nulls together; null where the sum is beyond a long."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors and the digest of the codebooks of all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    coded = with_label_errors(cut(encode(vectors, books, label_col="label"), "vector-codes"))
    digest = F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest())
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _round(n: int) -> str:
    """Assignment ``a{n}`` under codebook ``b{n}`` and the codebook after it."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, label, p, x, best % 64 AS e, best // 64 AS d FROM (
    SELECT c.vec_id, c.label, c.p, c.x,
           min(CAST(list_sum(list_transform(range(1, len(c.x) + 1), lambda i: (c.x[i] - b.x[i]) * (c.x[i] - b.x[i]))) AS BIGINT) * 64 + b.e) AS best
    FROM cuts c JOIN b{n} b USING (p) GROUP BY ALL)),
b{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{n}, range(1, 65) r(i) WHERE i <= len(x) GROUP BY ALL)
    GROUP BY p, e) m USING (p, e))"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
cuts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, range(16) r(p)),
b0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cuts) WHERE e < 64),
{_round(0)}, {_round(1)}, {_round(2)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""
