"""Toxicity by maximum-scoring segments (operator 1).

The score of a word is the log-odds of toxic against clean documents under an informative Dirichlet prior (the pooled
counts); a word that says nothing costs a little, so a passage has to keep up a density of telling words. One linear
scan per text finds all maximal segments. Under the clean distribution the best score of n words follows an
extreme-value law ``P(S < x) = exp(-K n exp(-lambda x))``; lambda is the root of the moment equation over the word
scores, K is fitted to clean documents. A document's evidence adds up what its segments exceed that law by, and a
logistic curve fitted on documents that gave no counts turns it into a score.

The model learns from at most ``rows`` labelled documents and keeps every word of theirs whose odds are significant; every
word of every text is scanned. Defined results: a null text counts as empty; texts without words get the score of no evidence; without
labelled documents of both kinds every score is next to 0; repeated rows get equal scores; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_batches, held_out, labelled, table

ROWS = 20_000
PRIOR = 0.1  # weight of the prior against the counts
SIGNIFICANT_WORD = 4.0  # in standard errors of the log-odds
DENSITY = 0.1  # telling words in a toxic passage
SIGNIFICANT_SEGMENT = 0.05  # expected number by chance
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass over its positive runs."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    first = np.r_[True, up[1:] != up[:-1] + 1]
    starts, ends = up[first], up[np.r_[first[1:], True]] + 1
    # Candidates with the sums before and after them, and the nearest earlier one with a smaller sum before it.
    open_: list[list] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        left, right = float(total[a]), float(total[b])
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= left:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= right:
                open_.append([a, b, left, right, j])
                break
            a, left = open_[j][0], open_[j][2]
            del open_[j:]
    return [(a, b, right - left) for a, b, left, right, _ in open_]


@dataclass
class Model:
    score: dict[str, float] = field(default_factory=dict)
    rest: float = -1.0
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -50.0

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        found = words(text)
        get, rest = self.score.get, self.rest
        return len(found), segments(np.array([get(w, rest) for w in found]))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum of -log(expected number by chance), of the best segment and of all further significant ones."""
        by_chance = math.log(self.k * max(n, 1))
        marks = sorted((self.lam * s - by_chance for _, _, s in found), reverse=True)
        return (marks[0] if marks else -by_chance) + sum(m for m in marks[1:] if m > -math.log(SIGNIFICANT_SEGMENT))

    def probability(self, x: float) -> float:
        z = self.slope * float(_damped(x)) + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _damped(x):
    """Evidence on a scale on which a few documents of overwhelming evidence and a wrong label don't flatten the curve."""
    return np.sign(x) * np.log1p(np.abs(x))


def _moment_root(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lam * score)) = 1."""
    lo, hi = 0.0, 1.0
    moment = lambda x: float(np.sum(share * np.exp(np.minimum(x * scores, 700)))) - 1
    while moment(hi) < 0 and hi < 1e3:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a light penalty on the slope."""
    w = np.zeros(2)
    data = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        step = np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + np.diag([0.05, 1e-6]), data.T @ (y - p) - np.array([0.05, 0]) * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, label: str = "toxic") -> Model:
    """Counts come from three folds, the calibration from the fourth."""
    arrow_batches(docs.sparkSession)
    sample = labelled(docs, labels, label, rows).persist()
    try:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: dict[str, list[int]] = {}
                for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for w in set(words(text)):
                        held.setdefault(w, [0, 0])[y] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["w", "clean", "bad"]
                )

        counted = sample.where("fold < 4").select("text", (F.col("y") > 0).cast("int").alias("y")).mapInArrow(count, "w string, clean long, bad long")
        counts = counted.groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).persist()
        n0, n1 = (float(v or 0) for v in counts.agg(F.sum("clean"), F.sum("bad")).first())
        if not n0 or not n1:
            return Model()
        prior = F.lit(PRIOR) * (F.col("clean") + F.col("bad"))
        whole = PRIOR * (n0 + n1)
        odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + whole) - F.col(y) - prior))
        error = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("clean") + prior))
        told = counts.withColumn("s", odds("bad", n1) - odds("clean", n0)).withColumn("z", F.col("s") / error)
        kept = told.where(F.abs("z") >= SIGNIFICANT_WORD).orderBy(F.abs("z").desc(), "w").collect()
        counts.unpersist()
        model = Model({r.w: float(r.s) for r in kept}, math.log1p(-DENSITY))
        shares = np.array([(r.clean + PRIOR * (r.clean + r.bad)) / (n0 + whole) for r in kept] + [0.0])
        shares[-1] = 1 - shares.sum()
        scores = np.array([r.s for r in kept] + [model.rest])
        if (scores > 0).any() and (shares * scores).sum() < 0:
            model.lam = _moment_root(scores, shares)
        last = sample.where("fold = 4").select("doc_id", "text", "y")
        best = _found(last, model, "y").select("doc_id", "y", "n", "best").toPandas()
        y = (best.y > 0).to_numpy(float)
        if len(best) and 0 < y.sum() < len(y):
            clean = best[y == 0]
            model.k = len(clean) / max(float((np.maximum(clean.n, 1) * np.exp(-model.lam * clean.best)).sum()), 1e-12)
            # The curve is fitted on what it is used for: the evidence of all significant segments.
            found = _found(last, model, "y").select("y", "evidence").toPandas()
            model.slope, model.shift = _logistic(_damped(found.evidence.to_numpy(float)), (found.y > 0).to_numpy(float))
        return model
    finally:
        sample.unpersist()


def _found(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep``, n, best, evidence, tail, passages of each (doc_id, text): passages are the significant segments in words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, best, evidence, tail, spans = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                length, found = model.passages(text)
                limit = math.log(model.k * max(length, 1)) - math.log(SIGNIFICANT_SEGMENT)
                n.append(length)
                best.append(max((s for _, _, s in found), default=0.0))
                evidence.append(model.evidence(length, found))
                tail.append(model.probability(evidence[-1]))
                spans.append([{"start": a, "end": b, "score": s} for a, b, s in found if model.lam * s > limit])
            kept = [batch.column(c) for c in ("doc_id", *keep)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), *[pa.array(c, pa.float64()) for c in (best, evidence, tail)], pa.array(spans, kind)], ["doc_id", *keep, "n", "best", "evidence", "tail", "passages"])

    extra = "".join(f", {c} int" for c in keep)
    return docs.mapInArrow(task, f"doc_id long{extra}, n long, best double, evidence double, tail double, passages array<struct<start:long,end:long,score:double>>")


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, passages) of every document."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _found(rows, model).select("doc_id", F.col("tail").alias("score"), "passages")


def without_toxic(docs: DataFrame, model: Model, text_col="text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``limit``; columns and other values stay as they are."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.probability(model.evidence(*model.passages(t or ""))) < limit for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
