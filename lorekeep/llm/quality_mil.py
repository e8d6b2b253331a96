"""Quality classifier by attention over passages (operator 8).

A document is a bag of passages, a passage a stretch of ``PASSAGE`` code points. Each passage becomes a vector: how
often kinds of characters follow one another, how long and how varied its words are. A layer encodes it; gated attention
(tanh times sigmoid) gives every passage a weight within its document; the weighted sum of the encoded passages is
scored. All weights are learnt together from document labels by gradient descent over a bounded sample of labelled
documents: at most ``rows`` of them, the first by a hash that together have at most ``BAGS`` passages. A document is in
the sample with all its passages. Scoring reads every passage of every text; long texts pass in slices of whole passages,
whose attention is joined as they come.

Defined results: a null text counts as empty, and an empty text is one passage of zeros; without labelled documents of
both kinds every score is the share of good ones (0 if there are none); repeated rows get equal scores; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lorekeep.llm.common import arrow_batches, held_out, labelled, table

ROWS, BAGS, PASSAGE = 6_000, 150_000, 600
HIDDEN, ATTENTION, ROUNDS, RATE, DECAY, SEED = 24, 12, 350, 0.02, 2e-3, 7
BLOCK = 1_200_000  # code points worked on at once, whole passages
THRESHOLD = 0.3

#: Kinds of characters: space, line end, lower, upper, digit, sentence end, comma, other mark, repeated mark, other letter.
SPACE, LINE, LOWER, UPPER, DIGIT, STOP, COMMA, MARK, LETTER = range(9)
KINDS = 9
ASCII = np.full(128, MARK, np.int64)
ASCII[[9, 11, 12, 13, 32]] = SPACE
ASCII[10] = LINE
ASCII[ord("a") : ord("z") + 1] = LOWER
ASCII[ord("A") : ord("Z") + 1] = UPPER
ASCII[ord("0") : ord("9") + 1] = DIGIT
ASCII[[ord(c) for c in ".!?"]] = STOP
ASCII[[ord(c) for c in ",;:'-\"()"]] = COMMA
EXTRA = 10
WIDTH = KINDS + KINDS * KINDS + EXTRA


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages, and the number of passages of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(1, -(-lengths // PASSAGE))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    first = np.cumsum(count) - count
    n = int(count.sum())
    if not len(points):
        return np.zeros((n, WIDTH)), count
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = first[doc] + place // PASSAGE
    kind = np.where(points < 128, ASCII[np.minimum(points, 127)], LETTER)
    size = np.bincount(at, minlength=n).astype(float)
    one = np.bincount(at * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS)
    same = at[1:] == at[:-1]
    two = np.bincount((at[:-1] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[same], minlength=n * KINDS * KINDS).reshape(n, KINDS * KINDS)
    per = 1 / np.maximum(size, 1)[:, None]

    # Words, as runs without white space inside a passage, by a hash of their characters.
    inside = kind > LINE
    begins = inside & np.r_[True, ~inside[:-1] | ~same]
    starts = np.flatnonzero(begins)
    extra = np.zeros((n, EXTRA))
    if len(starts):
        nth = np.cumsum(begins) - 1
        letters = np.flatnonzero(inside)
        owner = nth[letters]
        offset = (letters - starts[owner]).astype(np.uint64)
        mixed = (points[letters].astype(np.uint64) + np.uint64(1)) * (offset * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        mixed ^= mixed >> np.uint64(29)
        word = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), np.searchsorted(owner, np.arange(len(starts))))
        length = np.bincount(owner).astype(float)
        home = at[starts]
        words = np.bincount(home, minlength=n)
        order = np.lexsort((word, home))
        again = (home[order][1:] == home[order][:-1]) & (word[order][1:] == word[order][:-1])
        repeated = np.bincount(home[order][1:][again], minlength=n)
        share = 1 / np.maximum(words, 1)
        mean = np.bincount(home, length, n) * share
        extra[:, 0] = repeated * share
        extra[:, 1] = mean / 10
        extra[:, 2] = np.sqrt(np.maximum(np.bincount(home, length**2, n) * share - mean**2, 0)) / 10
        extra[:, 3] = np.bincount(home, length > 12, n) * share
        extra[:, 4] = np.bincount(home, length == 1, n) * share
        extra[:, 5] = np.log1p(words) / 6
        # Words whose last character is a mark, or that are marks alone.
        last = kind[np.flatnonzero(inside & np.r_[~inside[1:] | ~same, True])]
        extra[:, 6] = np.bincount(home, (length == 1) & (kind[starts] == MARK), n) * share
        extra[:, 7] = np.bincount(home, last == MARK, n) * share
        extra[:, 8] = np.bincount(home, kind[starts] == UPPER, n) * share
    extra[:, 9] = size / PASSAGE
    return np.concatenate([one * per, 4 * two * per, extra], 1), count


@dataclass
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    constant: float | None = None

    def scores(self, texts: list[str]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        out: list[float] = []
        for texts_at_once in _blocks(texts):
            if len(texts_at_once) == 1 and len(texts_at_once[0]) > BLOCK:
                out.append(self._long(texts_at_once[0]))
                continue
            x, count = passages(texts_at_once)
            p, _ = _forward(self.weights, (x - self.middle) / self.spread, np.cumsum(count) - count, count)
            out += p.tolist()
        return out

    def _long(self, text: str) -> float:
        """The score of one text, slice by slice: sums relative to the largest attention so far."""
        top, mass, z = -np.inf, 0.0, 0.0
        for at in range(0, len(text), BLOCK):
            x, _ = passages([text[at : at + BLOCK]])
            h, e = _attention(self.weights, (x - self.middle) / self.spread)[:2]
            higher = max(top, float(e.max()))
            share = np.exp(e - higher)
            scale = np.exp(top - higher)
            mass, z, top = mass * scale + share.sum(), z * scale + share @ h, higher
        return float(_sigmoid(z / mass @ self.weights[5] + self.weights[6][0]))


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in turn, together up to ``BLOCK`` code points; a longer one by itself."""
    block, held = [], 0
    for text in texts:
        if block and held + len(text) > BLOCK:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text)
    if block:
        yield block


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _attention(w: list[np.ndarray], x: np.ndarray):
    """Encoded passages, their attention before it is set in proportion, and the two gates."""
    enc, enc_b, gate_t, gate_s, att = w[:5]
    h = np.tanh(x @ enc + enc_b)
    t, s = np.tanh(h @ gate_t), _sigmoid(h @ gate_s)
    return h, (t * s) @ att, t, s


def _forward(w: list[np.ndarray], x: np.ndarray, first: np.ndarray, count: np.ndarray):
    h, e, t, s = _attention(w, x)
    out, out_b = w[5:]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
    a = e / np.repeat(np.add.reduceat(e, first), count)
    z = np.add.reduceat(h * a[:, None], first)
    return _sigmoid(z @ out + out_b[0]), (h, t, s, a, z)


def train(x: np.ndarray, count: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Adam over all bags at once; gradients of the mean log loss written out."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    shapes = [(d, HIDDEN), (HIDDEN,), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION), (ATTENTION,), (HIDDEN,), (1,)]
    w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s[0] in (ATTENTION, HIDDEN) else np.zeros(s) for s in shapes]
    w[1] = np.zeros(HIDDEN)
    m, v = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w]
    first = np.cumsum(count) - count
    for step in range(1, ROUNDS + 1):
        p, (h, t, s, a, z) = _forward(w, x, first, count)
        dz0 = (p - y) / len(y)
        dz = np.repeat(dz0[:, None] * w[5], count, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        dt, ds = de[:, None] * w[4] * s * (1 - t * t), de[:, None] * w[4] * t * s * (1 - s)
        dh = (dz * a[:, None] + dt @ w[2].T + ds @ w[3].T) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ dz0, np.array([dz0.sum()])]
        for k, g in enumerate(grads):
            g = g + (DECAY * w[k] if w[k].ndim > 1 or k == 5 else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bags: int = BAGS, label: str = "quality") -> Model:
    """Passages are encoded where the texts are; the vectors of at most ``rows`` documents and ``bags`` passages reach the driver."""
    arrow_batches(docs.sparkSession)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text, y in zip(batch.doc_id, batch.text, batch.y):
                x = np.concatenate([passages([text[at : at + BLOCK]])[0] for at in range(0, max(len(text), 1), BLOCK)])
                yield pd.DataFrame({"doc_id": [doc_id], "y": [y], "n": [len(x)], "x": [x.astype("<f4").tobytes()]})

    sample = labelled(docs, labels, label, rows).select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y"))
    # The sample has a bounded number of rows, so its running total may pass one task.
    so_far = F.sum(F.greatest(F.ceil(F.length("text") / PASSAGE), F.lit(1))).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = sample.select("doc_id", so_far.alias("bags")).where(F.col("bags") <= bags).select("doc_id")
    got = sample.join(chosen, "doc_id").mapInPandas(encoded, "doc_id long, y int, n int, x binary").toPandas().sort_values("doc_id")
    y = got.y.to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), [], float(y.mean()) if len(y) else 0.0)
    x = np.frombuffer(b"".join(got.x), "<f4").reshape(-1, WIDTH).astype(float)
    middle, spread = x.mean(0), x.std(0) + 0.01
    return Model(middle, spread, train((x - middle) / spread, got.n.to_numpy(), y))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score) of every document."""
    arrow_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(task, "doc_id long, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
