"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(t_k - w . x) with thresholds t_1 < t_2 < ...  and one weight vector for all grades.
x are hashed features of the whole text, as frequencies: lower-cased words, trigrams of character
classes, and one-hot buckets of length and repetition.  So w . x is a mean of per-token weights, which scoring
gets by table lookups.  The outputs are the expected grade and tail probabilities for selection.

Fitting takes at most `MAX_LABELLED` rated rows (those whose hashed doc_id is least) and L-BFGS with a ridge,
on features of whole texts.  Grades are any integers; with one grade, or none, all texts get that grade (or null).

Null and empty texts have the buckets of an empty text and a score like any other.  Null ratings are not
learnt from; several ratings of a document count as their greatest, and of several texts of one doc_id the one of least hash is
learnt from.  A row per row is returned with all other columns as they are, whatever their names; only columns that have the
results' own names are replaced, and kept_documents replaces none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from quillon.llm import textkit as tk
from quillon.llm.frames import beside, joined, rows_of
from quillon.llm.toxicity import labelled_texts

MAX_LABELLED = 6000
WORD_BITS = 16
RIDGE = 1e-3

#: Character classes: letters by case, digits, spaces, line ends, some marks of their own, other marks, beyond ASCII.
_CLASS = np.full(256, 15, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 0
for _k, _marks in enumerate((b" \t", b"\n\r", b".", b",", b"!", b"?", b"|", b"#%&*$@~^", b"<>{}[]()", b"-_=+/\\", b"'\""), 3):
    _CLASS[list(_marks)] = _k
SHAPES = 16**3
BUCKETS = 12
KINDS = 4
WORDS_AT, BUCKETS_AT = SHAPES, SHAPES + (1 << WORD_BITS)
WIDTH = BUCKETS_AT + KINDS * BUCKETS


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shape features and word features with their documents' offsets, and the buckets of each document (n x KINDS)."""
    c = _CLASS[buf].astype(np.int32)
    shape = c[:-2] * 256 + c[1:-1] * 16 + c[2:] if len(c) > 2 else np.zeros(0, np.int32)
    size = np.diff(off)
    inside = np.repeat(off[1:], size)[: len(shape)] >= np.arange(len(shape)) + 3
    shape = shape[inside]
    shape_at = np.concatenate([[0], np.cumsum(np.maximum(size - 2, 0))])
    h, at = tk.words(buf, off)
    word = (h >> np.uint64(64 - WORD_BITS)).astype(np.int32) + WORDS_AT
    n = np.diff(at)
    again = np.zeros(len(h))
    again[1:] = h[1:] == h[:-1]
    again[at[:-1][n > 0]] = 0
    distinct = np.array([len(np.unique(h[s:e])) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], float)
    upper = tk.segment_sums((c == 1).astype(float), off) / np.maximum(size, 1)
    level = lambda x: np.clip((x * BUCKETS).astype(int), 0, BUCKETS - 1)
    buckets = np.stack(
        [
            np.clip(np.log2(n + 1).astype(int), 0, BUCKETS - 1),
            level(tk.segment_sums(again, at) / np.maximum(n, 1)),
            level(distinct / np.maximum(n, 1)),
            level(upper),
        ],
        axis=1,
    )
    return shape, shape_at, word, at, buckets + np.arange(KINDS) * BUCKETS + BUCKETS_AT


def linear(weights: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """w . x of every document of a block."""
    shape, shape_at, word, at, buckets = features(buf, off)
    means = [tk.segment_sums(weights[f].astype(float), a) / np.maximum(np.diff(a), 1) for f, a in ((shape, shape_at), (word, at))]
    return means[0] + means[1] + weights[buckets].sum(axis=1)


def sparse(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of x for every document of a block."""
    shape, shape_at, word, at, buckets = features(buf, off)
    out = []
    for d in range(len(off) - 1):
        parts, values = [], []
        for f, a in ((shape, shape_at), (word, at)):
            place, count = np.unique(f[a[d] : a[d + 1]], return_counts=True)
            parts.append(place)
            values.append(count / max(1, a[d + 1] - a[d]))
        out.append((np.concatenate([*parts, buckets[d]]).astype(np.int32), np.concatenate([*values, np.ones(KINDS)]).astype(np.float32)))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Objective:
    """Mean negative log-likelihood with a ridge, in scaled weights; parameters: weights, first threshold, logarithms of the gaps."""

    def __init__(self, indptr: np.ndarray, places: np.ndarray, values: np.ndarray, y: np.ndarray, grades: int, ridge: float):
        self.rows, self.places, self.y, self.grades, self.ridge = len(y), places, y, grades, ridge
        self.row = np.repeat(np.arange(self.rows), np.diff(indptr))
        square = np.bincount(places, values.astype(float) ** 2, WIDTH) / max(1, self.rows)
        self.scale = 1 / np.sqrt(square + 1e-5)
        self.values = values * self.scale[places]

    def thresholds(self, p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[WIDTH : WIDTH + 1], np.exp(p[WIDTH + 1 :])]))

    def __call__(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = p[:WIDTH], self.thresholds(p)
        eta = np.bincount(self.row, self.values * w[self.places], self.rows)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        high, low = sigmoid(edge[self.y + 1] - eta), sigmoid(edge[self.y] - eta)
        prob = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / prob, low * (1 - low) / prob
        g_eta = (dh - dl) / self.rows
        g_w = np.bincount(self.places, self.values * g_eta[self.row], WIDTH) + self.ridge * w
        g_edge = np.bincount(self.y + 1, -dh, self.grades + 1) + np.bincount(self.y, dl, self.grades + 1)
        g_t = g_edge[1 : self.grades] / self.rows
        after = np.cumsum(g_t[::-1])[::-1]
        g_p = np.concatenate([after[:1], after[1:] * np.exp(p[WIDTH + 1 :])])
        return float(-np.log(prob).mean() + 0.5 * self.ridge * (w @ w)), np.concatenate([g_w, g_p])


def minimised(f: Objective, x: np.ndarray, steps: int = 120, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, a = g.copy(), []
        for s, y in reversed(past):
            a.append(s @ q / (y @ s))
            q -= a[-1] * y
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), k in zip(past, reversed(a), strict=True):
            q += s * (k - y @ q / (y @ s))
        step, slope = (1.0 if past else min(1.0, 1 / np.abs(g).sum())), -(g @ q)
        if slope >= -1e-12:
            break
        for _ in range(30):
            new, new_g = f(x - step * q)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_g - g
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, g = x + s, new, new_g
        if y @ s > 1e-12:
            past = [*past, (s, y)][-memory:]
        if done:
            break
    return x


@dataclass
class Model:
    grades: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the least), a column each."""
        return sigmoid(linear(self.weights, buf, off)[:, None] - self.thresholds[None, :])


def fit(docs: DataFrame, ratings: DataFrame, limit: int = MAX_LABELLED, rating: str = "quality") -> Model:
    """ratings: doc_id and an integer grade."""
    rows = labelled_texts(docs, ratings, rating, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tk.blocks(batch.column("text")):
                x = sparse(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([p for p, _ in x], pa.list_(pa.int32())), pa.array([v for _, v in x], pa.list_(pa.float32()))],
                    names=["doc_id", "label", "places", "vals"],
                )

    # At most `limit` rows and the distinct features of each; sorted, so that sums are the same each time.
    got = rows.select("doc_id", F.col("label").cast("long").alias("label"), "text").mapInArrow(run, "doc_id long, label long, places array<int>, vals array<float>")
    got = got.orderBy("doc_id").toArrow().combine_chunks()
    label = got.column("label").to_numpy()
    grades, y = np.unique(label, return_inverse=True)
    if len(grades) < 2:
        return Model(grades, np.zeros(WIDTH), np.zeros(0))
    places = got.column("places").combine_chunks()
    f = Objective(places.offsets.to_numpy(), places.flatten().to_numpy(), got.column("vals").combine_chunks().flatten().to_numpy(), y, len(grades), RIDGE)
    share = np.clip(np.cumsum(np.bincount(y)) / len(y), 1e-6, 1 - 1e-6)[:-1]
    t = np.log(share / (1 - share))
    p = minimised(f, np.concatenate([np.zeros(WIDTH), t[:1], np.log(np.maximum(np.diff(t), 1e-3))]))
    return Model(grades, p[:WIDTH] * f.scale, f.thresholds(p))


def _graded(docs: DataFrame, model: Model, grade: str, tails: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights

    def kernel(texts: pa.Array) -> list[pa.Array]:
        m = sent.value
        t = np.concatenate([m.tails(buf, off) for _, _, buf, off in tk.blocks(texts)] or [np.zeros((0, len(m.thresholds)))])
        expected = m.grades[0] + t @ np.diff(m.grades) if len(m.grades) else np.full(len(t), np.nan)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * t.shape[1]), pa.array(t.ravel()))
        return [pa.array(expected.astype(float), from_pandas=True), listed]

    return beside(docs, kernel, [StructField(grade, DoubleType()), StructField(tails, ArrayType(DoubleType()))])


def graded(docs: DataFrame, model: Model, grade: str = "expected_grade", tails: str = "tails") -> DataFrame:
    """The columns of docs and, by the given names, the expected grade and P(grade >= g) for every grade g but the least."""
    return joined(_graded(docs, model, grade, tails), docs)


def selected(model: Model, target: int, threshold: float = 0.5, tails: str = "tails") -> Column:
    """Whether P(grade >= target) reaches the threshold; where no grade lies below the target, all are."""
    below = int((model.grades < target).sum())
    if below == 0:
        return F.lit(True)
    if below == len(model.grades):
        return F.lit(False)
    return F.col(tails)[below - 1] >= threshold


def kept_documents(docs: DataFrame, ratings: DataFrame, target: int = 1, threshold: float = 0.5) -> DataFrame:
    """The selected documents, with their own columns and values."""
    model = fit(docs, ratings)
    return rows_of(_graded(docs, model, "grade", "tails").where(selected(model, target, threshold)), docs)
