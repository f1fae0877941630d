"""Toxicity by class-conditional Kneser-Ney models.

Models of lower-cased words, toxic and ordinary, with interpolated absolute discounting:

    class bigram -> class continuation counts -> continuation counts shared by both classes -> uniform

so an expression rarer than the discount gets nearly the same probability from both, and their ratio says nothing
about it.  Models of one word take the class continuation counts as they are.  The score compares length-normalised
log-likelihoods of the two classes: of the whole text (S / (n + 1)^a, S the difference over its n words), or of its most toxic
passage of k words (the greatest S / k of all passages; a shorter text is one passage).  A passage is PASSAGES words at least.  The order,
the discount, what is compared and a logistic map to a probability are those of least log-loss on texts that the models did not
see (four folds).  Whole texts stand among the choices; README has what they reach.

Bigrams that occur once in all are left to the backoff.  Learning uses at most `MAX_LABELLED` labelled documents (those
whose hashed doc_id is least, one text of each), so the model's size is bounded; statistics of those rows are of whole texts.
They are added up by Spark; the driver gets words, contexts and repeated bigrams, not texts.

Null, empty and word-less texts get the probability of no evidence.  Rows without a label, and null labels, are not learnt from.
With one class or no labels at all the score is the smoothed share of toxic labels.  Repeated labels of a document
count as their greatest; of several texts of one doc_id the one of least hash is learnt from.  Scoring returns a row per row with all
other columns as they are, whatever their names; only a column that has the result's own name is replaced, and kept_documents replaces none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from quillon.llm import textkit as tk
from quillon.llm.frames import beside, forget, joined, keep, rows_of

#: At most so many labelled documents are learnt from.
MAX_LABELLED = 4000
FOLDS = 4
#: Absolute discounts that are tried, where they exceed the usual estimate.
DISCOUNTS = (1.0, 2.0, 4.0, 8.0)
#: Words of an n-gram.
ORDERS = (1, 2)
PASSAGES = (4, 8, 16)
#: What is compared: whole texts by exponent of the length, passages by words.
EVIDENCE = (("whole", 0.5), ("whole", 1.0), *(("passage", k) for k in PASSAGES))
_START = np.uint64(0x5A5A5A5A5A5A5A5A)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their contexts (the word before, or a start mark) and the index of each document's first word."""
    w, at = tk.words(buf, off)
    before = np.concatenate([[_START], w]).astype(np.uint64)[: len(w)]
    before[at[:-1][np.diff(at) > 0]] = _START
    return w, before, at


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tk.mix(context * _PAIR + word)


def discount(once: int, twice: int) -> float:
    """The usual estimate from how many types occur once and twice."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


@dataclass
class Counts:
    """Counts by class, each n x 2: of bigrams seen twice at least, of contexts and of words (continuation types, and pooled ones)."""

    bigram: np.ndarray
    bigram_context: np.ndarray
    bigram_word: np.ndarray
    bigram_n: np.ndarray
    context: np.ndarray
    context_n: np.ndarray
    word: np.ndarray
    word_types: np.ndarray
    word_pooled: np.ndarray
    seen: np.ndarray  # by class: how many bigrams occur once, and twice

    def discounts(self) -> np.ndarray:
        return np.array([discount(*map(int, self.seen[k])) for k in (0, 1)])


class Smoothed:
    """Probabilities by class (ordinary, toxic), each n x 2, for one order and least absolute discount.

    P(word) = word_p, or unknown_p of one unknown word; P(word | context) = bigram_p of a held bigram, else weight of the context times P(word).
    """

    def __init__(self, c: Counts, order: int, least: float):
        pooled = c.word_pooled.astype(float)
        all_pooled = max(1.0, pooled.sum())
        d0 = discount(int((pooled == 1).sum()), int((pooled == 2).sum()))
        spare = d0 * len(pooled) / all_pooled if len(pooled) else 1.0
        shared = np.maximum(pooled - d0, 0) / all_pooled + spare / (len(pooled) + 1)
        types = c.word_types.astype(float)
        kept, back = np.zeros((len(shared), 2)), np.ones(2)
        for k in (0, 1):
            d = max(least, discount(int((types[:, k] == 1).sum()), int((types[:, k] == 2).sum())))
            kept[:, k] = np.maximum(types[:, k] - d, 0) / max(1.0, types[:, k].sum())
            back[k] = 1 - kept[:, k].sum()
        self.word, self.word_p, self.word_kept = c.word, kept + back * shared[:, None], kept.any(axis=1)
        self.unknown_p = back * spare / (len(pooled) + 1)
        self.order = order
        if order > 1:
            # What discounts and pruned bigrams had goes to the backoff, so every context sums to one.
            by = np.argsort(c.context)
            at = by[np.searchsorted(c.context, c.bigram_context, sorter=by)] if len(by) else np.zeros(0, np.int64)
            over = np.maximum(c.bigram_n - np.maximum(c.discounts(), least), 0)
            held = np.zeros(c.context_n.shape)
            np.add.at(held, at, over)
            self.context, self.weight = c.context, 1 - held / np.maximum(c.context_n, 1)
            of_word = np.argsort(c.word)
            low = self.word_p[of_word[np.searchsorted(c.word, c.bigram_word, sorter=of_word)]] if len(of_word) else np.zeros((0, 2))
            self.bigram, self.bigram_p, self.bigram_kept = c.bigram, over / np.maximum(c.context_n[at], 1) + self.weight[at] * low, over.any(axis=1)


class Ratios:
    """log P(word | context, toxic) - log P(word | context, ordinary), a column for each order and least discount.

    Words, contexts and bigrams that all discounts leave to backoff have the ratio of unknown ones and are not held.
    """

    def __init__(self, c: Counts, choices: list[tuple[int, float]]):
        ratio = lambda p: np.log(p[..., 1] / p[..., 0])
        words, unknown, contexts, bigrams = [], [], [], []
        some_words, some_contexts, some_bigrams = (np.zeros(len(x), bool) for x in (c.word, c.context, c.bigram))
        for order, least in choices:
            s = Smoothed(c, order, least)
            words.append(ratio(s.word_p))
            unknown.append(float(ratio(s.unknown_p)))
            some_words |= s.word_kept
            if order > 1:
                contexts.append(ratio(s.weight))
                bigrams.append(ratio(s.bigram_p))
                some_contexts |= (s.weight < 1).any(axis=1)
                some_bigrams |= s.bigram_kept
        held = lambda keys, some, columns: (tk.HashTable(keys[some]), np.stack([x[some] for x in columns], axis=1))
        self.words, self.word_ratio = held(c.word, some_words, words)
        self.unknown_ratio = np.array(unknown)
        self.long = np.array([order > 1 for order, _ in choices])
        if self.long.any():
            self.contexts, self.context_ratio = held(c.context, some_contexts, contexts)
            self.bigrams, self.bigram_ratio = held(c.bigram, some_bigrams, bigrams)

    def of(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """A row for each word, a column for each choice."""
        w = self.words.find(word)
        out = np.tile(self.unknown_ratio, (len(word), 1))
        out[w >= 0] = self.word_ratio[w[w >= 0]]
        if self.long.any():
            low = out[:, self.long]
            h, b = self.contexts.find(context), self.bigrams.find(pair(context, word))
            low[h >= 0] += self.context_ratio[h[h >= 0]]
            low[b >= 0] = self.bigram_ratio[b[b >= 0]]
            out[:, self.long] = low
        return out


#: Orders and discounts that are tried.
CHOICES = [(order, least) for order in ORDERS for least in DISCOUNTS]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias first) of a one-feature logistic regression by Newton's method."""
    a = np.stack([np.ones(len(x)), x], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(w[0] + w[1] * x, -30, 30)
    return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))


@dataclass
class Model:
    ratios: Ratios | None  # of one choice
    kind: tuple[str, float]
    bias: float
    slope: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = evidence(self.ratios, buf, off, (self.kind,))[:, 0, 0] if self.ratios else np.zeros(len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * x, -30, 30)))


def evidence(ratios: Ratios, buf: np.ndarray, off: np.ndarray, kinds: tuple[tuple[str, float], ...] = EVIDENCE) -> np.ndarray:
    """documents x choices x kinds; 0 for texts without words."""
    word, context, at = tokens(buf, off)
    size = np.diff(at)
    full = size > 0
    total = np.zeros((len(word) + 1, len(ratios.unknown_ratio)))
    np.cumsum(ratios.of(word, context), axis=0, out=total[1:])
    out = np.zeros((len(size), total.shape[1], len(kinds)))
    place, end = np.arange(len(word)), np.repeat(at[1:], size)
    for j, (kind, k) in enumerate(kinds):
        if kind == "whole":
            out[:, :, j] = (total[at[1:]] - total[at[:-1]]) / (size[:, None] + 1.0) ** k
        elif full.any():
            passage = (total[np.minimum(place + int(k), end)] - total[place]) / k
            out[full, :, j] = np.maximum.reduceat(passage, at[:-1][full], axis=0)
    return out


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The choice, the kind of evidence and the weights of least log-loss; of equal ones the first. x: evidence on unseen texts, rows x choices x kinds."""
    tried = [(log_loss(x[:, c, j], y, w), c, j, w) for c in range(x.shape[1]) for j in range(x.shape[2]) for w in [logistic(x[:, c, j], y)]]
    return min(tried, key=lambda t: t[:3])[1:]


def constant(ones: int, rows: int) -> Model:
    """Where there is one class or none: the smoothed share of toxic labels."""
    rate = (ones + 0.5) / (rows + 1)
    return Model(None, EVIDENCE[0], float(np.log(rate / (1 - rate))), 0.0)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fold, label, text) -> counts of (context, word) by fold and label, added up within a block."""
    for batch in batches:
        group = (batch.column("fold").to_numpy() * 2 + batch.column("label").to_numpy()).astype(np.uint64)
        for lo, hi, buf, off in tk.blocks(batch.column("text")):
            word, context, at = tokens(buf, off)
            own = group[lo:hi][tk.owners(at)]
            order = np.argsort(pair(context, word) * np.uint64(8) + own, kind="stable")
            word, context, own = word[order], context[order], own[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (own[1:] != own[:-1])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(context[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array((own[first]).astype(np.int32)), pa.array(np.diff(np.append(first, len(word))))],
                names=["context", "word", "cell", "n"],
            )
    tk.trim()


def _column(rows: "pa.Table", name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


#: The folds that are left out, and none.
LEFT_OUT = (*range(FOLDS), None)


#: Kinds of rows that _added gives out.
BIGRAM, CONTEXT, WORD, SEEN = range(4)
ADDED = "kind int, a long, b long, n array<int>"


def _by_class(n: np.ndarray, fold: int | None) -> np.ndarray:
    """Sums over folds but one, n x 2, of n x cells."""
    return sum(n[:, 2 * f : 2 * f + 2] for f in range(FOLDS) if f != fold)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All cells of some bigrams -> repeated ones with their counts, contexts with theirs, words with numbers of contexts (by fold left out: of both classes and of either), and how many bigrams occur once and twice."""
    table = pa.Table.from_batches(batches, pa.schema([("context", pa.int64()), ("word", pa.int64()), ("cell", pa.int32()), ("n", pa.int64())]))
    context, word = (_column(table, c).view(np.uint64) for c in ("context", "word"))
    _, first, place = np.unique(pair(context, word), return_index=True, return_inverse=True)
    n = np.zeros((len(first), 2 * FOLDS), np.int32)
    np.add.at(n, (place, _column(table, "cell")), _column(table, "n").astype(np.int32))
    context, word = context[first], word[first]
    del table, place, first

    def rows(kind: int, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 50_000):
            v = np.ascontiguousarray(values[k : k + 50_000], np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
            cols = [pa.array(np.full(len(v), kind, np.int32)), *(pa.array(np.ascontiguousarray(x[k : k + 50_000]).view(np.int64)) for x in (a, b)), listed]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "a", "b", "n"])

    twice = n.sum(axis=1) > 1
    yield from rows(BIGRAM, context[twice], word[twice], n[twice])
    keys, at = np.unique(context, return_inverse=True)
    yield from rows(CONTEXT, keys, keys, np.stack([np.bincount(at, x, len(keys)) for x in n.T], axis=1) if len(keys) else np.zeros((0, 1)))
    keys, at = np.unique(word, return_inverse=True)
    by = [_by_class(n, f) for f in LEFT_OUT]
    types = [np.bincount(at, x > 0, len(keys)) for c in by for x in (c.any(axis=1), c[:, 0], c[:, 1])]
    yield from rows(WORD, keys, keys, np.stack(types, axis=1))
    seen = np.array([[(c[:, k] == j).sum() for c in by for k in (0, 1) for j in (1, 2)]])
    yield from rows(SEEN, np.zeros(1, np.uint64), np.zeros(1, np.uint64), seen)
    tk.trim()


class Gathered:
    """Counts of the bounded sample by fold and label, from rows (context, word, cell, n): added up in tasks, and only what models hold is collected."""

    TASKS = 6

    def __init__(self, cells: "DataFrame | pa.Table"):
        if isinstance(cells, pa.Table):
            cells = SparkSession.active().createDataFrame(cells)
        cells = cells.select("context", "word", F.col("cell").cast("int"), F.col("n").cast("long"))
        added = keep(cells.repartition(self.TASKS, "context", "word").mapInArrow(_added, ADDED), "toxicity-counts")

        def part(k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = added.where(F.col("kind") == k).select("a", "b", "n").toArrow()  # of the sample only
            n = own.column("n").combine_chunks().flatten().to_numpy() if len(own) else np.zeros(0, np.int32)
            return _column(own, "a").view(np.uint64), _column(own, "b").view(np.uint64), n.reshape(len(own), width)

        def summed(k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
            """Keys, and the sums of what tasks have of them."""
            key, _, n = part(k, width)
            keys, place = np.unique(key, return_inverse=True)
            total = np.zeros((len(keys), width), np.int32)
            np.add.at(total, place, n)
            return keys, total

        self.context, self.word, self.n = part(BIGRAM, 2 * FOLDS)
        self.contexts, self.context_n = summed(CONTEXT, 2 * FOLDS)
        self.words, self.types = summed(WORD, 3 * len(LEFT_OUT))
        self.seen = part(SEEN, 4 * len(LEFT_OUT))[2].sum(axis=0).reshape(len(LEFT_OUT), 2, 2)
        forget(added)

    def without(self, fold: int | None) -> Counts:
        v = LEFT_OUT.index(fold)
        n, context_n = _by_class(self.n, fold), _by_class(self.context_n, fold)
        two = n.sum(axis=1) > 1
        context, word = self.context[two], self.word[two]
        pooled, types = self.types[:, 3 * v], self.types[:, 3 * v + 1 : 3 * v + 3]
        used_w, used_c = pooled > 0, context_n.any(axis=1)
        return Counts(
            pair(context, word), context, word, n[two].astype(float),
            self.contexts[used_c], context_n[used_c].astype(float),
            self.words[used_w], types[used_w].astype(float), pooled[used_w].astype(float), self.seen[v],
        )


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most `limit` rows (doc_id, label, text) with a label, of the doc_ids of least hash; one text of each."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most `limit` ids
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, label: str = "toxic") -> Model:
    """labels: doc_id and a 0/1 label; only its rows are learnt from."""
    rows = labelled_texts(docs, labels, label, limit).select(
        "doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), (F.col("label") > 0).cast("int").alias("label"), "text"
    )
    rows = keep(rows, "labelled")
    tally = rows.agg(F.count_if(F.col("label") == 1).alias("ones"), F.count("*").alias("all")).first()
    if not 0 < tally["ones"] < tally["all"]:
        forget(rows)
        return constant(tally["ones"], tally["all"])
    gathered = Gathered(rows.mapInArrow(_bigrams, "context long, word long, cell int, n long"))
    x, y = [], []
    for f in range(FOLDS):  # one model at a time is sent
        sent = rows.sparkSession.sparkContext.broadcast(Ratios(gathered.without(f), CHOICES))
        # At most `limit` rows; sorted, so that sums are the same each time.
        got = rows.where(F.col("fold") == f).mapInArrow(_unseen(sent), "doc_id long, label int, x array<double>").orderBy("doc_id").toArrow()
        sent.destroy()
        x.append(got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(CHOICES), len(EVIDENCE)))
        y.append(_column(got, "label").astype(float))
    forget(rows)
    choice, kind, w = calibrated(np.concatenate(x), np.concatenate(y))
    return Model(Ratios(gathered.without(None), [CHOICES[choice]]), EVIDENCE[kind], float(w[0]), float(w[1]))


def _unseen(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in tk.blocks(batch.column("text"), tk.BLOCK // 8):  # a column for each choice
                x = evidence(sent.value, buf, off).reshape(hi - lo, -1)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), listed], names=["doc_id", "label", "x"])
        tk.trim()

    return run


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LABELLED texts

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.concatenate([sent.value.scores(buf, off) for _, _, buf, off in tk.blocks(texts)] or [np.zeros(0)]))]

    return beside(docs, kernel, [StructField(name, DoubleType())])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of docs and, by the given name, the probability that a text is toxic."""
    return joined(_scored(docs, model, name), docs)


def is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents whose score is below the threshold, with their own columns and values."""
    return rows_of(_scored(docs, fit(docs, labels), "score").where(F.col("score") < threshold), docs)
