"""Trained models against plain versions of them."""

import itertools
import math
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import license, quality, toxicity
from quillon.llm import textkit as tk
from tests.llm.test_kernels import random_texts, words
from tests.llm.test_operators import documents


class PlainKneserNey:
    """The toxicity models of one order and least discount, with dictionaries."""

    def __init__(self, texts, labels, order, least):
        n = [Counter(), Counter()]
        for t, y in zip(texts, labels):
            w = words(t)
            n[y].update(zip([None, *w], w))
        self.order = order
        every = set(n[0]) | set(n[1])
        pooled = Counter(w for _, w in every)
        ones, twos = (sum(c == k for c in pooled.values()) for k in (1, 2))
        d0, total = toxicity.discount(ones, twos), sum(pooled.values())
        spare = d0 * len(pooled) / total
        self.unknown = spare / (len(pooled) + 1)
        self.shared = {w: max(c - d0, 0) / total + self.unknown for w, c in pooled.items()}
        self.types = [Counter(w for _, w in n[k]) for k in (0, 1)]
        self.d1 = [max(least, toxicity.discount(*(sum(c == j for c in self.types[k].values()) for j in (1, 2)))) for k in (0, 1)]
        self.all_types = [max(1, sum(self.types[k].values())) for k in (0, 1)]
        self.back = [1 - sum(max(c - self.d1[k], 0) for c in self.types[k].values()) / self.all_types[k] for k in (0, 1)]
        d2 = [max(least, toxicity.discount(*(sum(c == j for c in n[k].values()) for j in (1, 2)))) for k in (0, 1)]
        self.over = [{g: max(c - d2[k], 0) for g, c in n[k].items() if n[0][g] + n[1][g] > 1} for k in (0, 1)]
        self.context = [Counter(), Counter()]
        self.held = [defaultdict(float), defaultdict(float)]
        for k in (0, 1):
            for (h, _), c in n[k].items():
                self.context[k][h] += c
            for (h, _), c in self.over[k].items():
                self.held[k][h] += c

    def p(self, k, h, w):
        low = max(self.types[k][w] - self.d1[k], 0) / self.all_types[k] + self.back[k] * self.shared.get(w, self.unknown)
        if self.order == 1 or not self.context[k][h]:
            return low
        return self.over[k].get((h, w), 0) / self.context[k][h] + (1 - self.held[k][h] / self.context[k][h]) * low


@pytest.fixture(scope="module")
def sample(spark):
    texts = [t + " vile rotten" * (k % 3) for k, t in enumerate(random_texts(120, 31, 25))]
    labels = [int(k % 3 > 0) for k in range(len(texts))]
    rows = documents(spark, texts).selectExpr("doc_id", "cast(pmod(doc_id, 4) as int) as fold", "cast(doc_id % 3 > 0 as int) as label", "text")
    return texts, labels, toxicity.Gathered(rows.mapInArrow(toxicity._bigrams, "context long, word long, cell int, n long"))


@pytest.mark.parametrize("fold,order,least", [(None, 1, 1.0), (None, 2, 1.0), (2, 2, 2.0), (0, 1, 4.0), (1, 2, 0.0)])
def test_toxicity_models_equal_plain_ones(sample, fold, order, least):
    texts, labels, gathered = sample
    own = [(t, y) for k, (t, y) in enumerate(zip(texts, labels)) if k % 4 != fold]
    plain = PlainKneserNey(*zip(*own), order, least)
    ratios = toxicity.Ratios(gathered.without(fold), [(order, least)])
    tried = [*texts, "words nobody saw", "vile nobody", " ".join(reversed(words(texts[5])))]
    for t in tried:
        w = words(t)
        want = [math.log(plain.p(1, h, x) / plain.p(0, h, x)) for h, x in zip([None, *w], w)]
        buf, off = tk.column_bytes(pa.array([t]))
        got = ratios.of(*toxicity.tokens(buf, off)[:2])[:, 0]
        assert np.allclose(got, want, atol=1e-6, rtol=0)
        s = np.concatenate([[0], np.cumsum(want)])
        n = len(w)
        for (kind, k), x in zip(toxicity.EVIDENCE, toxicity.evidence(ratios, buf, off)[0, 0]):
            score = s[-1] / (n + 1) ** k if kind == "whole" else max(((s[min(i + k, n)] - s[i]) / k for i in range(n)), default=0.0)
            assert abs(x - score) < 1e-6


def test_toxicity_probabilities_sum_to_one(sample):
    texts, labels, gathered = sample
    for order, least in itertools.product((1, 2), (0.0, 1.0, 4.0)):
        s = toxicity.Smoothed(gathered.without(None), order, least)
        assert np.allclose(s.word_p.sum(axis=0) + s.unknown_p, 1)
        plain = PlainKneserNey(texts, labels, order, least)
        for k, h in itertools.product((0, 1), (None, "vile", words(texts[3])[2], "nobody")):
            assert abs(sum(plain.p(k, h, w) for w in plain.shared) + plain.p(k, h, "\0") - 1) < 1e-9
        if order == 2:  # and the arrays, by context
            of = {x: i for i, x in enumerate(s.word.tolist())}
            counts = gathered.without(None)
            low, held = defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2))
            kept = dict(zip(s.bigram.tolist(), s.bigram_p))
            for h, w in zip(counts.bigram_context.tolist(), counts.bigram_word.tolist()):
                p = kept.get(int(toxicity.pair(np.array([h], np.uint64), np.array([w], np.uint64))[0]))
                if p is not None:
                    low[h] += s.word_p[of[w]]
                    held[h] += p
            for h, weight in zip(s.context.tolist(), s.weight):
                assert np.allclose(held[h] + weight * (1 - low[h]), 1)


def test_toxicity_scores_of_held_out_passages(spark):
    texts = [t + (" vile rotten scum" if k % 4 == 0 else "") + " " + t for k, t in enumerate(random_texts(400, 32, 60))]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    docs = documents(spark, texts)
    model = toxicity.fit(docs, labels)
    assert model.kind in toxicity.EVIDENCE and (model.kind[0] == "whole" or model.kind[1] >= 4)
    rows = toxicity.scored(docs, model).where("doc_id >= 300").collect()
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rows) >= 95


def test_toxicity_of_texts_without_words(spark):
    docs = documents(spark, ["", None, "  ", "\n", "a word", ""])
    for which in ("true", "doc_id <> 4"):
        labels = spark.range(6).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").where(which)
        scores = [r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()]
        assert len(scores) == 6 and all(0 < s < 1 for s in scores)


def plain_grams(text):
    w = "".join(c.lower() if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text).split()
    return {tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}, w


def test_licences_equal_a_plain_classifier(spark):
    background = random_texts(150, 33, 50)
    model = license.train(background)
    place = {}
    for k, texts in itertools.chain(license.TEMPLATES.items(), license.TITLES.items()):
        for t in texts:
            for g in plain_grams(t)[0]:
                place[g] = int(model.table.find(license.gram_sets([" ".join(g)])[0]).max()) if len(g) == 1 else None
    hashed = {}

    def feature(g):
        if g not in hashed:
            h, at = tk.words(*tk.column_bytes(pa.array([" ".join(g)])))
            x, _ = license.ngrams(h, at)
            hashed[g] = int(model.table.find(x[-1:])[0])
        return hashed[g]

    def plain(text):
        """Families of a one-paragraph, one-line text with probabilities, and which ones a template confirms."""
        grams, _ = plain_grams(text)
        f = [x for x in map(feature, grams) if x >= 0]
        z = model.weights[f].astype(float).sum(axis=0) + model.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        out = {}
        for k, name in enumerate(model.families):
            if f and p[k] >= license.LEAST_PROBABILITY:
                for t in license.TEMPLATES[name]:
                    own = plain_grams(t)[0]
                    if len(own & grams) >= license.OF_TEMPLATE * len(own) or len(own & grams) >= license.OF_PARAGRAPH * len(grams):
                        out[name] = p[k]
                for t in license.TITLES.get(name, []):
                    if len(plain_grams(t)[0] & grams) >= license.OF_PARAGRAPH * len(grams):
                        out[name] = p[k]
        return out

    lines = [t for ts in license.TEMPLATES.values() for t in ts] + [t for ts in license.TITLES.values() for t in ts] + ["nothing of the kind", "the software is not licensed under these terms", *background[:30]]
    for line in lines:
        line = line.replace("\n", " ")
        got = {model.families[k]: p for _, _, k, p, ok, _ in license.found_in_block(model, *tk.column_bytes(pa.array([line]))) if ok}
        want = plain(line)
        assert set(got) <= set(want) and bool(got) == bool(want)
        assert all(abs(p - want[name]) < 1e-4 for name, p in got.items())


def test_wrapped_notices(spark):
    notice = "\n\n".join(t for t in license.TEMPLATES["mit"] if len(t) > 100 and "either" not in t)
    wrapped = "\n".join(textwrap.fill(p, 78) if p else "" for p in notice.split("\n"))
    lines = wrapped.split("\n")
    long = "\n".join(random_texts(3000, 34, 8))
    texts = [wrapped, "\n".join("# " + x for x in lines), "/*\n" + "\n".join(" * " + x for x in lines) + "\n */", long + "\n\n" + wrapped + "\n\n" + long, "MIT License", "BSD License", "Apache License, Version 2.0 or MIT license", textwrap.fill(license.TEMPLATES["gpl"][1], 50), *random_texts(20, 35, 60)]
    rows = {r["doc_id"]: [(x["family"], x["paragraph"]) for x in r["licences"] if x["confirmed"]] for r in license.scan(documents(spark, texts)).collect()}
    begins = [0] + [k + 1 for k, x in enumerate(lines) if not x]
    assert rows[0] == rows[1] == [("mit", k) for k in begins] and rows[2] == [("mit", k + 1) for k in begins]
    assert rows[3] == [("mit", k + len(long.split("\n")) + 1) for k in begins]
    assert rows[4] == [("mit", 0)] and rows[5] == [("bsd", 0)] and rows[6] == [("apache", 0), ("mit", 0)] and rows[7] == [("gpl", 0)]
    assert not any(rows[k] for k in range(8, len(texts)))


def test_quality_scores_equal_plain_ones(spark):
    """w . x from plain feature counts, the probabilities of grades, and a gradient that is zero where the fit ends."""
    texts = random_texts(120, 36, 30) + ["", "ONE", "a a a a b", "x" * 30]
    docs = documents(spark, texts)
    grades = spark.createDataFrame([(k, k % 3 + (k % 7 == 0)) for k in range(100)], "doc_id long, quality int")
    model = quality.fit(docs, grades)
    rows = {r["doc_id"]: r for r in quality.graded(docs, model).collect()}
    kinds = np.array(quality._CLASS)
    for k, t in enumerate(texts):
        buf = t.encode()
        c = [int(kinds[b]) for b in buf]
        shapes = [model.weights[a * 256 + b * 16 + d] for a, b, d in zip(c, c[1:], c[2:])]
        w = words(t)
        hashes = [int(tk.words(*tk.column_bytes(pa.array([x])))[0][0]) >> (64 - quality.WORD_BITS) for x in w]
        z = sum(shapes) / max(1, len(shapes)) + sum(model.weights[h + quality.WORDS_AT] for h in hashes) / max(1, len(w))
        again = sum(a == b for a, b in zip(w, w[1:]))
        level = lambda x: min(int(x * quality.BUCKETS), quality.BUCKETS - 1)
        buckets = [min(int(math.log2(len(w) + 1)), quality.BUCKETS - 1), level(again / max(1, len(w))), level(len(set(w)) / max(1, len(w))), level(sum(x == 1 for x in c) / max(1, len(c)))]
        z += sum(model.weights[b + j * quality.BUCKETS + quality.BUCKETS_AT] for j, b in enumerate(buckets))
        tails = [1 / (1 + math.exp(th - z)) for th in model.thresholds]
        assert np.allclose(rows[k]["tails"], tails, atol=1e-6)
        steps = np.diff(model.grades)
        assert abs(rows[k]["expected_grade"] - (model.grades[0] + sum(a * b for a, b in zip(steps, tails)))) < 1e-6
    assert quality.graded(docs, model).where(F.size("tails") != len(model.grades) - 1).count() == 0
