"""Kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import decontaminate, eftrie, lm, neardup, packing, quality, warc
from quillon.llm import textkit as tk

TEXTS = ["", None, "One", " a\tB  c\nd ", "é ü A\x0b\x0c\r z", "x" * 3000, "w " * 4000, "\x00  y", "the the the the the the"]


def lower(x):
    return x.translate({i: i + 32 for i in range(65, 91)})


def words(x):
    return re.findall("[^\x20\x09-\x0d]+", lower(x or ""))


def shingles(x, k=5):
    w = words(x)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def random_texts(n, seed=0, longest=80):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdeéÀ.") for _ in range(r.randint(1, 6))) for _ in range(60)]
    return ["".join(r.choice(v) + r.choice([" ", " ", "\n", "\t "]) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_words_and_hashes():
    texts = TEXTS + random_texts(200)
    seen = {}
    for lo, hi, buf, off in tk.blocks(pa.array(texts), 500):
        h, at = tk.words(buf, off)
        for d in range(lo, hi):
            own = h[at[d - lo] : at[d - lo + 1]].tolist()
            assert len(own) == len(words(texts[d]))
            for w, x in zip(words(texts[d]), own):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert list(tk.blocks(pa.array([], pa.string()))) == []


def test_span_hashes_do_not_depend_on_chunks():
    buf, off = tk.column_bytes(pa.array([" ".join(random_texts(50, 3))]))
    s, e, _ = tk.word_bounds(buf, off)
    assert (tk.span_hashes(buf, s, e) == tk.span_hashes(buf, s, e, size=40)).all()


def test_hash_table():
    r = np.random.default_rng(1)
    for n in (0, 1, 5000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        q = np.concatenate([keys, r.integers(0, 1 << 63, 100, dtype=np.uint64)])
        found = tk.HashTable(keys).find(q)
        where = {k: i for i, k in enumerate(keys.tolist())}
        assert found.tolist() == [where.get(k, -1) for k in q.tolist()]


def test_shingle_sets_and_sketches():
    texts = TEXTS + random_texts(120, 5)
    buf, off = tk.column_bytes(pa.array(texts))
    sets, at = neardup.shingle_sets(buf, off)
    assert np.diff(at).tolist() == [len(shingles(x)) for x in texts]
    sketch = neardup.sketches(sets, at)
    full = np.diff(at) > 0
    assert (sketch[full] != neardup._EMPTY).all() and (sketch[~full] == neardup._EMPTY).all()
    # The estimate is close to the similarity of sets.
    a, b = list(range(1000)), list(range(250, 1250))
    ids = tk.mix(np.array(a + b, np.uint64))
    s = neardup.sketches(ids, np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08
    tiny = neardup.sketches(tk.mix(np.array([7, 7, 8], np.uint64)), np.array([0, 1, 3]))
    assert (tiny != neardup._EMPTY).all() and 0.3 < (tiny[0] == tiny[1]).mean() < 0.7


def test_piece_bounds_and_plan():
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 4)] and packing.piece_bounds(8, 4) == [(0, 4), (4, 4)] and packing.piece_bounds(3, 4) == [(0, 3)]
    r = random.Random(2)
    for trial in range(60):
        cap = r.choice([7, 64, 300])
        hist = {}
        for _ in range(r.randint(0, 200)):
            n = r.randint(1, cap)
            hist[n] = hist.get(n, 0) + r.randint(1, 4)
        groups, large = r.choice([(1, 0.05), (3, 0.25), (50, 0.9), (4096, 0.25)])
        plan = packing.Plan(dict(hist), cap, groups, large)
        fill, used = {}, {}
        for n, lo, hi, base, off, per in plan.runs:
            for k in range(lo, hi):
                fill.setdefault(base + (k - lo) // per, []).append((off + (k - lo) % per * n, n))
                used[n] = used.get(n, set()) | {k}
        assert {n: len(u) for n, u in used.items()} == hist
        for parts in fill.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= cap
        total = sum(n * k for n, k in hist.items())
        assert -(-total // cap) <= len(fill)
        if groups > cap:  # nothing is rounded: at least as good as any fit that opens no sequence without need
            assert len(fill) <= max(1, 2 * total / cap + 1)


def test_encoder_equals_the_tokenizer_file():
    P = pytest.importorskip("public_tokenizers")
    enc = packing.Encoder(P.path("byte_bpe_50k.json"))
    assert enc.fast is not None
    texts = [*(x or "" for x in TEXTS), *random_texts(50, 9), "a <|endoftext|> b", "don't  stop \n\n 'll\t 12３ Ωmega x", "日本語 \U0001f600!! ", "".join(map(chr, range(1, 700)))]
    for x in texts:
        assert enc.encode(x) == enc.plain.encode(x, add_special_tokens=False).ids


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, top in ((1, 5), (10, 10), (1000, 5000), (3000, 10**9), (300, 3)):
        v = np.sort(r.integers(0, top, n))
        e = eftrie.EliasFano(*eftrie.EliasFano.coded(v))
        assert (e[np.arange(n)] == v).all()
        x, lo = r.integers(0, top + 5, 500), r.integers(0, n, 500)
        hi = lo + r.integers(0, n + 1 - lo)
        assert (e.successor(x, lo, hi) == [a + np.searchsorted(v[a:b], q) for a, b, q in zip(lo, hi, x)]).all()


def test_trie_finds_and_backs_off():
    r = np.random.default_rng(3)
    keys3 = np.unique(r.integers(1, 4, (30, 3)) @ np.array([65536, 256, 1])).astype(np.uint64)
    keys2, keys1 = np.unique(np.concatenate([keys3 >> np.uint64(8), keys3 & np.uint64(65535)])), np.array([1, 2, 3], np.uint64)
    levels = [(k, -r.random(len(k)) - 0.1, -r.random(len(k)) if i < 2 else np.zeros(len(k))) for i, k in enumerate((keys1, keys2, keys3))]
    trie = eftrie.Trie(eftrie.unpacked(eftrie.packed(eftrie.build(levels, -9.0))))
    tables = [{int(k): (a, b) for k, a, b in zip(*level)} for level in levels]
    for g in [a << 16 | b << 8 | c for a in range(1, 6) for b in range(1, 5) for c in range(1, 5)]:
        want, weight = None, 0.0
        for size in (3, 2, 1):
            s = g & (1 << 8 * size) - 1
            if s in tables[size - 1]:
                want = weight + tables[size - 1][s][0]
                break
            if size > 1:
                weight += tables[size - 2].get(s >> 8, (0, 0))[1]
        want = weight - 9.0 if want is None else want
        assert abs(float(trie.log10(np.array([g], np.uint64))[0]) - want) < 1e-3


def test_spelling_and_grams():
    texts = TEXTS + random_texts(40, 8)
    data, at = lm.spelled(*tk.column_bytes(pa.array(texts)))
    assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == [" ".join(words(x)) for x in texts]
    g, g_at = lm.grams(data, at)
    for d, x in enumerate(texts):
        k = lm.ORDER
        s = bytes([lm.PAD]) * (k - 1) + " ".join(words(x)).encode() + bytes([lm.END])
        assert g[g_at[d] : g_at[d + 1]].tolist() == [int.from_bytes(s[i : i + k], "big") for i in range(len(s) - k + 1)]


def edit_distance_within(pattern, text, most):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) <= most


def test_decontamination_against_alignment():
    r = random.Random(4)
    v = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [say(30) for _ in range(12)] + ["short", say(6), say(5) + " ..."]
    windows = []
    for i, t in enumerate(items):
        d, a = decontaminate.normalised(*tk.column_bytes(pa.array([t])))
        t = d.tobytes().strip()
        windows += [(i, w) for w in decontaminate.windows_of(t)] if len(t) >= decontaminate.LEAST else []
    index = decontaminate.Index.of(windows)
    docs = []
    for k in range(80):
        base = list(items[r.randrange(len(items))])
        for _ in range(r.choice([0, 0, 3, 8, 20, 60])):
            p = r.randrange(len(base))
            base[p : p + r.choice([0, 1])] = r.choice(["", "q", "z", " "])
        docs.append(say(r.randint(0, 40)) + " " + ("".join(base).upper() if k % 3 else "") + r.choice([" ", "!\n"]) + say(r.randint(0, 40)))
    docs += ["", "x", items[0], items[1][:97], "".join(items[2:5])]
    data, at = decontaminate.normalised(*tk.column_bytes(pa.array(docs)))
    got = set(zip(*(x.tolist() for x in decontaminate.matches(index, data, at))))
    want = set()
    for d in range(len(docs)):
        text = data[at[d] : at[d + 1]].tobytes()
        want |= {(d, w) for w, (_, p) in enumerate(windows) if edit_distance_within(p, text, decontaminate.edits(len(p)))}
    assert got == want and len(want) > 40


def test_ordinal_gradient_and_fit():
    r = np.random.default_rng(5)
    n, grades = 60, 4
    at = np.arange(n + 1) * 3
    places, values = r.integers(0, 40, 3 * n), r.random(3 * n)
    eta = np.add.reduceat(np.where(places < 20, 3.0, -3.0) * values, at[:-1])
    y = np.digitize(eta, [-2, 0, 2])
    f = quality.Objective(at, places, values, y, grades, 1e-3)
    p = r.normal(0, 0.1, quality.WIDTH + grades - 1)
    _, g = f(p)
    for j in [*range(0, 40, 7), quality.WIDTH, quality.WIDTH + 1, quality.WIDTH + 2]:
        e = np.zeros(len(p))
        e[j] = 1e-6
        assert abs((f(p + e)[0] - f(p - e)[0]) / 2e-6 - g[j]) < 1e-5
    best = quality.minimised(f, np.concatenate([np.zeros(quality.WIDTH), [-1.0, 0.0, 0.0]]))
    assert f(best)[0] < 0.4 and (np.diff(f.thresholds(best)) > 0).all()


@pytest.mark.parametrize("cut", [1, 50, 1000])
def test_members_at_every_split(cut, tmp_path):
    r = random.Random(6)
    tricky = warc.MAGIC + b"\x00" * 30 + warc.member(b"WARC/1.1\r\n\r\n")[:9]
    raws = [warc.record(k, f"http://h/{k}", r.randbytes(r.randint(0, 300)) + tricky * (k % 3), "D", None) for k in range(25)]
    data = b"".join(warc.member(x) for x in raws)
    (tmp_path / "f").write_bytes(data)
    got = []
    with open(tmp_path / "f", "rb") as f:
        for a in range(0, len(data), max(cut, len(data) // 300)):
            got += list(warc.Members(f, len(data), a, min(len(data), a + max(cut, len(data) // 300))))
    assert [x for _, x in got] == raws
