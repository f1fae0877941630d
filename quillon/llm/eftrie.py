"""An n-gram trie in Elias-Fano coded, memory-mapped levels.

Level k holds the k-grams in ascending order.  Two monotone sequences code it: the places where each (k-1)-gram's
children begin, and the children's symbols, made monotone by adding the last value of the range before.  A child is
found by successor search relative to its context: the least value of the parent's range that is not below base + symbol.
Logarithms of probabilities and of backoff weights are quantised to 16 bits, evenly spaced for each level.
"""

from __future__ import annotations

import io
import json
import math

import numpy as np

from quillon.llm.textkit import ranked


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts as unary gaps in a bit vector, with rank directories."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, head: np.ndarray):
        self.low, self.high, self.ones = low, high, ones
        self.n, self.bits = int(head[0]), int(head[1])
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.zeros = zeros

    @staticmethod
    def coded(values: np.ndarray) -> list[np.ndarray]:
        """The arrays of the sequence: low, high, ones before each word of high, and (n, bits)."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, int(math.floor(math.log2(top / n)))) if n and top > n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            x = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, x << shift)
            over = (shift + np.uint64(bits)) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 1
        high = np.zeros(size // 64 + 1, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return [low, high, ones, np.array([n, bits], np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        x = x | np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return x & np.uint64((1 << self.bits) - 1)

    @staticmethod
    def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one (from 0) within each word."""
        place = np.zeros(len(k), np.int64)
        rest = k.copy()
        for half in (32, 16, 8, 4, 2, 1):
            part = words >> place.astype(np.uint64) & np.uint64((1 << half) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            right = rest >= c
            rest -= np.where(right, c, 0)
            place += np.where(right, half, 0)
        return place

    def _select1(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, "right") - 1
        return w * 64 + self._select(self.high[w], i - self.ones[w])

    def _select0(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, i, "right") - 1
        w = np.minimum(w, len(self.high) - 1)
        return w * 64 + self._select(~self.high[w], i - self.zeros[w])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = self._select1(i) - i
        return high << self.bits | self._low(i).astype(np.int64)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least place in [lo, hi) whose value is not below x; hi where there is none."""
        h = x >> self.bits
        last = (len(self.high) * 64 - self.n) - 1  # zeros in all
        first = np.where(h > 0, self._select0(np.minimum(np.maximum(h - 1, 0), last)) - np.maximum(h - 1, 0), 0)
        end = self._select0(np.minimum(h, last)) - np.minimum(h, last)
        a, b = np.clip(first, lo, hi), np.clip(end, lo, hi)
        xl = (x & ((1 << self.bits) - 1)).astype(np.uint64)
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            below = self._low(mid) < xl[live]
            a[live] = np.where(below, mid + 1, a[live])
            b[live] = np.where(below, b[live], mid)
            live = live[a[live] < b[live]]
        return a


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes and (least value, step): evenly spaced values between the extremes; code 0 stands for 0 itself."""
    if not len(x):
        return np.zeros(0, np.uint16), np.zeros(2)
    step = float(x.max() - x.min()) / 65534 or 1.0
    codes = 1 + np.clip(np.rint((x - x.min()) / step), 0, 65534).astype(np.int64)
    return np.where(x == 0, 0, codes).astype(np.uint16), np.array([float(x.min()), step])


def restored(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, 0.0, scale[0] + (codes.astype(float) - 1) * scale[1])


def build(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: float) -> dict[str, np.ndarray]:
    """Arrays of a trie. levels: for k = 1, 2, ... the k-grams (big-endian bytes as an integer, ascending), log10 probabilities
    and log10 backoff weights; every prefix of a k-gram is a (k-1)-gram. floor: log10 probability of a symbol that level 1 lacks."""
    out: dict[str, np.ndarray] = {"head": np.array([len(levels)], np.int64), "floor": np.array([floor], np.float64)}
    above = np.zeros(1, np.uint64)
    for k, (keys, p, bow) in enumerate(levels, 1):
        parent = np.searchsorted(above, keys >> np.uint64(8))
        begin = np.searchsorted(parent, np.arange(len(above) + 1))
        symbol = (keys & np.uint64(255)).astype(np.int64)
        full = np.flatnonzero(np.diff(begin))
        width = symbol[begin[full + 1] - 1] + 1  # how far the range's values reach
        base = np.zeros(len(above), np.int64)
        base[full] = np.concatenate([[0], np.cumsum(width)[:-1]])
        out |= {f"{k}.child.{j}": a for j, a in enumerate(EliasFano.coded(base[parent] + symbol))}
        out |= {f"{k}.begin.{j}": a for j, a in enumerate(EliasFano.coded(begin))}
        for name, x in (("p", p), ("bow", bow)):
            out[f"{k}.{name}"], out[f"{k}.{name}.scale"] = quantised(x)
        above = keys
    return out


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the length of a JSON head, the head (name, type, place, items) and the arrays, aligned to 64 bytes."""
    head, place = [], 0
    for name, a in arrays.items():
        head.append([name, a.dtype.str, place, len(a)])
        place += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    out = io.BytesIO()
    out.write(np.array([len(text)], "<i8").tobytes() + text)
    out.write(bytes(-out.tell() % 64))
    for a in arrays.values():
        out.write(a.tobytes() + bytes(-a.nbytes % 64))
    return out.getvalue()


def unpacked(buffer) -> dict[str, np.ndarray]:
    """Views of the arrays in a buffer, such as a memory map."""
    n = int(np.frombuffer(buffer, "<i8", 1)[0])
    start = -(-(8 + n) // 64) * 64
    return {name: np.frombuffer(buffer, kind, size, start + place) for name, kind, place, size in json.loads(bytes(buffer[8 : 8 + n]))}


class Trie:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.order = int(arrays["head"][0])
        self.floor = float(arrays["floor"][0])
        self.child = [EliasFano(*(arrays[f"{k}.child.{j}"] for j in range(4))) for k in range(1, self.order + 1)]
        self.begin = [EliasFano(*(arrays[f"{k}.begin.{j}"] for j in range(4))) for k in range(1, self.order + 1)]
        self.codes = [(arrays[f"{k}.p"], arrays[f"{k}.p.scale"], arrays[f"{k}.bow"], arrays[f"{k}.bow.scale"]) for k in range(1, self.order + 1)]

    def down(self, k: int, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places at level k + 1 of the children of nodes of level k (k = 0: the root, node 0); -1 for none."""
        out = np.full(len(node), -1, np.int64)
        live = np.flatnonzero(node >= 0)
        if not len(live) or not self.child[k].n:
            return out
        lo, hi = self.begin[k][node[live]], self.begin[k][node[live] + 1]
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        if not len(live):
            return out
        base = np.zeros(len(lo), np.int64)
        base[lo > 0] = self.child[k][lo[lo > 0] - 1] + 1
        x = base + symbol[live]
        at = self.child[k].successor(x, lo, hi)
        there = at < hi
        there[there] = self.child[k][at[there]] == x[there]
        out[live[there]] = at[there]
        return out

    def nodes(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Places at level k of distinct ascending k-grams; every shared prefix is gone down once."""
        if not k:
            return np.zeros(len(grams), np.int64)
        above, back = distinct(grams >> np.uint64(8))
        return self.down(k - 1, self.nodes(k - 1, above)[back], (grams & np.uint64(255)).astype(np.int64))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 P(last symbol | those before) of n-grams of the full order, as big-endian integers."""
        out = np.full(len(grams), self.floor)
        todo, weight = np.arange(len(grams)), np.zeros(len(grams))
        for size in range(self.order, 0, -1):
            own, back = ranked(grams[todo] & np.uint64((1 << 8 * size) - 1))
            contexts, of = distinct(own >> np.uint64(8))
            node = self.nodes(size - 1, contexts)[of]
            last = self.down(size - 1, node, (own & np.uint64(255)).astype(np.int64))
            p, p_scale, _, _ = self.codes[size - 1]
            found = last >= 0
            value = np.zeros(len(own))
            value[found] = restored(p[last[found]], p_scale)
            if size > 1:
                _, _, bow, bow_scale = self.codes[size - 2]
                seen = ~found & (node >= 0)
                value[seen] = restored(bow[node[seen]], bow_scale)
            else:
                value[~found] = self.floor
            weight[todo] += value[back]
            done = found[back] | (size == 1)
            out[todo[done]] = weight[todo[done]]
            todo = todo[~done]
        return out


def distinct(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and for each element the place of its own."""
    if not len(ascending):
        return ascending, np.zeros(0, np.int64)
    new = np.append(True, ascending[1:] != ascending[:-1])
    return ascending[new], np.cumsum(new) - 1
