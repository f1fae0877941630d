"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised: A-Z lower-cased, runs of ASCII bytes that are neither letters nor digits become one space.
Items are cut into overlapping windows of `WINDOW` bytes (a shorter item is one window), and also of `PASSAGE` bytes, no further apart than
the edits that these may have: so a verbatim piece of PASSAGE bytes counts wherever in the item it begins.  A window of w bytes
that occurs in a document with at most e = w / 16 edits shares at least w - q + 1 - q * e of its q-grams with it
there, on diagonals that differ by at most e.  So:

1. q-grams of the document are looked up among those of all windows.
2. Stretches with fewer such q-grams than any window needs are dropped by a sliding count.
3. Hits are counted by document, window and overlapping diagonal bands of 2 (e + 1); bands that meet the bound stay.
4. Each is verified by alignment in the band (semi-global edit distance at most e).

Items under `LEAST` normalised bytes, which the lemma allows no edit, count where they occur in full, from word bound to word bound.

Every q-gram, occurrence and stretch counts; nothing is sampled.  A window that several items have is searched once and counts for all of
them.  Windows are broadcast in blocks of about `BLOCK_BYTES`.  A benchmark of one block is one pass over the rows; of a longer one
every block is a job of its own that writes the windows it finds, by hash of the text, and these are joined to their items and to the rows.

Null and empty texts are clean.  Null items, and items without a letter, digit or character beyond ASCII, are not searched.  A null item_id
is listed as a number below all others, -1 at most.  Rows are returned one for one with all other columns as they are, whatever their names; only a
column that has the result's own name is replaced, and clean_documents replaces none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from quillon.llm import textkit as tk
from quillon.llm.frames import beside, forget, joined, keep, place, rows_of

Q = 12
WINDOW, STRIDE = 96, 48
#: The least piece of a longer item that counts.
PASSAGE, PASSAGE_STRIDE = 64, 4
#: Shorter items are searched exactly.
LEAST = 24
#: One edit is allowed for so many bytes of a window.
PER_EDIT = 16
BLOCK_BYTES = 16 << 20
#: Texts with hits are broadcast up to this number, else joined by a shuffle.
BROADCAST_TEXTS = 200_000
FLAG_BITS = 20

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_NORMAL = np.where(_GAP, 32, tk.LOWER).astype(np.uint8)


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of a block and their offsets."""
    gap = _GAP[buf]
    kept = np.ones(len(buf), bool)
    kept[1:] = ~(gap[1:] & gap[:-1])
    first = off[:-1][np.diff(off) > 0]
    kept[first] = ~gap[first]
    return _NORMAL[buf[kept]], np.concatenate([[0], np.cumsum(kept)])[off]


def edits(size: int) -> int:
    """Edits that a window of so many bytes may have; its bound is one q-gram at least."""
    return min(size // PER_EDIT, (size - Q) // Q)


def least_shared(size: int) -> int:
    return size - Q + 1 - Q * edits(size)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams; those that cross documents among them."""
    n = len(data) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, tk.BLOCK):
        b = min(n, a + tk.BLOCK)
        p, inv = tk.powers(b - a + Q)
        acc = np.empty(b - a + Q, np.uint64)
        acc[0] = 0
        np.cumsum(tk.BYTE_LOWER[data[a : b + Q - 1]] * p[: b - a + Q - 1], out=acc[1:])
        out[a:b] = (acc[Q:] - acc[:-Q]) * inv[: b - a]
    return tk.mix(out)


@dataclass
class Index:
    """Windows of a block of items, the q-grams of the long ones, and the short ones by size."""

    item: np.ndarray
    text: np.ndarray  # n x WINDOW, padded
    size: np.ndarray
    table: tk.HashTable
    flags: np.ndarray
    post_at: np.ndarray  # of each q-gram: where its postings begin
    post_window: np.ndarray
    post_place: np.ndarray
    short: dict[int, tuple[tk.HashTable, np.ndarray]]  # size: hashes, and the window of each

    @staticmethod
    def of(windows: list[tuple[int, bytes]]) -> Index:
        size = np.array([len(w) for _, w in windows], np.int64)
        text = np.zeros((len(windows), WINDOW), np.uint8)
        for k, (_, w) in enumerate(windows):
            text[k, : len(w)] = np.frombuffer(w, np.uint8)
        flat = np.concatenate([np.frombuffer(w, np.uint8) for _, w in windows])
        start = np.concatenate([[0], np.cumsum(size)])
        long = np.flatnonzero(size >= LEAST)
        count = size[long] - Q + 1
        place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int16)
        window = np.repeat(long, count).astype(np.int32)
        grams = gram_hashes(flat)[start[window] + place] if len(window) else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        keys, first = np.unique(grams[order], return_index=True)
        flags = np.zeros(1 << FLAG_BITS, bool)
        flags[(keys >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True
        short = {}
        for s in np.unique(size[size < LEAST]).tolist():
            own = np.flatnonzero(size == s)
            short[s] = tk.HashTable(tk.span_hashes(flat, start[own], start[own] + s)), own
        return Index(np.array([i for i, _ in windows], np.int64), text, size, tk.HashTable(keys), flags, np.append(first, len(order)), window[order], place[order], short)


def short_matches(index: Index, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Rows (document, window) of the short windows that stand between word bounds."""
    if not index.short or not len(data):
        return []
    starts, _, at = tk.word_bounds(data, off)
    doc = tk.owners(at)
    out = []
    for s, (table, own) in index.short.items():
        end = starts + s
        fits = end <= off[doc + 1]
        fits[fits] = (end[fits] == off[doc[fits] + 1]) | (data[np.minimum(end[fits], len(data) - 1)] == 32)
        a = starts[fits]
        k = table.find(tk.span_hashes(data, a, a + s))
        a, d, w = a[k >= 0], doc[fits][k >= 0], own[k[k >= 0]]
        same = (data[a[:, None] + np.arange(s)] == index.text[w, :s]).all(axis=1)
        out.append(np.stack([d[same], w[same]], axis=1))
    return out


def matches(index: Index, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) of all verified occurrences in a normalised block; distinct."""
    found = short_matches(index, data, off)
    found += [verified(index, data, off, *banded(index, *hits)) for hits in dense_hits(index, data, off)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def dense_hits(index: Index, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, q-gram, document) of q-grams of windows that lie as close as any window needs, in stretches."""
    if not len(index.table.keys):
        return
    h = gram_hashes(data)
    at = np.flatnonzero(index.flags[(h >> np.uint64(64 - FLAG_BITS)).astype(np.int64)])
    gram = index.table.find(h[at])
    doc = np.searchsorted(off, at, "right") - 1
    real = (gram >= 0) & (at + Q <= off[doc + 1])
    at, gram, doc = at[real], gram[real], doc[real]
    sizes = np.unique(index.size[index.size >= LEAST])
    least = min(least_shared(int(w)) for w in sizes)
    reach = max(int(w) + 2 * edits(int(w)) for w in sizes)
    if len(at) < least:
        return
    # Stretches of `reach` bytes with `least` hits: the hit opens or lies within such a stretch.
    ends = np.searchsorted(at, at + reach, "right")
    opens = ends - np.arange(len(at)) >= least
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(opens), 1)
    np.add.at(cover, ends[opens], -1)
    dense = np.cumsum(cover[:-1]) > 0
    at, gram, doc = at[dense], gram[dense], doc[dense]
    for part in pieces(index, gram):
        yield at[part], gram[part], doc[part]


def pieces(index: Index, gram: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Hits in stretches whose postings number about `most`; neighbouring stretches share the hits of one window."""
    load = np.cumsum(index.post_at[gram + 1] - index.post_at[gram])
    a = 0
    while a < len(gram):
        b = max(a + 4 * WINDOW, int(np.searchsorted(load, (load[a - 1] if a else 0) + most, "right")))
        yield slice(a, min(len(gram), b + 2 * WINDOW))
        a = b


def banded(index: Index, at: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, window, band) where the count of shared q-grams meets the bound."""
    n = index.post_at[gram + 1] - index.post_at[gram]
    post = np.repeat(index.post_at[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    window = index.post_window[post]
    width = np.minimum(index.size[window] // PER_EDIT, (index.size[window] - Q) // Q) + 1
    diagonal = np.repeat(at, n) - index.post_place[post] + WINDOW  # never negative
    band = diagonal // width
    rows = np.stack([np.tile(np.repeat(doc, n), 2), np.tile(window, 2), np.concatenate([band, band - 1])], axis=1)
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(rows)))
    rows = rows[first]
    size = index.size[rows[:, 1]]
    bound = size - Q + 1 - Q * np.minimum(size // PER_EDIT, (size - Q) // Q)
    return tuple(rows[count >= bound].T)


def verified(index: Index, data: np.ndarray, off: np.ndarray, doc: np.ndarray, window: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Rows (document, window) whose edit distance within the band is small enough."""
    out = [np.zeros((0, 2), np.int64)]
    for a in range(0, len(doc), 20_000):
        d, w, b = doc[a : a + 20_000], window[a : a + 20_000], band[a : a + 20_000]
        size = index.size[w]
        most = np.minimum(size // PER_EDIT, (size - Q) // Q)
        e = int(most.max(initial=0))
        start = b * (most + 1) - WINDOW - most  # where the window's first byte may lie at the earliest
        columns = np.arange(2 * (e + 1) + 2 * e + 1)
        cost = np.zeros((len(d), len(columns)), np.int32)
        best = np.full(len(d), 1 << 20)
        lo, hi = off[d][:, None], off[d + 1][:, None]
        for i in range(int(size.max(initial=0))):
            place = start[:, None] + i + columns
            inside = (place >= lo) & (place < hi)
            byte = data[np.clip(place, 0, len(data) - 1)]
            step = cost + (~inside | (byte != index.text[w, i][:, None]))
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - columns, axis=1) + columns
            last = size == i + 1
            best[last] = cost[last].min(axis=1)
        ok = best <= most
        out.append(np.stack([d[ok], w[ok]], axis=1))
    return np.concatenate(out)


def windows_of(text: bytes, size: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    """Overlapping windows; the last one ends with the text."""
    if len(text) <= size:
        return [text]
    starts = [*range(0, len(text) - size, stride), len(text) - size]
    return [text[s : s + size] for s in starts]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[int, bytes]] = []
        for lo, hi, buf, off in tk.blocks(batch.column(1)):
            data, at = normalised(buf, off)
            for r in range(lo, hi):
                text = data[at[r - lo] : at[r - lo + 1]].tobytes().strip()
                if text:
                    rows += [(batch.column(0)[r].as_py(), w) for w in {*windows_of(text), *windows_of(text, PASSAGE, PASSAGE_STRIDE)}]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.binary())], names=["item_id", "win"])


def found_in(index: Index, texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(row, window)."""
    for lo, _, buf, off in tk.blocks(texts):
        for d, w in zip(*matches(index, *normalised(buf, off)), strict=True):
            yield lo + int(d), int(w)


def _marked(docs: DataFrame, benchmark: DataFrame, block_bytes: int, name: str) -> DataFrame:
    """(row, name) as beside() has them."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    nameless = min(items.agg(F.min("item_id")).first()[0] or 0, 0) - 1
    items = items.where("text is not null").fillna(nameless, ["item_id"])
    windows = keep(items.mapInArrow(_windows, "item_id long, win binary").distinct(), "benchmark-windows")
    size = windows.groupBy("win").agg(F.count("*").alias("n")).agg(F.sum(F.length("win")).alias("text"), F.sum(8 * F.col("n")).alias("ids")).first()
    field = StructField(name, ArrayType(LongType()))
    if (size["text"] or 0) + (size["ids"] or 0) <= block_bytes:
        held: dict[bytes, set[int]] = {}
        for r in windows.collect():  # at most block_bytes
            held.setdefault(bytes(r["win"]), set()).add(r["item_id"])
        forget(windows)
        order = sorted(held)
        sent = spark.sparkContext.broadcast((Index.of(list(enumerate(order))), [held[w] for w in order]) if order else None)

        def kernel(texts: pa.Array) -> list[pa.Array]:
            ids: list[set[int]] = [set() for _ in range(len(texts))]
            if sent.value:
                index, of = sent.value
                for d, w in found_in(index, texts):
                    ids[d] |= of[w]
            return [pa.array([sorted(x) for x in ids], pa.list_(pa.int64()))]

        return beside(docs, kernel, [field])
    keyed = lambda text: (F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"))
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = F.col(f"c{place(docs, 'text')}").cast("string")
    blocks = -(-size["text"] // block_bytes)
    hits: list[DataFrame] = []
    for k in range(blocks):
        order = sorted(bytes(r["win"]) for r in windows.select("win").distinct().where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k).collect())  # about block_bytes
        if order:
            block = spark.sparkContext.broadcast(Index.of(list(enumerate(order))))
            hits.append(keep(plain.select(*keyed(text), text.alias("text")).mapInArrow(_hits(block), "_a long, _b long, win binary").distinct(), "benchmark-hits"))
            block.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    items_of = every.join(windows, "win").select("_a", "_b", "item_id").distinct().groupBy("_a", "_b")
    items_of = keep(items_of.agg(F.array_sort(F.collect_set("item_id")).alias(name)), "benchmark-texts")
    few = items_of.count() <= BROADCAST_TEXTS
    forget(windows, *hits)
    rows = plain.select(F.struct(*plain.columns).alias("row"), *keyed(text))
    return rows.join(F.broadcast(items_of) if few else items_of, ["_a", "_b"], "left").select("row", F.coalesce(name, F.array().cast("array<long>")).alias(name))


def _hits(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(found_in(sent.value, batch.column("text")))
            at = pa.array([d for d, _ in pairs], pa.int64())
            found = [sent.value.text[w, : sent.value.size[w]].tobytes() for _, w in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("_a").take(at), batch.column("_b").take(at), pa.array(found, pa.binary())], names=["_a", "_b", "win"])

    return run


def marked(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, name: str = "benchmark_items") -> DataFrame:
    """The columns of docs and, by the given name, the ascending item_ids of which a window occurs in the text."""
    return joined(_marked(docs, benchmark, block_bytes, name), docs)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no window of the benchmark occurs, with their own columns and values."""
    return rows_of(_marked(docs, benchmark, BLOCK_BYTES, "items").where(F.size("items") == 0), docs)
