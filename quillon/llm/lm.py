"""Language-model scores from an Elias-Fano n-gram trie.

A text is its sequence of lower-cased words and one end.  The model spells it: bytes of the words with one space between
words and an end symbol, each given the five symbols before it (fewer at the start, which is padded), so rare
and unseen words have probabilities too and the probabilities of all sequences sum to at most one.  Probabilities are
Witten-Bell interpolations (with `BACKOFF` times the types) of 6-gram to 1-gram counts over all training texts.  Every
n-gram counts, at every size of the corpus.

No one holds the whole model.  n-grams go to shards by the last `LOCAL` symbols of their contexts: longer n-grams of a context,
and their suffixes, then share a shard, and the n-grams of up to LOCAL symbols (256^3 at most) go to every shard.  A shard
is counted, smoothed and built as a trie of its own (see eftrie), memory-mapped by its task, which answers the
distinct n-grams that each block of texts asks of the shard.  The answers come back to the block, in 16 bits.

Beside the score stands the add-one unigram baseline of word tokens, with exact counts of all words.  The vocabulary
has no bound, so it is never broadcast: texts are kept in blocks of about `BLOCK_BYTES`; counts are added up by hash in
shards, the distinct words of a block go there too, and their counts come back to the block.  Hot words cost one entry a
block and task.  Shards are as many as shuffle partitions at least, and more where the texts are over `SHARD_BYTES` a shard.  A task goes
through its shards one by one and holds the distinct n-grams or words of one; of n-grams these are 256^3 for each context that the shard
has, however long the corpus is.

Null and empty texts are the end alone.  Null doc_ids are scored, and learnt from as the caller says.  Rows are
scored one for one.  With nothing to learn from, all symbols are equally likely and N = V = 0.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import mmap
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import eftrie
from quillon.llm import textkit as tk
from quillon.llm.frames import forget_part, keep, shared_dir, shuffle_width
from quillon.llm.warc import file_system

ORDER = 6
#: A context's types count so many times in the weight of the shorter context.
BACKOFF = 6
#: n-grams are dealt by so many symbols before the last one.
LOCAL = 3
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 256 << 20
#: A stage has no more tasks than this on account of shards.
MOST_TASKS = 50_000
#: Bytes that no word has.
PAD, END, SPACE = 0x0A, 0x0D, 0x20
SYMBOLS = 257
#: n-grams that a task holds before it adds them up, and that it may hold on to after that.
MOST_PENDING, MOST_HELD = 600_000, 500_000
#: n-grams that are looked up together.
MOST_ASKED = 400_000

META, WORDS, GRAMS, ASKED, WANTED = 0, 1, 2, 3, 4
BLOCKS = "kind int, block long, shard int, doc_ids array<long>, held array<boolean>, a binary, b binary"


def press(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpress(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def mask(k: int) -> np.uint64:
    """Selects the last k symbols."""
    return np.uint64((1 << 8 * k) - 1)


def gaps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and sums of n."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return added(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def spelled(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words joined by one space, and the documents' offsets."""
    starts, ends, at = tk.word_bounds(buf, off)
    kept = np.zeros(len(buf) + 1, bool)
    if len(buf):
        kept[:-1] = ~tk.IS_SPACE[buf]
    final = np.zeros(len(ends), bool)
    final[at[1:][np.diff(at) > 0] - 1] = True
    kept[ends[~final]] = True
    data = tk.LOWER[buf[kept[:-1]]]
    data[tk.IS_SPACE[data]] = SPACE
    return data, np.concatenate([[0], np.cumsum(kept[:-1])])[off]


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol of spelled texts (big-endian), and offsets: a text's symbols and its end."""
    docs, size = len(off) - 1, np.diff(off)
    s = np.full(len(data) + docs * ORDER, PAD, np.uint64)
    lead = np.arange(docs) * ORDER + ORDER - 1
    s[np.arange(len(data)) + np.repeat(lead, size)] = data
    s[off[1:] + lead] = END
    key = np.zeros(max(0, len(s) - ORDER + 1), np.uint64)
    for j in range(ORDER):
        key = key << np.uint64(8) | s[j : j + len(key)]
    return key[s[ORDER - 1 :] != PAD], np.concatenate([[0], np.cumsum(size + 1)])


def row_ranges(off: np.ndarray, size: int = tk.BLOCK) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(off) - 1:
        hi = min(len(off) - 1, max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1))
        yield lo, hi
        lo = hi


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def sharded(kind: int, block: int, keys: np.ndarray, n: np.ndarray | None, shard: np.ndarray, shards: int) -> list[tuple]:
    """A row for each shard that has keys; keys ascend within an ascending shard."""
    edge = np.searchsorted(shard, np.arange(shards + 1))
    pressed = lambda a, b: None if n is None else press(n[a:b].astype(np.int64))
    return [(kind, block, s, None, None, press(gaps(keys[a:b])), pressed(a, b)) for s, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if a < b]


def gram_shards(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending n-grams by shard, and their shards in this order."""
    shard = shards_of(tk.mix(keys >> np.uint64(8) & mask(LOCAL)), shards)
    shard = shard.astype(np.uint16) if shards <= 1 << 16 else shard  # short ones are sorted by counting
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def gram_rows(keys: np.ndarray, n: np.ndarray, shards: int) -> list[tuple]:
    order, shard = gram_shards(keys, shards)
    return sharded(GRAMS, 0, keys[order], n[order], shard, shards)


def asked_rows(block: int, keys: np.ndarray, shards: int) -> list[tuple]:
    order, shard = gram_shards(keys, shards)
    return sharded(ASKED, block, keys[order], None, shard, shards)


class Counted:
    """Counts of a task by key, added up now and then and given out as rows before they are too many."""

    def __init__(self, rows: Callable[[np.ndarray, np.ndarray], list[tuple]]):
        self.rows, self.held, self.pending = rows, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, n.astype(np.int32)))
        self.pending += len(keys)
        if self.pending > MOST_PENDING:
            self.held = [merged(self.held)]
            self.pending = len(self.held[0][0])
            if self.pending > MOST_HELD:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield _record(self.rows(*merged(self.held)))
        self.held, self.pending = [], 0


def blocks(docs: DataFrame, shards: int) -> DataFrame:
    """Blocks of spelled texts, their words and n-grams by shard, and counts of words and n-grams by shard. docs: doc_id, text, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_counts = Counted(lambda keys, n: gram_rows(keys, n, shards))
        word_counts = Counted(lambda keys, n: sharded(WORDS, 0, keys, n, shards_of(keys, shards), shards))
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, off in tk.blocks(batch.column("text"), BLOCK_BYTES):
                block = uuid.uuid4().int >> 65
                data, at = spelled(buf, off)
                h, word_at = tk.words(data, at)
                learnt = ~held[lo:hi]
                own = np.repeat(learnt, np.diff(word_at))
                words, place = tk.ranked(h)
                n = np.bincount(place[own], minlength=len(words))
                rows = [(META, block, -1, batch.column("doc_id").slice(lo, hi - lo).to_pylist(), held[lo:hi].tolist(), press(data), press(at))]
                yield _record(rows + sharded(WANTED, block, words, None, shards_of(words, shards), shards))
                yield from word_counts.add(words[n > 0], n[n > 0])
                del h, words, place, own, n
                asked = []
                for a, b in row_ranges(at):
                    key, key_at = grams(data[at[a] : at[b]], at[a : b + 1] - at[a])
                    own = np.repeat(learnt[a:b], np.diff(key_at))
                    asked.append(tk.distinct(key[~own]))
                    key = np.sort(key[own])
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                    yield from gram_counts.add(key[first], np.diff(np.append(first, len(key))))
                    asked.append(key[first])
                yield _record(asked_rows(block, tk.distinct(np.concatenate(asked)), shards))
        yield from word_counts.rest()
        yield from gram_counts.rest()
        tk.trim()

    return docs.mapInArrow(run, BLOCKS)


Asks = Iterator[tuple[int, np.ndarray]]


def shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, Asks]]:
    """Rows sorted by shard and kind, counts before what is asked -> of every shard its distinct keys, their counts and (block, keys) that are asked.

    Counts are added up as they come, and what is asked is read as the caller goes on.
    """

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "block", "a", "b")), strict=True):
                yield *row[:3], np.cumsum(unpress(row[3], "<u8"), dtype=np.uint64), row[4]

    for shard, own in itertools.groupby(rows(), lambda r: r[0]):
        counts, pending, most, ask = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0, MOST_PENDING, None
        for row in own:
            if row[1] not in (WORDS, GRAMS):
                ask = row
                break
            counts.append((row[3], unpress(row[4], "<i8")))
            pending += len(row[3])
            if pending > most:
                counts = [merged(counts)]
                pending = len(counts[0][0])
                most = 2 * pending + MOST_PENDING
        keys, n = merged(counts)
        del counts
        yield shard, keys, n, ((r[2], r[3]) for r in itertools.chain([ask], own)) if ask else iter(())


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Rows sorted by shard -> all rows of a shard: (shard, block, keys, n)."""
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for shard, block, a, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "a", "b")), strict=True):
            if held and held[-1][0] != shard:
                yield held
                held = []
            held.append((shard, block, np.cumsum(unpress(a, "<u8"), dtype=np.uint64), unpress(b, "<i8")))
    if held:
        yield held


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row that asks, the words' total counts; and a row for the shard (block -1) with its tokens and distinct words."""
    for shard, keys, n, asks in shards_in(batches):
        yield _record([(WORDS, -1, shard, [int(n.sum()), len(keys)], None, None, None)])
        for some in itertools.batched(asks, 64):
            out = []
            for block, own in some:
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                count = np.where(keys[at] == own, n[at], 0) if len(keys) else np.zeros(len(own), np.int64)
                out.append((WORDS, block, shard, None, None, press(count.astype(np.int64)), None))
            yield _record(out)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in by_shard(batches):
        keys, n = added(np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]))
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], names=["key", "n"])


def _short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of n-gram counts -> counts of n-grams of LOCAL symbols."""
    held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            held.append(added(np.cumsum(unpress(a, "<u8"), dtype=np.uint64) & mask(LOCAL), unpress(b, "<i8")))
        held = [merged(held)]
    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1], pa.int64())], names=["key", "n"])


@dataclass
class Level:
    """n-grams of one length, ascending, and probabilities; contexts, ascending, and weights of the shorter context."""

    keys: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def smoothed(keys: np.ndarray, n: np.ndarray, k: int, below: Level | None, least: float = 1.0) -> Level:
    """k-grams seen `least` times at least, from counts of longer n-grams and the level below."""
    keys, n = added(keys & mask(k), n)
    h = keys >> np.uint64(8)
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    total, types = np.add.reduceat(n, first) if len(first) else n, size * BACKOFF
    of = np.repeat(np.arange(len(first)), size)[n >= least]
    keys, n = keys[n >= least], n[n >= least]
    q = np.full(len(keys), 1 / SYMBOLS) if below is None else below.p[np.searchsorted(below.keys, keys & mask(k - 1))]
    p = (n + types[of] * q) / (total[of] + types[of])
    left = [np.maximum(1 - np.bincount(of, x, len(first)), 1e-12) for x in (p, q)]
    some = np.unique(of)
    return Level(keys, p, h[first][some], np.minimum(left[0] / left[1], 1.0)[some])


def trie_arrays(levels: list[Level]) -> dict[str, np.ndarray]:
    """Arrays of a trie. n-grams that are contexts only, as the padding before a text is, are nodes too."""
    weights = levels[0].weights
    floor = float(np.log10((weights[0] if len(weights) else 1.0) / SYMBOLS))
    out, contexts = [], np.zeros(0, np.uint64)
    for k in range(len(levels), 0, -1):
        own = levels[k - 1]
        keys = np.union1d(own.keys, contexts)
        p, bow = np.full(len(keys), -20.0), np.zeros(len(keys))
        p[np.searchsorted(keys, own.keys)] = np.log10(own.p)
        if k < len(levels):
            bow[np.searchsorted(keys, levels[k].contexts)] = np.log10(levels[k].weights)
        out.append((keys, p, bow))
        contexts = tk.distinct(keys >> np.uint64(8))
    return eftrie.build(out[::-1], floor)


def levels_of(keys: np.ndarray, n: np.ndarray, low: list[Level], least: float = 1.0) -> list[Level]:
    """The given shortest levels and the others, up to ORDER."""
    levels = [*low]
    for k in range(len(low) + 1, ORDER + 1):
        levels.append(smoothed(keys, n, k, levels[-1] if levels else None, least))
    return levels


def counts_of(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = table.toArrow()
    return rows.column("key").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64)


def trie_file(gram_counts: DataFrame, rarest: float = 0.0) -> str:
    """One trie of a whole small table of n-gram counts (key, n), without n-grams under a share of all symbols; returns the file's URI."""
    keys, n = counts_of(gram_counts)
    uri = f"{shared_dir(gram_counts.sparkSession)}/quillon/trie-{uuid.uuid4().hex}.bin"
    store, path = file_system(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(eftrie.packed(trie_arrays(levels_of(keys, n, [], max(1.0, n.sum() * rarest)))))
    return uri


def mapped(parts: Iterable[bytes]) -> eftrie.Trie:
    """The trie of a file's bytes, memory-mapped from a file that is unlinked at once."""
    with tempfile.TemporaryFile() as own:
        for data in parts:
            own.write(data)
        own.flush()
        return eftrie.Trie(eftrie.unpacked(mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ)))


def opened(uri: str) -> eftrie.Trie:
    store, path = file_system(uri)
    with store.open_input_stream(path, compression=None) as source:
        return mapped(iter(lambda: source.read(1 << 20), b""))


def _answers(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by shard and kind -> for each row that asks, the log10 probabilities of its n-grams. sent: the levels up to LOCAL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, n, asks in shards_in(batches):
            trie = mapped([eftrie.packed(trie_arrays(levels_of(keys, n, sent.value)))])
            del keys, n
            asked: list[tuple[int, np.ndarray]] = []
            waiting = 0
            for ask in asks:
                asked.append(ask)
                waiting += len(ask[1])
                if waiting > MOST_ASKED:
                    yield from answered(shard, trie, asked)
                    asked, waiting = [], 0
            yield from answered(shard, trie, asked)
        tk.trim()

    return run


def answered(shard: int, trie: eftrie.Trie, asked: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if not asked:
        return
    new, back = tk.ranked(np.concatenate([keys for _, keys in asked]))
    p = trie.log10(new)[back]
    out, a = [], 0
    for block, keys in asked:
        codes, scale = eftrie.quantised(p[a : a + len(keys)])
        out.append((ASKED, block, shard, None, None, press(codes), scale.tobytes()))
        a += len(keys)
    for a in range(0, len(out), 256):
        yield _record(out[a : a + 256])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score every row of docs; the model learns from the rows for which held_out is false."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(width, -(-size // SHARD_BYTES))
    tasks = max(width, min(shards, MOST_TASKS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    table = keep(blocks(rows, shards), "lm-blocks", "kind")
    dealt = lambda *kinds: table.where(F.col("kind").isin(*kinds)).repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "block")
    answers = keep(dealt(WORDS, WANTED).mapInArrow(_word_counts, BLOCKS), "lm-counts")
    forget_part(table, "kind", WORDS, WANTED)
    # At most 256^LOCAL rows.
    short = table.where(F.col("kind") == GRAMS).select("a", "b").mapInArrow(_short_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys, counted = counts_of(short)
    low: list[Level] = []
    for k in range(1, LOCAL + 1):
        low.append(smoothed(keys, counted, k, low[-1] if low else None))
    likely = keep(dealt(GRAMS, ASKED).mapInArrow(_answers(spark.sparkContext.broadcast(low)), BLOCKS), "lm-answers")
    forget_part(table, "kind", GRAMS, ASKED)
    tokens = answers.where("block = -1").agg(F.sum(F.col("doc_ids")[0]).alias("n"), F.sum(F.col("doc_ids")[1]).alias("v")).first()
    ends = table.where(F.col("kind") == META).agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n, v = (tokens["n"] or 0) + ends, (tokens["v"] or 0) + (ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta: tuple | None = None
        counts: list[np.ndarray] = []
        found: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            if meta is None:
                return
            ids, held, data, at = meta
            h, word_at = tk.words(data, at)
            words, place = tk.ranked(h)
            c = np.concatenate([*counts, np.zeros(0, np.int64)])
            if len(c) != len(words):
                raise ValueError(f"{len(c)} counts for {len(words)} words")
            log = np.log10((c + 1) / (n + v + 1))[place] if len(words) else np.zeros(0)
            known = tk.segment_sums((c > 0)[place].astype(np.int64) if len(words) else np.zeros(0, np.int64), word_at) + (ends > 0)
            base = tk.segment_sums(log, word_at) + np.log10((ends + 1) / (n + v + 1))
            del h, words, place, log, c
            key, key_at = grams(data, at)
            key, place = tk.ranked(key)
            p = np.concatenate([*found, np.zeros(0)])
            if len(p) != len(key):
                raise ValueError(f"{len(p)} answers for {len(key)} n-grams")
            p[gram_shards(key, shards)[0]] = p.copy()
            total = tk.segment_sums(p[place], key_at)
            cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.diff(word_at) + 1), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORES.split(", ")])

        for batch in batches:
            for kind, ids, held, a, b in zip(*(batch.column(x).to_pylist() for x in ("kind", "doc_ids", "held", "a", "b")), strict=True):
                if kind == META:
                    yield from done()
                    meta, counts, found = (ids, held, unpress(a, "u1"), unpress(b, "<i8")), [], []
                elif kind == WORDS:
                    counts.append(unpress(a, "<i8"))
                else:
                    found.append(eftrie.restored(unpress(a, "<u2"), np.frombuffer(b)))
        yield from done()
        tk.trim()

    parts = table.where(F.col("kind") == META).union(answers.where("block >= 0")).union(likely)
    return parts.repartition(width, "block").sortWithinPartitions("block", "shard").mapInArrow(run, SCORES)
