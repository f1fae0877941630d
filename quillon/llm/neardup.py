"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct shingles: five consecutive words, lower-cased; shorter texts are one
shingle.  Documents are linked where intersection / union >= 0.75, and components of linked documents are
found.  The stages:

1. Sketch.  Rounds of hashed bin placement: in round i < t every shingle goes to a hashed bin with value i + hash; the
   least value of a bin is its coordinate, and rounds end when all bins are full.  After t rounds, round t + j
   fills bin j from all shingles.  So every coordinate fills and estimates concentrate.  56 bands of 6 of the 1024
   coordinates miss a pair at 0.75 with probability (1 - 0.75^6)^56 < 2e-5; four bits of each coordinate are kept
   to screen pairs.
2. Classes.  Equal sets are one class, a node of the graph; nodes are numbered in the order of their least doc_ids, and copies are never paired.
3. Stars.  Each bucket of a band compares its members with its least member only: pairs are linear in the members.
4. The rest.  In buckets that hold several components after that, members outside the least member's component
   are compared with members of other components.  Sizes and kept bits screen the pairs inside the join
   (the bits at 4.5 standard deviations), and a pair is made in the first band it shares, so groups that are
   already one component cost nothing more and others only their pairs near the threshold.
5. Verification of all pairs on full sets, computed from whole texts.  The members of a star are dealt out in
   chunks, each with its own copy of the centre, so that no task depends on a star's size.
6. Components by alternating large-star and small-star steps, each written to the shared folder.

Sets are of 64-bit hashes; two different shingles of a pair of documents collide with probability below 1e-9.

Null texts and texts without words have empty sets, are linked with nothing and stay.  Rows with a null
doc_id have no component and stay.  Rows that share a doc_id are linked by their texts alone, like any others; a component is named
by the least doc_id of its rows.  Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.frames import forget, place, shuffle_width
from quillon.llm.frames import keep_numbers as keep

WORDS = 5
#: Linked where 100 * intersection >= 75 * union.
PERCENT = 75
COORDINATES = 1024
BANDS, ROWS = 56, 6
#: Bits that are kept of each coordinate.
PLANES = 4
#: Of 1024 four-bit coordinates 240 differ on average at 0.75, with a standard deviation of 13.6; 4.5 of them are allowed (a miss below 4e-6).
MOST_DIFFERENT = 301
CHUNK = 200
#: Ids of documents to verify are broadcast up to this number (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(5))
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLDEN = 0x9E3779B97F4A7C15
_STEP = np.uint64(_GOLDEN)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block, and where each document's begin (n+1 values)."""
    h, at = tk.words(buf, off)
    size = np.diff(at)
    n = len(h)
    roll = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        roll += h[j : j + len(roll)] * _ODD[j]
    whole = np.repeat(at[1:], size)[: len(roll)] >= np.arange(len(roll)) + k
    few = np.flatnonzero((size > 0) & (size < k))
    single = np.zeros(len(few), np.uint64)
    for j in range(k - 1):
        has = size[few] > j
        single[has] += h[at[few[has]] + j] * _ODD[j]
    single += _ODD[k] * size[few].astype(np.uint64)
    counts = np.maximum(size - k + 1, 0)
    counts[few] = 1
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(start[-1], np.uint64)
    long = np.ones(len(out), bool)
    long[start[few]] = False
    out[long] = roll[whole]
    out[~long] = single
    out = tk.mix(out)
    for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if e - s > 1:
            out[s:e].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[start[:-1][counts > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[start]


def sketches(sets: np.ndarray, at: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates per document; t is a power of two. Empty sets give rows of ones."""
    docs = len(at) - 1
    best = np.full(docs * t, _EMPTY, np.uint64)
    size = np.diff(at)
    live = np.flatnonzero(size > 0)
    i = 0
    while len(live) and i < t:
        own = size[live]
        x = sets[np.repeat(at[live] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())]
        row = np.repeat(live * t, own)
        rounds = int(min(t - i, max(1, 60_000 // len(x))))
        for step in range(i, i + rounds):
            h = tk.mix(x + np.uint64(_GOLDEN * (step + 1) % (1 << 64)))
            np.minimum.at(best, row + (h & np.uint64(t - 1)).astype(np.int64), np.uint64(step << 53) | h >> np.uint64(11))
        i += rounds
        live = live[(best.reshape(docs, t)[live] == _EMPTY).any(axis=1)]
    for d in live.tolist():  # t rounds did not fill every bin: round t + j fills bin j
        own = sets[at[d] : at[d + 1]]
        bins = np.flatnonzero(best[d * t : (d + 1) * t] == _EMPTY)
        h = tk.mix(own[None, :] + _STEP * (bins[:, None] + t + 1).astype(np.uint64))
        best[d * t + bins] = (np.uint64(1 << 63) | h >> np.uint64(11)).min(axis=1)
    return best.reshape(docs, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), np.uint64)
    part = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    for j in range(rows):
        keys += tk.mix(part[:, :, j]) * _ODD[j]
    return tk.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)


def bit_planes(sketch: np.ndarray) -> np.ndarray:
    """The low bits of each coordinate: the lowest of all, then the next ones, as 64-bit words."""
    planes = [np.packbits((sketch >> np.uint64(b)) & np.uint64(1) != 0, axis=1) for b in range(PLANES)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


SKETCH = "doc_id long, h long, n_shingles long, class1 long, class2 long, bands array<long>, bits array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in tk.blocks(batch.column("text")):
            sets, at = shingle_sets(buf, off)
            sketch = sketches(sets, at)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            classes = [pa.array(tk.segment_sums(tk.mix(sets ^ _ODD[j]), at).view(np.int64)) for j in (8, 9)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "h")] + [pa.array(np.diff(at)), *classes, listed(band_keys(sketch)), listed(bit_planes(sketch))],
                names=[c.split()[0] for c in SKETCH.split(", ")],
            )


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text) and text: a distinct text of a doc_id is told by (doc_id, h)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def sketch_table(docs: DataFrame) -> DataFrame:
    """A sketch of every row, with a number of its own (row) once it is written."""
    return texts_of(docs).mapInArrow(_sketch, SKETCH).withColumn("row", F.monotonically_increasing_id())


def alike_in_size(a: str, b: str) -> "F.Column":
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def different(a: str, b: str) -> "F.Column":
    """How many kept coordinates differ."""
    words = COORDINATES // 64
    x, y = F.col(a), F.col(b)
    parts = []
    for i in range(words):
        bits = x[i].bitwiseXOR(y[i])
        for plane in range(1, PLANES):
            k = i + plane * words
            bits = bits.bitwiseOR(x[k].bitwiseXOR(y[k]))
        parts.append(F.bit_count(bits))
    return sum(parts[1:], parts[0])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by centre and chunk, the centre's text first."""
    key, centres = None, []
    for batch in batches:
        a, chunk, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "chunk", "b"))
        first = batch.column("is_centre").to_numpy(zero_copy_only=False)
        out: list[tuple[int, int]] = []
        for lo, hi, buf, off in tk.blocks(batch.column("text")):
            sets, at = shingle_sets(buf, off)
            for i in range(lo, hi):
                own = sets[at[i - lo] : at[i - lo + 1]]
                if (a[i], chunk[i]) != key:
                    key, centres = (a[i], chunk[i]), []
                if first[i]:
                    centres.append(own.copy())
                    continue
                for c in centres:
                    both = int((c[np.minimum(np.searchsorted(c, own), len(c) - 1)] == own).sum()) if len(c) else 0
                    if both and 100 * both >= PERCENT * (len(c) + len(own) - both):
                        out.append((a[i], b[i]))
                        break
        if out:
            x = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def files_for(rows: int, of: int = 1_000_000) -> int:
    return rows // of + 1


def verified(texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are linked. pairs is a written table of distinct pairs; texts: node and text of each of their nodes."""
    spark = pairs.sparkSession
    files = files_for(pairs.count())
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = keep(chunks.coalesce(files), name + "-chunks")
    members = pairs.join(chunks, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), "b", F.lit(False).alias("is_centre"))
    centres = chunks.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"), F.col("a").alias("b"), F.lit(True).alias("is_centre"))
    rows = members.unionByName(centres).join(texts, "node").select("a", "chunk", "b", "is_centre", "text")
    rows = rows.repartition(shuffle_width(spark), "a", "chunk").sortWithinPartitions("a", "chunk", F.desc("is_centre"))
    out = keep(rows.mapInArrow(_verify, "a long, b long").distinct().coalesce(files), name)
    forget(chunks)
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge. edges: a written table with columns a, b."""
    files = files_for(edges.count())
    kept = lambda df: keep(df.coalesce(files), name)
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")))
        large = kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        forget(edges, least)
        # Small star: a node and its neighbours below it go to the least of them.
        least = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        down = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = kept(down.where("a <> b").distinct())
        forget(large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._kept = edges._kept
            return out
        state = now


def linked(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, h, n_shingles, root (its component's node, null without one) and component_id."""
    table = keep(sketch_table(docs), "sketches")
    some = table.where("n_shingles > 0 and doc_id is not null")
    # A node is a distinct set; nodes are numbered in the order of least doc_ids. Only numbers are aggregated, so in hash tables; rows of a class have the same sketch.
    classes = some.groupBy("class1", "class2").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"))
    classes = keep(classes.orderBy("rep", "class1", "class2").withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = table.join(classes.select("row", "node"), "row").select("node", "doc_id", "h", F.col("n_shingles").alias("n"), "bands", "bits")
    reps = keep(reps, "representatives")
    entries = reps.select(F.explode("bands").alias("key"), "node", "n")
    buckets = entries.groupBy("key").agg(F.min("node").alias("centre"), F.min_by("n", "node").alias("centre_n"), F.count("*").alias("members")).where("members > 1")
    buckets = keep(buckets, "buckets")
    entries = keep(entries.join(buckets, "key"), "entries")
    forget(buckets)
    bits = reps.select("node", "bits")
    stars = entries.where("node <> centre").where(alike_in_size("n", "centre_n")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")
    stars = keep(stars.where(different("x", "y") <= MOST_DIFFERENT).select("a", "b").distinct(), "stars")
    links = verified(wanted_texts(docs, some, reps, stars), stars, "star-links")
    found = components(links, "star-components")
    forget(links)

    # Buckets that still hold several components.
    open_ = entries.where("members > 2")
    open_ = open_.join(found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    open_ = open_.join(found.select(F.col("node").alias("centre"), "root"), "centre", "left").withColumn("centre_comp", F.coalesce("root", "centre"))
    open_ = keep(open_.select("key", "node", "n", "comp", "centre", (F.col("comp") != F.col("centre_comp")).alias("outside")), "open")
    forget(entries)
    keys = keep(open_.where("outside").select("key").distinct(), "open-keys")
    slim = reps.select("node", "bits", "bands")
    outside = open_.where("outside").join(slim, "node")
    others = open_.where("node <> centre").join(keys, "key", "left_semi").join(slim, "node")
    x = keep(outside.select("key", *(F.col(c).alias("x_" + c) for c in ("node", "n", "comp", "bits", "bands"))), "open-x")
    y = keep(others.select("key", *(F.col(c).alias("y_" + c) for c in ("node", "n", "comp", "bits", "bands", "outside"))), "open-y")
    fits = (
        (x["key"] == y["key"])
        & (F.col("x_comp") != F.col("y_comp"))
        & (~F.col("y_outside") | (F.col("x_node") < F.col("y_node")))
        & alike_in_size("x_n", "y_n")
        & (different("x_bits", "y_bits") <= MOST_DIFFERENT)
        & (F.filter(F.arrays_zip("x_bands", "y_bands"), lambda b: b["x_bands"] == b["y_bands"])[0]["x_bands"] == x["key"])
    )
    rest = x.join(y, fits).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    rest = keep(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    forget(open_, keys, x, y, stars)
    if not rest.isEmpty():
        more = verified(wanted_texts(docs, some, reps, rest), rest, "rest-links")
        both = keep(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "links")
        forget(found, more)
        found = components(both, "components")
        forget(both)
    forget(rest, reps)

    # The least node of a component has its least doc_id.
    rooted = keep(classes.join(found, "node", "left").select("class1", "class2", F.coalesce("root", "node").alias("root")), "rooted")
    own = keep(rooted.join(classes.select(F.col("node").alias("root"), F.col("rep").alias("component_id")), "root"), "components")
    forget(classes, found, rooted)
    out = table.select("doc_id", "h", "n_shingles", "class1", "class2").join(own, ["class1", "class2"], "left")
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(has, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "h", "n_shingles", F.when(has, F.col("root")).alias("root"), component.alias("component_id"))
    out._reads = table, own
    return out


def wanted_texts(docs: DataFrame, some: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of the nodes of pairs."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = keep(reps.select("node", "doc_id", "h").join(nodes, "node", "left_semi"), "wanted")
    few = ids.count() <= BROADCAST_IDS
    texts = texts_of(docs).join(F.broadcast(ids) if few else ids, ["doc_id", "h"])
    # A row that is repeated is sent once.
    if not some.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    return texts.select("node", "text")


def clusters(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    found = linked(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns: one row of each component, and all rows without a component.

    Of a component that is a row of its least doc_id: among several the one whose text, then whose whole row, has the least hash.
    """
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    keys = [F.col(f"c{place(docs, 'doc_id')}").cast("long").alias("doc_id"), F.xxhash64(F.col(f"c{place(docs, 'text')}").cast("string")).alias("h")]
    rows = plain.select("*", *keys)
    every = linked(docs)
    found = keep(every.where("root is not null"), "found")
    forget(*every._reads)
    first = found.where("doc_id = component_id").groupBy("root").agg(F.min("h").alias("least_h"), F.count("*").alias("n"))
    ties = keep(first.where("n > 1").select("root", "least_h").coalesce(1), "ties")
    tied = not ties.isEmpty()
    again = found.where("doc_id = component_id").join(ties, "root")
    gone = found.where("doc_id <> component_id").select("doc_id", "h")
    if tied:
        gone = gone.union(again.where("h <> least_h").select("doc_id", "h"))
    gone = keep(gone.distinct(), "gone")
    if not tied:
        forget(found)
    few = gone.count() <= BROADCAST_IDS
    out = rows.join(F.broadcast(gone) if few else gone, ["doc_id", "h"], "left_anti")
    if tied:
        twice = again.where("h = least_h").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
        twice = keep(twice.coalesce(1), "repeated")
        forget(found)
        n = twice.count()
        if n:
            twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
            row = F.struct(*plain.columns)
            once = out.join(twice, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
            out = out.join(twice, ["doc_id", "h"], "left_anti").select(*plain.columns).unionByName(once)
    return out.select(*plain.columns).toDF(*docs.columns)
