"""Best-fit packing by a linear grouping scheme.

Documents become token ids (plus an end id) and pieces of at most `capacity` tokens.  Where pieces go is
decided on the histogram of piece lengths, which has at most `capacity` rows however large the input is:

1. Linear grouping: large lengths are dealt in descending order into groups of equal cardinality, and each
   counts as the longest length of its group.
2. Configurations: sets of few rounded sizes that fill a sequence are found by a bit-set subset sum, each
   applied as often as the demand allows.
3. Substitution: actual lengths take the slots of their group; what rounding left over is free space again.
4. Best fit: small lengths, longest first, go where the least space is left.

The result is a list of runs (length, ranks lo..hi -> sequences), so that documents are placed by their rank
among pieces of equal length.  Ranks are counted in salted groups, so a hot length is spread over tasks.

Null texts count as empty (one end id); empty tables give empty results; repeated rows are packed as often
as they occur; further columns of the input are ignored.  Very long texts are cut whole, nothing is dropped.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.frames import keep

CAPACITY = 2048
END_ID = 0
GROUPS = 4096
#: Lengths above this share of the capacity are large.
LARGE = 1 / 4
SALTS = 64
#: Fixed value: the pattern that splits texts for this family of byte-level tokenizers.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + k)] = b
    return table


class Encoder:
    """Ids of texts as the tokenizer file defines them.

    A byte-level file whose merges are in the order of its ids is run by the faster library on ranks read from
    that same file; other files, and texts that contain a special token, go through `tokenizers`.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        in_order = model.get("type") == "BPE" and not model.get("ignore_merges") and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if spec.get("normalizer") or not in_order or not level:
            return None
        import tiktoken

        back = byte_alphabet()
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, on demand, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*enc.encode(text.as_py() or ""), end_id], "<u4")
                doc = doc_id.as_py()
                for k, (s, n) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[s : s + n]
                    rows.append((doc, k, s, n, zlib.crc32(part.tobytes())) + ((part.astype(np.int64),) if with_ids else ()))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


class Plan:
    """Runs that place ranks of each length: (length, lo, hi, first sequence, offset, pieces of this run in a sequence)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.used = dict.fromkeys(histogram, 0)
        self.left = {n: c for n, c in histogram.items() if c}
        self.sequences = 0
        #: Free space -> stretches of sequences (first, count) that have it.
        self.space: dict[int, list[tuple[int, int]]] = {}
        if self.left and (min(self.left) < 1 or max(self.left) > capacity):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        self._large([n for n in sorted(self.left, reverse=True) if n > capacity * large], groups)
        self._small()

    def _place(self, length: int, count: int, base: int, offset: int, per: int = 1) -> None:
        lo = self.used[length]
        self.runs.append((length, lo, lo + count, base, offset, per))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _large(self, lengths: list[int], groups: int) -> None:
        total = sum(self.left[n] for n in lengths)
        share = max(1, -(-total // groups))
        # Equal-cardinality groups over lengths in descending order; a length may belong to two neighbouring groups.
        sizes: list[int] = []
        stock: list[list[list[int]]] = []  # per group: [length, count], longest first
        room = 0
        for n in lengths:
            count = self.left[n]
            while count:
                if not room:
                    sizes.append(n)
                    stock.append([])
                    room = share
                take = min(room, count)
                stock[-1].append([n, take])
                room -= take
                count -= take
        # Neighbours of equal rounded size are one size.
        merged: dict[int, list[list[int]]] = {}
        for size, items in zip(sizes, stock, strict=True):
            merged.setdefault(size, []).extend(items)
        sizes, stock = list(merged), list(merged.values())
        demand = [sum(c for _, c in items) for items in stock]
        for g in range(len(sizes)):
            while demand[g]:
                config = self._configuration(sizes, demand, g)
                times = min(demand[k] // c for k, c in config.items())
                for k, c in config.items():
                    demand[k] -= c * times
                self._substitute([k for k, c in config.items() for _ in range(c)], stock, times)

    def _configuration(self, sizes: list[int], demand: list[int], g: int) -> dict[int, int]:
        """Rounded sizes with g among them that fill a sequence best; of equal fills the one with the longest sizes."""
        rest = self.capacity - sizes[g]
        usable = [k for k in range(g, len(sizes)) if demand[k] - (k == g) and sizes[k] <= rest]
        limit = (1 << (rest + 1)) - 1
        reach, layers = 1, []
        for k in reversed(usable):
            layers.append((k, reach))
            copies = min(demand[k] - (k == g), rest // sizes[k])
            for _ in range(copies):
                more = (reach | reach << sizes[k]) & limit
                if more == reach:
                    break
                reach = more
        config, need = {g: 1}, reach.bit_length() - 1
        for k, below in reversed(layers):
            while need and not (below >> need) & 1:
                config[k] = config.get(k, 0) + 1
                need -= sizes[k]
        return config

    def _substitute(self, slots: list[int], stock: list[list[list[int]]], times: int) -> None:
        """Put actual lengths into the slots of `times` sequences of one configuration."""
        while times:
            # How many sequences get the same lengths: no slot may run out of the length at the end of its group's stock.
            wanted: dict[int, int] = {}
            for k in slots:
                wanted[k] = wanted.get(k, 0) + 1
            step, chosen = times, {}
            for k, c in wanted.items():
                picks: list[int] = []
                if stock[k][-1][1] >= c:
                    step = min(step, stock[k][-1][1] // c)
                    picks = [stock[k][-1][0]] * c
                else:  # the last lengths of several entries, one sequence at a time
                    step = 1
                    pool = [list(x) for x in stock[k]]
                    while len(picks) < c:
                        picks.append(pool[-1][0])
                        pool[-1][1] -= 1
                        if not pool[-1][1]:
                            pool.pop()
                chosen[k] = picks
            offset = 0
            for k, picks in chosen.items():
                for n in picks:
                    self._place(n, step, self.sequences, offset)
                    offset += n
                    stock[k][-1][1] -= step
                    if not stock[k][-1][1]:
                        stock[k].pop()
            self._free(self.capacity - offset, self.sequences, step)
            self.sequences += step
            times -= step

    def _free(self, space: int, first: int, count: int) -> None:
        if space:
            self.space.setdefault(space, []).append((first, count))

    def _small(self) -> None:
        for n in sorted(self.left, reverse=True):
            while count := self.left.get(n, 0):
                fits = [s for s in self.space if s >= n]
                if not fits:
                    per = self.capacity // n
                    full, rest = divmod(count, per)
                    for some, each in ((full, per), (1 if rest else 0, rest)):
                        if some:
                            self._place(n, some * each, self.sequences, 0, each)
                            self._free(self.capacity - n * each, self.sequences, some)
                            self.sequences += some
                    continue
                best = min(fits)
                first, have = self.space[best].pop()
                per = min(best // n, count)
                some = min(have, count // per)
                if some < have:
                    self.space[best].append((first + some, have - some))
                if not self.space[best]:
                    del self.space[best]
                self._place(n, some * per, first, self.capacity - best, per)
                self._free(best - n * per, first, some)


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, salts: int = SALTS) -> DataFrame:
    """Add sequence_id and offset to pieces with a column length. Ties of equal lengths are placed by doc_id and piece."""
    salted = pieces_df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").count().collect()  # at most capacity * salts rows
    base: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in sorted(counts):
        base[r["length"], r["_salt"]] = total.get(r["length"], 0)
        total[r["length"]] = total.get(r["length"], 0) + r["count"]
    runs = sorted(Plan(total, capacity, groups).runs)
    key = np.array([n << 44 | lo for n, lo, *_ in runs], np.int64)
    where = np.array([x[1:] for x in runs], np.int64).reshape(-1, 5)
    bases = np.zeros((capacity + 1, salts), np.int64)
    for (n, s), b in base.items():
        bases[n, s] = b
    kept = pieces_df.sparkSession.sparkContext.broadcast((key, where, bases))  # bounded by capacity and salts
    window = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(window) - 1)
    out = "sequence_id long, offset long"
    names = [c for c in ranked.columns if c not in ("_salt", "_rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, where, bases = kept.value
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() + bases[n, batch.column("_salt").to_numpy()]
            at = np.searchsorted(key, n << 44 | rank, "right") - 1
            lo, _, first, offset, per = where[at].T
            row = (rank - lo) // per
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(first + row), pa.array(offset + (rank - lo) % per * n)], names=[*names, "sequence_id", "offset"]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_df.schema] + [out])
    return ranked.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents. The pieces are written once, as ranks and the histogram both read them."""
    return pack(keep(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces"), capacity)
