"""I-Match document fingerprints from randomised lexicon subsets.

The lexicon holds the terms (lower-cased words) whose inverse document frequency lies in a band: those in at most a
tenth and at least one in 10,000 of all documents, and in two at least.  At most (mean distinct terms
of a document) * 10,000 terms can be that frequent, whatever the corpus.  A lexicon of up to `MOST_TERMS` is broadcast; a larger one stays in
files of the shared folder, which tasks go through one by one for the words of some texts at a time, with the same result.  Document
frequencies are counted over all rows.

Each of `SUBSETS` randomised subsets of the lexicon keeps a term with probability 2^-j; a document's sorted distinct
terms within a subset are hashed.  j follows the number of the document's terms so that about `AIM` of them are
left: one changed term then spoils few of the subsets.  Two neighbouring j are kept, so texts of
somewhat different length still have one in common.  A subset misses all terms of either document with probability (1 - r)^u and all
that they don't share with (1 - r)^(u (1 - J)), u terms in the union and J their share in common: so the shares of
subsets empty in both, and equal in both, give J, which is the likeness.  It is taken at the common j that fewer
subsets leave empty; 1 for equal fingerprints, 0 with no common j.

A document without terms in the band is fingerprinted by all of its words, one without words as empty.  Null texts count as
empty.  Equal texts have equal fingerprints.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.frames import forget, keep, shuffle_width
from quillon.llm.warc import file_system

MOST_COMMON, LEAST_COMMON = 0.1, 1e-4
#: Terms that are broadcast (8 bytes each), and terms of a file of a larger lexicon.
MOST_TERMS, FILE_TERMS = 12_000_000, 2_000_000
SUBSETS = 64
AIM = 0.75
#: About so many documents lie between two bounds of the order of doc_id, with at most so many bounds.
SPAN, MOST_BOUNDS = 1000, 10_000
_GOLDEN = 0x9E3779B97F4A7C15


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents): added up within a task as far as memory allows."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        terms, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(terms, kind="stable")
        terms, n = terms[order], n[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        return terms[first], np.add.reduceat(n, first) if len(first) else n

    def out(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "df"])

    for batch in batches:
        for _, _, buf, off in tk.blocks(batch.column(0)):
            h, at = tk.words(buf, off)
            owner = tk.owners(at)
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h = h[new]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            parts.append((h[first], np.diff(np.append(first, len(h)))))
            held += len(first)
            if held > 3_000_000:
                parts = [merged()]
                held = len(parts[0][0])
                if held > 1_500_000:
                    yield out(*parts[0])
                    parts, held = [], 0
    if parts:
        yield out(*merged())


Terms = np.ndarray | list[str]


def lexicon(docs: DataFrame, most: float = MOST_COMMON, least: float = LEAST_COMMON, most_terms: int = MOST_TERMS, file_terms: int = FILE_TERMS) -> Terms:
    """Hashes of the terms in the band, ascending; of more than most_terms the files that hold them."""
    n = docs.count()
    df = docs.select(F.col("text").cast("string")).mapInArrow(_document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    chosen = keep(df.where((F.col("df") >= max(2.0, least * n)) & (F.col("df") <= most * n)).select("term"), "lexicon")
    size = chosen.count()
    if size <= most_terms:
        terms = np.sort(chosen.toArrow().column("term").to_numpy().view(np.uint64))
        forget(chosen)
        return terms
    files = keep(chosen.repartition(-(-size // file_terms)), "lexicon-files")
    forget(chosen)
    return sorted(files.inputFiles())


def in_files(files: list[str], words: np.ndarray) -> np.ndarray:
    """Those of ascending distinct words that are in the files."""
    found = [np.zeros(0, np.uint64)]
    for uri in files:
        store, path = file_system(uri)
        terms = pq.read_table(path, columns=["term"], filesystem=store).column("term").to_numpy().view(np.uint64)
        found.append(words[np.isin(words, terms)])
    return np.sort(np.concatenate(found))


class Prints:
    """Fingerprints of blocks of texts: j of each (-1: by all words, -2: empty) and hashes, n x 2 x SUBSETS, 0 for an empty subset."""

    def __init__(self, terms: Terms):
        self.files = terms if isinstance(terms, list) else None
        self.terms = None if self.files else tk.HashTable(terms)
        #: Bytes of texts that are looked at together.
        self.together = tk.BLOCK * (64 if self.files else 1)

    def of(self, column: pa.Array) -> list[tuple[str, int, np.ndarray]]:
        if self.files:
            own = [np.unique(tk.words(buf, off)[0]) for _, _, buf, off in tk.blocks(column)]
            self.terms = tk.HashTable(in_files(self.files, np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))))
        out: list[tuple[str, int, np.ndarray]] = []
        for _, _, buf, off in tk.blocks(column):
            out += self._block(buf, off)
        return out

    def _block(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[str, int, np.ndarray]]:
        docs = len(off) - 1
        h, at = tk.words(buf, off)
        owner = tk.owners(at)
        known = self.terms.find(h) >= 0
        plain = np.bincount(owner[known], minlength=docs) == 0  # no term in the band: all words count
        use = known | plain[owner]
        h, owner = h[use], owner[use]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        n = np.bincount(owner, minlength=docs)
        j = np.maximum(np.floor(np.log2(np.maximum(n, 1) / AIM)), 0).astype(np.int64)
        limit = [np.uint64(2**64 - 1) >> (j + s).astype(np.uint64) for s in (0, 1)]
        value = tk.mix(h)
        hashes = np.zeros((docs, 2, SUBSETS), np.uint64)
        for k in range(SUBSETS):
            u = tk.mix(h + np.uint64(_GOLDEN * (k + 1) % (1 << 64)))
            near = np.flatnonzero(u <= limit[0][owner])
            for s in (0, 1):
                chosen = near if s == 0 else near[u[near] <= limit[1][owner[near]]]
                np.add.at(hashes[:, s, k], owner[chosen], value[chosen] | np.uint64(1))
        short = np.where(hashes > 0, tk.mix(hashes) >> np.uint64(40) | np.uint64(1), np.uint64(0)).astype(np.uint32)
        out = []
        for d in range(docs):
            if not n[d]:
                out.append(("empty", -2, short[d]))
            else:
                mark = "w" if plain[d] else "t"
                out.append((f"{mark}{j[d]}:" + "".join(f"{x:06x}" for x in short[d].ravel().tolist()), int(j[d]) + 1000 * plain[d], short[d]))
        return out


def likeness(a: tuple[str, int, np.ndarray], b: tuple[str, int, np.ndarray]) -> float:
    if a[0] == b[0]:
        return 1.0
    best, share = 0, 0.0
    for s in (0, 1):
        t = a[1] + s - b[1]
        if a[1] >= 0 and b[1] >= 0 and t in (0, 1):
            x, y = a[2][s], b[2][t]
            told = int(((x > 0) | (y > 0)).sum())
            if told > best:
                equal = int((x == y).sum())
                empty = min(SUBSETS - told, SUBSETS - 0.5) if told < SUBSETS else 0.5
                best, share = told, 1 - np.log(max(equal, empty) / SUBSETS) / np.log(empty / SUBSETS)
    return float(min(1.0, max(0.0, share)))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first, or all of them."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def with_edited(docs: DataFrame, terms: Terms) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and likenesses; the next document is the one of next larger doc_id.

    Texts are shuffled once, compressed, by spans of doc_id, and each span is read in order; the first text of a span is also
    sent to the span before it.  Null doc_ids come first; equal doc_ids are ordered by their compressed texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    tally = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.count("doc_id").alias("known")).first()
    spans = min(MOST_BOUNDS, tally["n"] // SPAN + 1)
    bounds = np.zeros(0, np.int64)
    if spans > 1 and tally["known"]:
        share = [k / spans for k in range(1, spans)]
        found = ids.agg(F.percentile_approx("doc_id", share, 100 * spans)).first()[0]
        bounds = np.unique(np.array([x for x in found if x > tally["least"]], np.int64))
    nulls = tally["known"] < tally["n"]
    if nulls and tally["known"]:
        bounds = np.union1d(bounds, [tally["least"]])
    first = None if nulls else tally["least"]
    sent = spark.sparkContext.broadcast(terms)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = press.compress(text.as_buffer())
                span = 0 if doc is None else int(np.searchsorted(bounds, doc, "right"))
                out.append((span, False, doc, z))
                if doc == first:
                    out.append((len(bounds), True, doc, z))
                if span and bounds[span - 1] == doc:
                    out.append((span - 1, True, doc, z))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["span", "ghost", "doc_id", "z"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        prints = Prints(sent.value)
        held: list[tuple[int | None, bool, str]] = []
        size, span, closed = 0, None, False

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if len(held) > 1:
                texts = [t for _, _, t in held]
                changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
                own, new = prints.of(pa.array(texts, pa.string())), prints.of(pa.array(changed, pa.string()))
                cols = [
                    pa.array([d for d, _, _ in held[:-1]], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                    pa.array([p[0] for p in own[:-1]]),
                    pa.array([p[0] for p in new]),
                    pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            held = [] if last else held[-1:]
            size = 0

        for batch in batches:
            for s, ghost, doc, z in zip(*(batch.column(c).to_pylist() for c in ("span", "ghost", "doc_id", "z")), strict=True):
                if s != span:
                    yield from emit(True)
                    span, closed = s, False
                if closed:
                    continue
                closed = ghost
                text = unpress.decompress(z).decode()
                held.append((doc, ghost, text))
                size += len(text)
                if size > prints.together:
                    yield from emit(False)
        yield from emit(True)

    dealt = rows.mapInArrow(deal, "span int, ghost boolean, doc_id long, z binary").repartition(shuffle_width(spark), "span")
    return dealt.sortWithinPartitions("span", "ghost", F.asc_nulls_first("doc_id"), "z").mapInArrow(read, OUT)


def fingerprints(docs: DataFrame, terms: Terms) -> DataFrame:
    """doc_id and fingerprint of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in prints.of(batch.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    return with_edited(docs, lexicon(docs))
