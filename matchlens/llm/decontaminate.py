"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is contained in a document if at least `threshold` of the item's
distinct word shingles occur in it. Items are partitioned by their number of
shingles m. The sketch of an item is its k least shingle hashes (a bottom-k
MinHash), where k = m - ceil(threshold * m) + 1: a document that holds enough of
the m shingles cannot miss all of any k of them, so no contained item is lost,
however long the document. A document with fewer shingles than a partition's
least need is not searched for that partition. Candidates are verified on the
shingles themselves.

Items are a stated query set: they are read on the driver in blocks of bounded
size, and all documents are searched for each block. Items with fewer words than
a shingle are one shingle of all their words, and are sought at that length.

Text is compared in lower case, and without punctuation at the edges of words.

Edge cases: items without words match nothing; null and empty documents match
nothing. Repeated items and repeated documents give a row each per pair of rows
(equal ids of equal texts are alike); null ids are kept. Empty tables give an
empty result. Other columns are not read. Long texts are read whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Shingles of the items of one block, a few dozen bytes each: the bound of what is broadcast.
BLOCK_SHINGLES = 500_000
#: Partitions of the items by size are powers of this.
SIZE_STEP = 2

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+(?:[^\x20\x09-\x0D]*[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])?")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Lower-case words from their first to their last letter or digit."""
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


def shingle_set(tokens: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(tokens[i:i + size]) for i in range(len(tokens) - size + 1)}


class WordHashes:
    """64-bit hashes of words, kept for a bounded number of words."""

    KEPT = 200_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.KEPT:
            known.clear()
        for w in tokens:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words from the words' hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, size):
        out *= _MULTIPLIER
        out ^= out >> np.uint64(29)
        out += h[i:i + n]
    return out


class Block:
    """The sketches and shingles of some items."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, threshold: float):
        hashes = WordHashes()
        self.items = []
        sketches: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (shingle size, size class) -> (hash, item)
        for item_id, text in items:
            tokens = words(text)
            if not tokens:
                continue
            own = min(size, len(tokens))
            shingles = shingle_set(tokens, own)
            need = math.ceil(threshold * len(shingles) - 1e-9)
            least = np.sort(np.unique(shingle_hashes(hashes(tokens), own)))[: len(shingles) - need + 1]
            k = len(self.items)
            self.items.append((item_id, own, shingles, need))
            sketches.setdefault((own, int(math.log(len(shingles), SIZE_STEP))), []).extend((int(x), k) for x in least)
        self.parts = []
        for (own, _), entries in sorted(sketches.items()):
            entries.sort()
            need = min(self.items[k][3] for _, k in entries)
            self.parts.append((own, need, np.array([h for h, _ in entries], dtype=np.uint64), np.array([k for _, k in entries])))

    def search(self, text: str | None, hashes: WordHashes) -> list[tuple[int, int]]:
        """(place of the item, shingles found) of every item contained in the text."""
        tokens = words(text)
        if not tokens:
            return []
        h, by_size, sets, out = hashes(tokens), {}, {}, []
        for own, need, sketch, owners in self.parts:
            if len(tokens) - own + 1 < need:
                continue
            if own not in by_size:
                by_size[own] = shingle_hashes(h, own)
            found = by_size[own]
            at = np.searchsorted(sketch, found)
            hit = np.flatnonzero(sketch[np.minimum(at, len(sketch) - 1)] == found)
            if not len(hit):
                continue
            values = np.unique(found[hit])
            lo, hi = np.searchsorted(sketch, values, "left"), np.searchsorted(sketch, values, "right")
            candidates = sorted({int(owners[j]) for a, b in zip(lo, hi, strict=True) for j in range(a, b)})
            if own not in sets:
                sets[own] = shingle_set(tokens, own)
            for k in candidates:
                shared = len(self.items[k][2] & sets[own])
                if shared >= self.items[k][3]:
                    out.append((k, shared))
        return out


def blocks_of(benchmark: DataFrame, size: int, threshold: float, block_shingles: int):
    """The items in blocks, streamed to the driver a partition at a time."""
    held, shingles = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        shingles += len(words(r["text"]))
        if shingles >= block_shingles:
            yield Block(held, size, threshold)
            held, shingles = [], 0
    if held:
        yield Block(held, size, threshold)


def contained_items(
    docs: DataFrame, benchmark: DataFrame, *, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment for every item contained in a document."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    found = None
    for block in blocks_of(benchmark, size, threshold, block_shingles):
        part = rows.mapInArrow(tidy(_searcher(docs.sparkSession.sparkContext.broadcast(block))), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _searcher(shared):
    def mapped(batches):
        hashes = WordHashes()
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, n in shared.value.search(text, hashes):
                    item_id, _, shingles, _ = shared.value.items[k]
                    out.append((doc, item_id, len(shingles), n, n / len(shingles)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.float64())],
                ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return mapped


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without those that contain an item. Rows of one id are judged together; rows with a null id stay."""
    leaked = contained_items(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
