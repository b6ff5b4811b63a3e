"""Importance resampling of documents towards a target text distribution.

Features are runs of one and two words, hashed into buckets. What the corpus and
the target hold of each bucket gives its gain, and a document's weight is the
mean gain of its features, read from an array of gains by its buckets. Scores
add Gumbel noise from a hash of the document's id, so the highest scores are a
draw without replacement in proportion to exp(weight / 1000).

The highest `k` are found by weighted median-of-medians selection. Keys (score,
doc_id, row) lie in sorted blocks. In each round every block gives the median of
its keys that are still open, every task the weighted median of its blocks'
medians, and the driver the weighted median of the tasks' ones, by the numbers of
open keys: at least an eighth of the open keys lie on either side of it, so each
round discards an eighth or more, whatever the scores look like. The round that
counts the keys before a median also gives the medians on both of its sides, so a
round is one job. The last `last` keys or fewer are compared directly. The driver
gets a row for each task. The winners alone are sorted, by ranges.

Edge cases: null text has no words. A null doc_id is hashed as an empty string
and counts as the greatest id in ties. Repeated rows are documents of their own;
of rows that tie in score and id one is before the other. A document without
features weighs 0. A target without features has t = T = 0. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import bounded_batches, tidy
from .ranks import ranked

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Keys of one block, and keys that are compared directly at the end.
BLOCK = 65_536
LAST = 4_096
NO_ID = np.iinfo(np.int64).max


def _folding() -> bytes:
    """A-Z in lower case; 0-9, a-z and bytes of characters beyond ASCII as they are; a space for all others."""
    keep = {b for b in range(256) if b >= 128 or chr(b).isalnum()}
    return bytes(ord(chr(b).lower()) if b in keep and b < 128 else b if b in keep else 32 for b in range(256))


FOLD = _folding()


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def feature_buckets(found: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of all words and pairs of neighbours; a pair's checksum goes on from its first word's."""
    ones = list(map(crc32, found))
    twos = list(map(crc32, [b" " + w for w in found[1:]], ones))
    return np.array(ones + twos, dtype=np.uint32) % buckets


def features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words and the buckets of all features (16 or 32 bits each); staged."""
    bounded_batches(docs.sparkSession)
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def mapped(batches):
        for b in batches:
            n, out = [], []
            for text in b.column("text").to_pylist():
                found = words(text)
                n.append(len(found))
                out.append(feature_buckets(found, buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["row", "doc_id", "n_words", "buckets"])

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return stage(given.mapInArrow(tidy(mapped), "row long, doc_id long, n_words long, buckets binary"), "features")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a table of features; a task adds up its own rows first."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def mapped(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for x in b.column("buckets"):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype=kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.select("buckets").mapInArrow(tidy(mapped), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of smoothed frequencies, rounded down."""
    n, big_s, big_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (big_s + n) / ((s + 1.0) * (big_t + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def scored(rows: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight and score of every document; staged."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def mapped(batches):
        for b in batches:
            n, weight = [], []
            for x in b.column("buckets"):
                at = np.frombuffer(x.as_buffer(), dtype=kind)
                n.append(len(at))
                weight.append(int(gains[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "doc_id", "n_words")), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                ["row", "doc_id", "n_words", "n_features", "weight"])

    weighed = rows.mapInArrow(tidy(mapped), "row long, doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return stage(weighed.withColumn("score", F.col("weight") + noise), "scored")


Key = tuple[int, int, int]


def _weighted_median(found: list[tuple[Key, int]]) -> Key | None:
    """The least key such that keys up to it carry half of the weight."""
    half, seen = sum(n for _, n in found) / 2, 0
    for key, n in sorted(found):
        seen += n
        if seen >= half:
            return key
    return None


def _search(block: tuple[np.ndarray, np.ndarray, np.ndarray], key: Key) -> int:
    """How many keys of a sorted block are less than `key`."""
    lo, hi = 0, len(block[0])
    for part, value in zip(block, key, strict=True):
        lo, hi = lo + int(np.searchsorted(part[lo:hi], value, "left")), lo + int(np.searchsorted(part[lo:hi], value, "right"))
    return lo


def key_blocks(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """Keys (score, doc_id, row), greatest score first, as sorted blocks of at most `block` keys; staged."""

    def packed(score, ids, rows):
        order = np.lexsort((rows, ids, -score))
        return [x[order].astype("<i8").tobytes() for x in (-score, ids, rows)]

    def mapped(batches):
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                held.append([part.column("score").to_numpy(), part.column("doc_id").fill_null(int(NO_ID)).to_numpy(), part.column("row").to_numpy()])
                n += part.num_rows
                while n >= block:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in packed(*[x[:block] for x in whole])], ["score", "ids", "rows"])
                    held, n = [[x[block:] for x in whole]], n - block
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in packed(*[np.concatenate(x) for x in zip(*held, strict=True)])], ["score", "ids", "rows"])

    given = keys.select(F.col("score").cast("long"), F.col("doc_id").cast("long"), F.col("row").cast("long"))
    return stage(given.mapInArrow(tidy(mapped), "score binary, ids binary, rows binary"), "keys")


_ROUND_SCHEMA = "n long, side int, score long, id long, row long"


def _round(blocks: DataFrame, lo: Key | None, mid: Key | None, hi: Key | None) -> list:
    """For the open keys (lo <= key < hi) on either side of `mid`: a task's number of keys and weighted median. Side 0 is before `mid`."""

    def mapped(batches):
        found: tuple[list, list] = ([], [])
        for b in batches:
            for r in b.to_pylist():
                block = tuple(np.frombuffer(r[c], "<i8") for c in ("score", "ids", "rows"))
                first = 0 if lo is None else _search(block, lo)
                end = len(block[0]) if hi is None else _search(block, hi)
                cut = first if mid is None else min(max(_search(block, mid), first), end)
                for side, (a, z) in enumerate(((first, cut), (cut, end))):
                    if z > a:
                        at = (a + z - 1) // 2
                        found[side].append((tuple(int(x[at]) for x in block), z - a))
        for side, some in enumerate(found):
            if some:
                key = _weighted_median(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.int64() if i != 1 else pa.int32()) for i, x in enumerate((sum(n for _, n in some), side, *key))],
                    ["n", "side", "score", "id", "row"])

    return blocks.mapInArrow(tidy(mapped), _ROUND_SCHEMA).collect()


def cutoff(blocks: DataFrame, k: int, last: int = LAST) -> Key | None:
    """The k-th key (from 1) of all, as (-score, doc_id, row); None for k of 0."""
    if k <= 0:
        return None
    lo = hi = None
    before = 0  # keys before lo
    answer = _round(blocks, None, None, None)
    while True:
        n = sum(r["n"] for r in answer)
        if n <= last:
            return _open_keys(blocks, lo, hi)[k - before - 1]
        mid = _weighted_median([((r["score"], r["id"], r["row"]), r["n"]) for r in answer])
        after = (mid[0], mid[1], mid[2] + 1)  # so that the median itself is among the keys before
        sides = _round(blocks, lo, after, hi)
        less = sum(r["n"] for r in sides if r["side"] == 0)
        if before + less >= k:
            hi, answer = after, [r for r in sides if r["side"] == 0]
        else:
            lo, before, answer = after, before + less, [r for r in sides if r["side"] == 1]


def _open_keys(blocks: DataFrame, lo: Key | None, hi: Key | None) -> list[Key]:
    """All keys within, in order: at most the `last` of `cutoff`."""

    def mapped(batches):
        for b in batches:
            for r in b.to_pylist():
                block = tuple(np.frombuffer(r[c], "<i8") for c in ("score", "ids", "rows"))
                a, z = 0 if lo is None else _search(block, lo), len(block[0]) if hi is None else _search(block, hi)
                yield pa.RecordBatch.from_arrays([pa.array(x[a:z]) for x in block], ["score", "id", "row"])

    return sorted(tuple(r) for r in blocks.mapInArrow(tidy(mapped), "score long, id long, row long").collect())


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
             block: int = BLOCK, last: int = LAST) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document; `target` has a column text."""
    rows = features(docs, buckets)
    aimed = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    out = scored(rows, bucket_gains(bucket_counts(rows, buckets), bucket_counts(aimed, buckets)), seed)
    able = F.col("n_words") >= min_words
    k = percent * out.where(able).count() // 100
    key = cutoff(key_blocks(out.where(able), block), k, last)
    columns = ["doc_id", "n_features", "weight", "score"]
    if key is None:
        return out.select(*columns, F.lit(None).cast("long").alias("rank"))
    own = F.struct(-F.col("score"), F.coalesce("doc_id", F.lit(int(NO_ID))), "row")
    drawn = able & (own <= F.struct(*[F.lit(x).cast("long") for x in key]))
    winners = ranked(out.where(drawn), F.desc("score"), F.coalesce("doc_id", F.lit(int(NO_ID))), F.col("row"))
    return winners.select(*columns, (F.col("rank") + 1).alias("rank")).unionByName(
        out.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
