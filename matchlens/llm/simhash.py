"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits are cut into 32 segments of two bits; a segment's bit
count is one coordinate. The Manhattan distance of two such points is never
more than the Hamming distance of the fingerprints, so it is a lower bound. Two
points within distance d differ in at most d coordinates. The coordinates are
dealt to 2 * d faces; every pair in range agrees on some d of them, so it meets
in a cell of one of the C(2 d, d) sub-grids. Inside a cell the lower bound, then
the fingerprints themselves are compared.

Equal fingerprints are one point. A cell yields a spanning forest of its links,
not its pairs. Cells with more points than `cell_points` are cut into blocks, and
each pair of blocks is a task of its own, so no task grows with a group.

Edge cases: null and empty texts, and texts without words, have fingerprint zero
and are linked like any other. Repeated rows and repeated ids are rows of their
own (the fingerprint is a row's, the component that of its fingerprint); rows
with a null id get a component of the other rows' least id, or null. An empty
table gives an empty result. Other columns are not read. A very long text is
hashed in blocks of bounded size.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import bounded_batches, exploded_join, tidy
from .components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Points of a cell that one task compares with each other.
CELL_POINTS = 2048
#: Shingles hashed at a time.
HASH_BLOCK = 1 << 16


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED):
    """64-bit hashes of all word shingles, repeats included, in blocks; a text of fewer words is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1
    n = max(1, len(words) - shingle_words + 1)
    last = ends[min(shingle_words, len(words)) - 1:] - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASH_BLOCK):
        cut = slice(at, at + HASH_BLOCK)
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts[:n][cut].tolist(), last[cut].tolist())], dtype=np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority bits of the 64-bit hashes of all word shingles, repeats included; 0 without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, shingle_words, seed):
        ones += np.add.reduce(np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row for each input row."""

    def mapped(batches):
        for b in batches:
            f = np.array([fingerprint(t, shingle_words, seed) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(mapped), "doc_id long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The popcount of each two-bit segment in unary (0: 00, 1: 01, 2: 11), so that XOR and popcount give the Manhattan distance."""
    one = np.uint64(0x5555555555555555)
    upper = fps >> np.uint64(1)
    return ((fps | upper) & one) | ((fps & upper & one) << np.uint64(1))


def faces(max_bits: int) -> list[int]:
    """Masks of the 2 * max_bits faces (one for distance 0) over the 32 coordinates."""
    n = max(1, 2 * max_bits)
    edges = [round(32 * i / n) for i in range(n + 1)]
    return [((1 << 2 * b) - (1 << 2 * a)) for a, b in zip(edges, edges[1:])]


def cells(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, node) to (cell, fp, node): a row for each sub-grid; a cell is known by sub-grid and its coordinates' values."""
    one = 0x5555555555555555
    fp = F.col("fp")
    upper = F.shiftrightunsigned(fp, 1)
    counts = fp.bitwiseOR(upper).bitwiseAND(F.lit(one)).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(F.lit(one)), 1))
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(sum(f)) for f in combinations(faces(max_bits), max(1, max_bits))]
    each = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    return points.withColumn("counts", counts).select(each.alias("cell"), "fp", "node")


def forest(fps: np.ndarray, nodes: np.ndarray, split: int, max_bits: int) -> list[tuple[int, int]]:
    """Links that join whatever is within `max_bits` bits: among all if split is 0, else of the first `split` with the rest."""
    n = len(fps)
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    counts, out = segment_counts(fps), []
    for i in range(split or n - 1):
        at = split or i + 1
        near = np.flatnonzero(np.bitwise_count(counts[i] ^ counts[at:]) <= max_bits) + at
        near = near[np.bitwise_count(fps[i] ^ fps[near]) <= max_bits]
        for j in near.tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[a] = b
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def links(points: DataFrame, max_bits: int = MAX_BITS, cell_points: int = CELL_POINTS) -> DataFrame:
    """(fp, node), fp distinct, to links (u, v) of nodes that join all points within `max_bits` bits."""
    placed = cells(points, max_bits)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / cell_points).cast("int")
    held = exploded_join(placed, sizes, "cell").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(F.least(b, F.col("block")).alias("a"), F.greatest(b, F.col("block")).alias("b")),
    ))
    dealt = held.select("cell", pair.alias("pair"), "block", "fp", "node").groupBy("cell", "pair").agg(
        F.collect_list(F.when(F.col("block") == F.col("pair.a"), F.struct("fp", "node"))).alias("left"),
        F.collect_list(F.when(F.col("block") != F.col("pair.a"), F.struct("fp", "node"))).alias("right"),
    ).select("left", "right")

    def compared(batches):
        for b in batches:
            us: list[int] = []
            vs: list[int] = []
            for left, right in zip(b.column("left"), b.column("right"), strict=True):
                x, y = left.values, right.values
                fps = np.concatenate([np.asarray(x.field("fp")), np.asarray(y.field("fp"))]).astype(np.int64).view(np.uint64)
                nodes = np.concatenate([np.asarray(x.field("node")), np.asarray(y.field("node"))])
                found = forest(fps, nodes, len(x) if len(y) else 0, max_bits)
                us += [u for u, _ in found]
                vs += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(tidy(compared), "u long, v long")


def near_duplicates(
    docs: DataFrame, *, max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, cell_points: int = CELL_POINTS,
) -> DataFrame:
    """doc_id, fp (signed long) and component_id (least doc_id that links reach), one row for each input row."""
    if not 0 <= max_bits <= 8:
        raise ValueError(f"max_bits must be 0 to 8 ({comb(16, 8)} sub-grids at 8)")
    bounded_batches(docs.sparkSession)
    prints = stage(with_fingerprint(docs, shingle_words, seed), "fingerprints")
    points = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "points")
    roots = components(links(points.where("node is not null"), max_bits, cell_points))
    classes = points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` without near-duplicates: of each component the document with the least id stays, every column kept.

    Rows of one id are judged together: the id stays if it is the least of a
    component of one of its rows, with its least text. Rows with a null id stay.
    """
    return keep_least(docs, near_duplicates(docs, **options))


def keep_least(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of `docs` that stay when `known` (doc_id, component_id) has a row for each of its rows."""
    known = known.where("doc_id is not null")
    status = known.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("_stays"), F.count("*").alias("_rows"))
    told = docs.join(stage(status.where("not _stays or _rows > 1"), "dropped"), "doc_id", "left")
    once = told.where("_stays is null").select(*docs.columns)
    return once.unionByName(_first_row(told.where("_stays").select(*docs.columns)))


def _first_row(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: that with the least text."""
    others = [c for c in rows.columns if c != "doc_id"]
    least = F.min_by(F.struct(*others), F.struct(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(*others).alias("h")))
    return rows.groupBy("doc_id").agg(least.alias("row")).select(*[
        F.col("doc_id") if c == "doc_id" else F.col("row").getField(c).alias(c) for c in rows.columns])
