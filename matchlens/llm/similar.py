"""Near-duplicates by the Jaccard similarity of word shingle sets: SimHash and MinHash bands find candidates, the sets themselves decide.

A text's set is that of its `SHINGLE_WORDS`-word runs (64-bit hashes, ASCII case
folded; a shorter text is one run). Two texts are linked if their sets' Jaccard
similarity is at least 0.8, in whole numbers 9 * common >= 4 * (sizes' sum).

Equal sets are one point. Candidates come from two sources. The grid of `simhash`
proposes what its fingerprints link. `BANDS` bands of `ROWS` minima propose what
lies further apart in bits: a pair of similarity 0.8 shares no band with
probability (1 - 0.8 ** 5) ** 32, 3 in a million, more similar ones less.
Candidates are compared in two rounds:

1. Each point with those that the grid links to it, and with the least point of
   all its buckets (a bucket: the points of one band value). This joins most of a
   group of near copies and is linear in its size.
2. What is left are buckets that hold more than one component. The largest
   component of such a bucket is its core; a core's points are compared with the
   points of other components in its buckets (its fringe), and those with each
   other, each set being sent once for each core, not for each bucket. Points of
   one component are never compared.

Both rounds are dealt in blocks by the number of shingles, so no task grows with
a group: a core of any size against a small fringe sends each set once.

Texts without words have the empty set and equal each other. Ids are treated as
in `simhash`.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from . import simhash
from .common import bounded_batches, exploded_join, tidy
from .components import components
from .simhash import SEED, fingerprint, keep_least, shingle_hashes

SHINGLE_WORDS = 5
#: Least similarity of a link.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 5
#: Shingles that one side of a comparison holds at a time.
BLOCK_SHINGLES = 1 << 16
#: Shingles that all minima are taken of at a time.
MINIMA_BLOCK = 2048


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; empty without words."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, shingle_words, seed)]))


def set_key(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def permutations(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)


def bands(members: np.ndarray, permuted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash for each band of minima of `members` under the permutations x -> a * x + b (a odd) of 32 bits."""
    if not len(members):
        return np.zeros(0, dtype=np.int64)
    a, b = permuted
    x = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), MINIMA_BLOCK):
        np.minimum(least, ((a | np.uint32(1)) * x[at:at + MINIMA_BLOCK] + b).min(axis=1), out=least)
    data = least.tobytes()
    width = 4 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[i * width:(i + 1) * width], i) for i in range(BANDS)], dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint fp of `simhash` (signed), key of the shingle set, its size n and its bands, one row for each input row."""

    def mapped(batches):
        permuted = permutations()
        for batch in batches:
            prints, keys, sizes, found = [], [], [], []
            for text in batch.column("text").to_pylist():
                prints.append(fingerprint(text))
                members = shingle_set(text)
                keys.append(set_key(members))
                sizes.append(len(members))
                found.append(bands(members, permuted))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, dtype=np.int64), *found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                ["doc_id", "fp", "key", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(mapped), "doc_id long, fp long, key binary, n long, bands array<long>")


def joined(nodes: list[int], labels: list[int], sets: list[np.ndarray], split: int) -> list[tuple[int, int]]:
    """Links that join whatever is similar and differs in label: among all if split is 0, else of the first `split` with the rest."""
    sizes = np.array([len(s) for s in sets])
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    label, held, out = np.array(labels), np.zeros(len(distinct), dtype=bool), []
    less, more = SIMILARITY
    for i in range(split or len(sets) - 1):
        first = split or i + 1
        size = sizes[first:]
        if not ((label[first:] != label[i]) & (np.minimum(size, sizes[i]) * more >= np.maximum(size, sizes[i]) * less)).any():
            continue
        own = at[ends[i] - sizes[i]:ends[i]]
        held[own] = True
        start = ends[first] - sizes[first]
        common = np.bincount(owner[start:][held[at[start:]]] - first, minlength=len(size))
        held[own] = False
        for j in (np.flatnonzero((less + more) * common >= less * (size + sizes[i])) + first).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((nodes[i], nodes[j]))
    return out


def compared(dealt: DataFrame) -> DataFrame:
    """Links (u, v) of rows (core, a, b, right, node, label, members) dealt in pairs of blocks a, b of a core; a block with itself if a = b."""
    columns = ("core", "a", "b", "right", "node", "label", "members")

    def mapped(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for (_, a, b), group in groupby(rows, key=lambda row: row[:3]):
            *_, rights, nodes, labels, members = zip(*group, strict=True)
            split = rights.count(False) if a != b else 0
            if len(nodes) > 1 and (a == b or 0 < split < len(nodes)):
                some = joined(list(nodes), list(labels), [np.frombuffer(m, dtype=np.uint64) for m in members], split)
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in some], pa.int64()), pa.array([v for _, v in some], pa.int64())], ["u", "v"])

    placed = dealt.select(*columns).repartition("core", "a", "b").sortWithinPartitions("core", "a", "b", "right")
    return placed.mapInArrow(tidy(mapped), "u long, v long")


def buckets(points: DataFrame) -> DataFrame:
    """(band, node, n, first) of the bands that more than one point has; first is the bucket's least point."""
    placed = points.select(F.explode("bands").alias("band"), "node", "n")
    shared = placed.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    return exploded_join(placed, shared.drop("last"), "band")


def shingle_sets(docs: DataFrame, points: DataFrame) -> DataFrame:
    """node and members (its sorted shingle hashes) of `points` (node, key), from the text of that id and key."""

    def mapped(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            right = pa.array([set_key(s) == k for s, k in zip(sets, b.column("key").to_pylist(), strict=True)], pa.bool_())
            held = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), held], ["node", "members"]).filter(right)

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(points.select("node", "key"), "node")
    # an id may come with the same text twice
    return texts.mapInArrow(tidy(mapped), "node long, members binary").dropDuplicates(["node"])


def _blocks(shingles: Column, block_shingles: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(shingles / block_shingles)).cast("int")


def _block(of: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(of), blocks).cast("int")


def print_links(known: DataFrame, points: DataFrame) -> DataFrame:
    """(node, n, first): points whose fingerprints the grid of `simhash` links, each with the lesser one, and points of one fingerprint with its least."""
    placed = stage(known.select("key", "fp").distinct().join(points.select("key", "node", "n"), "key").select("fp", "node", "n"), "prints")
    prints = stage(placed.groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("p")).select("fp", "p.node", "p.n"), "print-points")
    equal = placed.join(prints.select("fp", F.col("node").alias("first")), "fp").where("first < node").select("node", "n", "first")
    far = simhash.links(prints.select("fp", "node")).select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("first")).where("first < node").distinct()
    return equal.union(far.join(prints.groupBy("node").agg(F.first("n").alias("n")), "node").select("node", "n", "first")).distinct()


def star_links(shared: DataFrame, near: DataFrame, points: DataFrame, sets: DataFrame, block_shingles: int) -> DataFrame:
    """First round: each point with its `first` in `near` (node, n, first) and the least point of its buckets, where their sizes allow a link."""
    less, more = SIMILARITY
    stars = shared.groupBy("node").agg(F.min("first").alias("first"), F.first("n").alias("n")).where("first < node")
    stars = stars.select("node", "n", "first").union(near).distinct()
    sizes = points.groupBy(F.col("node").alias("first")).agg(F.first("n").alias("first_n"))
    stars = stars.join(sizes, "first").where(F.least("n", "first_n") * more >= F.greatest("n", "first_n") * less)
    stars = stage(stars, "stars")
    heads = stars.groupBy("first").agg(_blocks(F.sum("n"), block_shingles).alias("blocks"))
    rays = stars.select("first", "node").join(heads, "first").join(sets, "node").select(
        F.col("first").alias("core"), F.lit(-1).alias("a"), _block(F.col("node"), F.col("blocks")).alias("b"), F.lit(True).alias("right"), "node", "members")
    centres = heads.join(sets.withColumnRenamed("node", "first"), "first").select(
        F.col("first").alias("core"), F.lit(-1).alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(False).alias("right"),
        F.col("first").alias("node"), "members")
    return compared(centres.unionByName(rays).withColumn("label", F.col("node")))


def fringe_links(shared: DataFrame, roots: DataFrame, sets: DataFrame, block_shingles: int) -> DataFrame:
    """Second round: the points of buckets that hold several components (roots: node, root), by core."""
    told = stage(shared.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("label")), "told")
    counted = told.groupBy("band", "label").agg(F.sum("n").alias("size"))
    cores = counted.groupBy("band").agg(F.max_by("label", F.struct("size", "label")).alias("core"), F.count("*").alias("labels"))
    members = stage(told.join(cores.where("labels > 1").drop("labels"), "band").select("core", "node", "label", "n").distinct(), "fringes")
    inner = F.col("label") == F.col("core")
    sizes = members.groupBy("core").agg(
        _blocks(F.sum(F.when(~inner, F.col("n"))), block_shingles).alias("outer"), _blocks(F.sum(F.when(inner, F.col("n"))), block_shingles).alias("inner"))
    held = members.join(sizes, "core").join(sets, "node").withColumn("block", F.when(inner, _block(F.col("node"), F.col("inner"))).otherwise(_block(F.col("node"), F.col("outer"))))
    # blocks of the fringe are 0 .. outer - 1, those of the core follow; a fringe block meets all, a core block the fringe only
    end = F.col("outer") - 1 + F.when(inner, 0).otherwise(F.col("inner"))
    own = F.col("block") + F.when(inner, F.col("outer")).otherwise(0)
    pairs = held.select("core", "node", "label", "members", own.alias("own"), F.explode(F.sequence(F.lit(0), end)).alias("other"))
    return compared(pairs.select(
        "core", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("right"), "node", "label", "members"))


def links(docs: DataFrame, points: DataFrame, near: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, key, n, bands), key distinct, and candidates `near` (node, n, first) to links (u, v) of nodes; similar points that share a band reach each other through links."""
    shared, near = stage(buckets(points), "buckets"), stage(near, "near")
    asked = shared.select("node").union(near.select("node")).union(near.select("first")).distinct()
    sets = stage(shingle_sets(docs, points.join(asked, "node", "left_semi")), "sets")
    first = stage(star_links(shared, near, points, sets, block_shingles), "first-links")
    second = fringe_links(shared, components(first), sets, block_shingles)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id and component_id (least doc_id that links reach), one row for each input row."""
    bounded_batches(docs.sparkSession)
    known = stage(sketches(docs), "sketches")
    points = stage(known.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), "points")
    own = points.where("node is not null")
    roots = components(links(docs, own, print_links(known, own), block_shingles))
    classes = points.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    return known.join(classes, "key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """`docs` without near-duplicates: of each component the document with the least id stays, as in `simhash.one_of_each`."""
    return keep_least(docs, near_duplicates(docs, block_shingles))
