"""Exact top-k search by inner product, with a pivot table that eliminates candidates.

Vectors are integers, floor(256 x) of every component. A bounded sample gives the
pivots, far from each other; the distances of every vector to every pivot are
computed once and kept beside it. For a query q and a candidate x the triangle
inequality makes the greatest |d(q, p) - d(x, p)| over the pivots p a lower bound
of d(q, x), and since 2<q, x> = |q|^2 + |x|^2 - d(q, x)^2 an upper bound of the
score. A query meets candidates in the order of their bounds and stops at the
first bound below its k-th score so far, which is exact.

Vectors are ordered by nearest pivot and distance to it and cut by rank into
blocks, so a block is narrow, whatever group of equal vectors there is, and no
larger than `block` rows. Blocks have the same kind of bound by the ranges of
their distances. A block of queries first meets the block of candidates with the
greatest bound, then those that its least k-th score does not rule out. Pairs of
blocks are the unit of work; a task holds one pair, and emits only candidates
that reach what its queries already have.

The sample (`sample` rows) only steers the pivots: any pivots give exact results.

Edge cases: a vector that is null or holds a null or a component that is not
finite (also after scaling) takes no part, as query or as candidate. Of vectors
of different lengths the components that both have count. An empty vector scores
0. A row with a null vec_id is a candidate, behind others of its score. Repeated
rows are queries and candidates of their own; only the row itself is left out.
Scores outside 64 bits are held at their limits. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import bounded_batches, partitions, tidy
from .ranks import ranked

PIVOTS = 32
SAMPLE = 2048
BLOCK = 4096
QUERY_BLOCK = 512
SCALE = 256.0
#: Products below this add up exactly in doubles.
EXACT = float(1 << 52)
HUGE = 1e300
FIRST_STEP = 32


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of `rows` for what is executed within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def vectors(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """row (a number of its own), vec_id and v (doubles as bytes) of every vector that takes part; staged."""

    def mapped(batches):
        for b in batches:
            rows, ids, out = [], [], []
            for r, i, v in zip(b.column("row").to_pylist(), b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype("<f8"))
                if np.isfinite(x).all():
                    rows.append(r)
                    ids.append(i)
                    out.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["row", "vec_id", "v"])

    bounded_batches(embeddings.sparkSession)
    given = embeddings.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return stage(given.mapInArrow(tidy(mapped), "row long, vec_id long, v binary"), "vectors")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest of them."""
    out = np.zeros((len(blobs), max([len(x) // 8 for x in blobs], default=0)))
    for i, x in enumerate(blobs):
        out[i, :len(x) // 8] = np.frombuffer(x, dtype="<f8")
    return out


def _squares(a: np.ndarray) -> np.ndarray:
    """Squared lengths; infinite from `HUGE` on, where nothing is ruled out by a bound."""
    with np.errstate(over="ignore"):
        square = np.einsum("ij,ij->i", a, a)
    return np.where(square < HUGE, square, np.inf)


def distances(pivots: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row for each pivot; 0 for vectors of infinite length."""
    m = min(pivots.shape[1], a.shape[1])
    length = _squares(a)
    known = np.isfinite(length)
    near = np.where(known[:, None], a[:, :m], 0.0)
    square = _squares(pivots)[:, None] + np.where(known, length, 0.0)[None, :] - 2.0 * (pivots[:, :m] @ near.T)
    return np.where(known[None, :], np.sqrt(np.maximum(square, 0.0)), 0.0)


def choose_pivots(rows: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """At most `n` vectors of a sample, each the farthest from those before it."""
    some = rows.select("v", F.xxhash64("row", "v").alias("h")).orderBy("h", "v").limit(sample).collect()
    a = _matrix([bytes(r["v"]) for r in some])
    if len(a):  # outliers are far from everything alike, and their distances are known less exactly
        a = a[_squares(a) <= 16 * np.median(_squares(a))]
    chosen: list[int] = []
    least = np.full(len(a), np.inf)
    while len(chosen) < min(n, len(a)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(a[chosen[-1:]], a)[0])
    return np.where(np.isfinite(_squares(a[chosen]))[:, None], a[chosen], 0.0)


def _reach(pivots: np.ndarray) -> float:
    return float(np.sqrt(_squares(pivots).max(initial=0.0)))


_BLOCK_SCHEMA = "block long, n int, width int, ids binary, no_id binary, rows binary, v binary, squares binary, dist binary, lo array<double>, hi array<double>, most double"


def _blocks(rows: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """Rows with a `rank` as packed blocks of ranks; staged."""

    def packed(table):
        a = _matrix(table.column("v").to_pylist())
        square, dist = _squares(a), distances(pivots, a)
        ids = table.column("vec_id").combine_chunks()
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()), "n": pa.array([len(a)], pa.int32()), "width": pa.array([a.shape[1]], pa.int32()),
            "ids": [ids.fill_null(np.iinfo(np.int64).max).to_numpy().astype("<i8").tobytes()],
            "no_id": [ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes()],
            "rows": [table.column("row").combine_chunks().to_numpy().astype("<i8").tobytes()],
            "v": [a.astype("<f8").tobytes()], "squares": [square.astype("<f8").tobytes()], "dist": [dist.astype("<f8").tobytes()],
            "lo": pa.array([dist.min(axis=1).tolist()], pa.list_(pa.float64())), "hi": pa.array([dist.max(axis=1).tolist()], pa.list_(pa.float64())),
            "most": pa.array([float(square.max())]),
        })

    dealt = rows.select("row", "vec_id", "v", F.floor(F.col("rank") / block).alias("block"))
    return stage(dealt.groupBy("block").applyInArrow(packed, _BLOCK_SCHEMA), "blocks")


@dataclass
class Block:
    ids: np.ndarray
    no_id: np.ndarray
    rows: np.ndarray
    v: np.ndarray
    squares: np.ndarray
    dist: np.ndarray

    @classmethod
    def of(cls, r: dict, prefix: str) -> Block:
        n = r[prefix + "n"]
        return cls(
            np.frombuffer(r[prefix + "ids"], "<i8"), np.frombuffer(r[prefix + "no_id"], "u1"), np.frombuffer(r[prefix + "rows"], "<i8"),
            np.frombuffer(r[prefix + "v"], "<f8").reshape(n, -1), np.frombuffer(r[prefix + "squares"], "<f8"),
            np.frombuffer(r[prefix + "dist"], "<f8").reshape(-1, n))


def _scores(q: np.ndarray, a: np.ndarray, exact: bool) -> np.ndarray:
    m = min(len(q), a.shape[1])
    if exact:
        return (a[:, :m] @ q[:m]).astype(np.int64)
    whole = [int(y) for y in q[:m]]
    limits = np.iinfo(np.int64)
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, whole, strict=True)), limits.min), limits.max) for row in a[:, :m]], dtype=np.int64)


def meet(q: Block, x: Block, known: np.ndarray, k: int, reach: float) -> tuple[list[np.ndarray], np.ndarray, int]:
    """For each query the places in `x` of its best `k` that reach its `known` k-th score, the k-th score now, and how many were scored.

    `reach` is the greatest length of a pivot: distances are known to about a millionth of the lengths that they come from.
    """
    found, least, scored = [], known.copy(), 0
    most = float(q.squares.max()), float(x.squares.max())
    exact = max(most) < np.inf and most[0] * most[1] < EXACT * EXACT
    for i in range(len(q.ids)):
        gap = np.zeros(len(x.ids))
        for p in range(len(x.dist)):
            np.maximum(gap, np.abs(x.dist[p] - q.dist[p, i]), out=gap)
        sums = q.squares[i] + x.squares
        slack = 1e-6 + 1e-9 * sums  # more than rounding can be
        bound = (sums - np.maximum(gap - 1e-6 * (1 + reach + np.sqrt(sums)), 0.0) ** 2) / 2 + slack
        open_ = np.flatnonzero((bound >= known[i]) & (x.rows != q.rows[i]))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        best, best_scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_STEP
        while at < len(order) and bound[order[at]] >= least[i]:
            cut = order[at:at + step]
            best = np.concatenate([best, cut])
            best_scores = np.concatenate([best_scores, _scores(q.v[i], x.v[cut], exact)])
            scored += len(cut)
            keep = np.lexsort((x.rows[best], x.no_id[best], x.ids[best], -best_scores.astype(np.float64) if exact else [-int(s) for s in best_scores]))[:k]
            best, best_scores = best[keep], best_scores[keep]
            if len(best) == k:
                least[i] = max(least[i], float(best_scores[-1]))
            at, step = at + step, 2 * step
        keep = best_scores >= known[i]
        found.append((best[keep], best_scores[keep]))
    return found, least, scored


_FOUND = "array<struct<query_row:long,query_id:long,row:long,vec_id:long,score:long>>"
_MET_SCHEMA = f"q_block long, x_block long, least double, known binary, n_scored long, found {_FOUND}"


def _meet_pairs(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, reach: float) -> DataFrame:
    """Pairs (q_block, x_block, known) of blocks to what they find; staged."""

    def mapped(batches):
        for b in batches:
            for r in b.to_pylist():
                q, x = Block.of(r, "q_"), Block.of(r, "x_")
                known = np.full(len(q.ids), -np.inf) if r["known"] is None else np.frombuffer(r["known"], "<f8")
                found, least, scored = meet(q, x, known, k, reach)
                each = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
                at, score = (np.concatenate(part).astype(np.int64) for part in zip(*found, strict=True))
                rows = pa.StructArray.from_arrays([
                    pa.array(q.rows[each]), pa.array(q.ids[each], mask=q.no_id[each] > 0), pa.array(x.rows[at]),
                    pa.array(x.ids[at], mask=x.no_id[at] > 0), pa.array(score)], ["query_row", "query_id", "row", "vec_id", "score"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["q_block"]]), pa.array([r["x_block"]]), pa.array([float(least.min())]), pa.array([least.astype("<f8").tobytes()]),
                    pa.array([scored]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                ], ["q_block", "x_block", "least", "known", "n_scored", "found"])

    spark = pairs.sparkSession

    def named(blocks, prefix):
        return blocks.select(*[F.col(c).alias(prefix + c) for c in ("block", "n", "ids", "no_id", "rows", "v", "squares", "dist")])

    both = pairs.repartition(4 * partitions(spark), "q_block", "x_block").join(named(queries, "q_"), "q_block").join(named(candidates, "x_"), "x_block")
    both = both.repartition(4 * partitions(spark), "q_block", "x_block")  # a pair is the unit of work: few rows, many tasks
    with batches_of(spark, 4):
        return stage(both.mapInArrow(tidy(mapped), _MET_SCHEMA), "met")


def _block_bounds(queries: DataFrame, candidates: DataFrame, n_blocks: int, reach: float) -> DataFrame:
    """(q_block, x_block, bound): the greatest score that a pair of blocks can hold."""
    q = queries.select(F.col("block").alias("q_block"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.col("most").alias("q_most"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("x_block"))
    x = candidates.select(F.col("block").alias("x_block"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), F.col("most").alias("x_most"))
    gap = F.expr("coalesce(array_max(transform(sequence(0, size(q_lo) - 1), i -> greatest(q_lo[i] - x_hi[i], x_lo[i] - q_hi[i], 0D))), 0D)")
    sums = F.col("q_most") + F.col("x_most")
    held = F.greatest(gap - (F.sqrt(sums) + F.lit(1 + reach)) * 1e-6, F.lit(0.0))
    return q.join(x, "x_block").select("q_block", "x_block", ((sums - held * held) / 2 + 1e-6 + sums * 1e-9).alias("bound"))


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK,
          sample: int = SAMPLE, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` best of each row whose vec_id is divisible by `every`."""
    found, _ = search(embeddings, every, k, pivots, block, query_block, sample, scale)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search(embeddings: DataFrame, every: int, k: int, pivots: int, block: int, query_block: int, sample: int, scale: float) -> tuple[DataFrame, DataFrame]:
    """Rows that hold the best `k` of each query, a few for each, and the table of the pairs of blocks that met."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings, scale)
    points = choose_pivots(rows, pivots, sample)
    if not len(points):
        empty = rows.limit(0).select(F.lit(0).cast("int").alias("i"))
        none = empty.select(F.from_json(F.lit("[]"), _FOUND).alias("found"), F.lit(0).cast("long").alias("n_scored"))
        return none.select(F.inline("found")), none

    def near(batches):
        for b in batches:
            if b.num_rows:
                dist = distances(points, _matrix(b.column("v").to_pylist()))
                cell = dist.argmin(axis=0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist[cell, np.arange(len(cell))])], [*b.schema.names, "cell", "d"])

    placed = rows.mapInArrow(tidy(near), "row long, vec_id long, v binary, cell int, d double")
    keys = (F.col("cell"), F.col("d"), F.col("row"))
    candidates = _blocks(ranked(placed, *keys), points, block)
    queries = _blocks(ranked(placed.where(F.col("vec_id") % every == 0), *keys), points, query_block)
    n_blocks, reach = candidates.count(), _reach(points)
    bounds = stage(_block_bounds(queries, candidates, n_blocks, reach), "bounds")
    first = bounds.groupBy("q_block").agg(F.max_by("x_block", F.struct("bound", "x_block")).alias("x_block"))
    met = _meet_pairs(first.withColumn("known", F.lit(None).cast("binary")), queries, candidates, k, reach)
    known = met.select("q_block", F.col("x_block").alias("first"), "known", "least")
    rest = bounds.join(known, "q_block").where((F.col("x_block") != F.col("first")) & (F.col("bound") >= F.col("least")))
    all_met = met.unionByName(_meet_pairs(rest.select("q_block", "x_block", "known"), queries, candidates, k, reach))
    return all_met.select(F.inline("found")), all_met
