"""The trie of all conversations' turns, by sorted shards and a skeleton of their splitters.

A turn is its role and text, kept as a SHA-256 digest and a number of words; a
path is the digests of a conversation's turns, one behind the other, so paths
sort as bytes. Conversations are cut into shards by (path, conv_id) at splitters
from a sample. A node whose members lie in more than one shard is a prefix of
the path of a splitter between them, so the trie of the splitter paths, the
skeleton, has all such nodes. It is broadcast. Every shard walks its sorted
paths and finishes all nodes that are not of the skeleton; of those that are it
gives partial aggregates, which are reduced by node, and the skeleton's own
subtree sums are made over its few nodes. Equal paths are cut by conv_id, so a
group of copies is spread over shards like any others.

The skeleton is bounded: splitters are thinned out evenly until their paths take
at most `skeleton_bytes`; shards are then larger, the result is the same. A list
of the conversations that end at a skeleton node goes from each shard as pieces
of text and through one running digest in order, because SHA-256 is sequential:
memory is one piece.

A conversation is ranked by an external sort and gathered as digests and word
counts, 40 bytes a turn, not as texts; a shard is held as its nodes.

Edge cases: turns go by turn (null first), then role and text; repeated turns
stay. A null role or text is empty. A row with a null conv_id takes no part. A
conversation that has no turn after rebuilding is a member of the root and ends
there. c % 20 has the sign of c, so c - c % 20 is nearer to 0. An empty table
gives an empty result, without a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import WORD, bounded_batches, partitions, tidy

#: Conversations of one shard, about; sampled conversations for each; bytes of all splitter paths.
SHARD = 512
OVERSAMPLE = 8
SKELETON_BYTES = 8 << 20
DIGEST = 32
#: Ids of one piece of a list of ends.
PIECE = 50_000
FAMILY = 20
MOST_SHARED = 3

_NODES = ("conv_id long, depth long, parent_conv_id long, parent_node int, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "ends_sha256 string, node int, words long, shard int, piece int, ends string")


def _digest(role: Column, text: Column) -> Column:
    """SHA-256 of the role's length, the role and the text, as bytes."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (d: digest, w: words of the text) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)).cast("int")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"), _digest(role, text).alias("d"), words.alias("w"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    ranked = rows.select("conv_id", place.alias("place"), "d", "w")
    ordered = F.array_sort(F.collect_list(F.struct("place", "d", "w")))
    return ranked.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """conv_id, path (digests as bytes) and words (of each turn): every conversation with its first turns from the head of its family."""
    own = stage(conversations(turns), "conversations")
    head = F.col("conv_id") - F.col("conv_id") % family
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = own.select("conv_id", "turns", head.alias("head"), h.alias("h")).join(heads, "head", "left")
    shared = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    rows = rows.select("conv_id", F.when(shared.isNull(), rest).otherwise(F.concat(shared, rest)).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""))
    return rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["w"]).alias("words"))


def splitters(rows: DataFrame, n: int, shard: int = SHARD, budget: int = SKELETON_BYTES) -> list[tuple[bytes, int]]:
    """Keys (path, conv_id) at which shards begin, from a sample by the hash of conv_id; their paths take at most `budget` bytes."""
    wanted = -(-n // shard) - 1
    if wanted < 1:
        return []
    parts = max(1, n // (OVERSAMPLE * (wanted + 1)))
    some = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(parts)) == 0).select("path", "conv_id")
    size = some.agg(F.sum(F.length("path") + 8)).first()[0] or 0
    if size > OVERSAMPLE * budget:
        some = some.where(F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(-(-size // (OVERSAMPLE * budget)))) == 0)
    # the sample takes about eight times the budget at most, unless a few paths of the sample are longer than that by themselves
    keys = sorted((bytes(r["path"]), r["conv_id"]) for r in some.collect())
    chosen = sorted({keys[len(keys) * i // (wanted + 1)] for i in range(1, wanted + 1)}) if keys else []
    while sum(len(p) for p, _ in chosen) > budget:
        chosen = chosen[1::2]
    return chosen


def skeleton(keys: list[tuple[bytes, int]]) -> dict[tuple[int, bytes], int]:
    """(parent node, digest) to node for all prefixes of the splitter paths; the root is node 0."""
    nodes: dict[tuple[int, bytes], int] = {}
    for path, _ in keys:
        at = 0
        for i in range(0, len(path), DIGEST):
            at = nodes.setdefault((at, path[i:i + DIGEST]), len(nodes) + 1)
    return nodes


def _common(a: bytes, b: bytes) -> int:
    """How many digests two paths share at their beginning."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m // DIGEST
    x = np.frombuffer(a, "u1", m) != np.frombuffer(b, "u1", m)
    return int(x.argmax()) // DIGEST


class _Walk:
    """The nodes of one shard, from its paths in order."""

    def __init__(self, shard: int, nodes: dict[tuple[int, bytes], int]):
        self.shard, self.nodes, self.path = shard, nodes, b""
        # parent's place, depth, skeleton node or None, words of the last text, least member, members, children, leaves, saved, ends
        self.all: list[list] = [[-1, 0, 0, 0, None, 0, 0, 0, 0, []]]
        self.open = [0]

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        same = _common(self.path, path)
        del self.open[same + 1:]
        for d in range(same, len(path) // DIGEST):
            up = self.all[self.open[-1]]
            node = None if up[2] is None else self.nodes.get((up[2], path[d * DIGEST:(d + 1) * DIGEST]))
            self.open.append(len(self.all))
            self.all.append([self.open[-2], d + 1, node, words[d], None, 0, 0, 0, 0, []])
        last = self.all[self.open[-1]]
        last[9].append(conv_id)
        self.path = path

    def batches(self):
        """Finished nodes, and partial ones of the skeleton."""
        for x in reversed(self.all):  # children come behind their parents
            ends = x[9]
            if ends:
                x[4] = min(ends) if x[4] is None else min(x[4], min(ends))
                x[5] += len(ends)
            if x[2] is None:
                x[8] += (x[5] - 1) * x[3]
                x[7] = x[7] or 1
            if x[0] >= 0:
                up = self.all[x[0]]
                up[4] = x[4] if up[4] is None else min(up[4], x[4])
                up[5] += x[5]
                if x[2] is None:  # children and sums of skeleton nodes are added up when they are whole
                    up[6] += 1
                    up[7] += x[7]
                    up[8] += x[8]
        rows = []
        for x in self.all:
            up = self.all[x[0]] if x[0] >= 0 else None
            if x[2] is None:
                digest = hashlib.sha256(",".join(map(str, sorted(x[9]))).encode()).hexdigest()
                known = up[4] if up[2] is None else None
                rows.append((x[4], x[1], known, up[2], x[5], x[6], x[7], x[8], digest, None, x[3], self.shard, None, None))
            else:
                ends = x[9]
                rows.append((x[4], x[1], None, None, x[5], x[6], x[7], x[8], None, x[2], x[3], self.shard, None, None))
                for i in range(0, len(ends), PIECE):
                    rows.append((None, None, None, None, None, None, None, None, None, x[2], None, self.shard, i // PIECE, ",".join(map(str, ends[i:i + PIECE]))))
            if len(rows) >= PIECE:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
_COLUMNS = [tuple(c.split()) for c in _NODES.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[kind]) for x, (_, kind) in zip(columns, _COLUMNS, strict=True)], [name for name, _ in _COLUMNS])


def shard_nodes(rows: DataFrame, keys: list[tuple[bytes, int]]) -> DataFrame:
    """Finished nodes of all shards, and partial aggregates and pieces of ends of skeleton nodes (`node` is not null); staged."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((keys, skeleton(keys)))

    def dealt(batches):
        splits = shared.value[0]
        for b in batches:
            at = [bisect_right(splits, (p, c)) for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "shard"])

    def walked(batches):
        walk = None
        for b in batches:
            for c, p, w, s in zip(*(b.column(n).to_pylist() for n in ("conv_id", "path", "words", "shard")), strict=True):
                if walk is None or walk.shard != s:
                    if walk is not None:
                        yield from walk.batches()
                    walk = _Walk(s, shared.value[1])
                walk.add(c, p, w)
        if walk is not None:
            yield from walk.batches()

    given = rows.select("conv_id", F.coalesce("path", F.lit(b"")).alias("path"), "words")
    placed = given.mapInArrow(tidy(dealt), "conv_id long, path binary, words array<int>, shard int")
    sorted_ = placed.repartition(max(partitions(spark), len(keys) + 1), "shard").sortWithinPartitions("shard", "path", "conv_id")
    return stage(sorted_.mapInArrow(tidy(walked), _NODES), "nodes")


def _ends(pieces: DataFrame) -> dict[int, str]:
    """SHA-256 of the whole list of ends of each skeleton node, piece by piece in order."""

    def mapped(batches):
        node, digest = None, None
        for b in batches:
            for n, text in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if n != node:
                    if node is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])
                    node, digest = n, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    rows = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece").select("node", "ends")
    return {r["node"]: r["ends_sha256"] for r in rows.mapInArrow(tidy(mapped), "node int, ends_sha256 string").collect()}


def finish_skeleton(found: DataFrame, keys: list[tuple[bytes, int]]) -> list[tuple]:
    """Rows of the skeleton's nodes (node first) from the shards' partial aggregates. As many as the skeleton has, so bounded."""
    parts = found.where("node IS NOT NULL AND piece IS NULL").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("words").alias("words"))
    whole = {r["node"]: r.asDict() for r in parts.collect()}
    ends = _ends(found.where("piece IS NOT NULL"))
    parent = {node: up for (up, _), node in skeleton(keys).items()}
    for node in sorted(whole, reverse=True):  # a node's number is greater than its parent's
        x = whole[node]
        x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
        x["n_leaves"] = x["n_leaves"] or 1
        if node:
            up = whole[parent[node]]
            up["n_children"] += 1
            up["n_leaves"] += x["n_leaves"]
            up["saved_tokens"] += x["saved_tokens"]
    none = hashlib.sha256(b"").hexdigest()
    return [(n, x["conv_id"], x["depth"], whole[parent[n]]["conv_id"] if n else None, x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"],
             ends.get(n, none)) for n, x in sorted(whole.items())]


def trie(turns: DataFrame, shard: int = SHARD, skeleton_bytes: int = SKELETON_BYTES, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations."""
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = stage(rebuilt(turns, family, most), "rebuilt")
    keys = splitters(rows, rows.count(), shard, skeleton_bytes)
    found = shard_nodes(rows, keys)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    schema = "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    whole = spark.createDataFrame(finish_skeleton(found, keys), schema)
    ups = whole.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("up"))
    local = found.where("node IS NULL").join(F.broadcast(ups), "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    return local.select(*columns).unionByName(whole.select(*columns))
