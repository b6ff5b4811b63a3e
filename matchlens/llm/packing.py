"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Only documents longer than the capacity are cut, into full pieces and a last
shorter one. The packing itself looks at nothing but how many pieces have each
length, at most `capacity` numbers, so it is made once on the driver for any
amount of data: a bin is filled greedily with the longest pieces that fit, then
its smallest piece gives way to the two unpacked pieces that fill the widened
gap most tightly, as long as that helps. The same bin is repeated for as long as
its lengths last; at most sum(capacity / length) different bins arise. Pieces
take their places by rank among those of equal length. Ranks come from counts by
(length, bucket), so a length that a third of all pieces share is spread over
many tasks.

Edge cases: null and empty text is a document of the end id alone. Repeated rows
are documents of their own. A null doc_id is kept. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import bounded_batches, partitions, tidy, tokenizer_path
from .tokens import encoder

CAPACITY = 2048
END_ID = 0


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece of every document."""

    def mapped(batches):
        enc = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc, held = [], [], [], [], [], []
            for d, encoded in zip(b.column("doc_id").to_pylist(), enc.encode_all(b.column("text").to_pylist()), strict=True):
                ids = np.frombuffer(encoded + end, dtype="<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at:at + capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        held.append(cut)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(mapped), schema)


def best_bin(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one bin from what is left in `counts` (by length), which is not changed."""
    left = counts.copy()
    places = np.arange(capacity + 1)
    floor = np.maximum.accumulate(np.where(left > 0, places, 0))

    def longest(most: int) -> int:
        x = int(floor[most])
        while x and not left[x]:
            x = int(floor[x - 1])
        return x

    items: list[int] = []
    gap = capacity
    while gap and (x := longest(gap)):
        n = min(int(left[x]), gap // x)
        items += [x] * n
        left[x] -= n
        gap -= n * x
    while gap and items:
        least = items[-1]
        room = gap + least
        floor = np.maximum.accumulate(np.where(left > 0, places, 0))
        a = np.flatnonzero(left[:room + 1])
        if not len(a):
            break
        b = floor[np.minimum(a, room - a)]
        twice = (b == a) & (left[a] < 2)
        b = np.where(twice, floor[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        best = int(total.argmax())
        if total[best] <= least:
            break
        items[-1:] = [int(a[best]), int(b[best])]
        items.sort(reverse=True)
        left[least] += 1
        left[a[best]] -= 1
        left[b[best]] -= 1
        gap = room - int(total[best])
    return items


@dataclass(frozen=True)
class Plan:
    """Places by (length, rank): a slot is a run of ranks that go to one place of consecutive sequences."""

    keys: np.ndarray  # length << 40 | first rank
    sequences: np.ndarray  # of the first rank
    offsets: np.ndarray
    n_sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (lengths << 40) | ranks
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequences[at] + (key - self.keys[at]), self.offsets[at]


def make_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        counts[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    slots: list[tuple[int, int, int]] = []
    sequence = 0
    while counts.any():
        items = best_bin(counts, capacity)
        kinds, each = np.unique(items, return_counts=True)
        times = int((counts[kinds] // each).min())
        offset = 0
        for x in items:
            slots.append(((x << 40) | int(used[x]), sequence, offset))
            used[x] += times
            offset += x
        counts[kinds] -= each * times
        sequence += times
    slots.sort()
    keys, sequences, offsets = (np.array(x, dtype=np.int64) for x in zip(*slots, strict=True)) if slots else [np.zeros(0, np.int64)] * 3
    return Plan(keys, sequences, offsets, sequence)


def with_rank(pieces: DataFrame) -> DataFrame:
    """`pieces` (staged) with rank, the place among the pieces of equal length, from 0."""
    buckets = 4 * partitions(pieces.sparkSession)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(bases, ["length", "bucket"])
    return ranked.select(*pieces.columns, (F.col("base") + F.col("own") - 1).alias("rank"))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Any table with `length` (1 to capacity), doc_id, piece and ids_crc32, to the same with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(make_plan(counts, capacity))
    ranked = with_rank(pieces)

    def mapped(batches):
        for b in batches:
            seq, off = shared.value.place(np.asarray(b.column("length")), np.asarray(b.column("rank")))
            kept = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(tidy(mapped), schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset; `with_ids` adds the ids themselves."""
    bounded_batches(docs.sparkSession)
    return place(stage(token_pieces(docs, path or tokenizer_path(), capacity, end_id, with_ids), "pieces"), capacity)
