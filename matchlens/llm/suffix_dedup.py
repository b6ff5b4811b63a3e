"""Removal of byte strings that also start in an earlier document, by prefix doubling on anchored positions.

Ranking every position would shuffle many times the input, so positions are
pruned first, without loss. Each window of `length` bytes is represented by an
anchor: its `FIRST`-byte string of least hash. Equal windows have equal anchors
at equal places, so a window that repeats has an anchor that repeats. Two rounds
follow, each sorting pairs of ranks (hashes of byte strings serve as ranks) and
keeping only what is not yet unique over documents:

1. (first bytes at the anchor, all bytes of the windows around it): anchors whose
   first bytes occur in one document only are unique and dropped; anchors whose
   windows all lie in an earlier document too are decided; the rest stay open.
2. the open anchors' windows at full length, compared byte by byte.

Before each shuffle a task keeps one entry per rank pair and batch, that of the
least doc_id, so a passage that very many documents share sends little. Ranks
that still have very many different surroundings are dealt by window, not by
anchor. Document bytes are shuffled once by doc_id; results come back as ranges.

Edge cases: null text is empty. Rows of equal doc_id are not earlier than each
other, so a repeated row is left alone. Rows without doc_id are left as they are
and count as earlier than none. Long texts are read whole, in segments. An empty
table gives an empty result. Columns whose names clash with the added ones
(n_bytes, n_removed, n_spans, kept) are replaced by them.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import bounded_batches, partitions, text_or_empty, tidy

LENGTH = 50
FIRST = 20
#: Bytes handled at a time.
CHUNK = 1 << 18
#: Bytes of texts whose entries are combined before the shuffle.
COMBINED = 6 << 20
#: Entries of the first round, and bytes of windows of the second, that a task sorts at a time.
SORTED_ENTRIES, SORTED_BYTES = 1 << 17, 1 << 20
#: An anchor rank with so many different surroundings is dealt by window; grows with the input beyond 10^5 such ranks.
HOT = 2_000
#: Surroundings of one rank in one batch that are reported towards HOT.
REPORTED = 8

_COVERED, _OPEN, _COUNT = 0, 1, 2
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_LOW = _U((1 << 21) - 1)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and the powers of the hash's base and of its inverse modulo 2^64."""
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    powers = [np.ones(CHUNK + LENGTH * 4, dtype=np.uint64) for _ in range(2)]
    for p, b in zip(powers, (base, inverse), strict=True):
        p[1:] = b
        np.multiply.accumulate(p, out=p)
    return np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64), *powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes at each position, by doubling."""
    _, powers, _ = _tables()
    pieces, size, current = [], 1, words
    need, at = n, 0
    while need:
        if need & size:
            pieces.append((at, size, current))
            at += size
            need -= size
        if need:
            current = current[:len(current) - size] * powers[size] + current[size:]
            size *= 2
    m = len(words) - n + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    for start, length, h in pieces:
        out = out * powers[length] + h[start:start + m]
    return _mix(out)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = w - size
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def anchors(texts: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Anchors of some texts of CHUNK bytes together (a longer one alone): doc (place in the list), first and last window, rank, around."""
    found = [x for at, group in _grouped(texts) for x in _anchors_of(group, at, length)]
    names = ("doc", "p0", "p1", "rank", "around")
    return {n: np.concatenate([x[n] for x in found]) if found else np.zeros(0, np.int64 if n in names[:3] else np.uint64) for n in names}


def _grouped(texts: list[bytes]):
    """Texts in runs of at most CHUNK bytes; each as (place of the first text, texts)."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > CHUNK:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _anchors_of(group: list[bytes], at: int, length: int):
    if len(group) == 1 and len(group[0]) > CHUNK:  # segments that overlap by a window less a byte
        step = CHUNK - length + 1
        for s in range(0, len(group[0]) - length + 1, step):
            for x in _anchors_of([group[0][s:s + CHUNK]], at, length):
                yield {**x, "p0": x["p0"] + s, "p1": x["p1"] + s}
        return
    data = np.frombuffer(b"".join(group), dtype=np.uint8)
    if len(data) < length:
        return
    table, powers, inverses = _tables()
    sizes = np.fromiter(map(len, group), dtype=np.int64, count=len(group))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(group)), sizes)
    words = table[data]
    grams = _gram_hashes(words, FIRST)
    least = _sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - FIRST + 1)
    windows = np.flatnonzero(owner[:len(data) - length + 1] == owner[length - 1:])
    if not len(windows):
        return
    anchor = (least[windows] & _LOW).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]
    first = np.flatnonzero(new)
    p0, p1, a = windows[first], windows[np.r_[first[1:], len(windows)] - 1], anchor[first]
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers[:len(words)], out=sums[1:])
    around = (sums[p1 + length] - sums[p0]) * inverses[p0]
    around = _mix(around + (a - p0).astype(np.uint64) * _ODD + (p1 - p0).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))
    doc = owner[p0]
    yield {"doc": doc + at, "p0": p0 - starts[doc], "p1": p1 - starts[doc], "rank": grams[a] >> _U(16), "around": around}


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _in_parts(batches):
    """Batches cut into slices of about COMBINED bytes of text."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(b.column("text"))).astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMBINED, "right"))
            stop = max(stop, at + 1)
            yield b.slice(at, stop - at)
            at = stop


def _least(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each row, the least value of its group (rows of a group are sorted by value)."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1] if len(values) else values


def _spread(values: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, the least and greatest value and the size of its group."""
    if not len(values):
        return values, values, values
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    return np.minimum.reduceat(values, at)[group], np.maximum.reduceat(values, at)[group], np.diff(np.r_[at, len(values)])[group]


def _pair_key(rank: np.ndarray, around32: np.ndarray) -> np.ndarray:
    return _mix(rank * _ODD + around32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h * _ODD) % _U(n)).astype(np.int64)


def _parts(rank: np.ndarray, n: int):
    """Places of `n` parts, equal ranks in the same one."""
    to = (_mix(rank + _ODD) % _U(n)).astype(np.int32) if n > 1 else np.zeros(len(rank), dtype=np.int32)
    for k in range(n):
        at = np.flatnonzero(to == k)
        if len(at):
            yield at


# ---- round 1 -----------------------------------------------------------------

_ENTRY = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("ranks", pa.binary()), ("around", pa.binary()), ("docs", pa.binary())])
_ENTRY_SQL = "bucket int, kind int, ranks binary, around binary, docs binary"


def _packed(bucket: int, kind: int, ranks: np.ndarray, around: np.ndarray, docs: np.ndarray) -> tuple:
    six = np.ascontiguousarray(ranks.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if kind < 0 else ranks.astype("<u8").tobytes()
    return bucket, kind, six, around.astype("<u4").tobytes(), docs.astype("<i8").tobytes()


def _first_round_entries(n_buckets: int, length: int):
    def mapped(batches):
        for b in _in_parts(batches):
            ids = b.column("doc_id")
            some = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            if not len(some):
                continue
            doc_ids = ids.fill_null(0).to_numpy()[some]
            found = anchors([x.encode("utf-8", "surrogatepass") for x in b.column("text").take(pa.array(some)).to_pylist()], length)
            docs, rank, around = doc_ids[found["doc"]], found["rank"], found["around"] >> _U(32)
            order = np.lexsort((docs, around, rank))
            docs, rank, around = docs[order], rank[order], around[order]
            pair = _groups(rank, around)
            least = _least(docs, pair)
            rows = []
            later = docs > least
            rows.append(_packed(0, _COVERED, _pair_key(rank[later], around[later]), around[:0], docs[later]))
            docs, rank, around = docs[pair], rank[pair], around[pair]
            new = _groups(rank)
            low, high, n = _spread(docs, new)
            shared = low < high
            rows.append(_packed(1, _OPEN, rank[shared], around[:0], docs[shared]))
            many = new & (n >= REPORTED) & shared
            rows.append(_packed(2, _COUNT, rank[many], around[:0], n[many]))
            send = ~shared | (docs == low) | (docs == high)
            # of a rank shared within the batch, one entry at each end of the ids is enough
            ends = _groups(rank, docs)
            send &= ~shared | ends
            docs, rank, around = docs[send], rank[send], around[send]
            to = _bucket(rank, n_buckets)
            order = np.argsort(to, kind="stable")
            at = np.searchsorted(to[order], np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(at)).tolist():
                cut = order[at[k]:at[k + 1]]
                cut = cut[np.argsort(docs[cut], kind="stable")]
                rows.append(_packed(k, -1, rank[cut], around[cut], docs[cut]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)

    return mapped


def _answers(docs: np.ndarray, keys: np.ndarray, kind: int):
    for i in range(0, len(docs), 1 << 16):
        cut = slice(i, i + (1 << 16))
        n = len(docs[cut])
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[cut]), pa.array(keys[cut].view(np.int64)), pa.array(np.full(n, kind, dtype=np.int32))], ["doc_id", "key", "kind"])


def _first_round_ranks(batches):
    ranks, arounds, docs = [], [], []
    for b in batches:
        for kind, r, a, d in zip(*[b.column(c).to_pylist() for c in ("kind", "ranks", "around", "docs")], strict=True):
            if kind >= 0:
                yield from _answers(np.frombuffer(d, "<i8"), np.frombuffer(r, "<u8"), kind)
                continue
            wide = np.zeros((len(d) // 8, 8), dtype=np.uint8)
            wide[:, :6] = np.frombuffer(r, np.uint8).reshape(-1, 6)
            ranks.append(wide.view("<u8").ravel())
            arounds.append(np.frombuffer(a, "<u4"))
            docs.append(np.frombuffer(d, "<i8"))
    if not ranks:
        return
    ranks, arounds, docs = np.concatenate(ranks), np.concatenate(arounds), np.concatenate(docs)
    for at in _parts(ranks, -(-len(ranks) // SORTED_ENTRIES)):
        rank, around, doc = ranks[at], arounds[at], docs[at]
        order = np.lexsort((doc, around, rank))
        rank, around, doc = rank[order], around[order], doc[order]
        low, high, _ = _spread(doc, _groups(rank))
        shared = low < high
        later = shared & (doc > _least(doc, _groups(rank, around)))
        yield from _answers(doc[later], _pair_key(rank[later], around[later].astype(np.uint64)), _COVERED)
        still = shared & ~later
        yield from _answers(doc[still], rank[still], _OPEN)


# ---- round 2 -----------------------------------------------------------------

_PIECE = pa.schema([
    ("bucket", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("stop", pa.int64()), ("rank", pa.int64()), ("bytes", pa.binary()),
])
_PIECE_SQL = "bucket int, doc_id long, tag long, at long, stop long, rank long, bytes binary"


def _merged(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows by owner: those that follow each other without a gap become one."""
    if not len(owner):
        return owner, first, last
    order = np.lexsort((first, owner))
    owner, first, last = owner[order], first[order], last[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] > last[:-1] + 1)]
    at = np.flatnonzero(new)
    return owner[at], first[at], np.maximum.reduceat(last, at)


def _own_keys(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return _mix(key + doc.astype(np.uint64) * _ODD)


def _listed(column, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Owners and values of a column of lists; a null list is empty."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.asarray(lists.flatten()).astype(np.int64).view(kind)


def _second_round_entries(n_buckets: int, length: int, hot):
    def mapped(batches):
        hot_ranks = hot.value
        for b in _in_parts(batches):
            texts = [x.encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()]
            ids = b.column("doc_id").fill_null(0).to_numpy()
            tags = np.array([zlib.crc32(t) for t in texts], dtype=np.int64)
            covered_of, covered = _listed(b.column("covered"), np.uint64)
            open_of, opened = _listed(b.column("opened"), np.uint64)
            if not len(covered) and not len(opened):
                continue
            wanted = np.unique(np.r_[covered_of, open_of])
            found = anchors([texts[i] for i in wanted.tolist()], length)
            doc, p0, p1, rank, around = wanted[found["doc"]], found["p0"], found["p1"], found["rank"], found["around"]
            known = np.isin(_own_keys(doc, _pair_key(rank, around >> _U(32))), _own_keys(covered_of, covered))
            still = ~known & np.isin(_own_keys(doc, rank), _own_keys(open_of, opened))
            # of each rank pair the places in the document of least id
            at = np.flatnonzero(still)
            at = at[np.lexsort((ids[doc[at]], around[at], rank[at]))]
            pair = _groups(rank[at], around[at])
            later = ids[doc[at]] > _least(ids[doc[at]], pair)
            known[at[later]] = True
            at = at[~later]
            own, first, last = _merged(doc[known], p0[known], p1[known])
            n = len(own)
            if n:
                yield pa.RecordBatch.from_arrays([
                    pa.array(_bucket(ids[own].view(np.uint64), n_buckets), pa.int32()), pa.array(ids[own]), pa.array(tags[own]),
                    pa.array(first), pa.array(last + length), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                ], schema=_PIECE)
            spread = np.isin(rank[at], hot_ranks)
            pieces = {"doc": doc[at[~spread]], "at": p0[at[~spread]], "stop": p1[at[~spread]] + length, "rank": rank[at[~spread]]}
            if spread.any():  # each window on its own, once for each document of least id in the batch
                least: dict[bytes, int] = {}
                places = [(int(doc[i]), p) for i in at[spread].tolist() for p in range(int(p0[i]), int(p1[i]) + 1)]
                for k, p in places:
                    window, own_id = texts[k][p:p + length], int(ids[k])
                    least[window] = min(own_id, least.get(window, own_id))
                decided = [(k, p) for k, p in places if least[texts[k][p:p + length]] < ids[k]]
                if decided:
                    c = np.array(decided, dtype=np.int64)
                    own, first, last = _merged(c[:, 0], c[:, 1], c[:, 1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(_bucket(ids[own].view(np.uint64), n_buckets), pa.int32()), pa.array(ids[own]), pa.array(tags[own]),
                        pa.array(first), pa.array(last + length), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary()),
                    ], schema=_PIECE)
                extra = np.array([(k, p, zlib.crc32(w)) for k, p in places if least[w := texts[k][p:p + length]] == ids[k]], dtype=np.int64)
                pieces = {
                    "doc": np.r_[pieces["doc"], extra[:, 0]], "at": np.r_[pieces["at"], extra[:, 1]],
                    "stop": np.r_[pieces["stop"], extra[:, 1] + length],
                    "rank": np.r_[pieces["rank"], extra[:, 2].astype(np.uint64) | _U(1 << 63)],
                }
            d, s, e = pieces["doc"], pieces["at"], pieces["stop"]
            for i in range(0, len(d), 1 << 14):
                cut = slice(i, i + (1 << 14))
                yield pa.RecordBatch.from_arrays([
                    pa.array(_bucket(pieces["rank"][cut], n_buckets), pa.int32()), pa.array(ids[d[cut]]), pa.array(tags[d[cut]]), pa.array(s[cut]),
                    pa.array(e[cut]), pa.array(pieces["rank"][cut].view(np.int64)),
                    pa.array([texts[k][x:y] for k, x, y in zip(d[cut].tolist(), s[cut].tolist(), e[cut].tolist(), strict=True)], pa.binary()),
                ], schema=_PIECE)

    return mapped


def _ranges(docs, tags, starts, stops):
    for i in range(0, len(docs), 1 << 16):
        cut = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (docs, tags, starts, stops)], ["doc_id", "tag", "start", "stop"])


def _second_round_ranks(length: int):
    def mapped(batches):
        held = []
        for b in batches:
            decided = np.asarray(b.column("rank").is_null())
            doc, tag, at, stop = (b.column(c).to_numpy() for c in ("doc_id", "tag", "at", "stop"))
            yield from _ranges(doc[decided], tag[decided], at[decided], stop[decided])
            if not decided.all():
                held.append(b.filter(pa.array(~decided)))
        if not held:
            return
        table = pa.Table.from_batches(held)
        size = table.column("bytes").nbytes
        for at in _parts(table.column("rank").to_numpy().view(np.uint64), -(-size // SORTED_BYTES)):
            yield from _later_windows(table.take(pa.array(at)).combine_chunks(), length)

    return mapped


def _later_windows(t: pa.Table, length: int):
    """Ranges of the windows of these pieces that a document of smaller id has too."""
    doc, tag, at, stop, rank = (t.column(c).to_numpy() for c in ("doc_id", "tag", "at", "stop", "rank"))
    data = np.frombuffer(b"".join(t.column("bytes").to_pylist()), dtype=np.uint8)
    sizes = stop - at
    begins = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    piece = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    place = begins[piece] + inner
    table = _tables()[0]
    hashes = np.concatenate([  # the hash of every window, some megabytes at a time
        _gram_hashes(table[data[i:i + CHUNK + length - 1]], length) for i in range(0, max(len(data) - length + 1, 0), CHUNK)])
    key = _mix(hashes[place] + rank.view(np.uint64)[piece] * _ODD)
    order = np.lexsort((doc[piece], key))
    new = _groups(key[order])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = doc[piece[order]] > doc[piece[lead]]
    mine, theirs = order[later], lead[later]
    same = np.ones(len(mine), dtype=bool)
    for i in range(0, len(mine), 1 << 13):
        cut = slice(i, i + (1 << 13))
        x, y = place[mine[cut]][:, None] + np.arange(length), place[theirs[cut]][:, None] + np.arange(length)
        same[cut] = (data[x] == data[y]).all(axis=1)
    mine = mine[same]
    own, first, last = _merged(piece[mine], at[piece[mine]] + inner[mine], at[piece[mine]] + inner[mine])
    yield from _ranges(doc[own], tag[own], first, last + length)


# ---- result ------------------------------------------------------------------

ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs and what stays."""
    removed, spans, kept, at = 0, 0, [], 0
    runs: list[list[int]] = []
    for start, stop in sorted(ranges):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    for start, stop in runs:
        kept.append(text[at:start])
        removed += stop - start
        spans += 1
        at = stop
    kept.append(text[at:])
    return removed, spans, b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row and column of `docs` with n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    if not FIRST <= length <= 4 * LENGTH:
        raise ValueError(f"length must be {FIRST} to {4 * LENGTH}")
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    docs = docs.drop(*ADDED)
    plain = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    entries = plain.mapInArrow(tidy(_first_round_entries(n, length)), _ENTRY_SQL)
    dealt = entries.withColumn("to", F.when(F.col("kind") < 0, F.col("bucket")).otherwise(F.crc32("docs") % n)).repartition(n, "to").drop("to")
    answers = stage(dealt.mapInArrow(tidy(_first_round_ranks), "doc_id long, key long, kind int"), "first-round")
    total = answers.count()
    hot = answers.where(F.col("kind") == _COUNT).groupBy("key").agg(F.sum("doc_id").alias("n")).where(F.col("n") >= max(HOT, total // 100_000))
    hot_ranks = spark.sparkContext.broadcast(np.array(sorted(r["key"] for r in hot.select("key").collect()), dtype=np.int64).view(np.uint64))

    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", text_or_empty()).repartition(n, "doc_id")
    listed = answers.where(F.col("kind") != _COUNT).groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("kind") == _COVERED, F.col("key"))).alias("covered"),
        F.collect_list(F.when(F.col("kind") == _OPEN, F.col("key"))).alias("opened"),
    )
    pieces = rows.join(listed, "doc_id", "left").select("doc_id", "text", "covered", "opened")
    pieces = pieces.mapInArrow(tidy(_second_round_entries(8 * n, length, hot_ranks)), _PIECE_SQL).repartition(2 * n, "bucket")
    found = pieces.mapInArrow(tidy(_second_round_ranks(length)), "doc_id long, tag long, start long, stop long")
    ranges = found.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "stop")).alias("_ranges"))
    joined = rows.join(ranges, "doc_id", "left").select(*docs.columns, "_ranges")
    names = docs.columns

    def result(batches):
        for b in _in_parts(batches):
            texts = [x.encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()]
            cuts = []
            for text, found in zip(texts, b.column("_ranges").to_pylist(), strict=True):
                tag = zlib.crc32(text) if found else 0
                cuts.append(_cut(text, [(r["start"], r["stop"]) for r in found or () if r["tag"] == tag]))
            yield pa.RecordBatch.from_arrays([
                *[b.column(c) for c in names], pa.array(list(map(len, texts)), pa.int64()), pa.array([c[0] for c in cuts], pa.int64()),
                pa.array([c[1] for c in cuts], pa.int64()), pa.array([c[2] for c in cuts], pa.binary()),
            ], [*names, *ADDED])

    zero = F.lit(0).cast("long")
    schema = rows.select(*names, *[zero.alias(c) for c in ADDED[:3]], F.lit(b"").alias("kept")).schema
    return joined.mapInArrow(tidy(result), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with texts cut and n_chars (where there is one) counted again; documents of which nothing stays are left out.

    A code point of which only a part stays goes too.
    """

    def decoded(batches):
        for b in batches:
            text = pa.array([x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(c) for c in b.schema.names], b.schema.names)

    cut = remove_repeats(docs, length)
    cut = cut.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    out = cut.mapInArrow(tidy(decoded), cut.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
