"""Exact top-k, importance resampling and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchlens.llm import pivot_search, prefix_trie, resample

SF = "/root/testdata/sf0.001"


# ---- 11


def slow_top(rows, every, k):
    good = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            good.append((at, i, [math.floor(256 * x) for x in v]))
    out = []
    for at, i, q in good:
        if i is None or math.fmod(i, every):
            continue
        scored = []
        for other, j, v in good:
            if other != at:
                s = sum(a * b for a, b in zip(q, v, strict=False))
                scored.append((-min(max(s, -2**63), 2**63 - 1), j is None, j or 0, other, j))
        out += [(i, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("block,query_block,pivots", [(4096, 512, 32), (7, 3, 4), (5, 1, 1)])
def test_top_k(spark, block, query_block, pivots):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.02]) for i in range(90)]
    rows += [(i, [0.5] * 8) for i in range(100, 140)]  # one vector held by a third of all rows: only ties
    rows += [(200, None), (250, []), (300, [0.1, None, 0.2]), (350, [float("nan")] * 8), (400, [float("inf")] + [0.0] * 7), (None, [0.5] * 8),
             (450, [1.0, 2.0]), (100, [0.5] * 8), (-50, [-0.3] * 8), (500, [1e300] * 8), (501, [1e10] * 8), (550, [-1e10] * 8), (0, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score long")
    got = found(pivot_search.top_k(df, 50, 5, pivots, block, query_block, 64))
    assert got == slow_top(rows, 50, 5)
    assert pivot_search.top_k(df.limit(0)).count() == 0
    one = df.where("vec_id = 450")
    assert pivot_search.top_k(one).count() == 0  # a query without candidates
    two = df.where("vec_id IN (450, 1)")
    assert found(pivot_search.top_k(two)) == slow_top([r for r in rows if r[0] in (450, 1)], 50, 5)


def test_pivots_eliminate(spark):
    """Narrow groups far apart: a query meets its own group, not all rows, and finds the same."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.01]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best, met = pivot_search.search(df, 50, 5, 32, 64, 16, 512, 256.0)
    scored = sum(r.n_scored for r in met.collect())
    assert scored < 40 * 2000 / 3
    assert found(pivot_search.top_k(df, 50, 5, 32, 64, 16, 512)) == slow_top(rows, 50, 5)


def test_bound_of_blocks_holds():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, p = np.floor(rng.normal(size=(20, 6)) * 100), np.floor(rng.normal(size=(5, 6)) * 100)
        d = pivot_search.distances(p, a)
        least = np.abs(d[:, :, None] - d[:, None, :]).max(axis=0)
        exact = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
        assert (least <= exact + 1e-6).all()


# ---- 12


def slow_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_resample(docs, target, min_words=20, percent=25):
    def buckets(text):
        w = slow_words(text)
        return [zlib.crc32(f.encode()) % 10000 for f in w + [" ".join(p) for p in zip(w, w[1:], strict=False)]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for i, text in docs:
        b = buckets(text)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(slow_words(text)) >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {}
    for place, r in enumerate(able[:percent * len(able) // 100]):
        drawn.setdefault(r[:4], []).append(place + 1)
    return sorted([(*r[:4], drawn[r[:4]].pop(0) if drawn.get(r[:4]) and r[4] else None) for r in rows], key=str)


ODD = [(1, None), (2, ""), (3, "   \n"), (7, "ab " * 400), (9, "日本語 " * 60), (None, "x y " * 30), (None, "x y " * 30), (12, "Éa-b_c 9d " * 3000), (5, "q" * 70000)]


@pytest.mark.parametrize("block,last", [(65_536, 4_096), (9, 3), (1, 1)])
def test_resample(spark, block, last):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = ODD + [(7, "ab " * 400), (7, "cd " * 400)] + [(20_000 + i, "one two " * 15) for i in range(70)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("*", "1 AS score", "'a' AS weight", "2 AS row", "3 AS rank")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted(map(tuple, resample.resample(docs, target, block=block, last=last).collect()), key=str)
    want = slow_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got == want
    if block == 9:
        assert resample.resample(docs.limit(0), target).count() == 0
        assert resample.resample(docs.where("doc_id < 3"), target.limit(0)).where("rank IS NOT NULL").count() == 0


def test_selection_discards_whatever_the_keys(spark):
    """All equal scores, one huge score, ascending and descending keys: the cutoff is the sorted one for every k tried."""
    n = 500
    for scores in ([0] * n, [10**15] + [0] * (n - 1), list(range(n)), list(range(n, 0, -1)), [(-1) ** i * i for i in range(n)]):
        rows = [(s, i % 7, i) for i, s in enumerate(scores)]
        blocks = resample.key_blocks(spark.createDataFrame(rows, "score long, doc_id long, row long"), 13)
        order = sorted((-s, d, r) for s, d, r in rows)
        for k in (1, n // 3, n):
            assert resample.cutoff(blocks, k, last=16) == order[k - 1]
    assert resample.cutoff(blocks, 0) is None


# ---- 13


def slow_trie(rows, family=20, most=3):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,budget", [(512, 8 << 20), (7, 8 << 20), (1, 8 << 20), (7, 300)])
def test_trie(spark, shard, budget):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(1000 + i, t, "user", f"common {t}") for i in range(60) for t in range(4)]  # a conversation that many others repeat
    rows += [(2000, 1, None, None), (2001, None, "user", "null turn"), (2001, 0, "user", "a"), (2001, 0, "user", "a"), (2001, 0, "a", "user"), (None, 1, "user", "x"),
             (-7, 0, "user", "negative"), (-19, 0, "", ""), (3001, 0, "user", "alone, no head"), (3002, 0, "user:1", ":2"), (3003, 0, "user", "1::2")]
    rows += [(4000 + i, t, "user", "long " * (t % 5)) for i in (0, 40) for t in range(600)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    got = sorted(map(tuple, prefix_trie.trie(df, shard, budget).collect()), key=str)
    assert got == slow_trie(rows)
    if shard == 512:
        assert prefix_trie.trie(df.limit(0)).count() == 0


def test_skeleton_holds_every_node_of_several_shards(spark):
    paths = [(bytes([a]) * 32 + bytes([b]) * 32, i) for i, (a, b) in enumerate((a, b) for a in range(4) for b in range(5))] + [(b"\1" * 64, i) for i in range(50, 90)]
    keys = sorted(paths)[3::7]
    nodes = prefix_trie.skeleton(keys)
    shards = defaultdict(set)
    for p, c in paths:
        at = sum(k <= (p, c) for k in keys)
        for d in range(len(p) // 32 + 1):
            shards[p[:32 * d]].add(at)
    for prefix, some in shards.items():
        at = 0
        for i in range(0, len(prefix), 32):
            at = nodes.get((at, prefix[i:i + 32]), -1) if at >= 0 else -1
        assert len(some) == 1 or at >= 0


# ---- 4 and 10: no cut by word length; few labels


def test_quality_reference_counts_words_of_any_length(spark):
    """A language whose common words are long: its reference holds them, and ordinary texts of it are kept."""
    from matchlens.llm import quality

    rng = np.random.default_rng(4)
    common = [f"gewoehnlichwort{c}" for c in "abcdefghij"]
    texts = [" ".join(str(rng.choice(common)) if rng.random() < 0.6 else f"selten{rng.integers(10**9)}" for _ in range(120)) for _ in range(60)]
    rows = [(i, t, "long") for i, t in enumerate(texts)] + [(1000 + i, "of the and to in " * 30 + str(i), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality.common_words(docs, 10)
    counts = Counter(w for _, t, lang in rows if lang == "long" for w in t.split())
    assert found["long"] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
    kept = {r.doc_id for r in quality.quality(docs, size=10).where("kept").collect()}
    assert set(range(60)) <= kept


@pytest.mark.parametrize("n", [4, 6, 9])
def test_toxicity_with_few_labels(spark, n):
    """Labels of both kinds, too few for a calibration part of both: scores tell the texts apart as far as they were learned."""
    from matchlens.llm import toxicity

    rows = [(i, "you are an idiot, shut up!!! IDIOT" if i % 2 else "a calm text about the weather in spring") for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5][:n]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert len({i % 2 for i in ids}) == 2
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels, trees=3).collect()}
    assert len(got) == 59 and min(got[i] for i in got if i % 2) > max(got[i] for i in got if i % 2 == 0)
    assert toxicity.score(docs.limit(0), labels, trees=3).count() == 0
