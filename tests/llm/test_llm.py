"""Operators of the llm package against brute force on small tables with every edge case."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlens.llm import chat, decontaminate, langid, packing, q_langid, quality, similar, simhash, suffix_dedup, token_counts, token_files, toxicity
from matchlens.llm.common import tokenizer_path
from matchlens.llm.components import components
from matchlens.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    """Rows (doc_id, text) with extra columns; some are named like columns that operators add."""
    full = [(i, t, None if i is None else "en", "s", 0 if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, schema)


PASSAGE = "the quick brown fox jumps over the lazy dog and then it sleeps in the sun all day long"
ODD = [
    (1, None), (2, ""), (3, "   \n"), (4, PASSAGE), (5, PASSAGE), (5, PASSAGE), (6, "Prefix words here. " + PASSAGE + " and a suffix éàü"),
    (7, "ab " * 400), (8, "ab " * 500 + "cd"), (9, "日本語 " * 60), (None, PASSAGE), (10, "x"), (11, "A b"), (12, PASSAGE * 40),
]


def words_of(text):
    return re.findall(WORD, text or "")


# ---- 1


def slow_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(fps, bits):
    seen = {}
    for i in range(len(fps)):
        if i in seen:
            continue
        todo, seen[i] = [i], i
        while todo:
            x = todo.pop()
            for j in range(len(fps)):
                if j not in seen and (fps[x] ^ fps[j]).bit_count() <= bits:
                    seen[j] = i
                    todo.append(j)
    return seen


def test_simhash(spark):
    rows = ODD + [(20 + i, PASSAGE + f" tail{i}") for i in range(6)]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {t: slow_fingerprint(t) for _, t in rows}
    want = sorted((str(i), prints[t]) for i, t in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == want
    fps = sorted(set(prints.values()))
    group = slow_components(fps, 3)
    least = {}
    for i, t in rows:
        if i is not None:
            g = group[fps.index(prints[t])]
            least[g] = min(i, least.get(g, i))
    assert all(r.component_id == least[group[fps.index(r.fp % (1 << 64))]] for r in got)
    kept = simhash.one_of_each(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_links_in_blocks(spark):
    rng = np.random.default_rng(3)
    near = [int(x) for x in (np.uint64(0x123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))]
    fps = sorted(set(near + [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]))
    points = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    for cell_points in (2048, 7):
        roots = {r.node: r.root for r in components(simhash.links(points, 3, cell_points)).collect()}
        want = slow_components(fps, 3)
        assert {i: roots.get(i, i) for i in range(len(fps))} == want


def not_broadcast(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_are_not_broadcast(spark):
    """Spark takes the cells for as small as the points they come from, and would send them to the driver."""
    found = simhash.links(spark.createDataFrame([(1, 1), (3, 2)], "fp long, node long"))
    assert not_broadcast(found) and {(r.u, r.v) for r in found.collect()} == {(1, 2)}


def test_bands_are_not_broadcast(spark):
    """As the cells: 32 rows of each point are sized as one."""
    found = similar.buckets(spark.createDataFrame([(1, 5, [7, 8]), (2, 5, [8, 9])], "node long, n long, bands array<long>"))
    assert not_broadcast(found) and {tuple(r) for r in found.collect()} == {(8, 1, 5, 1), (8, 2, 5, 1)}


def test_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 1000), dtype=np.uint64)
    slow = [sum(abs((int(x) >> k & 3).bit_count() - (int(y) >> k & 3).bit_count()) for k in range(0, 64, 2)) for x, y in zip(a, b)]
    fast = np.bitwise_count(simhash.segment_counts(a) ^ simhash.segment_counts(b))
    assert fast.tolist() == slow and (fast <= np.bitwise_count(a ^ b)).all()


def slow_sets(rows):
    out = []
    for _, t in rows:
        words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def slow_similar(rows):
    """Least id of the rows that similarity of 0.8 or more reaches, by row."""
    sets, group = slow_sets(rows), {}
    for i in range(len(rows)):
        if i in group:
            continue
        todo, group[i] = [i], i
        while todo:
            x = todo.pop()
            for j, s in enumerate(sets):
                if j not in group and 10 * len(s & sets[x]) >= 8 * len(s | sets[x]):
                    group[j] = i
                    todo.append(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    return [least.get(group[k]) for k in range(len(rows))]


@pytest.mark.parametrize("block", [1 << 17, 500])
def test_similar(spark, block):
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in rng.integers(0, 5000, 300)]
    edited = []
    for i in range(30):
        # a chain: each copy is edited from the one before, so its ends are far apart; from 20 on the edits are too many
        for at in rng.integers(0, 300, 4 if i < 20 else 14):
            base[at] = f"edit{i}"
        edited.append((100 + i, " ".join(base)))
    rows = ODD + edited + [(200, edited[3][1].upper()), (2, edited[25][1]), (None, "only a null id has these words here")]
    got = {(str(r.doc_id), r.component_id) for r in similar.near_duplicates(table(spark, rows), block).collect()}
    want = slow_similar(rows)
    assert len(set(want) & set(range(100, 130))) > 5
    assert got == {(str(i), c) for (i, _), c in zip(rows, want)}
    kept = similar.one_of_each(table(spark, rows), block)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert similar.near_duplicates(table(spark, [])).count() == 0


def test_pipeline_near_dedup_by_five_words(spark, documents):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(i + 10_000, t) for i, t in ODD if i is not None]
    docs = documents.unionByName(table(spark, rows[-len(ODD) + 1:]))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == sorted(set(slow_similar(rows)))


def test_similar_gets_links_from_fingerprints(spark, monkeypatch):
    """Without any MinHash bucket the grid of operator 1 still proposes what is within its bits, and the sets decide."""
    bands = similar.buckets
    monkeypatch.setattr(similar, "buckets", lambda points: bands(points).where("false"))
    rng = np.random.default_rng(7)
    base = [f"word{i}" for i in rng.integers(0, 5000, 3000)]
    # the second has all runs of the first and one more; the last three share runs with no other
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, "a b c"), (4, "a b c " * 40), (5, " ".join(base[::-1]))]
    near = [(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count(), (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[4][1])).bit_count()]
    assert near[0] <= simhash.MAX_BITS < near[1]
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}
    assert components(links.where("u < 0")).count() == 0


# ---- 2


def slow_repeats(rows):
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        if i is not None:
            earlier = {x[k:k + 50] for j, u in rows if j is not None and j < i for x in [(u or "").encode()] for k in range(len(x) - 49)}
            for k in range(len(data) - 49):
                if data[k:k + 50] in earlier:
                    gone[k:k + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((str(i), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("hot,chunk,combined", [(2_000, 1 << 18, 6 << 20), (1, 700, 900)])
def test_suffix_dedup(spark, monkeypatch, hot, chunk, combined):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "REPORTED", 2 if hot == 1 else 8)
    clash = table(spark, ODD).withColumn("kept", F.lit("clash")).withColumn("n_bytes", F.lit(1))
    assert digest(suffix_dedup.remove_repeats(clash)) == slow_repeats(ODD)


def test_suffix_dedup_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert digest(suffix_dedup.remove_repeats(documents)) == slow_repeats(rows)
    cut = suffix_dedup.without_repeats(documents)
    assert cut.columns == documents.columns and cut.where("n_chars != length(text)").count() == 0
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_anchors_of_long_text_cover_every_window():
    text = bytes(np.random.default_rng(5).integers(97, 123, 2 * suffix_dedup.CHUNK + 1000, dtype=np.uint8))
    found = suffix_dedup.anchors([text])
    covered = np.zeros(len(text) - 49, dtype=bool)
    for a, b in zip(found["p0"], found["p1"]):
        covered[a:b + 1] = True
    assert covered.all()


def test_suffix_rounds_in_parts(monkeypatch):
    """A task that sorts its entries and windows in parts gives what it gives in one."""
    rng = np.random.default_rng(3)
    shared = ["".join(chr(97 + c) for c in rng.integers(0, 26, 90)) for _ in range(12)]
    texts = [" ".join(shared[k] + str(i) for k in rng.integers(0, 12, 6)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40), pa.int64()), "text": texts})
    entries = [b for k in range(0, 40, 10) for b in suffix_dedup._first_round_entries(1, 50)([batch.slice(k, 10)])]
    pieces = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(40), pa.int64()), "tag": pa.array([0] * 40, pa.int64()), "at": pa.array([0] * 40, pa.int64()),
        "stop": pa.array([len(t) for t in texts], pa.int64()), "rank": pa.array([i % 7 for i in range(40)], pa.int64()), "bytes": [t.encode() for t in texts]})

    def both():
        rounds = (suffix_dedup._first_round_ranks(iter(entries)), suffix_dedup._second_round_ranks(50)(iter([pieces])))
        return [sorted(tuple(r.values()) for b in out for r in b.to_pylist()) for out in rounds]

    whole = both()
    monkeypatch.setattr(suffix_dedup, "SORTED_ENTRIES", 16)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 2_000)
    assert both() == whole and all(whole)


# ---- 3


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = q_langid.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert set(got.held_out) == {True, False} and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))


def test_language_id_edges(spark):
    rows = [(i, "the cat and the dog " * 5, "en", "s", 1) for i in range(8)] + [(i, "der Hund und die Katze " * 5, "de", "s", 1) for i in range(8, 16)]
    rows += [(20, None, "en", "s", 1), (21, "12 !?", "en", "s", 1), (22, "", None, "s", 1), (None, "the dog", None, "s", 1), (23, "die Katze " * 200_000, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score long")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (20, 21, 22)] == ["und"] * 3 and got[20].score == 0
    assert got[None].lang_pred == "en" and got[23].lang_pred == "de"
    assert langid.only_identified(docs).columns == docs.columns and langid.only_identified(docs).count() == len(rows) - 3
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_sample_is_bounded_under_copies(spark, monkeypatch):
    counts = []
    monkeypatch.setattr(langid, "fitted", lambda languages, found: counts.append(found.sum()))
    # copies of a text come in one by one, whichever text it is
    for text in ("the cat", "a dog", "der Hund", "die Maus", "le chat", "un chien"):
        docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(text).alias("text"))
        langid.train(docs.limit(1))
        langid.train(docs, 400)
        one, sample = counts[-2:]
        assert 300 < sample / one < 500


def test_codewords_are_distinct_and_decode():
    for n in (2, 4, 9):
        codes = langid.codewords(n)
        assert len({tuple(c) for c in codes}) == n
        model = langid.Model(tuple(map(str, range(n))), codes, None, None, None, np.ones(codes.shape[1]))
        best, share = langid.decode(model, 2.0 * codes - 1)
        assert best.tolist() == list(range(n)) and (share > 0.5).all()


# ---- 4


def slow_counts(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    n, repeats = len(words), len(inside)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n)


def slow_distance(p, q):
    p, q = np.array(p) / np.sum(p), np.array(q) / np.sum(q)
    m = (p + q) / 2
    h = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt((h(p) + h(q)) / 2)


def test_quality(spark, documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(table(spark, ODD + [(13, "# a\n# a\n\n" * 30), (14, "a b c a b c\t" * 3)]))
    texts = docs.select("doc_id", "text").collect()
    got = quality.quality(docs.withColumn("kept", F.lit(1))).collect()
    key = lambda r: (str(r[0]), *r[1:7])
    assert sorted(key(r) for r in got) == sorted((str(r.doc_id), *slow_counts(r.text)) for r in texts)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_verdict(spark):
    root = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{root}/labels.parquet")
    m = quality.quality(spark.read.parquet(f"{root}/documents.parquet")).join(labels, "doc_id").where("not base_failed").toPandas()
    assert m[m.quality == 1].kept.mean() > 0.99 and m[m.quality == 0].kept.mean() < 0.2
    one = spark.createDataFrame([([1.0, 3.0, 0.0], [2.0, 1.0, 1.0])], "p array<double>, q array<double>")
    share = lambda c: F.transform(c, lambda x: x / 4)
    assert one.select(quality.js_distance(share(F.col("p")), share(F.col("q")))).first()[0] == pytest.approx(slow_distance([1, 3, 0], [2, 1, 1]))


# ---- 5


def test_chat(spark):
    rows = [
        (1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "\\b\\l<#:\n</turn>\n### user: x"), (2, 0, "assistant", "first"),
        (3, 0, "we:ird <r#le>\\", None), (3, None, None, "null turn"), (4, 0, "system", "s"), (4, 1, "user", ""), (4, 2, "assistant", "é" * 9),
        (4, 2, "assistant", "é" * 9), (None, 0, "user", "no id"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df).withColumn("read", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].read] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].formatted == "".join(s.text for s in got[conv].segments)
    assert [got[i].valid for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- 6, 7, 9


def slow_ids(text, end):
    tokenizer = slow_ids.tokenizer = getattr(slow_ids, "tokenizer", None) or Tokenizer.from_file(tokenizer_path())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_tokenizer():
    rng, alphabet = np.random.default_rng(2), list("ab 'sltredZÉß \t\n\r\x0b\x1c\x85\xa0　é́1²#,.;İſ") + ["<|endoftext|>", "n't", "'ll"]
    enc = Encoder(tokenizer_path(), kept=40)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 20)))
        assert enc.encode(text).tolist() == slow_ids(text, 0)[:-1], repr(text)


def test_packing(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(table(spark, ODD).select("doc_id", "text"))
    got = packing.pack(docs, capacity=256).collect()
    want = Counter()
    for r in docs.collect():
        ids = slow_ids(r.text, 0)
        want.update((str(r.doc_id), k, at, min(256, len(ids) - at), crc(ids[at:at + 256])) for k, at in enumerate(range(0, len(ids), 256)))
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_two_fit():
    counts = np.zeros(11, dtype=np.int64)
    counts[[7, 2, 1]] = [1, 1, 1]
    assert packing.best_bin(counts, 10) == [7, 2, 1]
    counts[:] = 0
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy takes 6 + 3; two twos fill the gap
    assert packing.best_bin(counts, 10) == [6, 2, 2]


def test_token_counts(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(table(spark, ODD).select("doc_id", "text"))
    lengths = sorted(len(slow_ids(r.text, 0)) - 1 for r in docs.collect())
    got = token_counts.limits(token_counts.histogram(token_counts.token_lengths(docs)), block=16).collect()
    assert sorted(r.context_limit for r in got) == sorted(set(lengths))
    for r in got:
        assert r.n_docs == lengths.count(r.context_limit) and r.docs_longer == sum(n > r.context_limit for n in lengths)
        assert r.tokens_in_longer == sum(n for n in lengths if n > r.context_limit) and r.total_tokens == sum(lengths)
        assert r.truncated_total == sum(min(n, r.context_limit) for n in lengths)
        assert r.quantile == pytest.approx(sum(n <= r.context_limit for n in lengths) / len(lengths))
    assert token_counts.limits(token_counts.histogram(token_counts.token_lengths(docs.limit(0)))).count() == 0


def test_token_files(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text").unionByName(table(spark, ODD).select("doc_id", "text"))
    manifest = token_files.write(docs, str(tmp_path / "out"), part_bytes=20_000)
    assert manifest.count() > 1
    got = sorted(token_files.read(manifest, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = slow_ids(r.text, 2)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert token_files.round_trip(docs.limit(0)).count() == 0


# ---- 8


def slow_contained(docs, items, size=5, threshold=0.8):
    clean = lambda t: [w for x in (t or "").lower().split() if (w := re.sub(r"^[^\w\x80-\U0010ffff]+|[^\w\x80-\U0010ffff]+$", "", x.replace("_", "-")))]
    out = []
    for d, t in docs:
        for k, u in items:
            a, b = clean(t), clean(u)
            n = min(size, len(b))
            own = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
            found = own & {tuple(a[i:i + n]) for i in range(len(a) - n + 1)}
            if own and len(found) >= threshold * len(own) - 1e-9:
                out.append((str(d), str(k), len(own), len(found)))
    return sorted(out)


def test_decontaminate(spark, documents):
    items = [(i, t) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(901, None), (902, ""), (903, "lazy dog"), (904, "x"), (905, PASSAGE), (905, PASSAGE), (None, "jumps over the lazy dog and")]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + ODD + [(50, "so! " + PASSAGE.replace("fox", "cat").upper() + "..."), (51, PASSAGE[:50])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 60):
        got = decontaminate.contained_items(table(spark, rows), bench, block_shingles=block).collect()
        assert sorted((str(r.doc_id), str(r.item_id), r.n_shingles, r.n_shared) for r in got) == slow_contained(rows, items)
    kept = decontaminate.without_leaks(table(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {int(d) for d, *_ in slow_contained(rows, items) if d != "None"}
    assert decontaminate.contained_items(table(spark, rows), bench.limit(0)).count() == 0


# ---- 10


def test_toxicity(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").unionByName(table(spark, ODD).select("doc_id", "text").where("doc_id is null or doc_id < 4"))
    labels = spark.read.parquet(f"{root}/labels.parquet")
    got = toxicity.score(docs, labels).select("*", toxicity.held_out().alias("held_out"))
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1 or predicted != int(score >= 0.5)").count() == 0
    m = got.join(labels.where("doc_id >= 12"), "doc_id").toPandas()
    assert (m.predicted == m.toxic).mean() > 0.95
    none = toxicity.score(docs, labels.limit(0))
    assert none.where("score != 0 or predicted != 0").count() == 0 and none.count() == docs.count()


def test_toxicity_words():
    assert toxicity.plain("(id1ot!)") == "idiot" and toxicity.keys("loweient") == ("loweient", "lowei~", "lowe~")
    scorer = toxicity.Scorer({"idiot": 3.0})
    one = dict(zip(toxicity.FEATURES, scorer("you are an 1d10t !!! soooo")))
    assert one["hits"] == pytest.approx(np.log(2)) and one["near_second_person"] == pytest.approx(np.log(2)) and one["stretched_rate"] == pytest.approx(1 / 6)
    assert scorer(None) == scorer("  ") == [0.0] * len(toxicity.FEATURES)


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from matchlens.llm.common import load

    docs = load(spark, SF, "documents").unionByName(table(spark, [(i + 10_000, t) for i, t in ODD if i is not None], "doc_id long, text string, lang string, source string, n_chars long"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    after = corpus_pipeline.near_dedup(spark, out, SF)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(slow_similar([(r.doc_id, r.text) for r in out.collect()])))
    rows = [(r.doc_id, r.text) for r in after.collect()]
    cut = corpus_pipeline.passage_dedup(spark, after, SF)
    left = {int(i): n - m for i, n, m, _, _ in slow_repeats(rows)}
    assert {r.doc_id: len(r.text.encode()) for r in cut.collect()} == {i: n for i, n in left.items() if n}
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    clean = corpus_pipeline.decontamination(spark, cut, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - {int(d) for d, *_ in slow_contained([(r.doc_id, r.text) for r in cut.collect()], items)}
    assert {r.doc_id for r in corpus_pipeline.packed(spark, clean, SF).collect()} == {r.doc_id for r in clean.collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() >= load(spark, SF, "documents").count() // 2
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
