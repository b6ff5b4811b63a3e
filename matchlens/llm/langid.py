"""Language identification by error-correcting output codes.

Each language has a codeword. One binary n-gram classifier for each bit learns
to tell the languages whose bit is 1 from the others: a linear model over hashed
byte 2- and 3-grams of lower-cased letters, whose weights are the logarithms
of the two sides' gram shares. A text's mean weight by bit is its margin.
Decoding sums exp(-margin) over bits, weighted by how well each bit's classifier
separates the training sample, and picks the codeword of least loss; texts whose
second-best language is nearly as good are flagged as ambiguous.

Edge cases: null text, empty text and text without a letter get `und`, score 0
and no flag. With no labelled rows every text is `und`. One language only: that
one, score 1. Rows are judged one by one; repeated rows, null ids and other
columns do no harm. Long texts are read whole, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy

UNDETERMINED = "und"
#: Grams are hashed to this many buckets.
BUCKETS = 1 << 15
GRAMS = (2, 3)
#: At most about this many labelled documents are learned from.
TRAIN_DOCUMENTS = 20_000
#: Ambiguous when the best language's share of the decoding weight is below this.
AMBIGUOUS = 0.6
#: Factor of the loss in the decoding weight exp(-factor * loss).
SHARPNESS = 3.0
#: Bytes of text handled at a time.
BLOCK = 1 << 19

_LETTER = regex.compile(r"\p{L}")
#: Bytes that stay: ASCII letters (lower-cased before) and everything beyond ASCII; others become spaces.
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def cleaned(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "


def gram_buckets(data: np.ndarray, n: int, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of the n-gram (n up to 4) at each position but the last n - 1."""
    m = len(data) - n + 1
    code = np.zeros(max(m, 0), dtype=np.uint32)
    for i in range(n):
        code |= data[i:i + len(code)].astype(np.uint32) << np.uint32(8 * i)
    code = (code + np.uint32(n)) * np.uint32(2654435761)
    return code >> np.uint32(32 - (buckets.bit_length() - 1))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of bits: every split of the languages for up to 6, else the random code of best distance out of 64 drawn."""
    if n <= 1:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 6:
        return np.array([[(c >> i) & 1 for c in range(1, 1 << (n - 1))] for i in range(n)], dtype=np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    drawn = [rng.integers(0, 2, (n, bits), dtype=np.int8) for _ in range(64)]
    return max(drawn, key=lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    scale: np.ndarray
    trust: np.ndarray  # by bit, mean 1


def learnable(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows that may be learned from: a language, some text, not held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out, F.lit(True)))


def train(labelled: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on all of `labelled` (doc_id, lang, text), or on about `max_documents` of its rows, chosen by a hash of id and text, so that copies are chosen one by one.

    Executors send sums only: gram counts by language, a bounded table.
    """
    n = labelled.count()
    if n > max_documents:
        share = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1_000_000))
        labelled = labelled.where(share < int(1_000_000 * max_documents / n))

    def summed(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                data = cleaned(text)
                for at in range(0, len(data), BLOCK):
                    block = np.frombuffer(data, dtype=np.uint8)[at:at + BLOCK + 3]
                    for g in GRAMS:
                        own += np.bincount(gram_buckets(block, g), minlength=BUCKETS)
        for lang, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], ["lang", "bucket", "n"])

    rows = labelled.select("lang", "text").mapInArrow(tidy(summed), "lang string, bucket int, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        counts[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    return fitted(languages, counts)


def fitted(languages: tuple[str, ...], counts: np.ndarray) -> Model:
    codes = codewords(len(languages))
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
    bits = codes.shape[1]
    weights = np.zeros((BUCKETS, bits), dtype=np.float32)
    bias, scale, trust = np.zeros(bits), np.ones(bits), np.ones(bits)
    for b in range(bits):
        one, zero = shares[codes[:, b] == 1], shares[codes[:, b] == 0]
        weights[:, b] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
        means = shares @ weights[:, b]
        low, high = means[codes[:, b] == 1].min(), means[codes[:, b] == 0].max()
        bias[b] = (low + high) / 2
        scale[b] = max(abs(low - high) / 2, 1e-6)
        trust[b] = max((low - high) / (weights[:, b].std() + 1e-9), 1e-3)
    if bits:
        trust /= trust.mean()
    return Model(languages, codes, weights, bias, scale, trust)


def margins(model: Model, texts: list[str]) -> np.ndarray:
    """A row of margins for each text: its mean gram weight by bit, centred and scaled to 1 at the nearest training language."""
    sums, grams = np.zeros((len(texts), model.codes.shape[1])), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        sizes = np.array([len(x) for x in held])
        data, owner = np.concatenate(held), np.repeat(np.array(owners), sizes)
        for g in GRAMS:
            at = gram_buckets(data, g)
            inside = owner[: len(at)] == owner[g - 1:]
            starts = np.flatnonzero(np.r_[True, owner[1:len(at)] != owner[: len(at) - 1]])
            values = model.weights[at] * inside[:, None]
            np.add.at(sums, owner[starts], np.add.reduceat(values, starts, axis=0))
            np.add.at(grams, owner[starts], np.add.reduceat(inside.astype(np.int64), starts))
        held.clear()
        owners.clear()

    size = 0
    for i, text in enumerate(texts):
        data = np.frombuffer(cleaned(text), dtype=np.uint8)
        for at in range(0, max(len(data) - 1, 1), BLOCK):
            piece = data[at:at + BLOCK + 3]
            held.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= BLOCK:
                flush()
                size = 0
    if held:
        flush()
    return (sums / np.maximum(grams, 1)[:, None] - model.bias) / model.scale


def decode(model: Model, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the codeword of least weighted loss, and its share of the decoding weight."""
    signs = 2.0 * model.codes - 1
    loss = np.stack([(np.exp(-np.clip(found * s, -20, 20)) * model.trust).sum(axis=1) for s in signs], axis=1)
    loss /= max(model.codes.shape[1], 1)
    best = loss.argmin(axis=1)
    weight = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    return best, weight[np.arange(len(best)), best] / weight.sum(axis=1)


def predict(model: Model, docs: DataFrame, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """`docs` with lang_pred, score and ambiguous added (in place of columns of those names); only `text` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "ambiguous")

    def mapped(batches):
        m = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if some:
                best, share = decode(m, margins(m, [texts[i] for i in some]))
                for i, k in zip(some, best.tolist(), strict=True):
                    pred[i] = m.languages[k]
                score[some] = share
            flag = np.zeros(len(texts), dtype=bool)
            flag[some] = score[some] < ambiguous
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(flag)], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema
    return docs.mapInArrow(tidy(mapped), schema)


def held_out() -> Column:
    """Rows kept for measuring: crc32 of the id as text leaves 2 when divided by 4. Null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Learn from the rows of `docs` that are not held out, then predict every row."""
    bounded_batches(docs.sparkSession)
    return predict(train(learnable(docs, held_out()), max_documents), docs)


def only_identified(docs: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """`docs` without the rows whose language cannot be told: `und`, so null texts and texts without a letter (if any row has a language). Ambiguous rows stay."""
    found = identify(docs, max_documents)
    return found.where(F.col("lang_pred") != UNDETERMINED).select(*docs.columns)
