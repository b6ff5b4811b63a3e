"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the labelled sample: words, and five- and
four-letter word beginnings, whose share of toxic documents is far above their
share of the others. Before the look-up a word loses outer punctuation and
look-alike characters become letters. The other features are second-person
words near a lexicon hit, and the rates of capitals, punctuation, exclamation
marks, stretched letters and obfuscated words. A third of the sample is kept
from the trees and fits the calibration.

Edge cases: null, empty and wordless texts have all-zero features and are scored
like any other. With no labels, or one label only, every score is the share of
label 1 (0 without labels). With so few labels that the part for the trees or
the one for calibration lacks one of the two, all train the trees and the trees'
probability is the score. Labels without an id or a value are ignored; of
repeated labels of one document the greatest counts. Documents are scored row by
row; repeated rows, null ids and other columns do no harm.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import bounded_batches, tidy

#: At most about this many labelled documents are learned from.
TRAIN_DOCUMENTS = 20_000
#: A lexicon entry occurs in so many toxic documents at least, and its log-odds are at least this.
LEXICON_MIN_DOCUMENTS = 4
LEXICON_LOG_ODDS = 2.5
LEXICON_SIZE = 5_000
#: Words to either side of a hit in which a second-person word counts.
NEAR = 4

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset((
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "tus", "vosotros",
))
# Look-alike characters and the letters they stand for.
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = (
    "log_words", "hits", "density", "weight_density", "top_weight", "near_second_person", "second_person_rate",
    "capital_rate", "mark_rate", "exclamation_rate", "stretched_rate", "obfuscated_rate",
)
_OUTER = ".,;:!?\"'()[]{}<>*-_#&%|/\\"
_OBFUSCATED = re.compile(r"(?i)(?<=[a-z])[0-9@$*!]+(?=[a-z])")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_CAPITALS = string.ascii_uppercase.encode()
_MARKS = string.punctuation.encode()


def plain(word: str) -> str:
    word = word.strip(_OUTER)
    return word if word.isalpha() else word.translate(LOOK_ALIKES)


def keys(word: str) -> tuple[str, ...]:
    """The lexicon keys of a plain word: itself, and its beginnings if it is longer."""
    return (word, *(f"{word[:n]}~" for n in (5, 4) if len(word) > n))


class Scorer:
    """Features of texts under one lexicon; what is found out about a word is kept, for a bounded number of words."""

    KEPT = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[float, bool, bool, bool] | None] = {}

    def word(self, word: str) -> tuple[float, bool, bool, bool] | None:
        """Lexicon weight, second person, stretched, obfuscated; None if all are nil."""
        p = plain(word)
        weight = max((self.lexicon.get(k, 0.0) for k in keys(p)), default=0.0)
        found = (weight, p in SECOND_PERSON, _STRETCHED.search(word) is not None, _OBFUSCATED.search(word) is not None)
        if len(self.known) >= self.KEPT:
            self.known.clear()
        self.known[word] = out = found if any(found) else None
        return out

    def __call__(self, text: str | None) -> list[float]:
        if not text or not (words := text.lower().split()):
            return [0.0] * len(FEATURES)
        counts, known = Counter(words), self.known
        found = {w: x for w in counts if (x := known[w] if w in known else self.word(w))}
        hits = sum(counts[w] for w, x in found.items() if x[0])
        near = 0
        if hits:
            second = [w in found and found[w][1] for w in words]
            near = sum(any(second[max(0, i - NEAR):i + NEAR + 1]) for i, w in enumerate(words) if w in found and found[w][0])
        raw = text.encode("utf-8", "surrogatepass")
        n, size = len(words), len(raw)
        return [
            math.log1p(n), math.log1p(hits), hits / n, sum(x[0] * counts[w] for w, x in found.items()) / n,
            max((x[0] for x in found.values()), default=0.0), math.log1p(near), sum(counts[w] for w, x in found.items() if x[1]) / n,
            (size - len(raw.translate(None, _CAPITALS))) / size, (size - len(raw.translate(None, _MARKS))) / size, raw.count(b"!") / size,
            sum(counts[w] for w, x in found.items() if x[2]) / n, sum(counts[w] for w, x in found.items() if x[3]) / n,
        ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """`docs` without text, with a double column for each feature."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    others = [c for c in docs.columns if c != "text"]

    def mapped(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            found = np.array([scorer(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in others], *[pa.array(found[:, i]) for i in range(len(FEATURES))]], [*others, *FEATURES])

    schema = docs.select(*others, *[F.lit(0.0).alias(f) for f in FEATURES]).schema
    return docs.mapInArrow(tidy(mapped), schema)


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """From (text, label): the entries of greatest log-odds, `size` at most."""

    def mapped(batches):
        for b in batches:
            found: Counter[tuple[str, int]] = Counter()
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                own = {k for w in set((text or "").lower().split()) for k in keys(plain(w)) if len(k) > 2}
                found.update((k, int(label)) for k in own)
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64()),
            ], ["key", "label", "n"])

    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1.0, 0), total.get(0.0, 0)
    by_label = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    table = sample.select("text", "label").mapInArrow(tidy(mapped), "key string, label int, n long").groupBy("key").agg(by_label(1).alias("a"), by_label(0).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    top = table.where(F.col("a") >= LEXICON_MIN_DOCUMENTS).withColumn("odds", odds).where(F.col("odds") >= LEXICON_LOG_ODDS)
    return {r["key"]: r["odds"] for r in top.orderBy(F.desc("odds"), "key").limit(size).collect()}


def held_out() -> Column:
    """Rows kept for measuring: crc32 of the id as text is divisible by 5. Null ids are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_sample(docs: DataFrame, labels: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text, label) of at most about `max_documents` labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    n = known.count()
    if n > max_documents:
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_documents / n))
    # the sample's ids are bounded by max_documents, so they may be broadcast
    return stage(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "toxicity-sample")


def score(docs: DataFrame, labels: DataFrame, max_documents: int = TRAIN_DOCUMENTS, trees: int = 20, depth: int = 3) -> DataFrame:
    """doc_id, score and predicted for every row of `docs`, learned from `labels` (doc_id, toxic)."""
    bounded_batches(docs.sparkSession)
    sample = train_sample(docs, labels, max_documents)
    share = sample.agg(F.avg("label").alias("share"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if share["share"] is None or share["low"] == share["high"]:
        constant = F.lit(float(share["share"] or 0.0))
        return docs.select("doc_id", constant.alias("score"), (constant >= 0.5).cast("int").alias("predicted"))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(3)) == 0
    # with few labels a part may lack one of the two: then all rows train the trees and their probability is the score
    calibrated = sample.select(part.alias("part"), "label").distinct().count() == 4
    if not calibrated:
        part = F.lit(False)
    lexicon = learn_lexicon(sample.where(~part))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    dense = stage(with_features(sample, lexicon), "toxicity-features")
    trees_on = assembler.transform(dense.where(~part)).select("features", "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8 if calibrated else 1.0, seed=5).fit(trees_on)
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])
    scored = raw(assembler.transform(with_features(docs.select("doc_id", "text"), lexicon)))
    if calibrated:
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="fitted").fit(raw(assembler.transform(dense.where(part))))
        scored = isotonic.transform(scored)
    else:
        scored = scored.withColumn("fitted", F.col("raw"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fitted")))
    return scored.select("doc_id", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
