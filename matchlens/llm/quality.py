"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and of its language's common words
is compared with the language's reference by the Jensen-Shannon distance (base
2, so 0 to 1). References are sums over all documents. Short documents are not
judged by a histogram: each test has a least length.

The repeated-window count hashes windows with 64 bits within one document;
equal hashes count as equal windows.

Edge cases: null text counts as empty. Documents without a language, or with
one that has no reference, are compared with the pooled reference. Rows are
judged one by one, so repeated rows and repeated ids are kept. An empty table
gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import WORD, text_or_empty

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")
#: Reference of documents without a known language.
POOLED = "*"

#: Number of common words in a language's reference.
COMMON_WORDS = 16
#: Distances above which a document is rejected, and least lengths to be judged.
CLASS_LIMIT = 0.25
WORD_LIMIT = 0.75
MIN_CHARS = 200
MIN_WORDS = 80


def _chars_without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def word_array(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def _barrier(df: DataFrame) -> DataFrame:
    """Keeps Catalyst from copying costly columns into every later expression that reads them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def repeated_words(words: Column) -> Column:
    """Words inside any three-word window that occurs at least twice."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def placed(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        starts = F.sort_array(F.transform(
            F.filter(
                F.transform(pairs, lambda p, j: F.struct(
                    p["i"].alias("i"),
                    ((F.coalesce(F.get(pairs, j - 1)["h"] == p["h"], F.lit(False)))
                     | (F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False)))).alias("twice"),
                )),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        ))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts, zero,
            lambda acc, s: F.struct(
                (s + 3).alias("end"), (acc["n"] + (s + 3 - F.greatest(s, acc["end"]))).alias("n")
            ),
            lambda acc: acc["n"],
        )

    return windows, placed, covered


def document_counts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, lang, text) with its words and its word, line and class counts, one row for each input row."""
    rest, words = F.col("rest"), F.col("words")
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(WORD))
    df = _barrier(docs.select(
        "doc_id", "lang", word_array(text_or_empty()).alias("words"), _chars_without(text_or_empty(), "[a-z]+").alias("rest"),
        F.length(text_or_empty()).cast("long").alias("n_chars"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    ))
    outer = (F.get(words, F.lit(0)) == "") | (F.element_at(words, -1) == "")
    gone = lambda pattern: (F.length(rest) - F.length(_chars_without(rest, pattern))).cast("long")
    df = _barrier(df.select(
        "doc_id", "lang", F.when(outer, F.array_remove(words, "")).otherwise(words).alias("words"), "n_chars", "n_dup_lines",
        (F.col("n_chars") - F.length(rest)).alias("n_ascii_lower"),
        gone(r"[\x20\x09-\x0D]+").alias("n_space"),
        gone(r"[#*$%&|<>]+").alias("n_symbols"),
        gone(r"[A-Z\p{Lu}]+").alias("n_upper"),
        gone(r"[\p{L}&&[^\p{Lu}]]+").alias("n_other_letters"),
        gone(r"\p{N}+").alias("n_digit"),
        gone(r"[\p{P}&&[^#*$%&|<>]]+").alias("n_mark"),
    ))
    return df.withColumn("n_words", F.size(words).cast("long"))


def _classes() -> dict[str, Column]:
    c = F.col
    known = c("n_ascii_lower") + c("n_other_letters") + c("n_upper") + c("n_digit") + c("n_space") + c("n_mark") + c("n_symbols")
    return {
        "lower": c("n_ascii_lower") + c("n_other_letters"), "upper": c("n_upper"), "digit": c("n_digit"), "space": c("n_space"),
        "mark": c("n_mark"), "symbol": c("n_symbols"), "other": F.greatest(c("n_chars") - known, F.lit(0).cast("long")),
    }


def common_words(docs: DataFrame, size: int = COMMON_WORDS) -> dict[str, list[tuple[str, int]]]:
    """The most frequent words of each language (and of all) with their counts, over all documents and words of any length.

    Words are counted once, in the tasks first; what reaches the driver is at
    most `size` words for each language.
    """
    words = docs.select("lang", F.explode(word_array(text_or_empty())).alias("word"))
    counts = stage(words.where(F.col("word") != "").groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    pooled = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "word", "n")
    each = counts.where("lang is not null").unionByName(pooled)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found: dict[str, list[tuple[str, int]]] = {}
    for r in each.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect():
        found.setdefault(r["lang"], []).append((r["word"], r["n"]))
    return found


def common_word_counts(words: Column, lang: Column, lists: dict[str, list[tuple[str, int]]], size: int) -> list[Column]:
    """How often each of the language's common words occurs, in the order of its list."""
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in lists]), F.array(*[
        F.array(*[F.lit(w) for w, _ in (v + [("", 0)] * size)[:size]]) for v in lists.values()
    ]))
    mine = F.coalesce(F.try_element_at(table, lang), F.try_element_at(table, F.lit(POOLED)))
    return [(F.size(words) - F.size(F.array_remove(words, F.get(mine, F.lit(i))))).cast("long") for i in range(size)]


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of shares; null if either has none."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y), F.lit(0.0)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def _reference(values: dict[str, list[int]]) -> Column:
    """The row's language's shares, else the pooled ones, from a literal table of a row for each language."""
    table = {}
    for k, v in values.items():
        total = sum(v)
        table[k] = F.array(*[F.lit(x / total) for x in v]) if total else F.lit(None).cast("array<double>")
    found = F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*table.values()))
    return F.coalesce(F.try_element_at(found, F.col("lang")), table[POOLED])


def quality(
    docs: DataFrame, *, size: int = COMMON_WORDS, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT,
    min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, the base counts, both distances, base_failed and kept, one row for each input row."""
    docs = docs.select("doc_id", "lang", "text")
    lists = common_words(docs, size)
    lists.setdefault(POOLED, [])
    counts = document_counts(docs)
    words = F.col("words")
    windows, placed, covered = repeated_words(words)
    rest = [x for x in counts.columns if x != "words"]
    each = [x.alias(f"w_{i}") for i, x in enumerate(common_word_counts(words, F.col("lang"), lists, size))]
    counts = _barrier(counts.select(*rest, *each, F.when(F.size(words) >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows")))
    rest += [f"w_{i}" for i in range(size)]
    counts = _barrier(counts.select(
        *rest, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed(F.col("windows"))).alias("pairs")
    ))
    features = stage(counts.select(
        "doc_id", "lang", "n_words", (F.col("n_chars") - F.col("n_space")).alias("word_chars"), "n_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("pairs").isNotNull(), covered(F.col("pairs"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        *[v.alias(f"c_{k}") for k, v in _classes().items()], F.array(*[f"w_{i}" for i in range(size)]).alias("common"),
    ), "quality")

    sums = [F.sum(f"c_{k}").alias(f"r_{k}") for k in CLASSES]
    by_lang = features.where("lang is not null").groupBy("lang").agg(*sums)
    refs = {r["lang"]: [r[f"r_{k}"] or 0 for k in CLASSES] for r in by_lang.unionByName(
        features.agg(*sums).select(F.lit(POOLED).alias("lang"), "*")).collect()}

    word_refs = {k: [n for _, n in (v + [("", 0)] * size)[:size]] for k, v in lists.items()}
    features = _barrier(features.select(
        "doc_id", "n_words", "word_chars", "n_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        shares(F.array(*[f"c_{k}" for k in CLASSES])).alias("classes"), shares(F.col("common")).alias("common"),
        _reference(refs).alias("class_ref"), _reference(word_refs).alias("word_ref"),
    ))
    d_class = js_distance(F.col("classes"), F.col("class_ref"))
    d_word = js_distance(F.col("common"), F.col("word_ref"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged_class = (F.col("n_chars") >= min_chars) & (F.coalesce(F.col("class_distance"), F.lit(0.0)) > class_limit)
    judged_word = (F.col("n_words") >= min_words) & (F.coalesce(F.col("word_distance"), F.lit(1.0)) > word_limit)
    out = features.withColumn("class_distance", d_class).withColumn("word_distance", d_word).withColumn("base_failed", base)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~judged_class & ~judged_word).alias("kept"), "class_distance", "word_distance",
    )
