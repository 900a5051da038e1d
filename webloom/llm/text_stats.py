"""Statistics of texts as native column expressions, shared by the quality operators.

Null texts count as empty. Words are runs of characters other than ASCII white
space. Each array is a column of its own step, so that no lambda computes it
again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"

#: Ratios and counts that rules test, from the columns of `counts`.
FEATURES = (
    "n_words",
    "mean_word",
    "symbol_ratio",
    "upper_ratio",
    "mark_ratio",
    "digit_ratio",
    "distinct_ratio",
    "dup_line_ratio",
    "repeat_ratio",
)


def _count_of(text: Column, inverse_class: str) -> Column:
    """Characters of `text` that the negated class does not match."""
    return F.length(F.regexp_replace(text, inverse_class, "")).cast("long")


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The `keep` columns and the counts of each row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(*keep, text.alias("__text"))
    step = step.select(
        *keep,
        "__text",
        F.filter(F.split("__text", _SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    words, n = F.col("__words"), F.size("__words")
    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    step = step.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        _count_of(F.col("__text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        _count_of(F.col("__text"), r"[^A-Z]+").alias("n_upper"),
        _count_of(F.col("__text"), r"[^!]+").alias("n_marks"),
        _count_of(F.col("__text"), r"[^0-9]+").alias("n_digits"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).alias("__windows"),
    )
    others = [c for c in step.columns if c != "__windows"]
    # Most texts repeat no window; only for the rest are windows sorted with their places.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(*others, F.when(repeats, placed).alias("__sorted"))
    s, last = F.col("__sorted"), F.size("__sorted") - 1
    twice = F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == x["h"])))
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    step = step.select(*others, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    # A condition on a row number that always holds keeps filters above this point; the optimiser
    # would otherwise write the statistics out again inside every filter on them.
    whole = F.monotonically_increasing_id() >= 0
    return step.select(*keep, *(F.when(whole, F.col(c)).alias(c) for c in step.columns if c not in keep))


def features(counted: DataFrame) -> dict[str, Column]:
    """The values that rules test; 0 where there is nothing to divide by."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "upper_ratio": per("n_upper", "word_chars"),
        "mark_ratio": per("n_marks", "n_words"),
        "digit_ratio": per("n_digits", "word_chars"),
        "distinct_ratio": per("n_distinct", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    counted = counts(docs, *keep)
    return counted.select(*counted.columns[: len(keep)], *(c.alias(f"f_{name}") for name, c in features(counted).items()), *[c for c in counted.columns if c not in keep])
