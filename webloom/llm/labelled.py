"""A bounded sample of labelled documents' features, for fitting on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import common, text_stats

#: Labelled rows that a fit reads, about; the sample is spread evenly by a hash of doc_id.
MAX_ROWS = 12_000

_SPREAD = 1 << 20


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by row, labels 0 or 1, whether a row is for pruning) of rows that are not held out.

    A doc_id with several labels has the greatest; one with several documents counts once, with the least features.
    """
    own = labels.where(F.col("quality").isNotNull() & ~common.held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_SPREAD))
    n = own.count()
    share = _SPREAD if n <= max_rows else _SPREAD * max_rows // n
    taken = own.where(place < share)
    # About max_rows rows of two numbers, so small enough to broadcast.
    some = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    names = [f"f_{name}" for name in text_stats.FEATURES]
    label, prune = (F.col("quality") > 0).cast("int").alias("label"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("prune")
    fields = text_stats.with_features(some, "doc_id", "quality").select("doc_id", F.struct(*names, label, prune).alias("row"))
    one = fields.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*", F.xxhash64("doc_id").alias("place"))
    rows = sorted(map(tuple, one.collect()), key=lambda r: (r[-1], r))  # no more rows than were taken
    x = np.array([r[: len(names)] for r in rows], float).reshape(len(rows), len(names))
    return x, np.array([r[-3] for r in rows], int), np.array([r[-2] for r in rows], bool)


def thresholds(x: np.ndarray, rare: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints between quantiles of all rows, and round those of the rarer class."""
    out, steps = [], np.linspace(0, 1, most + 1)
    for column in x.T:
        values = np.unique(column)
        between = (values[1:] + values[:-1]) / 2
        wanted = np.quantile(column, steps)
        if rare.any():
            wanted = np.concatenate([wanted, np.quantile(column[rare], steps)])
        at = np.searchsorted(between, np.unique(wanted))
        out.append(between[np.unique(np.concatenate([at - 1, at]).clip(0, max(0, len(between) - 1)))] if len(between) else between)
    return out


#: A literal: (feature, threshold, whether values above it hold).
Literal = tuple[int, float, bool]


def holds(x: np.ndarray, rule: tuple[Literal, ...]) -> np.ndarray:
    found = np.ones(len(x), bool)
    for feature, threshold, above in rule:
        found &= (x[:, feature] > threshold) == above
    return found


def condition(rule: tuple[Literal, ...]):
    """The rule as a Spark condition on the columns f_<feature>."""
    found = F.lit(True)
    for feature, threshold, above in rule:
        value = F.col(f"f_{text_stats.FEATURES[feature]}")
        found = found & (value > threshold if above else value <= threshold)
    return found


def describe(rule: tuple[Literal, ...]) -> str:
    return " and ".join(f"{text_stats.FEATURES[f]} {'>' if above else '<='} {t:.4g}" for f, t, above in rule)
