"""Quality rules: base filters and a learned decision list, all native expressions.

The list is learned by sequential covering on a bounded labelled sample. A rule
for the rejected class grows by the literal of best information gain, is pruned
from its end on rows it has not seen, and is accepted only if it stays precise
there; the rows it covers go, and the next rule is grown from the rest. A rule
that is not accepted is passed over: its rows no longer lead the growth, but the
covering goes on. Rows that fail the base filter are decided and teach nothing.
The rules come out as one ordered conditional expression over text statistics.

Texts that are null or empty have no words and fail the base filter. Without
labels, or with one class only, the list is empty and only the base filter
rejects. Repeated rows get repeated results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import text_stats
from webloom.llm.labelled import Literal, condition, describe, holds, sample, thresholds
from webloom.llm.text_stats import FEATURES

#: Rules, literals in a rule, least share of the rejected rows that a rule must cover (two rows at least), and precision it must keep on unseen rows.
MAX_RULES, MAX_LITERALS, MIN_COVER, MIN_PRECISION = 8, 3, 0.01, 0.9

#: The base filter: fewer words, or a greater share of repeated ones, fail.
LEAST_WORDS, MOST_REPEATED = 50, 0.5


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[Literal, ...]:
    rule: tuple[Literal, ...] = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_LITERALS and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base = np.log2(p0 / (p0 + n0))
        best: tuple[float, Literal | None] = (1e-9, None)
        values, kind = x[inside], bad[inside]
        for feature, borders in enumerate(cuts):
            slot = np.searchsorted(borders, values[:, feature], side="left")  # borders below the value
            p = np.cumsum(np.bincount(slot[kind], minlength=len(borders) + 1))[:-1]
            n = np.cumsum(np.bincount(slot[~kind], minlength=len(borders) + 1))[:-1]
            for above, good, wrong in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(good >= least, good * (np.log2(good / (good + wrong)) - base), -1.0)
                if len(gain) and (k := int(np.argmax(gain))) >= 0 and gain[k] > best[0]:
                    best = float(gain[k]), (feature, float(borders[k]), above)
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside &= holds(x, (best[1],))
    return rule


def _prune(rule: tuple[Literal, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Literal, ...]:
    """The prefix of the rule of best (right - wrong) / covered; the shorter one on ties."""
    worth = []
    for k in range(1, len(rule) + 1):
        inside = holds(x, rule[:k])
        right = int((inside & bad).sum())
        wrong = int(inside.sum()) - right
        worth.append(((right - wrong) / (right + wrong) if right + wrong else -1.0, -k))
    return rule[: -max(worth)[1]]


def learn(x: np.ndarray, labels: np.ndarray, prune: np.ndarray) -> list[tuple[Literal, ...]]:
    """Ordered rules for the rejected class (label 0)."""
    bad = labels == 0
    if not bad.any() or bad.all():
        return []
    cuts, rules = thresholds(x, bad), []
    least = max(2, math.ceil(MIN_COVER * bad.sum()))
    left, passed = np.ones(len(x), bool), np.zeros(len(x), bool)
    while len(rules) < MAX_RULES:
        grow, check = left & ~prune, left & prune
        rule = _grow(x[grow & ~passed], bad[grow & ~passed], cuts, least)
        if not rule:
            break
        rule = _prune(rule, x[check], bad[check])
        inside = holds(x, rule) & left
        parts = [bad[inside & part] for part in (grow, check)]
        if (bad & inside).sum() >= least and all(part.mean() >= MIN_PRECISION for part in parts if len(part)):
            rules.append(rule)
            left &= ~inside
        else:
            led = inside & grow & bad & ~passed
            if not led.any():
                break
            passed |= led
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[tuple[Literal, ...]]:
    x, y, prune = sample(docs, labels)
    failed = (x[:, FEATURES.index("n_words")] < LEAST_WORDS) | (x[:, FEATURES.index("repeat_ratio")] > MOST_REPEATED)
    return learn(x[~failed], y[~failed], prune[~failed])


def judge(docs: DataFrame, rules: list[tuple[Literal, ...]]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule)."""
    stats = text_stats.with_features(docs, "doc_id")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    decided = F.when(failed, F.lit("base"))
    for rule in rules:
        decided = decided.when(condition(rule), F.lit(describe(rule)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = stats.select(*columns, failed.alias("base_failed"), decided.alias("rule"))
    return out.select(*columns, "base_failed", F.col("rule").isNull().alias("kept"), "rule")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
