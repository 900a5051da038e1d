"""Quality classifier: a sparse rule ensemble over text statistics.

Small boosted trees are grown on a bounded labelled sample; every path from a
root is a conjunctive rule. A lasso logistic regression over the rules leaves
few with a weight, and these become one Spark expression: a sum of weights of
the rules that hold, through the logistic function.

Null and empty texts are scored like any other, by their statistics. Without
labels every score is 0.5; with one class, that class's share. Repeated rows
get repeated results; other columns are ignored by `score` and kept by `keep`.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import common, text_stats
from webloom.llm.labelled import Literal, condition, describe, holds, sample, thresholds

#: Trees, their depth, shrinkage, rows in a leaf; most rules with a weight.
TREES, DEPTH, SHRINKAGE, LEAF, MAX_RULES = 40, 3, 0.3, 10, 40


@dataclasses.dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[float, tuple[Literal, ...]]]

    def describe(self) -> list[str]:
        return [f"{weight:+.3f} if {describe(rule)}" for weight, rule in self.rules]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * holds(x, rule)
        return 1 / (1 + np.exp(-total))


def _tree(slots: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[Literal, ...]], np.ndarray]:
    """(all paths, predicted step of each row) of one tree by second-order gain."""
    paths: list[tuple[Literal, ...]] = []
    step = np.zeros(len(gradient))
    todo: list[tuple[tuple[Literal, ...], np.ndarray]] = [((), np.arange(len(gradient)))]
    while todo:
        path, rows = todo.pop()
        g, h = gradient[rows], weight[rows]
        best: tuple[float, int, int] | None = None
        if len(path) < DEPTH and len(rows) >= 2 * LEAF:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for feature, borders in enumerate(cuts):
                if not len(borders):
                    continue
                slot = slots[rows, feature]
                gl, hl, nl = (np.cumsum(np.bincount(slot, w, len(borders) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
                k = int(np.argmax(gain))
                if gain[k] > (best[0] if best else 1e-6):
                    best = float(gain[k]), feature, k
        if path:
            paths.append(path)
        if best is None:
            step[rows] = g.sum() / (h.sum() + 1)
            continue
        _, feature, k = best
        above = slots[rows, feature] > k
        for side in (False, True):
            todo.append(((*path, (feature, float(cuts[feature][k]), side)), rows[above == side]))
    return paths, step


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: tuple[float, np.ndarray], rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on weighted rows, by accelerated proximal steps; y: share of label 1."""
    b, w = start
    rate = 4.0 / (np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + 1)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-(vb + z @ vw))) - y)
        nb = vb - rate * error.sum()
        nw = vw - rate * (z.T @ error)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def learn(x: np.ndarray, labels: np.ndarray) -> Ensemble:
    n = len(labels)
    if not n or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (n + 1)
        return Ensemble(float(np.log(share / (1 - share))), [])
    cuts = thresholds(x, labels == (labels.mean() < 0.5))
    slots = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    total = np.full(n, np.log(labels.mean() / (1 - labels.mean())))
    rules: dict[tuple[Literal, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        paths, step = _tree(slots, cuts, labels - p, p * (1 - p))
        rules.update(dict.fromkeys(paths))
        total += SHRINKAGE * step
    z = np.stack([holds(x, rule) for rule in rules], 1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that cover the same rows count once
    names, z = [list(rules)[i] for i in sorted(first)], z[:, sorted(first)]
    scale = z.std(0)
    keep = scale > 0
    names, mean, scale = [r for r, k in zip(names, keep) if k], z[:, keep].mean(0), scale[keep]
    z = (z[:, keep] - mean) / scale
    fitted = float(np.log(labels.mean() / (1 - labels.mean()))), np.zeros(z.shape[1])
    penalty = float(np.abs(z.T @ (labels - labels.mean())).max()) / n
    # Documents that the same rules cover are one weighted row.
    z, inverse, rows = np.unique(z, axis=0, return_inverse=True, return_counts=True)
    share, weight = np.bincount(inverse.ravel(), labels) / rows, rows / n
    while penalty > 1e-4:
        penalty *= 0.7
        following = _lasso(z, share, weight, penalty, fitted)
        if (np.abs(following[1]) > 1e-6).sum() > MAX_RULES:
            break
        fitted = following
    b, w = fitted
    w = w / scale
    return Ensemble(float(b - (w * mean).sum()), [(float(v), rule) for v, rule in zip(w, names) if abs(v) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame) -> Ensemble:
    x, y, _ = sample(docs, labels)
    return learn(x, y)


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    stats = text_stats.with_features(docs, "doc_id")
    scored = stats.select("doc_id", common.held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep(docs: DataFrame, model: Ensemble) -> DataFrame:
    """The rows of `docs` that the model does not reject, with their own columns."""
    own = docs.select(F.struct(*common.quoted(docs)).alias("__row"), "text")
    stats = text_stats.with_features(own, "__row")
    return stats.where(model.column() >= 0.5).select("__row.*")
