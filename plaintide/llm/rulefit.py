"""Quality classifier: a sparse ensemble of tree rules.

Small boosted trees over document statistics are cut into their paths; each path is a conjunction of
comparisons. Lasso logistic regression keeps few of them, and what is left becomes one Spark column.

Edge cases: NULL and empty texts have zero statistics and are scored like any other row; repeated rows give
repeated results; an empty label table or a single class gives the constant prior; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintide.llm import trees
from plaintide.llm.common import held_out, table
from plaintide.llm.textstats import FEATURES, labelled_sample, with_stats

Rule = tuple[tuple[int, bool, float], ...]  # (feature, is "<=", threshold), ...


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, names: list[str]) -> Column:
        """The probability of label 1 as a column over the statistics."""
        def test(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [F.col(names[j]) <= t if le else F.col(names[j]) > t for j, le, t in rule])
        z = reduce(lambda a, b: a + b, [F.when(test(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def paths(forest: trees.Forest) -> list[Rule]:
    """Every path from a root to a node below it, with one bound per feature and direction; without repeats."""
    found: dict[Rule, None] = {}
    for f, t, left, right in zip(forest.feature, forest.threshold, forest.left, forest.right):
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            node, bounds = todo.pop()
            if bounds:
                found.setdefault(tuple(sorted((j, le, v) for (j, le), v in bounds.items())))
            if f[node] >= 0:
                j, v = int(f[node]), float(t[node])
                todo.append((int(left[node]), bounds | {(j, True): min(v, bounds.get((j, True), np.inf))}))
                todo.append((int(right[node]), bounds | {(j, False): max(v, bounds.get((j, False), -np.inf))}))
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, le, t in rule:
        out &= (x[:, j] <= t) if le else (x[:, j] > t)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the mean logistic loss; columns are scaled by their deviation and the
    intercept is free."""
    mean, dev = r.mean(axis=0), np.maximum(r.std(axis=0), 1e-6)
    a = (r - mean) / dev
    n, m = a.shape
    v = np.ones(m) / np.sqrt(m)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1.0 / (0.25 * max(float(v @ (a.T @ (a @ v))) / n, 1.0) + 0.25)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        e = trees.sigmoid(a @ u + c) - y
        new = u - step * (a.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = c - step * e.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    w = w / dev
    return b - float(mean @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, penalty: float = 0.002, rounds: int = 400) -> RuleModel:
    forest = trees.fit(x, y, n_trees=n_trees, depth=depth, rate=0.3, subsample=0.5)
    rules = paths(forest)
    if not rules:
        return RuleModel(forest.base, [])
    r = np.stack([holds(k, x) for k in rules], axis=1).astype(np.float64)
    r, first = np.unique(r, axis=1, return_index=True)  # rules that agree on every row are one rule
    b, w = lasso_logistic(r, y, penalty, rounds)
    return RuleModel(b, [(rules[i], float(v)) for i, v in zip(first, w) if abs(v) > 1e-9])


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", max_labels: int = 20_000,
             threshold: float = 0.7, modulus: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, statistics) of every document. Learns from at most ``max_labels``
    labelled documents outside the held-out share; the table is scored whole."""
    out = held_out("doc_id", modulus, rest)
    x, y = labelled_sample(documents, labels, label, max_labels, ~out)
    model = fit_rules(x, y)
    scored = with_stats(documents).withColumn("score", model.column(FEATURES))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)


def op1_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
