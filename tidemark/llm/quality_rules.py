"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns.

``statistics`` are built-in column expressions. On a bounded sample of labelled rows (``sample`` rows, chosen by a
hash of the id; only statistics reach the driver, some 20 numbers a row) gradient-boosted shallow trees are grown;
every path from a root to a node becomes a conjunctive rule, and an L1-penalised logistic regression gives most
rules weight zero. The remaining rules compile into one column expression, so scoring the corpus is a single native
pass without Python.

Null texts count as empty; empty texts are scored like any other. With no labelled row, or one class only, the score
is the smoothed share of label 1. Ties between equally good splits go to the first statistic and smallest threshold.
Repeated rows are scored alike, of several labels of one id the smallest counts, and no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

MARKS = "|#%$&*!.,?@/=<{-"


def statistics(text: Column) -> dict[str, Column]:
    """Ratios that don't depend on what language a text is in."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines, words = F.split(text, "\n"), F.split(text, " ")
    n_lines, n_words = F.size(lines).cast("double"), F.size(words).cast("double")

    def rate(n: Column, of: Column = size) -> Column:
        return n.cast("double") / of

    out = {"log_chars": F.log1p(F.length(text).cast("double")), "chars_per_word": size / n_words, "words_per_line": n_words / n_lines}
    out |= {f"mark_{i}": rate(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) for i, c in enumerate(MARKS)}
    out |= {
        "digits": rate(F.regexp_count(text, F.lit("[0-9]"))),
        "capitals": rate(F.regexp_count(text, F.lit("[A-Z]"))),
        "distinct_lines": rate(F.size(F.array_distinct(lines)), n_lines),
        "distinct_words": rate(F.size(F.array_distinct(words)), n_words),
    }
    return out


@dataclass
class Rule:
    """A conjunction of (statistic, is it greater, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def covers(self, x: np.ndarray, at: dict[str, int]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, greater, limit in self.tests:
            out &= (x[:, at[name]] > limit) == greater
        return out

    def column(self) -> Column:
        out = None
        for name, greater, limit in self.tests:
            test = F.col(name) > F.lit(limit) if greater else F.col(name) <= F.lit(limit)
            out = test if out is None else out & test
        return out


@dataclass
class Ensemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, names: list[str], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, edges: list[np.ndarray], bins: np.ndarray, depth: int, path: tuple, rules: list, leaf: int) -> np.ndarray:
    """Fit one tree to the gradients; adds its paths to ``rules`` and returns its step for each row."""
    step = np.zeros(len(grad))
    g, h = grad[rows].sum(), hess[rows].sum()
    if path:
        rules.append(path)
    best = (1e-6, None, None)
    if depth:
        for j in range(len(names)):
            if not len(edges[j]):
                continue
            k = len(edges[j]) + 1
            gs = np.cumsum(np.bincount(bins[rows, j], grad[rows], k))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], hess[rows], k))[:-1]
            ns = np.cumsum(np.bincount(bins[rows, j], minlength=k))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < leaf) | (len(rows) - ns < leaf)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                best = (gain[i], j, i)
    if best[1] is None:
        step[rows] = -g / (h + 1)
        return step
    _, j, i = best
    low = bins[rows, j] <= i
    for side, greater in ((rows[low], False), (rows[~low], True)):
        step += grow(x, names, grad, hess, side, edges, bins, depth - 1, (*path, (names[j], greater, float(edges[j][i]))), rules, leaf)
    return step


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    n, k = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    w = np.zeros(k + 1)
    p = y.mean()
    w[0] = np.log(p / (1 - p))
    v, t = w.copy(), 1.0
    rate = 4 * n / (np.linalg.norm(a, 2) ** 2)
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, leaf: int = 5) -> Ensemble:
    p = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 2 * leaf or y.min() == y.max():
        return Ensemble(float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)[1:-1], method="lower")) for j in range(x.shape[1])]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    f, paths = np.full(len(y), np.log(p / (1 - p))), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        f += rate * grow(x, names, q - y, q * (1 - q), np.arange(len(y)), edges, bins, depth, (), paths, leaf)
    at, rules, seen, cols = {n: i for i, n in enumerate(names)}, [], set(), []
    for path in paths:
        c = Rule(path).covers(x, at)
        if (k := c.tobytes()) not in seen and 0 < c.sum() < len(c):
            seen.add(k)
            rules.append(Rule(path))
            cols.append(c)
    if not rules:
        return Ensemble(float(np.log(p / (1 - p))))
    z = np.stack(cols, axis=1).astype(float)
    b, w = lasso_logistic(z, y, penalty)
    return Ensemble(b, [Rule(r.tests, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-9])


def scored_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Columns to keep and the statistics, named so that no column of the input clashes with them."""
    stats = {f"__stat_{k}": v for k, v in statistics(F.col("__text")).items()}
    base = docs.select(*[F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns)], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return base.select("*", *[v.alias(k) for k, v in stats.items()]), list(stats)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id", sample: int = 12_000, **options) -> Ensemble:
    """Fit on at most ``sample`` labelled documents; only their statistics leave the executors."""
    rows = labelled_sample(docs, labels, label_col, sample, 7, id_col, text_col).select(F.col("label").cast("double").alias("__y"), F.col("text").alias("__t"))
    stats, names = scored_statistics(rows, "__t", ["__y"])
    got = stats.select("__y", *names).toPandas().sort_values(["__y", *names]).to_numpy(dtype=float)
    return fit_rules(got[:, 1:], got[:, 0], names, **options)


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score between 0 and 1, in one native pass."""
    stats, _ = scored_statistics(docs, text_col)
    return stats.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col], model.column().alias(score_col))


def keep(docs: DataFrame, model: Ensemble, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more.

    The score comes from a generator, below which a filter isn't pushed; inlined there, each rule would compute its
    statistics anew.
    """
    stats, _ = scored_statistics(docs, text_col)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return stats.select(*own, F.explode(F.array(model.column())).alias("__score")).filter(F.col("__score") >= least).select(*own)
