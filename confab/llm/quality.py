"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of a text are Spark columns. On a bounded sample of labelled rows, shallow
regression trees are boosted against the label; every path from a root to a node is a
conjunctive rule; a lasso-penalised logistic regression keeps few of them. The kept
rules and weights are compiled back into one Spark column, so scoring stays in the JVM:
one scan, no shuffle, no Python.

Edge cases: a null text counts as an empty one, whose statistics are 0, and is scored
like any other; repeated rows score alike; without both classes among the labels, or
with too few rows for a rule, every document is kept with score 1; null ids are scored; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.llm.texts import bounded_sample
from confab.sources.tables import table

SYMBOLS = "#$%&*<>{}@=~^\\_+"


@dataclass(frozen=True)
class QualityParams:
    """``sample_rows`` bounds the labelled rows of either class used for training."""

    sample_rows: int = 6000
    trees: int = 40
    depth: int = 3
    shrink: float = 0.3
    subsample: float = 0.5
    bins: int = 24
    penalties: tuple[float, ...] = (0.03, 0.01, 0.003, 0.001)
    steps: int = 400
    hold_out: float = 0.25
    seed: int = 3


Condition = tuple[str, bool, float]  # statistic, greater than?, bound


@dataclass
class QualityModel:
    bias: float = 30.0
    rules: list[tuple[float, tuple[Condition, ...]]] = field(default_factory=list)
    threshold: float = 0.5
    held_out_accuracy: float | None = None


def statistics() -> dict[str, Column]:
    """Statistics by name, of the columns that :func:`with_statistics` lays down; no division by zero."""
    t, words, lines = F.col("_t"), F.col("_words"), F.col("_lines")
    n, n_words, n_lines = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": F.length(t) / n_words,
        "symbols": without(SYMBOLS) / n,
        "pipes": without("|") / n_words,
        "marks": without("!?") / n_words,
        "upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛÑÓÁÍÚ") / n,
        "digits": without("0123456789") / n,
        "stops": without(".,") / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": F.size(words) / n_lines,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n_words,
    }


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``stat_`` columns of a text; it is split once, in a projection of its own."""
    held = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = held.select("*", F.array_remove(F.split("_t", r"\s+"), "").alias("_words"), F.array_remove(F.split("_t", "\n"), "").alias("_lines"))
    return split.select(*keep, *[c.alias(f"stat_{name}") for name, c in statistics().items()])


def grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], depth: int, rows: np.ndarray, path: tuple) -> list[tuple[tuple, float]]:
    """Paths (conditions, mean residual) to every node below the root of one regression tree."""
    if depth == 0 or len(rows) < 20:
        return []
    y = residual[rows]
    best = (1e-9, None, None)
    for f, bounds in enumerate(cuts):
        if not len(bounds):
            continue
        bucket = np.searchsorted(bounds, x[rows, f], side="left")
        n = np.bincount(bucket, minlength=len(bounds) + 1).cumsum()[:-1]
        s = np.bincount(bucket, y, minlength=len(bounds) + 1).cumsum()[:-1]
        m = len(rows) - n
        ok = (n >= 10) & (m >= 10)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(m, 1) - y.sum() ** 2 / len(rows), 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(bounds[k]))
    if best[1] is None:
        return []
    _, f, bound = best
    above = x[rows, f] > bound
    found = []
    for side in (False, True):
        part = rows[above == side]
        own = (*path, (f, side, bound))
        found.append((own, float(residual[part].mean())))
        found += grow(x, residual, cuts, depth - 1, part, own)
    return found


def holds(x: np.ndarray, path: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, bound in path:
        ok &= (x[:, f] > bound) == above
    return ok


def simplify(path: tuple) -> tuple:
    """One bound a statistic and direction, in a fixed order, so that equal rules look equal."""
    least: dict[tuple[int, bool], float] = {}
    for f, above, bound in path:
        old = least.get((f, above))
        least[f, above] = bound if old is None else max(old, bound) if above else min(old, bound)
    return tuple((f, above, bound) for (f, above), bound in sorted(least.items()))


def lasso_logistic(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the weighted cross entropy with an L1 penalty."""
    n, p = r.shape
    rate = 4.0 / (np.linalg.norm(r * np.sqrt(weight)[:, None], 2) ** 2 / n + 1)
    w = z = np.zeros(p)
    b = zb = 0.0
    t = 1.0
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(r @ z + zb, -30, 30))) - y) / n
        nw = z - rate * (r.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = zb - rate * g.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def train(x: np.ndarray, y: np.ndarray, names: list[str], params: QualityParams = QualityParams()) -> QualityModel:
    """Fit rules to statistics ``x`` and labels ``y`` (1 is good)."""
    if len(set(y.tolist())) < 2:
        return QualityModel()
    rng = np.random.default_rng(params.seed)
    held = rng.random(len(x)) < params.hold_out
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    xt, yt = x[~held], y[~held].astype(float)
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, params.bins + 1)[1:-1])) for f in range(x.shape[1])]
    weight = np.where(yt == 1, 0.5 / yt.mean(), 0.5 / (1 - yt.mean()))
    score = np.zeros(len(xt))
    paths: dict[tuple, None] = {}
    for _ in range(params.trees):
        residual = (yt - 1 / (1 + np.exp(-score))) * weight
        some = np.flatnonzero(rng.random(len(xt)) < params.subsample)
        tree = grow(xt, residual, cuts, params.depth, some, ())
        if not tree:
            break
        leaves = {p for p, _ in tree} - {p[:-1] for p, _ in tree}
        for path, value in tree:
            paths.setdefault(simplify(path))
            if path in leaves:
                score += params.shrink * 4 * value * holds(xt, path)
    rules = list(paths)
    if not rules:
        return QualityModel()  # the statistics tell nothing
    r = np.stack([holds(x, p) for p in rules], 1).astype(float)
    best = None
    for penalty in params.penalties:
        w, b = lasso_logistic(r[~held], yt, weight, penalty, params.steps)
        test = held if held.any() else ~held
        p = 1 / (1 + np.exp(-np.clip(r[test] @ w + b, -30, 30)))
        loss = -np.mean(np.where(y[test] == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
        if best is None or loss < best[0] - 0.002:
            best = (loss, w, b, p, y[test])
    _, w, b, p, truth = best
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    threshold, accuracy = _threshold(p, truth)
    named = [(float(w[k]), tuple((names[f], above, bound) for f, above, bound in rules[k])) for k in keep]
    return QualityModel(float(b), named, threshold, accuracy)


def _threshold(p: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Middle of the widest gap among the cuts with most rows right."""
    order = np.argsort(p, kind="stable")
    s, t = p[order], truth[order]
    right = np.concatenate([[t.sum()], t.sum() + np.cumsum(1 - 2 * t)])  # rows below the cut count as bad
    low, high = np.concatenate([[0.0], s]), np.concatenate([s, [1.0]])
    right = np.where(high > low, right, -1)
    best = np.flatnonzero(right == right.max())
    k = best[np.argmax(high[best] - low[best])]
    return float((low[k] + high[k]) / 2), float(right[k] / len(p))


def score_column(model: QualityModel) -> Column:
    """The model as one column over ``stat_`` columns."""
    total = F.lit(model.bias)
    for weight, conditions in model.rules:
        test = None
        for name, above, bound in conditions:
            one = F.col(f"stat_{name}") > bound if above else F.col(f"stat_{name}") <= bound
            test = one if test is None else test & one
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Train on a bounded sample of labelled rows, broadcast to the documents; only statistics are collected."""
    named = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).where("_id is not null")
    sample = None
    for value in (0, 1):
        part = bounded_sample(named.where(F.col("_quality") == value), "_id", params.sample_rows)
        sample = part if sample is None else sample.unionByName(part)
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(sample), "_id")
    rows = with_statistics(own, ["_id", "_quality"], "_text").toPandas()
    names = list(statistics())
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return train(rows[[f"stat_{n}" for n in names]].to_numpy(float), rows["_quality"].to_numpy(int), names, params)


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, keep): one row a document."""
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", score_column(model).alias("score"))
    return scored.withColumn("keep", F.col("score") >= F.lit(model.threshold))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
