"""Sparse rule ensemble: tree paths as rules, lasso weights, Spark column expressions (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from awardgrid.llm.common import bound_batches


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "symbol_share": F.regexp_count(t, F.lit(r"[#*$%&|<>{}\\^~=_@]")) / n,
        "exclaim_share": F.regexp_count(t, F.lit("!")) / n,
        "upper_share": F.regexp_count(t, F.lit("[A-Z]")) / n,
        "digit_share": F.regexp_count(t, F.lit("[0-9]")) / n,
        "stop_share": F.regexp_count(t, F.lit(r"[.,]")) / n,
        "word_length": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "words_per_line": n_words / F.greatest(F.size(lines), F.lit(1)),
        "log_words": F.log(n_words),
    }


STATISTICS = tuple(
    ["symbol_share", "exclaim_share", "upper_share", "digit_share", "stop_share", "word_length", "distinct_words", "distinct_lines", "words_per_line", "log_words"]
)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> list[tuple]:
    """Paths of one tree fitted to gradients g with curvatures h: ((feature, sign, threshold), ...), inner nodes too."""
    paths: list[tuple] = []

    def split(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-6, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= least) & (len(order) - at - 1 >= least)]
            if at.size:
                gain = cg[at] ** 2 / (ch[at] + 1) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1) - total
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, float((v[at[k]] + v[at[k] + 1]) / 2)))
        if best[1]:
            f, cut = best[1]
            low = x[rows, f] <= cut
            split(rows[low], (*path, (f, "<=", cut)))
            split(rows[~low], (*path, (f, ">", cut)))

    split(np.arange(len(x)), ())
    return paths


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] <= c) if s == "<=" else (x[:, f] > c) for f, s, c in rule])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class RuleEnsemble:
    """Rules over the statistics with weights, and an intercept."""

    rules: list[tuple] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + sum((w * _holds(x, r) for w, r in zip(self.weights, self.rules, strict=True)), np.zeros(len(x))))

    def column(self) -> Column:
        """The score as one expression over columns named as the statistics."""
        z = F.lit(self.intercept)
        for w, rule in zip(self.weights, self.rules, strict=True):
            holds = reduce(lambda a, b: a & b, [(F.col(STATISTICS[f]) <= c) if s == "<=" else (F.col(STATISTICS[f]) > c) for f, s, c in rule])
            z = z + F.when(holds, w).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, steps: int = 400) -> RuleEnsemble:
    """Boosted trees give the rules, logistic regression with an l1 penalty (accelerated proximal steps) their weights."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(intercept=float(np.log(share / (1 - share))))
    r = np.random.Generator(np.random.PCG64(3))
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        p = _sigmoid(z)
        rows = np.flatnonzero(r.random(len(y)) < 0.7)
        paths = _grow(x[rows], (y - p)[rows], (p * (1 - p))[rows], depth, max(5, len(y) // 400))
        rules |= dict.fromkeys(paths)
        leaves = [p for p in paths if not any(q[: len(p)] == p and q != p for q in paths)]
        for path in leaves:
            on = _holds(x, path)
            z[on] += 0.3 * (y - p)[on].sum() / ((p * (1 - p))[on].sum() + 1)
    rules = {rule: on for rule in rules if 0 < (on := _holds(x, rule)).sum() < len(y)}
    a = np.stack(list(rules.values()), 1).astype(float) if rules else np.zeros((len(y), 0))
    mean, sd = a.mean(0), a.std(0) + 1e-9
    a = (a - mean) / sd
    step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
    w, b, old, t = np.zeros(a.shape[1]), z.mean() * 0, np.zeros(a.shape[1]), 1.0
    look = w
    for _ in range(steps):
        res = (_sigmoid(a @ look + b) - y) / len(y)
        b -= step * res.sum()
        new = look - step * (a.T @ res)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = new + (s - 1) / t * (new - old)
        old = w = new
    on = np.flatnonzero(w)
    weights = w[on] / sd[on]
    return RuleEnsemble([list(rules)[i] for i in on], [float(v) for v in weights], float(b - (weights * mean[on]).sum()))


def _third(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def learn_ensemble(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """Fit on about ``sample`` labelled documents that aren't held out, those with the least hashes of their id.

    What reaches the driver is a row of numbers for each picked id; of repeated rows the one with the
    least statistics counts. No labels, or an empty table, give the constant model.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (_third(id_col) != 2)).groupBy(id_col).agg(F.min(label_col).alias("y"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64(id_col, F.lit(8)), F.lit(1 << 52)) < float(1 << 52) * sample / n)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known.withColumnRenamed(id_col, "__id")), "__id")
    told = rows.select("__id", "y", *[c.cast("double").alias(k) for k, c in statistics(F.col("text")).items()])
    # a row for each id, however often it is repeated
    once = told.groupBy("__id").agg(F.min(F.struct("y", *STATISTICS)).alias("r")).select("r.*")
    got = once.toPandas()
    got = got.sort_values(list(got.columns)).to_numpy(float) if len(got) else np.zeros((0, 1 + len(STATISTICS)))
    return fit_rules(got[:, 1:], got[:, 0])


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: RuleEnsemble | None = None) -> DataFrame:
    """(id, held_out, score, predicted, statistics) of every row, whole texts.

    ``score`` is the ensemble's chance of label 1; every input is a statistic of the text. Labels of
    rows whose crc32 of the id as text, modulo 4, is 2 are never read into the fit; a document with
    two labels counts with the lower. At most about ``sample`` labelled rows are collected. With no
    labels, or of one kind only, every text gets the smoothed share of label 1.
    Null and empty texts have the statistics of an empty text; very long ones are read whole. A score
    of exactly ``threshold`` predicts 1. held_out of a null id is false. Repeated rows are kept, other
    columns ignored whatever their names. An empty table gives no rows. Scoring is one projection without a shuffle or Python.
    """
    bound_batches(spark)
    model = model or learn_ensemble(docs, labels, sample, id_col, text_col, label_col)
    held = F.coalesce(_third(id_col) == 2, F.lit(False))
    told = docs.select(F.col(id_col).alias("__id"), held.alias("held_out"), *[c.cast("double").alias(k) for k, c in statistics(F.col(text_col)).items()])
    scored = told.select(F.col("__id").alias(id_col), "held_out", model.column().alias("score"), *STATISTICS)
    return scored.select(id_col, "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *STATISTICS)
