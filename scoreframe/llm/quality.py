"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Shallow boosted trees are grown on text statistics; every path from a root to a node becomes a conjunctive rule, a
lasso logistic regression weighs the rules, and the rules that keep a weight are written out as Column expressions. The
fit sees at most ``max_rows`` labelled rows (those with the smallest hash of their id), repeated rows included; scoring is
one scan without shuffle or Python.

Defined cases: null and empty texts have the statistics of "" and are scored by the same rules; repeated rows and ids
are scored row by row, null ids like any other (they are never labelled, and held out like the empty id); an empty table gives no rows; without two classes among the labels the score is the smoothed
share of label 1. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import smallest

STATS = (
    "n_chars", "n_words", "mean_word", "upper_share", "digit_share", "symbol_share",
    "space_share", "distinct_share", "repeat_share", "line_words",
)


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def statistics(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """One row of statistics per input row; expressions only. With carry the input row follows as the struct _row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if carry else []
    base = df.select(F.col(id_col).alias("doc_id"), text.alias("t"), *row)
    row = ["_row"] * carry
    base = base.select(
        "doc_id",
        *row,
        F.length("t").cast("double").alias("n_chars"),
        _count(F.col("t"), r"[^\p{Lu}]+").alias("_upper"),
        _count(F.col("t"), r"[^\p{L}]+").alias("_letters"),
        _count(F.col("t"), r"[^0-9]+").alias("_digits"),
        _count(F.col("t"), r"[\p{L}0-9\s.,;:'()\-]+").alias("_symbols"),
        _count(F.col("t"), r"[\S]+").alias("_spaces"),
        _count(F.col("t"), r"[^\n]+").alias("_breaks"),
        F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != "").alias("w"),
    )
    n = F.greatest(F.col("n_chars"), F.lit(1.0))
    words = F.size("w").cast("double")
    n_words = F.greatest(words, F.lit(1.0))
    repeats = F.size(F.filter(F.zip_with("w", F.slice("w", 2, 1 << 30), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)).cast("double")
    letters = F.greatest(F.col("_letters").cast("double"), F.lit(1.0))
    return base.select(
        "doc_id",
        *row,
        "n_chars",
        words.alias("n_words"),
        (F.col("_letters") / n_words).alias("mean_word"),
        (F.col("_upper") / letters).alias("upper_share"),
        (F.col("_digits") / n).alias("digit_share"),
        (F.col("_symbols") / n).alias("symbol_share"),
        (F.col("_spaces") / n).alias("space_share"),
        (F.size(F.array_distinct("w")) / n_words).alias("distinct_share"),
        (repeats / n_words).alias("repeat_share"),
        (words / (F.col("_breaks") + 1)).alias("line_words"),
    )


# A rule is a tuple of (statistic, threshold, above); it holds if all its tests do.
Rule = tuple[tuple[str, float, bool], ...]


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    bias: float
    fitted_rows: int = 0
    meta: dict = field(default_factory=dict)

    def column(self) -> Column:
        """The score as one expression over the columns of ``statistics``."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for name, cut, above in rule:
                test = test & ((F.col(name) > cut) if above else (F.col(name) <= cut))
            total = total + F.when(test, F.lit(float(weight))).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[int, float, float]:
    best = (-1, 0.0, 1e-9)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if not len(at):
            continue
        gain = cg[at] ** 2 / (ch[at] + 1.0) + (cg[-1] - cg[at]) ** 2 / (ch[-1] - ch[at] + 1.0) - whole
        k = int(np.argmax(gain))
        if gain[k] > best[2]:
            best = (f, float((v[at[k]] + v[at[k] + 1]) / 2), float(gain[k]))
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule, paths: list[Rule], out: np.ndarray) -> None:
    if path:
        paths.append(path)
    f, cut, _ = _best_split(x[rows], g[rows], h[rows], least) if depth else (-1, 0.0, 0.0)
    if f < 0:
        out[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
        return
    above = x[rows, f] > cut
    for side in (False, True):
        _grow(x, g, h, rows[above == side], depth - 1, least, (*path, (STATS[f], cut, side)), paths, out)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the bias is free."""
    a = np.hstack([r, np.ones((len(r), 1))])
    limit = 4.0 * len(a) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / len(a)
        new = z - limit * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - limit * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 5e-4, steps: int = 600) -> RuleEnsemble:
    """Trees by Newton boosting on the logistic loss, then paths as rules, then the lasso."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return RuleEnsemble([], [], float(np.log(share / (1 - share))), len(y))
    score, paths = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, max(5, len(y) // 500), (), paths, step)
        score = score + rate * step
    rules = list(dict.fromkeys(paths))
    held = np.ones((len(y), len(rules)), dtype=bool)
    for k, rule in enumerate(rules):
        for name, cut, above in rule:
            held[:, k] &= (x[:, STATS.index(name)] > cut) == above
    _, first = np.unique(held, axis=1, return_index=True)
    first = np.sort(first)
    rules, held = [rules[k] for k in first], held[:, first]
    w, bias = _lasso(held.astype(float), y, penalty, steps)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble([rules[k] for k in keep], [float(w[k]) for k in keep], bias, len(y))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8000, folds: int = 5) -> RuleEnsemble:
    """Fits on labelled rows whose crc32(doc_id) mod folds is not 0. ``max_rows`` bounds what reaches the driver."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("y"))
    marked = marked.filter(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    marked = smallest(marked, max_rows, F.xxhash64("doc_id"), F.col("doc_id"))
    table = statistics(docs.join(F.broadcast(marked), "doc_id"), "doc_id", "text").join(F.broadcast(marked), "doc_id")
    # rows that repeat an id are within the bound as well
    got = smallest(table, max_rows, F.xxhash64("doc_id"), F.col("doc_id"), *map(F.col, STATS)).toPandas().sort_values(["doc_id", *STATS], kind="stable")
    if not len(got):
        return RuleEnsemble([], [], 0.0)
    return fit_rules(got[list(STATS)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs."""
    out = statistics(docs, "doc_id", "text").select("doc_id", model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""
    return statistics(docs, "doc_id", "text", carry=True).filter(model.column() >= threshold).select("_row.*")
