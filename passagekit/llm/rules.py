"""Quality scores by a sparse rule ensemble.

Statistics of the whole text are Spark column expressions.  Small boosted trees
over the statistics of a bounded labelled sample give paths; every path is a
conjunction of comparisons, a rule.  A lasso (L1) logistic model weights the
rules, most to zero, and the rest is compiled back into one column expression,
so scoring never leaves the JVM.

Fitting uses at most about ``SAMPLE_ROWS`` labelled rows (half of each label,
chosen by a hash of the id); only their statistics reach the driver.

Defined cases: a NULL text counts as empty, whose statistics are all 0 (and so
has a score); with labels of one kind only (or none) every score is 0.5; rows
with a NULL id or label are never learned from; repeated rows are scored one by
one; other columns are carried only if named in ``carry``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.llm.langid import labelled_sample

SAMPLE_ROWS = 8000
TREES = 24
DEPTH = 3
CUTS = 24
SHRINK = 0.3
LASSO = 5e-4


@dataclass
class Model:
    #: (conditions (statistic, "<=" or ">", cut), weight)
    rules: list[tuple[tuple[tuple[str, str, float], ...], float]] = field(default_factory=list)
    intercept: float = 0.0


def statistics(text: Column) -> dict[str, dict[str, Column]]:
    """Statistics in layers; a layer's expressions may name the columns of the layers before it."""
    def count(pattern: str) -> Column:
        return F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))

    return {
        "text": {"_t": F.coalesce(text, F.lit(""))},
        "parts": {
            "_words": F.filter(F.split(F.lower("_t"), r"\s+"), lambda w: w != ""),
            "_lines": F.filter(F.split("_t", "\n"), lambda x: x != ""),
            "n_chars": F.length("_t").cast("double"),
            "_letters": count(r"\p{L}+"), "_upper": count(r"\p{Lu}+"), "_digits": count(r"\p{Nd}+"),
            "_space": count(r"\s+"), "_ends": count(r"[^.!?]+"), "_marks": count(r"[^#$%&*|<>{}\[\]=_~^\\/@+]+"),
        },
        "sizes": {
            "n_words": F.size("_words").cast("double"), "n_lines": F.size("_lines").cast("double"),
            "_distinct": F.size(F.array_distinct("_words")), "_distinct_lines": F.size(F.array_distinct("_lines")),
            "_symbols": F.col("n_chars") - F.col("_marks"),
            "_stops": F.col("n_chars") - F.col("_ends"),
            "_others": F.col("n_chars") - F.col("_letters") - F.col("_digits") - F.col("_space"),
        },
        "shares": {
            "letter_share": share("_letters", "n_chars"), "upper_share": share("_upper", "_letters"),
            "digit_share": share("_digits", "n_chars"), "mark_share": share("_symbols", "n_chars"),
            "other_share": share("_others", "n_chars"), "word_chars": share("_letters", "n_words"),
            "distinct_share": share("_distinct", "n_words"), "line_distinct": share("_distinct_lines", "n_lines"),
            "line_words": share("n_words", "n_lines"), "stop_share": share("_stops", "n_words"),
            "distinct_rate": F.coalesce(F.log1p("_distinct") / F.nullif(F.log1p("n_words"), F.lit(0.0)), F.lit(0.0)),
        },
    }


NAMES = ["n_chars", "n_words", "n_lines", "letter_share", "upper_share", "digit_share", "mark_share", "other_share",
         "word_chars", "distinct_share", "line_distinct", "line_words", "stop_share", "distinct_rate"]


def with_statistics(df: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """Rows (*carry as ``_c0`` ..., statistics): own names, so no column of ``df`` can clash."""
    kept = [f"_c{k}" for k in range(len(carry))]
    out = df.select(*(F.col(c).alias(k) for c, k in zip(carry, kept)), F.col(text_col).alias("_text"))
    for layer in statistics(F.col("_text")).values():
        out = out.withColumns(layer)
    return out.select(*kept, *NAMES)


def grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray,
         rows: np.ndarray, path: tuple, depth: int, paths: list, out: np.ndarray) -> None:
    """One boosted tree on binned statistics; adds every node's path and the leaf values."""
    if path:
        paths.append(path)
    best = (1e-6, None)
    if depth and len(rows) >= 40:
        g, h = slope[rows], bend[rows]
        base = g.sum() ** 2 / (h.sum() + 1)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            gl = np.cumsum(np.bincount(bins[rows, f], g, len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(bins[rows, f], h, len(cut) + 1))[:-1]
            nl = np.cumsum(np.bincount(bins[rows, f], minlength=len(cut) + 1))[:-1]
            gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
            gain[(nl < 10) | (len(rows) - nl < 10)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        out[rows] -= SHRINK * slope[rows].sum() / (bend[rows].sum() + 1)
        return
    f, k = best[1]
    low = bins[rows, f] <= k
    for side, part in (("<=", rows[low]), (">", rows[~low])):
        grow(x, bins, cuts, slope, bend, part, (*path, (f, side, float(cuts[f][k]))), depth - 1, paths, out)


def tree_paths(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Distinct paths of boosted trees, as (statistic, side, cut) conjunctions."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(cut, c) for cut, c in zip(cuts, x.T)])
    value, paths = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-value))
        grow(x, bins, cuts, p - y, p * (1 - p), np.arange(len(x)), (), DEPTH, paths, value)
    return list(dict.fromkeys(tuple(sorted(p)) for p in paths))


def holds(x: np.ndarray, path: tuple) -> np.ndarray:
    return reduce(np.logical_and, [x[:, f] <= cut if side == "<=" else x[:, f] > cut for f, side, cut in path])


def lasso_logistic(r: np.ndarray, y: np.ndarray, lasso: float = LASSO, steps: int = 600) -> tuple[np.ndarray, float]:
    """L1 logistic weights by accelerated proximal steps; the intercept is free."""
    z = np.c_[r, np.ones(len(r))]
    size = 4 / max(1e-9, np.linalg.norm(z, 2) ** 2 / len(z))
    w = w_old = np.zeros(z.shape[1])
    for k in range(steps):
        v = w + k / (k + 3) * (w - w_old)
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        step = v - size * (z.T @ (p - y) / len(z))
        w_old, w = w, np.r_[np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - size * lasso, 0), step[-1]]
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "quality", most: int = SAMPLE_ROWS) -> Model:
    chosen = labelled_sample(df, labels, learn, text_col, id_col, label_col, most)
    got = with_statistics(chosen, "text", ["label"]).toPandas()
    y = got["_c0"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return Model()
    x = got[NAMES].to_numpy(dtype=float)
    paths = tree_paths(x, y)
    if not paths:
        return Model()
    weights, intercept = lasso_logistic(np.column_stack([holds(x, p) for p in paths]).astype(float), y)
    return Model([(tuple((NAMES[f], side, cut) for f, side, cut in p), float(w))
                  for p, w in zip(paths, weights) if w], intercept)


def compiled(model: Model) -> Column:
    """The ensemble as a column over the statistics."""
    def rule(conditions: tuple) -> Column:
        return reduce(lambda a, b: a & b, [
            F.col(name) <= F.lit(cut) if side == "<=" else F.col(name) > F.lit(cut) for name, side, cut in conditions])

    total = reduce(lambda a, b: a + b, [F.when(rule(c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in model.rules],
                   F.lit(model.intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows (*carry, score, predicted) for every row of ``df``."""
    carry = list(carry or [])
    rows = with_statistics(df, text_col, carry).withColumn("_score", compiled(model))
    return rows.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)), F.col("_score").alias("score"),
                       (F.col("_score") >= 0.5).cast("int").alias("predicted"))
