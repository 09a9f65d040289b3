"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of a text are built-in functions. Small boosted trees are grown on a bounded sample of labelled rows; each
path from a root is a conjunctive rule; a lasso logistic regression keeps few of them. The score of a text is the
logistic of the sum of the weights of the rules that hold, one column expression without Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the classifier is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 8000
TREES, DEPTH, BINS, SHRINKAGE = 24, 3, 24, 0.3
#: Weight of the absolute sum of the rule weights against the mean loss, and steps of the solver.
PENALTY, STEPS = 0.0004, 800


def statistics(text: Column) -> dict[str, Column]:
    """Name -> statistic of the whole text. Null counts as empty; all are finite."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    rate = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(t) / n,
        "vocabulary": F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n),  # unlike a plain ratio it hardly falls with length
        "repeated_words": rate(r"(?<!\S)(\S+)\s+(?=\1(?!\S))"),
        "symbol_runs": rate(r"[*$%#&@~^=+<>]{3,}"),
        "exclamation_runs": rate(r"!!+"),
        "bars": rate(r"\|"),
        "capital_runs": rate(r"\p{Lu}{2,}"),
        "numbers": rate(r"[0-9]+"),
        "sentence_ends": rate(r"[.?!](?!\S)"),
        "commas": rate(r"[,;:](?!\S)"),
        "lines": rate(r"\n"),
    }


@dataclass(frozen=True)
class Rule:
    """All of the conditions (statistic, is above, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, of) -> Column:
        out = None
        for name, above, cut in self.conditions:
            c = of(name) > cut if above else of(name) <= cut
            out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def margin(self, of) -> Column:
        """``of``: name of a statistic -> Column."""
        out = F.lit(self.intercept)
        for r in self.rules:
            out = out + F.when(r.column(of), F.lit(r.weight)).otherwise(F.lit(0.0))
        return out

    def score(self, of) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin(of)))


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """Grow one node; append every path below the root to ``out``; the step for each row."""
    step = np.zeros(len(x))
    step[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 20:
        return step
    gain, pick = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        if not len(cuts[f]):
            continue
        place = np.searchsorted(cuts[f], x[rows, f], "left")  # x <= cut i exactly for places up to i
        cg, ch = (np.cumsum(np.bincount(place, w, len(cuts[f]) + 1))[:-1] for w in (g[rows], h[rows]))
        value = cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - total_g**2 / (total_h + 1.0)
        i = int(value.argmax())
        if value[i] > gain:
            gain, pick = float(value[i]), (f, float(cuts[f][i]))
    if pick is None:
        return step
    f, cut = pick
    above = x[rows, f] > cut
    for side, sub in ((False, rows[~above]), (True, rows[above])):
        longer = (*path, (f, side, cut))
        out.append(longer)
        step[sub] = _grow(x, cuts, g, h, sub, depth - 1, longer, out)[sub]
    return step


def _simplified(path: tuple) -> tuple:
    """One condition for each statistic and side."""
    best: dict = {}
    for f, side, cut in path:
        best[f, side] = max(best.get((f, side), cut), cut) if side else min(best.get((f, side), cut), cut)
    return tuple((f, side, cut) for (f, side), cut in sorted(best.items()))


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, side, cut in path:
        out &= (x[:, f] > cut) if side else (x[:, f] <= cut)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic loss with an absolute penalty on all weights but the intercept, by accelerated proximal gradient."""
    n = len(y)
    mean = r.mean(axis=0)
    c = r - mean
    size = np.linalg.norm(c, 2) ** 2 / (4 * n) + 0.25
    w, b, v, vb, t = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), None, None, 1.0
    v, vb = w.copy(), b
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(c @ v + vb, -30, 30)))
        nw = v - c.T @ (p - y) / n / size
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / size, 0)
        nb = vb - (p - y).mean() / size
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b - float(mean @ w), w


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Rules and weights for labels 0 or 1. Without rows the score is 0.5; with one label only it is near that label."""
    if not len(y):
        return RuleEnsemble(0.0, ())
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(np.unique(np.concatenate((mid[np.linspace(0, len(mid) - 1, min(len(mid), BINS)).astype(int)], np.quantile(x[:, f], np.linspace(0.02, 0.98, BINS))))) if len(mid) else mid)
    margin, paths = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        margin += SHRINKAGE * np.clip(_grow(x, cuts, y - p, p * (1 - p), np.arange(len(y)), DEPTH, (), paths), -8, 8)
    distinct = sorted({_simplified(p) for p in paths})
    if not distinct:  # too few rows for any tree
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    r = np.stack([_holds(x, p) for p in distinct], axis=1).astype(float)
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows count once
    first = np.sort(first)
    b, w = _lasso(r[:, first], y.astype(float), PENALTY, STEPS)
    kept = [Rule(tuple((names[f], side, float(cut)) for f, side, cut in distinct[j]), float(v)) for j, v in zip(first, w, strict=True) if abs(v) > 1e-3]
    return RuleEnsemble(float(b), tuple(kept))


def fit(docs: DataFrame, doc: str, text: str, labels: DataFrame, label_doc: str, label: str, usable: Column, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on labelled documents for which ``usable`` (over ``label_doc``) holds.

    The sample is bounded: the ``sample_rows`` labels with the smallest hashes, and ``4 * sample_rows`` of their
    documents, in the order of the same hashes, should ids be repeated. Other labels than 0 and 1, null among them, and
    labels without a document are ignored; a null text counts as empty. The order of rows doesn't matter. Without rows
    every score is 0.5.
    """
    picked = labels.where(usable & F.col(label).isin(0, 1)).select(F.col(label_doc).alias("_d"), F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("_d"), "_d", "_y").limit(sample_rows)
    joined = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_doc") == F.col("_d"))  # sample_rows at most
    stats = statistics(F.col("_text"))
    full = joined.select("_d", "_y", *(c.cast("double").alias(k) for k, c in stats.items()))
    rows = full.orderBy(F.xxhash64("_d"), "_d", "_y", *stats).limit(4 * sample_rows).drop("_d").collect()
    a = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(stats) + 1)
    a = a[np.lexsort(a.T)]  # the order of rows must not matter
    return fit_rules(list(stats), a[:, 1:], a[:, 0])


def with_score(df: DataFrame, text: str, model: RuleEnsemble, into: str = "score") -> DataFrame:
    """``df`` with the score of each whole text, 0 to 1; a column already called ``into`` is replaced, others stay.

    A null text is scored like an empty one; repeated rows each return; an empty table stays empty.
    """
    keep = [c for c in df.columns if c != into]
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row")
    stats = df.select(row, F.struct(*(c.cast("double").alias(k) for k, c in statistics(F.col(text)).items())).alias("_stats"))
    return stats.select("_row.*", model.score(lambda k: F.col(f"_stats.{k}")).alias(into))
