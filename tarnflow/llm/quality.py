"""Quality by a sparse rule ensemble (RuleFit): tree paths over text statistics, lasso weights, Spark columns.

Shallow trees are boosted on a bounded labelled sample of statistics; every path from a root is a conjunctive rule; an
L1-penalised logistic fit keeps few of them; what stays becomes one Spark column expression, so scoring is JVM code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fitting import held_out, labelled_sample, logistic

#: Labelled rows that a fit reads at most; trees, their depth, cuts tried for a statistic, least rows of a rule.
SAMPLE_ROWS, TREES, DEPTH, CUTS, LEAST_ROWS = 8000, 60, 3, 32, 10
THRESHOLD = 0.7
_SYMBOLS = "#*$%&@^~=+<>{}[]\\_"


def _parts(text: Column) -> tuple[Column, Column, Column]:
    """The text without nulls, its words and its lines."""
    t = F.coalesce(text, F.lit(""))
    return t, F.filter(F.split(F.translate(t, "\n\t\r", "   "), " "), lambda w: w != ""), F.filter(F.split(t, "\n"), lambda x: x != "")


def statistics(text: Column, parts: tuple[Column, Column, Column] | None = None) -> dict[str, Column]:
    """The statistics that rules speak of; shares are of characters, words or lines, 0 for an empty text."""
    t, words, lines = parts or _parts(text)
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    m = F.greatest(F.size(lines), F.lit(1)).cast("double")
    without = lambda s: (F.length(t) - F.length(F.translate(t, s, ""))) / chars
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": F.length(F.translate(t, " \n\t", "")) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / m,
        "line_words": F.size(words) / m,
        "symbols": without(_SYMBOLS),
        "exclaim": without("!?"),
        "pipes": without("|"),
        "digits": without("0123456789"),
        "stops": without("."),
        "commas": without(",;:"),
        "quotes": without("\"'()/-"),
        "upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "breaks": without("\n"),
        "wide": (F.octet_length(t) - F.length(t)) / chars,
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double"),
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "repeats": F.lit(1.0) - F.size(F.array_distinct(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))) / n,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, cut)."""

    parts: tuple[tuple[str, bool, float], ...]

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] > c) == above for s, above, c in self.parts])

    def column(self) -> Column:
        out = F.lit(True)
        for s, above, c in self.parts:
            out = out & ((F.col(s) > F.lit(c)) if above else (F.col(s) <= F.lit(c)))
        return out


def _grow(x: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, step: np.ndarray) -> None:
    """Grows a tree below ``path``: each node's path becomes a rule, each leaf adds its Newton step."""
    best, at = 1e-6, None
    if depth:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, cuts in enumerate(bins):
            if not len(cuts):
                continue
            sg = np.bincount(binned[rows, j], g[rows], len(cuts) + 1).cumsum()[:-1]
            sh = np.bincount(binned[rows, j], h[rows], len(cuts) + 1).cumsum()[:-1]
            sn = np.bincount(binned[rows, j], minlength=len(cuts) + 1).cumsum()[:-1]
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(sn < LEAST_ROWS) | (len(rows) - sn < LEAST_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], (j, k)
    if at is None:
        step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    j, k = at
    above = binned[rows, j] > k
    for side in (False, True):
        longer = (*path, (j, side, k))
        rules.add(longer)
        _grow(x, bins, binned, g, h, rows[above == side], depth - 1, longer, rules, step)


def extract_rules(x: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees over the statistics ``x``, in a fixed order."""
    names = list(x)
    matrix = np.column_stack([x[n] for n in names])
    bins = [np.unique(np.quantile(matrix[:, j], np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")) for j in range(len(names))]
    bins = [b[b < matrix[:, j].max()] for j, b in enumerate(bins)]
    binned = np.column_stack([np.searchsorted(b, matrix[:, j], side="left") for j, b in enumerate(bins)])
    score, rules = np.full(len(y), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _grow(matrix, bins, binned, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), rules, step)
        score = score + 0.2 * step
    return [Rule(tuple((names[j], above, float(bins[j][k])) for j, above, k in r)) for r in sorted(rules)]


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 400) -> np.ndarray:
    """Weights, intercept first and unpenalised, by accelerated proximal gradient steps."""
    a = np.c_[np.ones(len(a)), a]
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    rate = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -35, 35))) - y) / len(y)
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, t2
    return w


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score over columns named as the statistics."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(x: dict[str, np.ndarray], y: np.ndarray) -> RuleEnsemble:
    """Rules from trees, then the lasso; the penalty with the least loss on every fourth row is used on all rows.

    The lasso draws scores towards the share of all rows, so a line through the log odds of those fourth rows, which
    neither rules nor weights have seen, calibrates them.
    """
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    check = np.arange(len(y)) % 4 == 3
    if not 0 < y[~check].sum() < (~check).sum():
        check[:] = False
    rules = extract_rules({k: v[~check] for k, v in x.items()}, y[~check])
    columns = {}
    for r in rules:
        on = r.on(x)
        if 0 < on.mean() < 1:
            columns.setdefault(np.packbits(on).tobytes(), (r, on))
    kept = list(columns.values())
    if not kept:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    a = np.column_stack([on for _, on in kept]).astype(float)
    best, w, line = (math.inf, 0.0), None, (0.0, 1.0)
    for penalty in (0.02, 0.01, 0.005, 0.0025, 0.001, 0.0005):
        w = lasso_logistic(a[~check], y[~check], penalty, w)
        if check.any():
            p = np.clip(1 / (1 + np.exp(-(w[0] + a[check] @ w[1:]))), 1e-6, 1 - 1e-6)
            loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
            if loss < best[0]:
                best = loss, penalty
                z = w[0] + a[check] @ w[1:]
                fitted = logistic(z[:, None], y[check], ridge=0.1) if 0 < y[check].sum() < check.sum() else line
                line = tuple(fitted) if fitted[1] > 0 else line
    w = lasso_logistic(a, y, best[1] or 0.005)
    return RuleEnsemble(float(line[0] + line[1] * w[0]), [(r, float(line[1] * v)) for (r, _), v in zip(kept, w[1:], strict=True) if v])


def with_statistics(docs: DataFrame, keep: list) -> DataFrame:
    """``keep`` and the statistics; words and lines are columns of their own first, so that each row is split once."""
    split = docs.select(*keep, *[c.alias(n) for c, n in zip(_parts(F.col("text")), ("_text", "_words", "_lines"), strict=True)])
    made = statistics(F.col("_text"), (F.col("_text"), F.col("_words"), F.col("_lines")))
    return split.select(*keep, *[c.cast("double").alias(n) for n, c in made.items()])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """An ensemble learnt from the statistics of at most ``rows`` labelled documents that are not held out."""
    names = list(statistics(F.col("text")))
    drawn = labelled_sample(docs, labels, "quality", rows, [c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()])
    got = drawn.collect()
    x = {n: np.array([r[n] for r in got], dtype=float) for n in names}
    return train(x, np.array([r["_label"] for r in got], dtype=float))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, score) of every row; a null text counts as empty; only ``doc_id`` and ``text`` are read.

    Whole texts are read, of any length; equal texts have equal scores, so repeated rows and ties score alike; a null
    doc_id is kept; other columns are ignored, whatever their names; no rows give no rows.
    """
    return with_statistics(docs, ["doc_id"]).select("doc_id", model.column().alias("score"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
