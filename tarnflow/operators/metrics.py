"""Statistical metrics by group: ranks, Boyce indices, quantiles, correlation, response profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import TOLERANCE, finite


#: Shares that a key's values are ranked in, so that the rows of one huge key are dealt to as many tasks.
SHARES = 64


def beside(table: DataFrame, few: bool) -> DataFrame:
    """A table of some rows a key as it joins the rows of its keys: sent to every task where the keys are ``few``, such as
    the fits or groups that the driver has listed, so that the many rows need not move; else as Spark sees fit."""
    return F.broadcast(table) if few else table


def running_totals(rows: DataFrame, key: str, value: str, sums: Sequence[str], few: bool = False) -> DataFrame:
    """``rows``, one for each key and value, with ``<c>_to``, the sum of each of ``sums`` over the key's values up to its
    own, and ``<c>_all``, the sum over all of them.

    Values are dealt into shares between approximate quantiles of their key: sums run within a share, and what the shares
    before hold is added. Where the quantiles fall changes no result, and no task ranks more than about a share. ``few``
    as in ``beside``.
    """
    at = [i / SHARES for i in range(1, SHARES)]
    cuts = rows.groupBy(F.col(key).alias("_key")).agg(F.percentile_approx(value, at, 10 * SHARES).alias("_cuts"))
    placed = rows.join(beside(cuts, few), F.col(key).eqNullSafe(F.col("_key"))).withColumn("_share", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_key", "_cuts")
    size = placed.groupBy(F.col(key).alias("_key"), F.col("_share").alias("_of")).agg(*[F.sum(c).alias(c) for c in sums])
    up, whole = Window.partitionBy("_key").orderBy("_of"), Window.partitionBy("_key")
    before = size.select("_key", "_of", *[(F.sum(c).over(up) - F.col(c)).alias(f"_{c}_before") for c in sums], *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy(key, "_share").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    both = placed.join(beside(before, few), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_share") == F.col("_of")))
    return both.select(*rows.columns, *[(F.sum(c).over(inside) + F.col(f"_{c}_before")).alias(f"{c}_to") for c in sums], *[f"{c}_all" for c in sums])


def presence_rank(df: DataFrame, key: str, score: str = "score", presence: str = "is_presence", few: bool = False) -> DataFrame:
    """(key, presence_rank): P(p > b) + P(p = b) / 2 for presence scores against background scores.

    Scores are counted by value first, then accumulated in shares, so pairs are never formed. Missing scores are left out;
    a key without both kinds gets null.
    """
    counts = df.where(finite(score).isNotNull()).groupBy(key, score).agg(F.count_if(F.col(presence)).alias("p"), F.count_if(~F.col(presence)).alias("b"))
    won = F.sum(F.col("p") * (F.col("b_to") - 0.5 * F.col("b")))
    out = running_totals(counts, key, score, ["b"], few).groupBy(key).agg(won.alias("w"), F.sum("p").alias("np"), F.sum("b").alias("nb"))
    return out.select(key, (F.col("w") / F.nullif(F.col("np") * F.col("nb"), F.lit(0)).cast("double")).alias("presence_rank"))


def or10(df: DataFrame, key: str, score: str = "score", test: str = "is_presence", few: bool = False) -> DataFrame:
    """(key, or10): share of test scores strictly below the 10 % quantile, linear between order statistics, of the
    training scores. Scores that are no finite number take no part."""
    cut = linear_quantiles(df.where(~F.col(test)), key, score, [0.1], few).select(key, F.get("quantiles", 0).alias("cut"))
    return df.where(F.col(test)).join(beside(cut, few), key).groupBy(key).agg(F.avg((F.col(score) < F.col("cut")).cast("double")).alias("or10"))


#: Even bins of a key's range in which its rows are counted to find where a quantile lies.
BINS = 1024


def _near_quantiles(rows: DataFrame, key: str, ends: Sequence[Callable[[Column], tuple[Column, Column]]], few: bool = False) -> DataFrame:
    """Of ``rows`` (key, v, w) the distinct values near some places of their key's running total, as (key, v, w, to, all):
    their weights, the total up to and with them, and that of the key. ``ends`` give each place's first and last total.

    Weights are added up by even bins of the key's range; only the values of bins that hold a place, and of the next ones
    on either side, are ranked, within their bin. Bins follow from exact ends of the range, so they are the same whenever
    they are worked out, and no task ranks a key's values. ``few`` as in ``beside``.
    """
    span = rows.groupBy(F.col(key).alias("_key")).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    half = lambda c: F.col(c) / 2.0  # noqa: E731  so that no range overflows
    at = F.coalesce(F.try_divide(half("v") - half("_low"), half("_high") - half("_low")), F.lit(0.0)) * BINS
    placed = rows.join(beside(span, few), F.col(key).eqNullSafe(F.col("_key"))).select("_key", "v", "w", F.least(F.floor(at), F.lit(BINS - 1)).alias("_bin"))
    up, whole = Window.partitionBy("_key").orderBy("_bin"), Window.partitionBy("_key")
    bins = placed.groupBy("_key", "_bin").agg(F.sum("w").alias("_w")).select("_key", "_bin", F.sum("_w").over(up).alias("_to"))
    bins = bins.select("_key", "_bin", "_to", (F.coalesce(F.lag("_to").over(up), F.lit(0))).alias("_before"), F.max("_to").over(whole).alias("all"))
    holds = F.lit(False)
    for first, last in (e(F.col("all")) for e in ends):
        holds = holds | (F.col("_before") <= last) & (F.col("_to") >= first)
    bins = bins.withColumn("_holds", holds)
    near = bins.withColumn("_near", F.col("_holds") | F.coalesce(F.lag("_holds").over(up), F.lit(False)) | F.coalesce(F.lead("_holds").over(up), F.lit(False))).where("_near")
    near = near.select(F.col("_key").alias("_of"), F.col("_bin").alias("_at"), "_before", "all")
    own = placed.join(beside(near, few), F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_bin") == F.col("_at")))
    values = own.groupBy("_key", "_bin", "v").agg(F.sum("w").alias("w"), F.max("_before").alias("_before"), F.max("all").alias("all"))
    inside = Window.partitionBy("_key", "_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return values.select(F.col("_key").alias(key), "v", "w", (F.sum("w").over(inside) + F.col("_before")).alias("to"), "all")


def linear_quantiles(df: DataFrame, key: str, value: str, at: Sequence[float], few: bool = False) -> DataFrame:
    """(key, quantiles): an array of quantiles, linear between order statistics.

    Only values near the wanted places are ranked, so that no task holds a key's values at once.
    """
    rows = df.where(finite(value).isNotNull()).select(key, F.col(value).alias("v"), F.lit(1).cast("long").alias("w"))
    pos = lambda n, q: (n - 1) * F.lit(float(q))
    placed = _near_quantiles(rows, key, [lambda n, q=q: (F.floor(pos(n, q)), F.floor(pos(n, q)) + 1) for q in at], few)
    n = F.col("n")
    here = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("to")), F.col("v")))
    placed = placed.select(key, "v", (F.col("to") - F.col("w")).alias("first"), "to", F.col("all").alias("n"))
    ends = placed.groupBy(key).agg(F.max("n").alias("n"), *[e for i, q in enumerate(at) for e in (here(F.floor(pos(n, q))).alias(f"a{i}"), here(F.least(F.floor(pos(n, q)) + 1, n - 1)).alias(f"b{i}"))])
    lerp = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (pos(n, q) - F.floor(pos(n, q))) for i, q in enumerate(at)]
    return ends.select(key, F.array(*lerp).alias("quantiles"))


def boyce_bins(df: DataFrame, key: str, score: str = "score", presence: str = "is_presence", bins: int = 10) -> DataFrame:
    """(key, bin, observed, expected): shares in equal bins over the combined range, the last bin closed."""
    rows = df.where(finite(score).isNotNull())
    span = rows.groupBy(key).agg(F.min(score).alias("low"), F.max(score).alias("high"))
    at = F.least(F.floor((F.col(score) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")
    counted = rows.join(span, key).where("high > low").groupBy(key, at.alias("bin")).agg(F.count_if(F.col(presence)).alias("p"), F.count_if(~F.col(presence)).alias("b"))
    w = Window.partitionBy(key)
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0)).cast("double")
    return counted.select(key, "bin", share("p").alias("observed"), share("b").alias("expected"))


def average_rank(c: str, *keys: str):
    """The mean of the places that equal values share."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, n, spearman): correlation of average-tie ranks, null for fewer than three rows or a constant side.

    Pairs of values are counted first; the rank of a value comes from totals that run in shares.
    """
    rows = df.where(finite(a).isNotNull() & finite(b).isNotNull()).groupBy(key, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("k"))

    def ranked(side: str, name: str) -> DataFrame:
        t = running_totals(rows.groupBy(key, side).agg(F.sum("k").alias("k")), key, side, ["k"])
        return t.select(F.col(key).alias(f"_{name}key"), F.col(side).alias(f"_{name}at"), (F.col("k_to") - (F.col("k") - 1) / 2.0).alias(name))

    for side, name in (("_a", "x"), ("_b", "y")):
        rows = rows.join(ranked(side, name), F.col(key).eqNullSafe(F.col(f"_{name}key")) & (F.col(side) == F.col(f"_{name}at"))).drop(f"_{name}key", f"_{name}at")
    return _correlation(rows, key, F.col("k"))


def _correlation(ranked: DataFrame, key: str, k: Column) -> DataFrame:
    """(key, n, spearman) of ranks x and y that ``k`` rows have."""
    s = ranked.groupBy(key).agg(F.sum(k).alias("n"), *[F.sum(k * e).alias(n) for n, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))])
    vx, vy = F.col("n") * F.col("xx") - F.col("x") ** 2, F.col("n") * F.col("yy") - F.col("y") ** 2
    r = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(F.when((vx > TOLERANCE) & (vy > TOLERANCE), vx * vy))
    return s.select(key, "n", F.when(F.col("n") >= 3, r).alias("spearman"))


def _window_spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``spearman`` for keys of as many rows as an index has windows: ranked by key as they are."""
    rows = df.where(finite(a).isNotNull() & finite(b).isNotNull())
    return _correlation(rows.select(key, average_rank(a, key).alias("x"), average_rank(b, key).alias("y")), key, F.lit(1).cast("long"))


def binned_boyce(df: DataFrame, key: str, score: str = "score", presence: str = "is_presence") -> DataFrame:
    """(key, n, spearman): correlation of bin and observed / expected ratio; ``n`` bins have background."""
    ratios = boyce_bins(df, key, score, presence).where("expected > 0").select(key, F.col("bin").cast("double").alias("bin"), (F.col("observed") / F.col("expected")).alias("ratio"))
    return _window_spearman(ratios.withColumn("ratio", F.round("ratio", 10)), key, "bin", "ratio")


def continuous_boyce(df: DataFrame, key: str, score: str = "score", presence: str = "is_presence", windows: int = 101, few: bool = False) -> DataFrame:
    """(key, n, spearman): as the binned index, over overlapping closed windows a tenth of the background's range wide.

    Scores are counted by value. The ends of the windows, to ten digits, are put among the values of their key, and what a
    window holds is the difference of the running totals at its ends: no value is copied into the windows that hold it.
    Successive equal ratios count once.
    """
    rows = df.where(finite(score).isNotNull())
    span = rows.where(~F.col(presence)).groupBy(key).agg(F.min(score).alias("low"), F.max(score).alias("high")).where("high > low")
    values = rows.groupBy(key, F.col(score).cast("double").alias("at")).agg(F.count_if(F.col(presence)).alias("p"), F.count_if(~F.col(presence)).alias("b")).join(beside(span.select(key), few), key, "left_semi")
    width, half = (F.col("high") - F.col("low")) / 10.0, F.lit(0.5e-10)
    start = F.col("low") + F.col("w") * ((F.col("high") - F.col("low") - width) / float(windows - 1))
    ends = span.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    ends = ends.select(key, "w", F.explode(F.array(F.struct((start - half).alias("at"), F.lit(-1).alias("sign")), F.struct((start + width + half).alias("at"), F.lit(1).alias("sign")))).alias("e")).select(key, "w", "e.*")
    marks = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "sign")))  # no more than there are windows
    placed = values.select(key, "at", "p", "b", F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("sign")).unionByName(ends.select(key, "at", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("b"), "w", "sign"))
    totals = running_totals(placed.groupBy(key, "at").agg(F.sum("p").alias("p"), F.sum("b").alias("b"), marks.alias("marks")), key, "at", ["p", "b"], few)
    # values below the lower end, and up to the upper one
    up_to = lambda c: F.when(F.col("m.sign") < 0, F.col(f"{c}_to") - F.col(c)).otherwise(F.col(f"{c}_to")) * F.col("m.sign")
    counted = totals.withColumn("m", F.explode("marks")).groupBy(key, F.col("m.w").alias("w")).agg(F.sum(up_to("p")).alias("p"), F.sum(up_to("b")).alias("b"), F.max("p_all").alias("np"), F.max("b_all").alias("nb"))
    return window_boyce(counted, key)


def window_boyce(counted: DataFrame, key: str) -> DataFrame:
    """(key, n, spearman) of ``continuous_boyce`` from (key, w, p, b, np, nb): what a window and its key hold of either kind."""
    ratio = F.round((F.col("p") / F.nullif(F.col("np"), F.lit(0)).cast("double")) / (F.col("b") / F.nullif(F.col("nb"), F.lit(0)).cast("double")), 10)
    ratios = counted.where("b > 0").select(key, F.col("w").cast("double").alias("w"), ratio.alias("ratio"))
    before = F.lag("ratio").over(Window.partitionBy(key).orderBy("w"))
    return _window_spearman(ratios.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("ratio"))), key, "w", "ratio")


def weighted_quantiles(df: DataFrame, key: str, value: str, weight: str, at: Sequence[float], few: bool = False) -> DataFrame:
    """(key, q, value): linear between mid-point cumulative weights, clamped at the ends; equal values are one.

    A quantile lies between the last value at or before it and the first one after it, which are a maximum and a minimum
    of the values near it.
    """
    v = df.where((finite(value).isNotNull()) & (F.col(weight) > 0)).select(key, F.col(value).alias("v"), F.col(weight).alias("w"))
    near = _near_quantiles(v, key, [lambda n, q=q: (n * F.lit(float(q)), n * F.lit(float(q))) for q in at], few)
    cdf = near.select(key, "v", ((F.col("to") - F.col("w") / 2.0) / F.col("all")).alias("c"))
    point, q_of = F.struct("c", "v"), [F.lit(float(q)) for q in at]
    ends = [F.struct(q.alias("q"), F.max(F.when(F.col("c") <= q, point)).alias("low"), F.min(F.when(F.col("c") > q, point)).alias("high")) for q in q_of]
    e = cdf.groupBy(key).agg(F.array(*ends).alias("ends")).select(key, F.explode("ends").alias("e"))
    low, high = F.col("e.low"), F.col("e.high")
    inside = low.v + (F.col("e.q") - low.c) / (high.c - low.c) * (high.v - low.v)
    return e.select(key, F.col("e.q").alias("q"), F.when(low.isNull(), high.v).when(high.isNull(), low.v).otherwise(inside).alias("value"))


def direction_changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, changes): how often the sign of successive differences turns, steps of zero left out."""
    w = Window.partitionBy(key).orderBy(order)
    steps = df.withColumn("d", F.signum(F.col(value) - F.lag(value).over(w))).where("d <> 0")
    turns = steps.withColumn("turn", (F.col("d") != F.lag("d").over(w)).cast("int"))
    return df.select(key).distinct().join(turns.groupBy(key).agg(F.sum(F.coalesce("turn", F.lit(0))).alias("t")), key, "left").select(key, F.coalesce("t", F.lit(0)).cast("long").alias("changes"))


def schoener_d(df: DataFrame, key: str, x: str, y: str, presence, bins: int = 20, pad: float = 1e-9) -> DataFrame:
    """(key, overlap): 1 - sum |p - b| / 2 of shares on a padded grid over both kinds of rows."""
    rows = df.where(finite(x).isNotNull() & finite(y).isNotNull()).withColumn("_p", presence)
    span = rows.groupBy(key).agg(*[f(c).alias(n + c) for c in (x, y) for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    at = lambda c: F.floor((F.col(c) - F.col("lo_" + c) + pad) / (F.col("hi_" + c) - F.col("lo_" + c) + 2 * pad) * bins)
    cells = rows.join(span, key).groupBy(key, at(x).alias("gx"), at(y).alias("gy")).agg(F.count_if("_p").alias("p"), F.count_if(~F.col("_p")).alias("b"))
    w = Window.partitionBy(key)
    part = lambda c: F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0)).cast("double")
    return cells.select(key, F.abs(part("p") - part("b")).alias("d")).groupBy(key).agg((1.0 - 0.5 * F.sum("d")).alias("overlap"))


def _moments(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    keep = df
    for c in columns:
        keep = keep.where(finite(c).isNotNull())
    return keep.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs])


def correlation_matrices(df: DataFrame, key: str, columns: Sequence[str]) -> Iterator[tuple[object, int, np.ndarray]]:
    """(key, rows, Pearson matrix) of each key from moments that Spark sums; one row a key reaches the driver."""
    for r in _moments(df, key, columns).toLocalIterator():
        c = np.array([[r[f"c_{a}_{b}"] if f"c_{a}_{b}" in r else r[f"c_{b}_{a}"] for b in columns] for a in columns], dtype=float)
        s = np.sqrt(np.maximum(np.diag(c), 0))
        yield r[key], r["n"], np.divide(c, np.outer(s, s), out=np.zeros_like(c), where=np.outer(s, s) > 0)


def _inflation(r: np.ndarray) -> np.ndarray:
    """1 / (1 - R^2) of each variable on the rest, infinite for a combination of them."""
    out = []
    for j in range(len(r)):
        rest = [i for i in range(len(r)) if i != j]
        spare = 1.0 - r[j, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)]) @ r[rest, j] if rest else 1.0
        out.append(1.0 / spare if spare > 1e-9 else np.inf)
    return np.array(out)


def vif(df: DataFrame, key: str, columns: Sequence[str], threshold: float = 10.0) -> DataFrame:
    """(key, step, predictor, vif, kept): predictors leave from the highest inflation on, the first of equals."""
    out = []
    for k, _, r in correlation_matrices(df, key, columns):
        left = list(range(len(columns)))
        step = 0
        while left:
            v = _inflation(r[np.ix_(left, left)])
            worst = int(np.argmax(np.round(v, 9)))
            if v[worst] <= threshold:
                out += [(k, step, columns[i], float(x), True) for i, x in zip(left, v, strict=True)]
                break
            out.append((k, step, columns[left[worst]], float(v[worst]), False))
            left.pop(worst)
            step += 1
    kind = dict(df.dtypes)[key]
    return df.sparkSession.createDataFrame(out, f"{key} {kind}, step int, predictor string, vif double, kept boolean")


def equivalence_groups(pairs: Sequence[tuple[str, str]], predictors: Sequence[str]) -> dict[str, str]:
    """Predictors joined by pairs share a group, numbered by their first predictor in order."""
    parent = {p: p for p in predictors}

    def find(p: str) -> str:
        while parent[p] != p:
            p = parent[p]
        return p

    order = {p: i for i, p in enumerate(predictors)}
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            first, other = (x, y) if order[x] < order[y] else (y, x)
            parent[other] = first
    names: dict[str, str] = {}
    return {p: names.setdefault(find(p), f"eq{len(names) + 1:03d}") for p in predictors}


def density_weights(df: DataFrame, key: str, p, cap_quantile: float = 0.99) -> DataFrame:
    """``df`` with ``weight``: inverse odds of ``p`` capped at a key's quantile, with mean one."""
    from tarnflow.functions.values import odds

    rows = df.withColumn("_w", odds(p))
    cap = rows.groupBy(key).agg(F.percentile("_w", cap_quantile).alias("_cap"))
    capped = rows.join(cap, key).withColumn("_w", F.least("_w", "_cap"))
    return capped.withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy(key))).drop("_w", "_cap")


def effective_size(df: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """(key, n, effective_size): (sum w)^2 / sum w^2."""
    return df.groupBy(key).agg(F.count("*").alias("n"), (F.sum(weight) ** 2 / F.sum(F.col(weight) ** 2)).alias("effective_size"))
