"""Roll-ups of metric tables: performance, stability, contrasts, evidence, heterogeneity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import TOLERANCE, checked_join, positive_fraction


def winners(df: DataFrame, case: Sequence[str], metric: str) -> DataFrame:
    """``df`` with ``won``: within the tolerance of its case's best."""
    return df.withColumn("won", F.col(metric) >= F.max(metric).over(Window.partitionBy(*case)) - TOLERANCE)


def method_performance(df: DataFrame, case: Sequence[str], method: str, metric: str, size: str) -> DataFrame:
    """(method, n_cases, mean, median, win_fraction, mean_size); ties all win."""
    return winners(df, case, metric).groupBy(method).agg(
        F.count("*").alias("n_cases"), F.avg(metric).alias("mean_metric"), F.median(metric).alias("median_metric"), F.avg(F.col("won").cast("double")).alias("win_fraction"), F.avg(size).alias("mean_size")
    )


def pair_summary(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Count, mean, median, least and most of a metric by keys."""
    return df.groupBy(*keys).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean_metric"), F.median(metric).alias("median_metric"), F.min(metric).alias("worst"), F.max(metric).alias("best"))


def case_scores(df: DataFrame, case: Sequence[str], metric: str) -> DataFrame:
    """``df`` with ``case_rank`` (least place of equals, best first), ``rank_score`` from 1 to 0 and ``case_win``."""
    w = Window.partitionBy(*case)
    n = F.count("*").over(w)
    ranked = df.withColumn("case_rank", F.rank().over(w.orderBy(F.desc(metric)))).withColumn("_n", n)
    score = F.when(F.col("_n") <= 1, F.lit(1.0)).otherwise(1.0 - (F.col("case_rank") - 1) / (F.col("_n") - 1).cast("double"))
    return ranked.withColumn("rank_score", score).withColumn("case_win", (F.col("case_rank") == 1).cast("int")).drop("_n")


def robust_across_specs(df: DataFrame, spec: str, case: str, method: Sequence[str], metric: str) -> DataFrame:
    """By method over specifications: mean and worst spec's mean rank score, win shares, spec wins."""
    scored = case_scores(df, [spec, case], metric)
    by_spec = scored.groupBy(spec, *method).agg(F.avg("rank_score").alias("s"), F.avg("case_win").alias("w"), F.avg(metric).alias("_v"))
    best = by_spec.withColumn("spec_win", (F.col("s") >= F.max("s").over(Window.partitionBy(spec)) - TOLERANCE).cast("double"))
    return best.groupBy(*method).agg(F.count("*").alias("n_specs"), F.avg("s").alias("mean_rank_score"), F.min("s").alias("worst_rank_score"), F.avg("w").alias("case_win_fraction"), F.avg("spec_win").alias("spec_win_fraction"), F.avg("_v").alias("mean_metric"))


def transfer_summary(df: DataFrame, spec: str, method: Sequence[str], inner: str, outer: str) -> DataFrame:
    """By method: worst, best and sample deviation of spec means, and the gap of inner to outer."""
    means = df.groupBy(spec, *method).agg(F.avg(outer).alias("o"), F.avg(inner).alias("i"))
    return means.groupBy(*method).agg(F.min("o").alias("worst_spec"), F.max("o").alias("best_spec"), F.stddev_samp("o").alias("sd_spec"), F.avg("o").alias("mean_spec"), (F.avg("i") - F.avg("o")).alias("gap"))


def best_combination(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """The key with the highest mean of a metric, the first of equals, with its count."""
    means = df.groupBy(*keys).agg(F.avg(metric).alias("mean_metric"), F.count(metric).alias("n"))
    return means.orderBy(F.desc(F.round("mean_metric", 9)), *keys).limit(1)


def selection_frequency(df: DataFrame, item: str, case: str, gain: str, step: str) -> DataFrame:
    """(item, n_cases, fraction, median_gain, median_step): fraction of all cases."""
    total = df.agg(F.countDistinct(case).alias("total"))
    out = df.groupBy(item).agg(F.countDistinct(case).alias("n_cases"), F.median(gain).alias("median_gain"), F.median(step).alias("median_step"))
    return out.crossJoin(F.broadcast(total)).select(item, "n_cases", (F.col("n_cases") / F.col("total").cast("double")).alias("fraction"), "median_gain", "median_step")


def common_set(frequency: DataFrame, item: str, least: float, k: int) -> DataFrame:
    """Items chosen often enough, or all if none is; then the first ``k`` by fraction, gain and name."""
    often = frequency.withColumn("_any", F.max((F.col("fraction") >= least).cast("int")).over(Window.partitionBy(F.lit(1))))
    kept = often.where((F.col("_any") == 0) | (F.col("fraction") >= least)).drop("_any")
    return kept.orderBy(F.desc("fraction"), F.desc("median_gain"), item).limit(k)


def item_evidence(df: DataFrame, item: str, case: str, gain: str, drop: str) -> DataFrame:
    """By item over cases: mean and median of summed gain, share of positive drops, coverage of all cases."""
    per = df.groupBy(item, case).agg(F.sum(gain).alias("g"), F.max(drop).alias("d"))
    total = F.broadcast(df.agg(F.countDistinct(case).alias("total")))
    out = per.groupBy(item).agg(F.avg("g").alias("mean_gain"), F.median("g").alias("median_gain"), positive_fraction(F.col("d")).alias("positive_drop_fraction"), F.count("*").alias("n_cases"))
    return out.crossJoin(total).select(item, "mean_gain", "median_gain", "positive_drop_fraction", "n_cases", (F.col("n_cases") / F.col("total").cast("double")).alias("coverage"))


def group_map(df: DataFrame, group: str, item: str, process: str) -> DataFrame:
    """(group, items, processes, cross_process): sorted unique lists, joined by commas."""
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("items"), F.array_join(F.array_sort(F.collect_set(process)), ",").alias("processes"), (F.countDistinct(process) > 1).alias("cross_process"))


def heterogeneity(df: DataFrame, item: str, stratum: str, value: str, least_cases: int) -> DataFrame:
    """By item over strata with enough rows: range and population deviation of stratum means, and where they are."""
    means = df.groupBy(item, stratum).agg(F.avg(value).alias("m"), F.count(value).alias("n")).where(F.col("n") >= least_cases)
    low, high = F.min(F.struct("m", stratum)), F.min(F.struct((-F.col("m")).alias("m"), F.col(stratum)))
    return means.groupBy(item).agg(F.count("*").alias("n_strata"), low["m"].alias("least"), (-high["m"]).alias("most"), F.stddev_pop("m").alias("sd"), low[stratum].alias("least_stratum"), high[stratum].alias("most_stratum")).withColumn("range", F.col("most") - F.col("least"))


def split_stability(df: DataFrame, item: str, split: str, selected: Column, drop: str) -> DataFrame:
    """By item: in how many of all splits it is selected, and its drops there."""
    total = F.broadcast(df.agg(F.countDistinct(split).alias("total")))
    per = df.where(selected).groupBy(item).agg(F.countDistinct(split).alias("n_selected"), F.avg(drop).alias("mean_drop"), F.median(drop).alias("median_drop"), positive_fraction(F.col(drop)).alias("positive_fraction"))
    return per.crossJoin(total).withColumn("selection_fraction", F.col("n_selected") / F.col("total").cast("double")).drop("total")


def choice_stability(df: DataFrame, run: str, choice: Sequence[str], metric: str) -> DataFrame:
    """(choice, runs_selected, n_runs, selection_fraction): how often each choice wins a run, the first of equals."""
    means = df.groupBy(run, *choice).agg(F.round(F.avg(metric), 9).alias("_v"))
    first = means.withColumn("_nth", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("_v"), *choice))).where("_nth = 1")
    total = F.broadcast(df.agg(F.countDistinct(run).alias("n_runs")))
    return first.groupBy(*choice).agg(F.count("*").alias("runs_selected")).crossJoin(total).withColumn("selection_fraction", F.col("runs_selected") / F.col("n_runs").cast("double"))


def paired_deltas(df: DataFrame, keys: Sequence[str], method: str, metric: str, baseline: str) -> DataFrame:
    """(keys, method, delta): a method's mean less the baseline's in the same case; cases without both are left out."""
    m = df.groupBy(*keys, method).agg(F.avg(metric).alias("v"))
    base = m.where(F.col(method) == baseline).select(*keys, F.col("v").alias("b"))
    return checked_join(m.where(F.col(method) != baseline), base, keys, "inner", "many_to_one").where("v is not null and b is not null").select(*keys, method, (F.col("v") - F.col("b")).alias("delta"))


def retained_fraction(full: DataFrame, reduced: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """(keys, full, reduced, loss, retained): what is left of the skill above one half, null where there was none."""
    both = checked_join(full.select(*keys, F.col(metric).alias("full")), reduced.select(*keys, F.col(metric).alias("reduced")), keys, "inner", "one_to_one")
    return both.withColumn("loss", F.col("full") - F.col("reduced")).withColumn("retained", (F.col("reduced") - 0.5) / F.nullif(F.col("full") - 0.5, F.lit(0.0)))


def delta_summary(deltas: DataFrame, method: str, run: str) -> DataFrame:
    """By method: mean, median, positive share of pairs and of run means, worst and best run."""
    runs = deltas.groupBy(method, run).agg(F.avg("delta").alias("r"))
    per_run = runs.groupBy(method).agg(F.count("*").alias("n_runs"), positive_fraction(F.round("r", 9)).alias("positive_run_fraction"), F.min("r").alias("worst_run"), F.max("r").alias("best_run"))
    pairs = deltas.groupBy(method).agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"), positive_fraction(F.round("delta", 9)).alias("positive_fraction"))
    return checked_join(pairs, per_run, [method], "inner", "one_to_one")


def perturbation_ranks(df: DataFrame, case: Sequence[str], higher: Sequence[str], lower: Sequence[str]) -> DataFrame:
    """``df`` with ``rank_<metric>`` by direction, and the worst and mean of them."""
    w = Window.partitionBy(*case)
    out = df
    for m in (*higher, *lower):
        out = out.withColumn(f"rank_{m}", F.rank().over(w.orderBy(F.desc(m) if m in higher else F.asc(m))))
    ranks = [F.col(f"rank_{m}") for m in (*higher, *lower)]
    return out.withColumn("worst_rank", F.greatest(*ranks)).withColumn("mean_rank", sum(ranks[1:], ranks[0]) / float(len(ranks)))


def co_winners(ranked: DataFrame, case: Sequence[str], candidate: str) -> DataFrame:
    """(case, winners): all candidates with the least worst rank, then the least mean rank, joined by commas."""
    w = Window.partitionBy(*case)
    best = ranked.withColumn("_w", F.min("worst_rank").over(w)).where("worst_rank = _w").withColumn("_m", F.min("mean_rank").over(w)).where(F.col("mean_rank") <= F.col("_m") + TOLERANCE)
    return best.groupBy(*case).agg(F.array_join(F.array_sort(F.collect_set(candidate)), ",").alias("winners"))


def inner_outer(df: DataFrame, case: Sequence[str], candidate: str, inner: str, outer: str) -> DataFrame:
    """By case: the inner winner's outer value, the regret against the best, whether they match, and the gap."""
    first = lambda c: F.min(F.struct((-F.col(c)).alias("v"), F.col(candidate), F.col(inner).alias("i"), F.col(outer).alias("o")))
    g = df.groupBy(*case).agg(first(inner).alias("a"), first(outer).alias("b"), F.count("*").alias("n"))
    return g.select(*case, "n", F.col(f"a.{candidate}").alias("inner_winner"), F.col(f"b.{candidate}").alias("outer_winner"), (F.col("b.o") - F.col("a.o")).alias("regret"), (F.col(f"a.{candidate}") == F.col(f"b.{candidate}")).alias("match"), (F.col("a.i") - F.col("a.o")).alias("gap"))


def role_dominance(df: DataFrame, role: str, value: str) -> DataFrame:
    """(role, total, share, dominant): each role's share of a total, and whether it is more than half."""
    g = df.groupBy(role).agg(F.sum(value).alias("total"))
    share = F.col("total") / F.nullif(F.sum("total").over(Window.partitionBy(F.lit(1))), F.lit(0.0))
    return g.withColumn("share", share).withColumn("dominant", F.col("share") > 0.5)


def fold_counts(df: DataFrame, case: Sequence[str], fold: str, presence: Column, least: int) -> DataFrame:
    """(case, n_folds, least_presence, least_background, supported, imbalance): of rows in folds."""
    per = df.groupBy(*case, fold).agg(F.count_if(presence).alias("p"), F.count_if(~presence).alias("b"), F.count("*").alias("n"))
    g = per.groupBy(*case).agg(F.count("*").alias("n_folds"), F.min("p").alias("least_presence"), F.min("b").alias("least_background"), (F.max("n") / F.avg("n")).alias("imbalance"))
    return g.withColumn("supported", (F.col("least_presence") >= least) & (F.col("least_background") >= least))


def fold_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, count and worst fold of each metric (the least value) over finite folds."""
    return df.groupBy(*keys).agg(*[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_folds"), F.min(m).alias(f"{m}_worst"))])
