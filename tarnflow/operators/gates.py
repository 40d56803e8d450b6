"""Gates: rules as a table of (grain, figure, bound), held against evidence that is brought into long form.

Every gate gives a ledger, a row for each rule and each subject it is put to, with the value, the bound and whether it
passes; a decision is an aggregate of its ledger. All gates take ``case`` columns: many decisions share one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import TOLERANCE, finite, positive_fraction

from .certificates import BASE, MARGIN, pareto_front


@dataclass(frozen=True)
class Rule:
    """``figure`` of the subjects of ``grain`` must be at least ``bound``; a missing figure fails."""

    grain: str
    figure: str
    bound: float


def _fractions(rules: Sequence[Rule]) -> None:
    for rule in rules:
        if rule.figure.endswith(("fraction", "stability")) and not 0 <= rule.bound <= 1:
            raise ValueError(f"{rule.figure}: a share lies in 0 to 1")
        if rule.figure.startswith("n_") and rule.bound < 1:
            raise ValueError(f"{rule.figure}: a count is 1 at least")


def ledger(evidence: DataFrame, case: Sequence[str], grain: str, subject: Column, rules: Sequence[Rule], kept: Sequence[str] = ()) -> DataFrame:
    """(case, kept, grain, subject, figure, value, bound, passes): the rules of ``grain`` against wide ``evidence``."""
    own = [x for x in rules if x.grain == grain]
    _fractions(own)
    each = F.explode(F.array(*[F.struct(F.lit(x.figure).alias("figure"), finite(F.col(x.figure).cast("double")).alias("value"), F.lit(float(x.bound)).alias("bound")) for x in own])).alias("rule")
    rows = evidence.select(*case, *kept, F.lit(grain).alias("grain"), subject.cast("string").alias("subject"), each)
    return rows.select(*case, *kept, "grain", "subject", "rule.*").withColumn("passes", F.coalesce(F.col("value") >= F.col("bound"), F.lit(False)))


def contrast(deltas: DataFrame, case: Sequence[str], delta: str, run: str) -> DataFrame:
    """(case, n_pairs, n_runs, mean_delta, median_delta, positive_fraction, positive_run_fraction) of paired differences.

    A run counts as positive by its mean. Missing differences count as pairs that are not positive.
    """
    runs = deltas.groupBy(*case, run).agg(F.avg(finite(delta)).alias("_mean")).groupBy(*case).agg(F.count("*").alias("n_runs"), positive_fraction(F.col("_mean")).alias("positive_run_fraction"))
    pairs = deltas.groupBy(*case).agg(F.count("*").alias("n_pairs"), F.avg(finite(delta)).alias("mean_delta"), F.median(finite(delta)).alias("median_delta"), positive_fraction(finite(delta)).alias("positive_fraction"))
    both = reduce(lambda a, c: a & c, [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in case], F.lit(True))
    joined = pairs.alias("p").join(runs.alias("r"), both) if case else pairs.crossJoin(runs)
    own = [F.col(f"p.{c}").alias(c) for c in case]
    return joined.select(*own, "n_pairs", "n_runs", "mean_delta", "median_delta", "positive_fraction", "positive_run_fraction")


#: Grains of a process promotion.
NOMINATION, NECESSITY, CORE_FULL, CORE_RANDOM = "nomination", "necessity", "core_over_full", "core_over_random"


def process_promotion(stability: DataFrame, over_full: DataFrame, over_random: DataFrame, case: Sequence[str], process: str, rules: Sequence[Rule], delta: str = "delta", split: str = "split_id") -> DataFrame:
    """The ledger of a process core: (case, grain, subject, figure, value, bound, passes, nominated, failure).

    ``stability`` has a row a process with the figures that the rules of nomination (stable in discovery) and necessity
    (what unseen taxa lose without it) name; ``over_full`` and ``over_random`` have paired differences of the core. A
    process that is not nominated is judged but fails nothing; a case without any nominated process fails by a row of its
    own, and one without pairs by the core's missing figures. Nominated processes are never dropped for what fails them.
    """
    nomination = ledger(stability, case, NOMINATION, F.col(process), rules)
    passed = nomination.groupBy(*case, "subject").agg(F.bool_and("passes").alias("nominated"))
    held = nomination.unionByName(ledger(stability, case, NECESSITY, F.col(process), rules)).join(passed, [*case, "subject"])
    held = held.withColumn("failure", F.col("nominated") & ~F.col("passes"))
    none = passed.groupBy(*case).agg(F.count_if("nominated").alias("n_nominated"))
    none = ledger(none, case, NOMINATION, F.lit(None), [Rule(NOMINATION, "n_nominated", 1)]).withColumns({"nominated": F.lit(None).cast("boolean"), "failure": ~F.col("passes")})
    cases = stability.select(*case).distinct()
    out = held.unionByName(none)
    for grain, deltas in ((CORE_FULL, over_full), (CORE_RANDOM, over_random)):
        figures = cases.join(contrast(deltas, case, delta, split), list(case), "left").fillna(0, ["n_pairs", "n_runs"])
        out = out.unionByName(ledger(figures, case, grain, F.lit(None), rules).withColumns({"nominated": F.lit(None).cast("boolean"), "failure": ~F.col("passes")}))
    return out


def process_decision(held: DataFrame, case: Sequence[str]) -> DataFrame:
    """(case, promoted, n_nominated, n_validated, n_failures, failures): of the ledger of ``process_promotion``.

    A core is promoted if nothing fails; ``n_validated`` counts nominated processes that are necessary as well.
    """
    subjects = held.where("subject is not null").groupBy(*case, "subject").agg(F.bool_and("nominated").alias("nominated"), F.bool_and("passes").alias("all"))
    n = subjects.groupBy(*case).agg(F.count_if("nominated").alias("n_nominated"), F.count_if(F.col("nominated") & F.col("all")).alias("n_validated"))
    said = F.concat_ws(":", "grain", "subject", "figure")
    g = held.groupBy(*case).agg((F.count_if("failure") == 0).alias("promoted"), F.count_if("failure").alias("n_failures"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("failure"), said))), ";").alias("failures"))
    return g.join(n, list(case)).select(*case, "promoted", "n_nominated", "n_validated", "n_failures", "failures")


#: Grains of a method promotion.
PROTOCOL, COMPARATOR = "protocol", "comparator"


def method_promotion(stability: DataFrame, runs: DataFrame, deltas: DataFrame, case: Sequence[str], choice: Sequence[str], required: Sequence[str], rules: Sequence[Rule], strategy: str = "strategy", run: str = "run_id", comparator: str = "comparator", delta: str = "delta") -> DataFrame:
    """The ledger of a case's most stable method: (case, choice, grain, subject, status, figure, value, bound, passes).

    The method with the largest ``selection_fraction``, then ``runs_selected``, then the first by name is put to the rules
    of its protocol, whose figures may name columns of its ``runs`` by their least (``least_<column>``), and to those of
    every required comparator over its own pairs. A comparator that is the method itself passes (status ``self``), one
    without pairs fails each of its rules (``missing``).
    """
    first = F.row_number().over(Window.partitionBy(*case, *([] if case else [F.lit(1)])).orderBy(F.desc("selection_fraction"), F.desc("runs_selected"), *choice))
    top = stability.withColumn("_nth", first).where("_nth = 1").select(*case, *choice, "selection_fraction", "runs_selected")
    least = [x.figure.removeprefix("least_") for x in rules if x.grain == PROTOCOL and x.figure.startswith("least_")]
    keys = [*case, *choice]
    if least:
        top = top.join(runs.groupBy(*keys).agg(*[F.min(finite(F.col(c).cast("double"))).alias(f"least_{c}") for c in least]), keys, "left")
    protocol = ledger(top, keys, PROTOCOL, F.lit(None), rules).withColumn("status", F.lit("evaluated"))
    pairs = deltas.join(top.select(*keys), keys, "left_semi").where(F.col(comparator).isin(list(required)))
    figures = contrast(pairs, [*keys, comparator], delta, run)
    asked = top.select(*keys, F.explode(F.array(*map(F.lit, required))).alias(comparator)).join(figures, [*keys, comparator], "left").fillna(0, ["n_pairs", "n_runs"])
    own = F.col(comparator) == F.col(strategy)
    asked = asked.withColumn("status", F.when(own, "self").when(F.col("n_pairs") == 0, "missing").otherwise("evaluated"))
    compared = ledger(asked, keys, COMPARATOR, F.col(comparator), rules, ["status"]).withColumn("passes", F.col("passes") | (F.col("status") == "self"))
    return protocol.unionByName(compared)


def method_decision(held: DataFrame, runs: DataFrame, case: Sequence[str], choice: Sequence[str], shown: Sequence[str], run: str = "run_id") -> DataFrame:
    """(case, choice, promoted, n_failures, failures, shown of the choice's first run): of a ledger of ``method_promotion``."""
    keys = [*case, *choice]
    said = F.concat_ws(":", "grain", "subject", "figure")
    g = held.groupBy(*keys).agg(F.bool_and("passes").alias("promoted"), F.count_if(~F.col("passes")).alias("n_failures"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passes"), said))), ";").alias("failures"))
    reference = runs.groupBy(*keys).agg(F.min(F.struct(run, *shown)).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (run, *shown)])
    return g.join(reference, keys, "left")


#: Names of the checks of a differentiation, and their figures (fixed values).
_CHECKS = {"n_runs": "runs", "n_pairs": "pairs", "mean_delta": "mean_delta", "positive_fraction": "positive_pairs", "positive_run_fraction": "positive_runs"}


def differentiation(summary: DataFrame, case: Sequence[str], required: Sequence[str], bounds: dict[str, float], comparator: str = "comparator") -> DataFrame:
    """(case, comparator, present, figures, passes, failure_reason): a row for each required comparator of each case.

    ``summary`` has the figures of ``contrast`` a comparator. One that is missing, or there twice, is not present and
    fails; the reason names the checks that fail, in the order of the figures.
    """
    _fractions([Rule("", c, b) for c, b in bounds.items()])
    asked = summary.select(*case).distinct().withColumn(comparator, F.explode(F.array(*map(F.lit, required)))) if case else summary.sparkSession.createDataFrame([(c,) for c in required], f"{comparator} string")
    figures = summary.groupBy(*case, comparator).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in _CHECKS])
    out = asked.join(figures, [*case, comparator], "left").withColumn("present", F.coalesce(F.col("_n") == 1, F.lit(False)))
    counts = ("n_runs", "n_pairs")
    out = out.withColumns({c: F.when(F.col("present"), F.col(c)).otherwise(F.lit(0) if c in counts else F.lit(None)) for c in _CHECKS})
    fails = [F.when(~F.coalesce(F.col(c) >= bounds[c], F.lit(False)), F.lit(name)) for c, name in _CHECKS.items() if c in bounds]
    reason = F.when(~F.col("present"), "missing_or_duplicate_comparator").otherwise(F.concat_ws(";", *fails))
    return out.withColumn("failure_reason", reason).withColumn("passes", F.col("failure_reason") == "").select(*case, comparator, "present", *_CHECKS, "passes", "failure_reason")


def perturbation_selection(
    df: DataFrame, case: Sequence[str], candidate: str, perturbation: str, higher: Sequence[str], lower: Sequence[str], gate: str = "presence_rank",
    kind: str | None = None, hard: Sequence[str] | None = None, complexity: str | None = None, sems: float = 1.0, chance: float = BASE, margin: float = MARGIN, most: dict[str, float] | None = None,
) -> DataFrame:
    """A procedure that holds under every perturbation of its data: (case, candidate, eligible, complete, on_front,
    worst_rank, mean_worst_rank, worst_mean_rank, mean_rank, mean_complexity, selected), a row a candidate.

    ``df`` has a row for each candidate, perturbation and fold. Eligible is who passes the ``gate`` metric (mean a margin
    above chance, its lower bound not below) in every perturbation of the ``hard`` kinds, all if none are named, and stays
    at or below the means that ``most`` names there. Eligible candidates are ranked within each perturbation by the mean of
    each metric; those with finite ranks in all perturbations of the case are complete. Of these, who is not dominated in
    the worst ranks of the metrics stands on the front, and the least worst of them, then their mean, the same of the mean
    ranks, complexity and name win. A case where nobody qualifies has no selected row; a case with fewer than two
    perturbations, or none of a hard kind, has no eligible one. Ranks count who is eligible, complete or not.
    """
    metrics, keys = [*higher, *lower], [*case, candidate]
    if hard is not None and (kind is None or not hard):
        raise ValueError("hard kinds need a column of kinds, and one kind at least")
    is_hard = F.lit(True) if hard is None else F.coalesce(F.col(kind).isin(list(hard)), F.lit(False))
    value = finite(F.col(gate).cast("double"))
    bounds = dict(most or {})
    per = df.groupBy(*keys, perturbation).agg(
        F.max(is_hard).alias("_hard"), F.min(is_hard).alias("_same"), F.avg(value).alias("_mean"), F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"),
        *[F.avg(finite(F.col(c).cast("double"))).alias(f"_most_{c}") for c in bounds], *[F.avg(finite(F.col(m).cast("double"))).alias(m) for m in metrics],
    )
    lower_bound = F.col("_mean") - sems * F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_sd"))  / F.sqrt(F.col("_n").cast("double"))
    ok = (F.col("_mean") >= chance + margin - TOLERANCE) & (lower_bound >= chance - TOLERANCE)
    for c, bound in bounds.items():
        ok = ok & (F.col(f"_most_{c}") <= bound + TOLERANCE)
    per = per.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    # a kind belongs to a perturbation of the case, whoever was tried in it
    kinds = per.groupBy(*case, perturbation).agg(F.max("_hard").alias("_is"), F.min("_same").alias("_all"))
    if hard is not None:
        mixed = F.col("_is") & ~F.col("_all")
        kinds = kinds.withColumn("_is", F.when(mixed, F.raise_error(F.lit("a perturbation has rows of hard and of other kinds")).cast("boolean")).otherwise(F.col("_is")))
    total = kinds.groupBy(*case).agg(F.count("*").alias("_every"), F.count_if("_is").alias("_gates"))
    base = per.groupBy(*keys).agg(F.count("*").alias("_seen"), F.count_if("_hard").alias("_gated"), F.count_if(F.col("_hard") & F.col("_ok")).alias("_passed"))
    base = base.join(total, list(case)).withColumn("eligible", (F.col("_gates") > 0) & (F.col("_every") > 1) & (F.col("_gated") == F.col("_gates")) & (F.col("_passed") == F.col("_gates")))
    ranked = per.join(base.where("eligible").select(*keys), keys, "left_semi")
    within = Window.partitionBy(*case, perturbation)
    place = lambda m: F.when(F.col(m).isNotNull(), F.rank().over(within.orderBy(F.desc_nulls_last(m) if m in higher else F.asc_nulls_last(m))))
    ranked = ranked.select(*keys, *[place(m).alias(f"_r_{m}") for m in metrics])
    full = reduce(lambda a, c: a & c, [F.col(f"_r_{m}").isNotNull() for m in metrics])
    g = ranked.groupBy(*keys).agg(F.count("*").alias("_ranked"), F.bool_and(full).alias("_finite"), *[f(f"_r_{m}").cast("double").alias(f"{n}_{m}") for m in metrics for f, n in ((F.max, "_w"), (F.avg, "_m"))])
    size = df.groupBy(*keys).agg((F.avg(finite(F.col(complexity).cast("double"))) if complexity else F.lit(None).cast("double")).alias("mean_complexity"))
    out = base.join(g, keys, "left").withColumn("complete", F.coalesce(F.col("eligible") & F.col("_finite") & (F.col("_ranked") == F.col("_every")), F.lit(False))).join(size, keys)
    worst, mean = [F.col(f"_w_{m}") for m in metrics], [F.col(f"_m_{m}") for m in metrics]
    average = lambda c: sum(c[1:], c[0]) / float(len(c))
    highest = lambda c: F.greatest(*c) if len(c) > 1 else c[0]
    out = out.withColumns({"worst_rank": highest(worst), "mean_worst_rank": average(worst), "worst_mean_rank": highest(mean), "mean_rank": average(mean)})
    front = pareto_front(out.where("complete"), case, candidate, [], [f"_w_{m}" for m in metrics]).select(*keys, *(figures := ["worst_rank", "mean_worst_rank", "worst_mean_rank", "mean_rank"]), "mean_complexity")
    order = ["worst_rank", *[F.round(c, 9) for c in figures[1:]], F.asc_nulls_last("mean_complexity"), candidate]
    front = front.withColumn("_nth", F.row_number().over(Window.partitionBy(*case).orderBy(*order))).select(*keys, F.lit(True).alias("on_front"), (F.col("_nth") == 1).alias("selected"))
    out = out.join(front, keys, "left").fillna(False, ["on_front", "selected"])
    shown = F.col("complete")
    return out.select(*keys, "eligible", "complete", "on_front", *[F.when(shown, F.col(c)).alias(c) for c in figures], "mean_complexity", "selected")
