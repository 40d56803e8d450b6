"""Completeness, envelopes, knock-outs, certificates and decisions, with selection by fronts and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import TOLERANCE, checked_join, expected_grid

#: Fixed values of the decision rules.
BASE, MARGIN, SUPPORT, REFUTE, MODAL, SPAN_RTOL = 0.50, 0.01, 2 / 3, 1 / 3, 2 / 3, 1e-9


def auc_adequacy(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean, standard error (0 for one value, null for none), lower bound, and both gates."""
    g = df.groupBy(*keys).agg(F.avg(metric).alias("mean_metric"), F.count(metric).alias("n"), F.stddev_samp(metric).alias("_sd"))
    sem = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("n") > 1, F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    out = g.withColumn("sem", sem).withColumn("lower", F.col("mean_metric") - F.col("sem")).drop("_sd")
    return out.withColumn("adequate", F.coalesce((F.col("mean_metric") >= BASE + MARGIN - TOLERANCE) & (F.col("lower") >= BASE - TOLERANCE), F.lit(False)))


def fold_completeness(df: DataFrame, keys: Sequence[str], fold: str, folds: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """(keys, n_rows, n_folds, eligible): exactly the expected folds, once each, with every column present."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull() & ~F.isnan(c)
    g = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(fold).alias("n_folds"), F.count_if(F.col(fold).isin(list(folds)) & full).alias("_ok"))
    want = len(set(folds))
    return g.withColumn("eligible", (F.col("n_rows") == want) & (F.col("n_folds") == want) & (F.col("_ok") == want)).drop("_ok")


def dense_grid(evidence: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every pair of the two dimensions, with zero where there is no evidence."""
    return checked_join(expected_grid(left, right), evidence, keys, "left", "one_to_one").withColumn(value, F.coalesce(value, F.lit(0.0)))


def knockout_pairs(full: DataFrame, reduced: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``reduced`` rows with the loss of each metric against the full model in the same cell."""
    base = full.select(*keys, *[F.col(m).alias(f"_full_{m}") for m in metrics])
    both = checked_join(reduced, base, keys, "inner", "many_to_one")
    return both.select(*[c for c in reduced.columns if c not in metrics], *[(F.col(f"_full_{m}") - F.col(m)).alias(f"{m}_loss") for m in metrics])


def knockout_ledger(full: DataFrame, reduced: DataFrame, keys: Sequence[str], knockout: str, expected: int | None = None) -> DataFrame:
    """(knockout, n_pairs, n_reduced, n_full, complete): whether each knock-out has exactly one row for each cell of the
    full model, and as many cells as expected where that is given."""
    cells = checked_join(reduced.select(knockout, *keys), full.select(*keys).withColumn("_f", F.lit(1)), keys, "left", "many_to_one")
    total = full.agg(F.count("*").alias("n_full"))
    g = cells.groupBy(knockout).agg(F.count("_f").alias("n_pairs"), F.count("*").alias("n_reduced"), F.countDistinct(F.when(F.col("_f") == 1, F.struct(*keys))).alias("_d"))
    out = g.crossJoin(F.broadcast(total))
    whole = (F.col("n_pairs") == F.col("n_reduced")) & (F.col("_d") == F.col("n_pairs")) & (F.col("n_pairs") == F.col("n_full"))
    return out.withColumn("complete", whole if expected is None else whole & (F.col("n_full") == expected)).drop("_d")


def process_state(df: DataFrame, keys: Sequence[str], admitted: Column, complete: Column) -> DataFrame:
    """(keys, state): a witness if any route is admitted, required if all are complete, else unresolved."""
    g = df.groupBy(*keys).agg(F.bool_or(F.coalesce(admitted, F.lit(False))).alias("a"), F.bool_and(F.coalesce(complete, F.lit(False))).alias("c"))
    return g.select(*keys, F.when(F.col("a"), "witness").when(F.col("c"), "required").otherwise("unresolved").alias("state"))


def spec_status(df: DataFrame, keys: Sequence[str], spec: str, succeeded: Column, expected: int) -> DataFrame:
    """(keys, n_successful, status): complete if as many specifications succeeded as were expected."""
    g = df.groupBy(*keys).agg(F.countDistinct(F.when(succeeded, F.col(spec))).alias("n_successful"))
    return g.withColumn("status", F.when(F.col("n_successful") == expected, "complete").when(F.col("n_successful") > 0, "partial").otherwise("unavailable"))


def refit_envelope(df: DataFrame, keys: Sequence[str], estimate: str, span: str, expected: int) -> DataFrame:
    """(keys, lower, upper, width, n, complete, consistent): over refits; spans must agree within the tolerance."""
    g = df.groupBy(*keys).agg(F.min(estimate).alias("lower"), F.max(estimate).alias("upper"), F.count(estimate).alias("n"), F.min(span).alias("_a"), F.max(span).alias("_b"))
    near = (F.col("_b") - F.col("_a")) <= SPAN_RTOL * F.greatest(F.abs("_a"), F.abs("_b"))
    return g.select(*keys, "lower", "upper", (F.col("upper") - F.col("lower")).alias("width"), "n", (F.col("n") == expected).alias("complete"), near.alias("consistent"))


def calibrate(envelope: DataFrame, calibration: DataFrame, keys: Sequence[str], radius: str, span: str) -> DataFrame:
    """``envelope`` widened on both sides by a normalised radius times the span; unknown keys stay uncalibrated."""
    both = checked_join(envelope, calibration, keys, "left", "many_to_one")
    grow = F.col(radius) * F.col(span)
    return both.withColumns({"calibrated_lower": F.col("lower") - grow, "calibrated_upper": F.col("upper") + grow, "calibrated": F.col(radius).isNotNull()})


def expected_members(species: DataFrame, members: DataFrame, estimates: DataFrame) -> DataFrame:
    """(species, member_id, estimate, available): every expected member, missing ones unavailable."""
    grid = checked_join(species, members, ["species"], "inner", "many_to_many")
    return checked_join(grid, estimates, ["species", "member_id"], "left", "one_to_one").withColumn("available", F.col("estimate").isNotNull())


def truth_audit(claims: DataFrame, truth: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall) of claimed against true items, by a full outer join."""
    a, b = claims.select(*keys, item).distinct().withColumn("_c", F.lit(1)), truth.select(*keys, item).distinct().withColumn("_t", F.lit(1))
    both = a.join(b, [*keys, item], "full")
    g = both.groupBy(*keys).agg(F.count_if(F.col("_c").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_c").isNull()).alias("fn"))
    share = lambda other: F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0)).cast("double")
    return g.withColumns({"precision": share("fp"), "recall": share("fn")})


def taxon_process_support(losses: DataFrame, keys: Sequence[str], loss: str, expected_cells: int) -> DataFrame:
    """(keys, n_cells, worsening, improvement, median_loss, status) by the support and refutation shares."""
    g = losses.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.avg((F.col(loss) > TOLERANCE).cast("double")).alias("worsening"), F.avg((F.col(loss) < -TOLERANCE).cast("double")).alias("improvement"), F.median(loss).alias("median_loss"))
    whole = F.col("n_cells") == expected_cells
    status = F.when(whole & (F.col("worsening") >= SUPPORT - TOLERANCE) & (F.col("improvement") <= REFUTE + TOLERANCE), "supported").when(whole & (F.col("improvement") >= SUPPORT - TOLERANCE), "refuted").otherwise("unresolved")
    return g.withColumn("status", status)


def core_confirmation(support: DataFrame, process: str, half: Column) -> DataFrame:
    """(process, discovery, validation, core): supported shares in both halves; a core passes both."""
    is_in = (F.col("status") == "supported").cast("double")
    g = support.withColumn("_d", half).groupBy(process).agg(F.avg(F.when(F.col("_d"), is_in)).alias("discovery"), F.avg(F.when(~F.col("_d"), is_in)).alias("validation"))
    return g.withColumn("core", F.coalesce((F.col("discovery") >= SUPPORT - TOLERANCE) & (F.col("validation") >= SUPPORT - TOLERANCE), F.lit(False)))


def cross_taxon_states(support: DataFrame, process: str) -> DataFrame:
    """(process, n_taxa, n_informative, n_supported, n_refuted, supported_fraction, state) over informative taxa."""
    g = support.groupBy(process).agg(F.count("*").alias("n_taxa"), F.count_if(F.col("status") != "unresolved").alias("n_informative"), F.count_if(F.col("status") == "supported").alias("n_supported"), F.count_if(F.col("status") == "refuted").alias("n_refuted"))
    share = F.col("n_supported") / F.nullif(F.col("n_informative"), F.lit(0)).cast("double")
    state = F.when(F.col("n_informative") == 0, "no_evidence").when(F.col("n_supported") == F.col("n_informative"), "shared").when(F.col("n_refuted") == F.col("n_informative"), "refuted").otherwise("mixed")
    return g.withColumns({"supported_fraction": share, "state": state})


def perturbation_certificate(df: DataFrame, candidate: str, perturbation: str, passed: Column, expected: int) -> DataFrame:
    """(candidate, n_passed, critical, state): selected if all pass, near if all but one, with those that fail."""
    g = df.groupBy(candidate).agg(F.countDistinct(F.when(passed, F.col(perturbation))).alias("n_passed"), F.array_join(F.array_sort(F.collect_set(F.when(~passed, F.col(perturbation)))), ",").alias("critical"))
    return g.withColumn("state", F.when(F.col("n_passed") == expected, "selected").when(F.col("n_passed") == expected - 1, "near_complete").otherwise("abstain"))


def modal_fraction(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, mode, modal_fraction, stable): the commonest value, the first of equals."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    g = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m"), F.sum("n").alias("t"))
    out = g.select(*keys, F.col("m.v").alias("mode"), (-F.col("m.n") / F.col("t").cast("double")).alias("modal_fraction"))
    return out.withColumn("stable", F.col("modal_fraction") >= MODAL - TOLERANCE)


def certificate_sets(df: DataFrame, keys: Sequence[str], item: str, status: str) -> DataFrame:
    """(keys, supported, refuted, unresolved): sorted items of each status, joined by commas."""
    one = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col(status) == s, F.col(item)))), ",").alias(s)
    return df.groupBy(*keys).agg(one("supported"), one("refuted"), one("unresolved"))


def set_algebra(df: DataFrame, key: str, member: str, item: str) -> DataFrame:
    """(key, necessary, possible, contested) of items over a key's members: in all, in any, in some but not all."""
    total = df.groupBy(key).agg(F.countDistinct(member).alias("_n"))
    per = df.groupBy(key, item).agg(F.countDistinct(member).alias("_k")).join(total, key)
    one = lambda c, a: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(item)))), ",").alias(a)
    return per.groupBy(key).agg(one(F.col("_k") == F.col("_n"), "necessary"), one(F.lit(True), "possible"), one(F.col("_k") < F.col("_n"), "contested"))


def inference_state(n_models: Column, n_processes: Column, contested: Column) -> Column:
    """The interpretation of an inference certificate."""
    return (
        F.when(n_models == 0, "abstain").when(n_models == 1, "model_consensus").when(contested == 0, "process_consensus_model_uncertainty")
        .when(n_processes > 0, "partial_process_consensus").otherwise("process_contested")
    )


def dominated(df: DataFrame, case: Sequence[str], candidate: str, higher: Sequence[str], lower: Sequence[str]) -> DataFrame:
    """(case, candidate) of rows that another row of the case dominates; rows with a missing metric never dominate.

    A case's candidates are few (a design decision of the tables); pairs are formed within a case alone.
    """
    metrics = [*higher, *lower]
    a = df.select(*case, candidate, *metrics)
    b = df.select(*case, F.col(candidate).alias("_other"), *[F.col(m).alias(f"_o_{m}") for m in metrics])
    for m in metrics:
        b = b.where(F.col(f"_o_{m}").isNotNull() & ~F.isnan(f"_o_{m}"))
    gain = [(F.col(f"_o_{m}") - F.col(m)) if m in higher else (F.col(m) - F.col(f"_o_{m}")) for m in metrics]
    beats = F.col("_other") != F.col(candidate)
    for g in gain:
        beats = beats & (F.coalesce(g, F.lit(1.0)) >= -TOLERANCE)
    strictly = F.greatest(*[F.coalesce(g, F.lit(1.0)) for g in gain]) > TOLERANCE
    return a.join(b, list(case)).where(beats & strictly).select(*case, candidate).distinct()


def pareto_front(df: DataFrame, case: Sequence[str], candidate: str, higher: Sequence[str], lower: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that no other row of their case dominates."""
    return df.join(dominated(df, case, candidate, higher, lower), [*case, candidate], "left_anti")


def minimax(front: DataFrame, case: Sequence[str], candidate: str, higher: Sequence[str], lower: Sequence[str], complexity: str) -> DataFrame:
    """One row a case: least worst rank, then mean rank, complexity and name."""
    from .rollups import perturbation_ranks

    ranked = perturbation_ranks(front, case, higher, lower)
    nth = F.row_number().over(Window.partitionBy(*case).orderBy("worst_rank", F.round("mean_rank", 9), complexity, candidate))
    return ranked.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def preferred(df: DataFrame, case: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """One row a case: of those within the tolerance of the best score, the first by ``order``."""
    near = df.where(F.col(score).isNotNull()).withColumn("_best", F.max(score).over(Window.partitionBy(*case))).where(F.col(score) >= F.col("_best") - TOLERANCE)
    return near.withColumn("_nth", F.row_number().over(Window.partitionBy(*case).orderBy(*order))).where("_nth = 1").drop("_nth", "_best")


def loss_flags(df: DataFrame, losses: Sequence[str]) -> DataFrame:
    """``df`` with ``flag``: worsened, improved, trade_off or unchanged by signed losses."""
    worse, better = (F.greatest(*[(s * F.col(c) > TOLERANCE).cast("int") for c in losses]) == 1 for s in (1, -1))
    return df.withColumn("flag", F.when(worse & better, "trade_off").when(worse, "worsened").when(better, "improved").otherwise("unchanged"))


def promotion_gate(stability: DataFrame, evidence: DataFrame, choice: Sequence[str], least_fraction: float, least_runs: int) -> DataFrame:
    """``stability`` with comparator evidence and ``promoted``: chosen often, over enough runs, better than all comparators."""
    g = evidence.groupBy(*choice).agg(F.min("mean_delta").alias("worst_delta"), F.count("*").alias("n_comparators"))
    out = checked_join(stability, g, choice, "left", "one_to_one")
    passed = (F.col("selection_fraction") >= least_fraction) & (F.col("n_runs") >= least_runs) & (F.col("worst_delta") > 0)
    return out.withColumn("promoted", F.coalesce(passed, F.lit(False)))


def panel_decision(df: DataFrame, key: str, available: Column, process_ok: Column, boundary_ok: Column) -> DataFrame:
    """(key, outcome): unavailable, supported, process_only, boundary_only or not_supported over a key's panels."""
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    g = df.groupBy(key).agg(every(available).alias("a"), every(process_ok).alias("p"), every(boundary_ok).alias("b"))
    return g.select(key, F.when(~F.col("a"), "unavailable").when(F.col("p") & F.col("b"), "supported").when(F.col("p"), "process_only").when(F.col("b"), "boundary_only").otherwise("not_supported").alias("outcome"))


def gated(df: DataFrame, gate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key passed a gate (a column ``adequate``)."""
    return checked_join(df, gate.select(*keys, "adequate"), keys, "inner", "many_to_one").where("adequate").drop("adequate")
