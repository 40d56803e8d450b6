"""Which process each predictor stands for, and whether candidates have complete evidence before any outcome is opened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.values import assert_unique, finite, require_columns

#: Roles of predictors, and states of a decision from the first that holds (fixed values).
ROLES = ("ecological", "observation")
STATES = (
    "invalid_sealed_artifact_present", "abstain_no_predeclared_discovery_cells", "abstain_no_candidate_fold_metrics",
    "abstain_no_complete_prediction_candidate", "abstain_no_complete_ecological_candidate", "ready_for_known_truth",
)


def process_registry(manifest: DataFrame) -> DataFrame:
    """(predictor, process, equivalence_group, role, source_family, units, rationale) of a manifest.

    Missing columns and values: a predictor is its own group, ecological, of unspecified source and units; a rationale
    falls back on the mechanism, then on nothing. No rows, an empty name, process or group, a role of another name, or a
    predictor twice is an error.
    """
    require_columns(manifest, ["predictor", "process"])
    has = set(manifest.columns)

    def first(*options: Column | str) -> Column:
        known = [F.col(o) if isinstance(o, str) else o for o in options if not isinstance(o, str) or o in has]
        return F.coalesce(*[c.cast("string") for c in known])

    filled = lambda c: F.nullif(F.trim(c), F.lit("")) if c in has else F.lit(None)
    out = manifest.select(
        F.col("predictor").cast("string").alias("predictor"),
        F.col("process").cast("string").alias("process"),
        first("equivalence_group", F.col("predictor")).alias("equivalence_group"),
        first("role", F.lit("ecological")).alias("role"),
        first("source", "source_family", F.lit("unspecified")).alias("source_family"),
        first("units", F.lit("unspecified")).alias("units"),
        F.coalesce(filled("rationale"), filled("mechanism"), F.lit("")).alias("rationale"),
    )
    blank = F.lit(False)
    for c in ("predictor", "process", "equivalence_group"):
        blank = blank | F.coalesce(F.trim(c) == "", F.lit(True))
    n, wrong = out.agg(F.count("*"), F.count_if(blank | ~F.col("role").isin(*ROLES))).first()
    if not n or wrong:
        raise ValueError(f"{wrong} of {n} entries lack a name, a process, a group or a known role")
    return assert_unique(out, ["predictor"], "predictor registry")


def aliases(registry: DataFrame, to: str = "process", ecological_only: bool = True) -> DataFrame:
    """(predictor, alias): the process or group of each predictor."""
    rows = registry.where("role = 'ecological'") if ecological_only else registry
    return rows.select("predictor", F.col(to).alias("alias"))


def assert_registered(predictors: DataFrame, registry: DataFrame) -> DataFrame:
    """``predictors``, all of which are in the registry; others are an error that names some."""
    unknown = predictors.join(registry.select("predictor"), "predictor", "left_anti").select("predictor").distinct()
    some = [r[0] for r in unknown.orderBy("predictor").limit(10).collect()]
    if some:
        raise ValueError(f"predictors absent from the registry: {', '.join(map(str, some))}")
    return predictors


def sealed_columns(columns: Sequence[str]) -> list[str]:
    """Names that give a sealed outcome away."""
    return sorted(c for c in columns if c.lower().startswith(("sealed_", "n_sealed_")))


def candidate_readiness(metrics: DataFrame, cells: DataFrame, n_folds: int, recovery: Sequence[str], cell: Sequence[str] = ("species", "perturbation")) -> DataFrame:
    """(candidate, complete_prediction_evidence, complete_ecological_evidence, expected_cells, expected_folds).

    A candidate is complete if its cells are exactly those expected and each of them has exactly the folds 0 to
    ``n_folds`` - 1, in every one of which each needed figure is finite in a row at least: the presence rank for
    prediction, and the figures of ``recovery`` as well for ecology. Figures are reduced by fold, cell and candidate
    with partial sums, so that no candidate's rows meet in one task.
    """
    if n_folds < 2:
        raise ValueError("at least two folds")
    figures = ["presence_rank", *recovery]
    fold = F.col("fold").cast("int")
    known = fold.isNotNull() & fold.between(0, n_folds - 1)
    # a null in the folds, or one beyond those expected, spoils the cell
    by_fold = metrics.groupBy("candidate", *cell, fold.alias("_fold")).agg(
        F.bool_and(known).alias("_known"), *[F.bool_or(finite(c).isNotNull()).alias(f"_has{i}") for i, c in enumerate(figures)]
    )
    every = lambda names: F.expr(" and ".join(names))
    by_cell = by_fold.groupBy("candidate", *cell).agg(
        (F.bool_and("_known") & (F.count("*") == n_folds)).alias("_folds"), F.bool_and("_has0").alias("_p"), F.bool_and(every([f"_has{i}" for i in range(len(figures))])).alias("_e")
    )
    wanted = cells.select(*cell).distinct()
    total = wanted.agg(F.count("*").alias("expected_cells"))
    met = by_cell.join(wanted.withColumn("_wanted", F.lit(True)), [*cell], "left")
    out = met.groupBy("candidate").agg(
        F.bool_and(F.coalesce("_wanted", F.lit(False))).alias("_only"), F.count("*").alias("_n"),
        F.bool_and(F.col("_folds") & F.col("_p")).alias("_p"), F.bool_and(F.col("_folds") & F.col("_e")).alias("_e"),
    ).crossJoin(F.broadcast(total))  # of one row
    exact = F.col("_only") & (F.col("_n") == F.col("expected_cells"))
    return out.select(
        "candidate", (exact & F.col("_p")).alias("complete_prediction_evidence"), (exact & F.col("_e")).alias("complete_ecological_evidence"),
        "expected_cells", F.lit(n_folds).alias("expected_folds"),
    )


def readiness_decision(readiness: DataFrame, cells: DataFrame, sealed_artifacts: Sequence[str] = (), cell: Sequence[str] = ("species", "perturbation")) -> DataFrame:
    """One row: the state, and how many cells and candidates of each kind there are; a sealed artefact spoils it all."""
    seen = readiness.agg(
        F.count("*").alias("n_candidates"), F.count_if("complete_prediction_evidence").alias("n_prediction"), F.count_if("complete_ecological_evidence").alias("n_ecological")
    )
    both = seen.crossJoin(cells.select(*cell).distinct().agg(F.count("*").alias("n_cells")))  # one row each
    state = F.lit(STATES[5])
    for test, name in zip(("n_ecological", "n_prediction", "n_candidates", "n_cells"), reversed(STATES[1:5]), strict=True):
        state = F.when(F.col(test) == 0, name).otherwise(state)
    if sealed_artifacts:
        state = F.lit(STATES[0])
    return both.select(state.alias("status"), "n_cells", "n_candidates", "n_prediction", "n_ecological", F.lit(len(sealed_artifacts)).alias("n_sealed_artifacts"))
