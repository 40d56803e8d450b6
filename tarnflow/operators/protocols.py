"""Grids of specifications, universes and strategies: figures by key, choices on discovery taxa, what unseen taxa say.

A figure is a row a (specification, universe, strategy, taxon): sealed ``presence_rank`` and ``boyce``, the
``inner_presence_rank`` of the model rows, ``n_predictors`` and ``n_candidates`` of the universe. Splits of the taxa are
a table (split_id, taxon, validation), so that every repeated split is a key of one plan and figures are made once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import TOLERANCE, finite

from .models import ModelSpec, cross_validated_rank
from .partitions import ROLE, split_taxa
from .procedures import ModelPool, fit_all, freeze_methods, random_sets, score_sealed
from .selection import assert_matched

GRID = ("specification", "universe", "strategy")
FIGURES = "specification string, universe string, strategy string, taxon string, presence_rank double, boyce double, inner_presence_rank double, n_predictors int, n_candidates int, predictors string"


def repeated_splits(spark: SparkSession, taxa: Sequence[str], seeds: Sequence[int], validation: float = 0.2) -> DataFrame:
    """(split_id, seed, taxon, validation): the taxa split anew for each seed."""
    rows = [(i, int(s), t, v) for i, s in enumerate(seeds) for names, v in zip(split_taxa(taxa, validation, s), (False, True), strict=True) for t in names]
    return spark.createDataFrame(rows, "split_id int, seed long, taxon string, validation boolean")


def protocol_figures(specifications: Mapping[str, DataFrame], universes: Mapping[str, Sequence[str]], key: str, label: Column, folds: Sequence[int], spec: ModelSpec | None = None, matched: Sequence[str] = (), repeats: int = 2, seed: int = 0, most: int = 8, done: DataFrame | None = None) -> DataFrame:
    """The figures of every taxon that all specifications have: methods frozen on model rows, scored once on sealed ones.

    Specification and taxon are one key of one table, so all of them share each aggregation of a fit; universes are tried
    one after the other, and all their methods are fitted and scored in one call at the end. Presences must be the same in
    the ``matched`` columns of every specification. Figures in ``done`` are not made again: a grid resumes where it
    stopped, specification by taxon.
    """
    spec, names = spec or ModelSpec(), list(specifications)
    if matched:
        assert_matched({n: df.where(label).select(*matched) for n, df in specifications.items()}, list(matched))
    if not all(universes.values()):
        raise ValueError("a universe without predictors")
    tagged = [df.withColumn("_set", F.concat_ws("\x1f", F.lit(n), F.col(key).cast("string"))) for n, df in specifications.items()]
    rows = reduce(lambda a, b: a.unionByName(b), [df.select("_set", key, ROLE, "fold", label.alias("_y"), *sorted({p for u in universes.values() for p in u})) for df in tagged])
    found: dict[str, set[str]] = {}
    for r in rows.select("_set").distinct().collect():  # a row a specification and taxon
        n, t = r[0].split("\x1f", 1)
        found.setdefault(t, set()).add(n)
    had = set() if done is None else {(r.specification, r.taxon) for r in done.select("specification", "taxon").distinct().collect()}
    sets = [f"{n}\x1f{t}" for n in names for t in sorted(t for t, has in found.items() if len(has) == len(names)) if (n, t) not in had]
    spark = rows.sparkSession
    if not sets:
        return spark.createDataFrame([], FIGURES) if done is None else done
    rows, y = rows.where(F.col("_set").isin(sets)), F.col("_y")
    pool, chosen = ModelPool(rows), {}
    for name, predictors in universes.items():
        own = freeze_methods(pool, "_set", y, sets, list(predictors), folds, spec, most)
        own |= random_sets(own, predictors, repeats, seed)
        chosen |= {(k, f"{name}\x1f{strategy}"): p for (k, strategy), p in own.items()}
    inner = cross_validated_rank(pool.rows, "_set", y, sorted({(k, p) for (k, _), p in chosen.items()}), folds, spec)
    sealed = score_sealed(rows, "_set", y, fit_all(pool, "_set", y, chosen, spec))
    known = spark.createDataFrame([(k, s, inner.get((k, p)), len(universes[s.split("\x1f")[0]])) for (k, s), p in chosen.items()], "taxon string, strategy string, inner_presence_rank double, n_candidates int")
    both, of, how = sealed.join(known, ["taxon", "strategy"]), F.split("taxon", "\x1f"), F.split("strategy", "\x1f")
    out = both.select(
        F.get(of, 0).alias("specification"), F.get(how, 0).alias("universe"), F.get(how, 1).alias("strategy"), F.get(of, 1).alias("taxon"),
        "presence_rank", "boyce", "inner_presence_rank", "n_predictors", "n_candidates", "predictors",
    )
    return out if done is None else done.unionByName(out)


def discovery_ranking(figures: DataFrame, splits: DataFrame) -> DataFrame:
    """(split_id, specification, universe, strategy, n_species, mean and median rank, global_win_fraction,
    mean_predictors, n_candidates, place): each split's discovery taxa alone.

    A method wins a taxon if no other of the grid is better there. The best mean comes first, then more wins, fewer
    predictors, fewer candidates, and the names.
    """
    rows = figures.join(splits.where("not validation").select("split_id", "taxon"), "taxon")
    best = F.max("presence_rank").over(Window.partitionBy("split_id", "taxon"))
    won = F.coalesce((F.col("presence_rank") >= best - TOLERANCE).cast("double"), F.lit(0.0))
    g = rows.withColumn("won", won).groupBy("split_id", *GRID).agg(
        F.countDistinct("taxon").alias("n_species"), F.avg("presence_rank").alias("mean_presence_rank"), F.median("presence_rank").alias("median_presence_rank"),
        F.avg("won").alias("global_win_fraction"), F.avg("n_predictors").alias("mean_predictors"), F.max("n_candidates").alias("n_candidates"))
    order = [F.desc_nulls_last(F.round("mean_presence_rank", 12)), F.desc_nulls_last(F.round("global_win_fraction", 12)), "mean_predictors", "n_candidates", *GRID]
    return g.withColumn("place", F.row_number().over(Window.partitionBy("split_id").orderBy(*order)))


def validation_figures(figures: DataFrame, splits: DataFrame, ranking: DataFrame) -> DataFrame:
    """Figures of unseen taxa within the specification and universe that their split chose, ``selected`` where the
    strategy is the chosen one too. Nothing is chosen anew."""
    first = ranking.where("place = 1").select("split_id", "specification", "universe", F.col("strategy").alias("_chosen"))
    rows = figures.join(splits.where("validation").select("split_id", "taxon"), "taxon").join(first, ["split_id", "specification", "universe"])
    return rows.withColumn("selected", F.col("strategy") == F.col("_chosen")).drop("_chosen")


def validation_summary(held: DataFrame) -> DataFrame:
    """(split_id, strategy, n_species, mean and median rank, win_fraction, mean_predictors, selected) of unseen taxa."""
    best = F.max("presence_rank").over(Window.partitionBy("split_id", "taxon"))
    won = F.coalesce((F.col("presence_rank") >= best - TOLERANCE).cast("double"), F.lit(0.0))
    return held.withColumn("won", won).groupBy("split_id", "strategy").agg(
        F.countDistinct("taxon").alias("n_species"), F.avg("presence_rank").alias("mean_presence_rank"), F.median("presence_rank").alias("median_presence_rank"),
        F.avg("won").alias("win_fraction"), F.avg("n_predictors").alias("mean_predictors"), F.bool_or("selected").alias("selected"))


def validation_deltas(held: DataFrame) -> DataFrame:
    """(split_id, taxon, strategy, comparator, delta): the chosen strategy's rank less another's on the same unseen taxon."""
    own = held.where("selected").select("split_id", "taxon", "strategy", F.col("presence_rank").alias("_own"))
    other = held.where("not selected").select("split_id", "taxon", F.col("strategy").alias("comparator"), "presence_rank")
    return own.join(other, ["split_id", "taxon"]).select("split_id", "taxon", "strategy", "comparator", (F.col("_own") - F.col("presence_rank")).alias("delta")).where("delta is not null")


@dataclass(frozen=True)
class Protocol:
    figures: DataFrame
    splits: DataFrame
    discovery: DataFrame
    validation: DataFrame
    summary: DataFrame
    deltas: DataFrame


def protocol_grid(figures: DataFrame, splits: DataFrame) -> Protocol:
    """All that a grid says, for every split at once; the figures are read from where they were written."""
    discovery = discovery_ranking(figures, splits)
    held = validation_figures(figures, splits, discovery)
    return Protocol(figures, splits, discovery, held, validation_summary(held), validation_deltas(held))


#: Names of the selectors (fixed values): chosen over all specifications, in the canonical one by a metric, and anew in
#: each unseen case by its inner folds.
ROBUST, CANONICAL, LOCAL = "m_robust", "canonical_", "local_nested"


def frozen_selectors(discovery: DataFrame, canonical: str, chosen: tuple[str, str], metrics: Sequence[str] = ("presence_rank", "boyce")) -> DataFrame:
    """(selector, universe, strategy, metric, score, same_as_robust): what each selector takes, on discovery evidence.

    The canonical selectors take the largest mean of a metric in one specification, then the fewest predictors, then the
    first by name; a metric without any finite value there chooses nothing.
    """
    rows = discovery.where(F.col("specification") == canonical)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(m).alias("v")) for m in metrics])).alias("e")
    g = rows.select("universe", "strategy", "n_predictors", each).groupBy("e.metric", "universe", "strategy").agg(F.avg("e.v").alias("score"), F.avg("n_predictors").alias("_size"))
    nth = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc(F.round("score", 12)), "_size", "universe", "strategy"))
    best = g.where("score is not null").withColumn("_nth", nth).where("_nth = 1").select(F.concat(F.lit(CANONICAL), "metric").alias("selector"), "universe", "strategy", "metric", "score")
    robust = discovery.sparkSession.createDataFrame([(ROBUST, *chosen, "within_case_rank", None)], "selector string, universe string, strategy string, metric string, score double")
    return robust.unionByName(best).withColumn("same_as_robust", (F.col("universe") == chosen[0]) & (F.col("strategy") == chosen[1]))


def selector_figures(figures: DataFrame, choices: DataFrame) -> DataFrame:
    """(selector, specification, taxon, universe, strategy, ranks, gap): frozen and local selectors on the same cases.

    A frozen selector must find exactly one figure in each case, or the query fails. The local one takes, in every case,
    the largest inner rank, then the fewest predictors, the first universe and strategy by name; sealed figures have no
    say in it, and a case without a finite inner rank fails. Figures are shared: nobody's case is fitted twice.
    """
    shown = ["specification", "taxon", "universe", "strategy", "inner_presence_rank", "presence_rank", "boyce", "n_predictors"]
    cases = figures.select("specification", "taxon").distinct()
    frozen = cases.withColumn("_c", F.lit(1)).crossJoin(F.broadcast(choices.select("selector", "universe", "strategy")))  # a row a selector
    joined = frozen.join(figures.select(*shown).withColumn("_f", F.lit(1)), ["specification", "taxon", "universe", "strategy"], "left")
    one = Window.partitionBy("selector", "specification", "taxon")
    found = F.count("_f").over(one)
    joined = joined.withColumn("_n", found).withColumn("_f", F.when(F.col("_n") != 1, F.raise_error(F.lit("a frozen selector needs exactly one figure in each case")).cast("int")).otherwise(F.col("_f")))
    held = joined.where("_f = 1").select("selector", *shown)
    order = [F.desc_nulls_last(finite("inner_presence_rank")), "n_predictors", "universe", "strategy"]
    first = figures.withColumn("_nth", F.row_number().over(Window.partitionBy("specification", "taxon").orderBy(*order))).where("_nth = 1")
    bad = F.raise_error(F.lit("a case without a finite inner rank")).cast("double")
    local = first.withColumn("inner_presence_rank", F.when(finite("inner_presence_rank").isNull(), bad).otherwise(F.col("inner_presence_rank"))).select(F.lit(LOCAL).alias("selector"), *shown)
    return held.unionByName(local).withColumn("gap", F.col("presence_rank") - F.col("inner_presence_rank"))


def selector_deltas(transfer: DataFrame, reference: str = ROBUST) -> DataFrame:
    """(specification, taxon, comparator, delta): the reference selector's sealed rank less another's in the same case."""
    own = transfer.where(F.col("selector") == reference).select("specification", "taxon", F.col("presence_rank").alias("_own"))
    other = transfer.where(F.col("selector") != reference).select("specification", "taxon", F.col("selector").alias("comparator"), "presence_rank")
    return own.join(other, ["specification", "taxon"]).select("specification", "taxon", "comparator", (F.col("_own") - F.col("presence_rank")).alias("delta")).where("delta is not null")
