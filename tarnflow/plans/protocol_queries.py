"""Queries of protocol grids, selectors, process cores and searches by recovery; those without fits have their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import cores, protocols
from tarnflow.operators import models as L

from .adapters import environment, metrics
from .model_queries import _cells
from .occurrence_queries import r, register, rounded

#: Figures over the metrics table: a universe is a half of the folds, of which the even one is inner and the odd one sealed.
#: As SQL that Spark and DuckDB read alike.
FIGURES = """SELECT M AS specification, CASE WHEN fold < 2 THEN 'climate' ELSE 'soil' END AS universe, candidate AS strategy, taxon,
  round(avg(CASE WHEN fold % 2 = 1 THEN presence_rank END) + CAST(1e-12 AS DOUBLE), 6) AS presence_rank, round(avg(CASE WHEN fold % 2 = 1 THEN overlap END) + CAST(1e-12 AS DOUBLE), 6) AS boyce,
  round(avg(CASE WHEN fold % 2 = 0 THEN presence_rank END) + CAST(1e-12 AS DOUBLE), 6) AS inner_presence_rank, CAST(min(n_rows) AS INT) AS n_predictors, CAST(CASE WHEN min(fold) < 2 THEN 8 ELSE 5 END AS INT) AS n_candidates
FROM {metrics} GROUP BY M, CASE WHEN fold < 2 THEN 'climate' ELSE 'soil' END, candidate, taxon"""
#: Four splits of the taxa by the last digit of their name.
SPLITS = "SELECT CAST(s.id AS INT) AS split_id, taxon, CAST(right(taxon, 1) AS INT) % 4 = s.id AS validation FROM (SELECT DISTINCT taxon FROM {metrics}) t CROSS JOIN (SELECT explode(sequence(0, 3)) AS id) s"
_F = FIGURES.format(metrics="metrics")
_S = "SELECT s.id::INT AS split_id, taxon, right(taxon, 1)::INT % 4 = s.id AS validation FROM (SELECT DISTINCT taxon FROM metrics) t, range(4) s(id)"
_DISCOVERY = f"""WITH figures AS ({_F}), splits AS ({_S}),
  d AS (SELECT f.*, split_id, coalesce(presence_rank >= max(presence_rank) OVER (PARTITION BY split_id, f.taxon) - 1e-12, false)::INT AS won FROM figures f JOIN splits s ON s.taxon = f.taxon AND NOT validation),
  g AS (SELECT split_id, specification, universe, strategy, count(DISTINCT taxon) AS n_species, avg(presence_rank) AS mean_presence_rank, median(presence_rank) AS median_presence_rank, avg(won) AS global_win_fraction,
    avg(n_predictors) AS mean_predictors, max(n_candidates) AS n_candidates FROM d GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY round(mean_presence_rank, 12) DESC NULLS LAST, round(global_win_fraction, 12) DESC, mean_predictors, n_candidates, specification, universe, strategy) AS place FROM g),
  held AS (SELECT f.*, s.split_id, f.strategy = k.strategy AS selected FROM figures f JOIN splits s ON s.taxon = f.taxon AND validation JOIN k ON place = 1 AND k.split_id = s.split_id AND k.specification = f.specification AND k.universe = f.universe)"""


def _view(spark, sf, text):
    return spark.sql(text, metrics=metrics(spark, sf))


def _grid(spark, sf):
    return protocols.protocol_grid(_view(spark, sf, FIGURES), _view(spark, sf, SPLITS))


@register("protocol_discovery", _DISCOVERY + f" SELECT split_id, specification, universe, strategy, n_species, {', '.join(r(c, c) for c in ('mean_presence_rank', 'median_presence_rank', 'global_win_fraction', 'mean_predictors'))}, n_candidates::INT AS n_candidates, place::INT AS place FROM k")
def _(spark, sf):
    return rounded(_grid(spark, sf).discovery)


@register("protocol_validation", _DISCOVERY + f""", w AS (SELECT *, coalesce(presence_rank >= max(presence_rank) OVER (PARTITION BY split_id, taxon) - 1e-12, false)::INT AS won FROM held)
  SELECT split_id, strategy, count(DISTINCT taxon) AS n_species, {r('avg(presence_rank)', 'mean_presence_rank')}, {r('median(presence_rank)', 'median_presence_rank')}, {r('avg(won)', 'win_fraction')}, {r('avg(n_predictors)', 'mean_predictors')}, bool_or(selected) AS selected FROM w GROUP BY split_id, strategy""")
def _(spark, sf):
    return rounded(_grid(spark, sf).summary)


@register("protocol_deltas", _DISCOVERY + f" SELECT a.split_id, a.taxon, a.strategy, b.strategy AS comparator, {r('a.presence_rank - b.presence_rank', 'delta')} FROM held a JOIN held b ON a.split_id = b.split_id AND a.taxon = b.taxon AND a.selected AND NOT b.selected WHERE a.presence_rank IS NOT NULL AND b.presence_rank IS NOT NULL")
def _(spark, sf):
    return rounded(_grid(spark, sf).deltas)


#: Discovery taxa are those before Brand#4; the robust choice is stated.
ROBUST = ("soil", "PROMO")
_CHOICES = f"""WITH figures AS ({_F}), long AS (SELECT universe, strategy, n_predictors, unnest(['presence_rank', 'boyce']) AS metric, unnest([presence_rank, boyce]) AS v FROM figures WHERE specification = 'A' AND taxon < 'Brand#4'),
  g AS (SELECT metric, universe, strategy, avg(v) AS score, avg(n_predictors) AS size FROM long GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(score, 12) DESC, size, universe, strategy) AS nth FROM g WHERE score IS NOT NULL),
  choices AS (SELECT 'm_robust' AS selector, '{ROBUST[0]}' AS universe, '{ROBUST[1]}' AS strategy, 'within_case_rank' AS metric, NULL::DOUBLE AS score UNION ALL SELECT 'canonical_' || metric, universe, strategy, metric, score FROM best WHERE nth = 1)"""


def _choices(spark, sf):
    return protocols.frozen_selectors(_view(spark, sf, FIGURES).where("taxon < 'Brand#4'"), "A", ROBUST)


@register("frozen_selectors", _CHOICES + f" SELECT selector, universe, strategy, metric, {r('score', 'score')}, universe = '{ROBUST[0]}' AND strategy = '{ROBUST[1]}' AS same_as_robust FROM choices")
def _(spark, sf):
    return rounded(_choices(spark, sf))


_TRANSFER = _CHOICES + """, seen AS (SELECT f.* FROM figures f JOIN (SELECT specification, taxon FROM figures JOIN choices USING (universe, strategy) WHERE taxon >= 'Brand#4' AND inner_presence_rank IS NOT NULL GROUP BY ALL HAVING count(DISTINCT selector) = 3) USING (specification, taxon)),
  local AS (SELECT *, row_number() OVER (PARTITION BY specification, taxon ORDER BY inner_presence_rank DESC NULLS LAST, n_predictors, universe, strategy) AS nth FROM seen),
  transfer AS (SELECT selector, specification, taxon, universe, strategy, inner_presence_rank, presence_rank FROM seen JOIN choices USING (universe, strategy) UNION ALL SELECT 'local_nested', specification, taxon, universe, strategy, inner_presence_rank, presence_rank FROM local WHERE nth = 1)"""


def _transfer(spark, sf):
    figures, choices = _view(spark, sf, FIGURES), _choices(spark, sf)
    whole = figures.join(choices, ["universe", "strategy"]).where("taxon >= 'Brand#4' and inner_presence_rank is not null").groupBy("specification", "taxon").agg(F.countDistinct("selector").alias("n")).where("n = 3")
    return protocols.selector_figures(figures.join(whole.drop("n"), ["specification", "taxon"], "left_semi"), choices)


@register("local_nested_transfer", _TRANSFER + f" SELECT selector, specification, taxon, universe, strategy, {r('inner_presence_rank', 'inner_presence_rank')}, {r('presence_rank', 'presence_rank')}, {r('presence_rank - inner_presence_rank', 'gap')} FROM transfer")
def _(spark, sf):
    return rounded(_transfer(spark, sf).drop("boyce", "n_predictors"))


@register("selector_deltas", _TRANSFER + f" SELECT a.specification, a.taxon, b.selector AS comparator, {r('a.presence_rank - b.presence_rank', 'delta')} FROM transfer a JOIN transfer b ON a.specification = b.specification AND a.taxon = b.taxon AND a.selector = 'm_robust' AND b.selector <> 'm_robust' WHERE a.presence_rank IS NOT NULL AND b.presence_rank IS NOT NULL")
def _(spark, sf):
    return rounded(protocols.selector_deltas(_transfer(spark, sf)))


#: Evidence of process cores: figures of random cores beside the core's own, by specification and taxon.
_NULLS = "SELECT specification, taxon, CASE WHEN strategy <> 'PROMO' THEN strategy END AS repeat, round(avg(presence_rank) + CAST(1e-12 AS DOUBLE), 6) AS v FROM ({f}) GROUP BY specification, taxon, strategy"


@register("null_rank", f"""WITH n AS ({_NULLS.format(f=_F)}), c AS (SELECT specification, taxon, v AS core FROM n WHERE repeat IS NULL),
  g AS (SELECT specification, taxon, core, count(v) AS n_random, avg(v) AS mean_random, stddev_samp(v) AS sd_random, count(*) FILTER (WHERE v >= core - 1e-12) AS n_at_least FROM n JOIN c USING (specification, taxon) WHERE repeat IS NOT NULL GROUP BY ALL)
  SELECT specification, taxon, {r('core', 'core')}, n_random, {r('mean_random', 'mean_random')}, n_at_least, n_at_least + 1 AS rank, {r('(n_at_least + 1) / (n_random + 1)', 'p_value')} FROM g""")
def _(spark, sf):
    rows = spark.sql(_NULLS.replace("({f})", "{f}"), f=_view(spark, sf, FIGURES))
    out = cores.null_rank(rows, ["specification", "taxon"], "repeat", "v").drop("z", "sd_random")
    return rounded(out)


def _taxa(spark, sf):
    rows = environment(spark, sf).withColumns({"taxon": F.col("species").cast("string"), "fold": (F.col("vec_id") % 3).cast("int")})
    return rows.withColumn("y", F.col("e0") + F.col("e1") * F.col("e1") > 0.02)


@register("process_core_splits")
def _(spark, sf):
    rows = _taxa(spark, sf)
    taxa = sorted(t[0] for t in rows.select("taxon").distinct().collect())
    return cores.process_core_splits(rows, "taxon", F.col("y"), taxa, {f"p{i}": [f"e{2 * i}", f"e{2 * i + 1}"] for i in range(4)}, [11, 22, 33, 44, 55], [0, 1, 2])


@register("observation_weights")
def _(spark, sf):
    from tarnflow.operators.recovery import observation_weights

    return observation_weights(_cells(spark, sf), "all", F.col("y"), ["e6", "e7"], [0, 1, 2], "vec_id").select("vec_id", "fold", "weight")


@register("recovery_forward")
def _(spark, sf):
    from tarnflow.operators.recovery import observation_weights, recovery_forward

    rows, features = _cells(spark, sf).persist(), [f"e{i}" for i in range(4)]
    try:
        weights = observation_weights(rows, "all", F.col("y"), ["e6", "e7"], [0, 1, 2], "vec_id").persist()
        got = recovery_forward(rows, "all", F.col("y"), ["all"], features, [0, 1, 2], features, L.ModelSpec(), weights=weights, row="vec_id")
        weights.unpersist()
    finally:
        rows.unpersist()
    return spark.createDataFrame(got, "taxon string, step int, winner string, front string")


@register("drop_group_importance")
def _(spark, sf):
    from tarnflow.operators.procedures import drop_group_importance

    rows = _cells(spark, sf).withColumn("role", F.when(F.col("vec_id") % 5 == 0, "sealed").otherwise("model"))
    groups = {f"e{i}": f"eq{i // 2 + 1:03d}" for i in range(8)}
    return drop_group_importance(rows, "all", F.col("y"), ["all"], list(groups), groups, L.ModelSpec())
