"""Queries of promotions, differentiation and selection over perturbations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import cores, gates
from tarnflow.operators.gates import CORE_FULL, CORE_RANDOM, NECESSITY, NOMINATION, Rule

from .adapters import metrics
from .occurrence_queries import r, register, rounded

#: Evidence over the metrics table, as SQL that Spark and DuckDB read alike.
CORES = "SELECT M, candidate AS process, fold AS split_id FROM {metrics} GROUP BY M, candidate, fold HAVING avg(presence_rank) >= CAST(0.7 AS DOUBLE)"
DROPS = "SELECT M, candidate AS process, fold AS split_id, taxon, round(avg(presence_rank) - CAST(0.7 AS DOUBLE) + CAST(1e-12 AS DOUBLE), 6) AS delta FROM {metrics} GROUP BY M, candidate, fold, taxon"
OVER_FULL = "SELECT M, fold AS split_id, taxon, round(avg(presence_rank) - CAST(0.701 AS DOUBLE) + CAST(1e-12 AS DOUBLE), 6) AS delta FROM {metrics} GROUP BY M, fold, taxon"
OVER_RANDOM = "SELECT M, fold AS split_id, taxon, candidate AS repeat, round(presence_rank - CAST(0.69 AS DOUBLE), 6) AS delta FROM {metrics}"

BOUNDS = [
    Rule(NOMINATION, "core_stability", 0.5), Rule(NOMINATION, "splits_selected", 2),
    Rule(NECESSITY, "validation_drop_pairs", 20), Rule(NECESSITY, "validation_drop_splits", 3), Rule(NECESSITY, "mean_validation_process_drop", 0.0), Rule(NECESSITY, "positive_validation_drop_fraction", 0.5),
    Rule(CORE_FULL, "n_pairs", 50), Rule(CORE_FULL, "n_runs", 4), Rule(CORE_FULL, "mean_delta", -0.005),
    Rule(CORE_RANDOM, "n_pairs", 100), Rule(CORE_RANDOM, "n_runs", 4), Rule(CORE_RANDOM, "mean_delta", 0.0), Rule(CORE_RANDOM, "positive_fraction", 0.5),
]


def _view(spark, sf, text):
    return spark.sql(text, metrics=metrics(spark, sf))


def _own(text: str) -> str:
    return text.format(metrics="metrics")


def _long(grain: str, source: str, subject: str) -> str:
    rules = [x for x in BOUNDS if x.grain == grain]
    return " UNION ALL ".join(f"SELECT M, '{grain}' AS grain, {subject} AS subject, '{x.figure}' AS figure, {x.figure}::DOUBLE AS value, {float(x.bound)}::DOUBLE AS bound FROM {source}" for x in rules)


_GROUPED = "count(*) AS n_pairs, count(DISTINCT split_id) AS n_runs, avg(delta) AS mean_delta, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS positive_fraction"
_PROMOTION = f"""WITH cores AS ({_own(CORES)}), drops AS ({_own(DROPS)}), total AS (SELECT M, count(DISTINCT fold) AS n FROM metrics GROUP BY M),
  lost AS (SELECT M, process, count(*) AS validation_drop_pairs, count(DISTINCT split_id) AS validation_drop_splits, avg(delta) AS mean_validation_process_drop,
    avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS positive_validation_drop_fraction FROM drops GROUP BY M, process),
  stable AS (SELECT c.M, c.process, count(DISTINCT split_id) AS splits_selected, count(DISTINCT split_id) / any_value(n)::DOUBLE AS core_stability FROM cores c JOIN total USING (M) GROUP BY c.M, c.process),
  evidence AS (SELECT * FROM stable LEFT JOIN lost USING (M, process)),
  full_core AS (SELECT M, {_GROUPED} FROM ({_own(OVER_FULL)}) GROUP BY M), random_core AS (SELECT M, {_GROUPED} FROM ({_own(OVER_RANDOM)}) GROUP BY M),
  judged AS (SELECT *, coalesce(value >= bound, false) AS passes FROM ({_long(NOMINATION, 'evidence', 'process')} UNION ALL {_long(NECESSITY, 'evidence', 'process')})),
  named AS (SELECT M, subject, bool_and(passes) AS nominated FROM judged WHERE grain = '{NOMINATION}' GROUP BY M, subject),
  cored AS (SELECT *, coalesce(value >= bound, false) AS passes FROM ({_long(CORE_FULL, 'full_core', 'NULL')} UNION ALL {_long(CORE_RANDOM, 'random_core', 'NULL')})),
  none AS (SELECT M, '{NOMINATION}' AS grain, NULL AS subject, 'n_nominated' AS figure, count(*) FILTER (WHERE nominated)::DOUBLE AS value, 1.0::DOUBLE AS bound FROM named GROUP BY M),
  held AS (SELECT M, grain, subject, figure, value, bound, passes, nominated, nominated AND NOT passes AS failure FROM judged JOIN named USING (M, subject)
    UNION ALL SELECT M, grain, subject, figure, value, bound, passes, NULL, NOT passes FROM cored UNION ALL SELECT M, grain, subject, figure, value, bound, value >= bound, NULL, value < bound FROM none)"""


def _ledger(spark, sf):
    splits = metrics(spark, sf).select("M", F.col("fold").alias("split_id")).distinct()
    stability = cores.core_evidence(_view(spark, sf, CORES), splits, _view(spark, sf, DROPS), ["M"], "process")
    return gates.process_promotion(stability, _view(spark, sf, OVER_FULL), _view(spark, sf, OVER_RANDOM), ["M"], "process", BOUNDS)


@register("process_promotion", _PROMOTION + f" SELECT M, grain, subject, figure, {r('value', 'value', 6)}, bound, passes, nominated, failure FROM held")
def _(spark, sf):
    return _ledger(spark, sf).withColumn("value", F.round(F.col("value") + 1e-12, 6))


@register("process_decision", _PROMOTION + """, n AS (SELECT M, count(*) FILTER (WHERE nominated) AS n_nominated, count(*) FILTER (WHERE nominated AND every) AS n_validated
  FROM (SELECT M, subject, bool_and(nominated) AS nominated, bool_and(passes) AS every FROM held WHERE subject IS NOT NULL GROUP BY M, subject) GROUP BY M),
  f AS (SELECT M, concat_ws(':', grain, subject, figure) AS said FROM held WHERE failure)
  SELECT M, NOT EXISTS (SELECT 1 FROM f WHERE f.M = n.M) AS promoted, n_nominated, n_validated, (SELECT count(*) FROM f WHERE f.M = n.M) AS n_failures,
    coalesce((SELECT string_agg(said, ';' ORDER BY said) FROM f WHERE f.M = n.M), '') AS failures FROM n""")
def _(spark, sf):
    return gates.process_decision(_ledger(spark, sf), ["M"])


#: Runs are taxa; a universe is a half of the folds, a strategy the candidate.
RUNS = """SELECT M, taxon AS run_id, CASE WHEN fold < 2 THEN 'climate' ELSE 'soil' END AS universe, candidate AS strategy,
  round(avg(presence_rank) + CAST(1e-12 AS DOUBLE), 6) AS score, round(avg(overlap) + CAST(1e-12 AS DOUBLE), 6) AS m_spec_win_fraction, concat(candidate, '-', CAST(min(n_rows) AS STRING)) AS predictors
FROM {metrics} GROUP BY M, taxon, CASE WHEN fold < 2 THEN 'climate' ELSE 'soil' END, candidate"""
PROTOCOL_RULES = [Rule("protocol", "selection_fraction", 0.03), Rule("protocol", "runs_selected", 2), Rule("protocol", "least_m_spec_win_fraction", 0.2)]
COMPARATOR_RULES = [Rule("comparator", "n_pairs", 20), Rule("comparator", "mean_delta", 0.0), Rule("comparator", "positive_fraction", 0.5)]
REQUIRED = ["PROMO", "SMALL", "STANDARD", "ABSENT"]
_CHOICE = ["universe", "strategy"]
_METHODS = f"""WITH runs AS ({_own(RUNS).replace('STRING', 'VARCHAR')}), best AS (SELECT *, row_number() OVER (PARTITION BY M, run_id ORDER BY score DESC, universe, strategy) AS nth FROM runs),
  total AS (SELECT M, count(DISTINCT run_id) AS n_runs FROM runs GROUP BY M),
  stable AS (SELECT M, universe, strategy, count(*) AS runs_selected, count(*) / any_value(n_runs)::DOUBLE AS selection_fraction FROM best JOIN total USING (M) WHERE nth = 1 GROUP BY M, universe, strategy),
  top AS (SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY M ORDER BY selection_fraction DESC, runs_selected DESC, universe, strategy) AS nth FROM stable) WHERE nth = 1),
  deltas AS (SELECT a.M, a.run_id, a.universe, a.strategy, b.strategy AS comparator, round(a.score - b.score, 6) AS delta FROM runs a JOIN runs b ON a.M = b.M AND a.run_id = b.run_id AND a.universe = b.universe AND a.strategy <> b.strategy),
  protocol AS (SELECT top.M, top.universe, top.strategy, any_value(selection_fraction) AS selection_fraction, any_value(runs_selected) AS runs_selected, min(m_spec_win_fraction) AS least_m_spec_win_fraction
    FROM top JOIN runs USING (M, universe, strategy) GROUP BY ALL),
  asked AS (SELECT M, universe, strategy, unnest({REQUIRED}) AS comparator FROM top),
  compared AS (SELECT a.M, a.universe, a.strategy, a.comparator, count(delta) AS n_pairs, avg(delta) AS mean_delta, avg(CASE WHEN delta > 0 THEN 1.0 WHEN delta IS NOT NULL THEN 0.0 END) AS positive_fraction
    FROM asked a LEFT JOIN deltas d USING (M, universe, strategy, comparator) GROUP BY ALL),
  held AS ({" UNION ALL ".join(f"SELECT M, universe, strategy, 'protocol' AS grain, NULL AS subject, 'evaluated' AS status, '{x.figure}' AS figure, {x.figure}::DOUBLE AS value, {float(x.bound)}::DOUBLE AS bound FROM protocol" for x in PROTOCOL_RULES)}
    UNION ALL {" UNION ALL ".join(f"SELECT M, universe, strategy, 'comparator', comparator, CASE WHEN comparator = strategy THEN 'self' WHEN n_pairs = 0 THEN 'missing' ELSE 'evaluated' END, '{x.figure}', {x.figure}::DOUBLE, {float(x.bound)}::DOUBLE FROM compared" for x in COMPARATOR_RULES)}),
  judged AS (SELECT *, coalesce(value >= bound, false) OR status = 'self' AS passes FROM held)"""


def _methods(spark, sf):
    from tarnflow.operators.occurrences import first_by

    runs = _view(spark, sf, RUNS)
    total = runs.groupBy("M").agg(F.countDistinct("run_id").alias("n_runs"))
    best = first_by(runs, ["M", "run_id"], [F.desc("score"), "universe", "strategy"])
    stable = best.groupBy("M", *_CHOICE).agg(F.count("*").alias("runs_selected")).join(total, "M").withColumn("selection_fraction", F.col("runs_selected") / F.col("n_runs").cast("double"))
    other = runs.select("M", "run_id", "universe", F.col("strategy").alias("comparator"), F.col("score").alias("theirs"))
    deltas = runs.join(other, ["M", "run_id", "universe"]).where("strategy <> comparator").withColumn("delta", F.round(F.col("score") - F.col("theirs"), 6))
    return gates.method_promotion(stable, runs, deltas, ["M"], _CHOICE, REQUIRED, [*PROTOCOL_RULES, *COMPARATOR_RULES]), runs


@register("method_promotion", _METHODS + f" SELECT M, universe, strategy, grain, subject, status, figure, {r('value', 'value', 6)}, bound, passes FROM judged")
def _(spark, sf):
    return _methods(spark, sf)[0].withColumn("value", F.round(F.col("value") + 1e-12, 6))


@register("method_decision", _METHODS + """, f AS (SELECT M, concat_ws(':', grain, subject, figure) AS said FROM judged WHERE NOT passes), one AS (SELECT M, universe, strategy, min(run_id) AS run_id FROM runs GROUP BY ALL)
  SELECT top.M, top.universe, top.strategy, NOT EXISTS (SELECT 1 FROM f WHERE f.M = top.M) AS promoted, (SELECT count(*) FROM f WHERE f.M = top.M) AS n_failures,
    coalesce((SELECT string_agg(said, ';' ORDER BY said) FROM f WHERE f.M = top.M), '') AS failures, one.run_id, runs.predictors
  FROM top JOIN one USING (M, universe, strategy) JOIN runs ON runs.M = one.M AND runs.universe = one.universe AND runs.strategy = one.strategy AND runs.run_id = one.run_id""")
def _(spark, sf):
    held, runs = _methods(spark, sf)
    return gates.method_decision(held, runs, ["M"], _CHOICE, ["predictors"])


#: Each method's score less that of the strategy ECONOMY in the same case.
SELECTORS = "SELECT M, taxon AS run_id, fold, candidate AS comparator, avg(presence_rank) AS score FROM {metrics} GROUP BY M, taxon, fold, candidate"
ASKED, CHECKS = ["SMALL", "LARGE", "PROMO", "ABSENT"], {"n_runs": 10, "n_pairs": 40, "mean_delta": 0.0, "positive_fraction": 0.5, "positive_run_fraction": 0.5}


@register("differentiation_gate", f"""WITH s AS ({_own(SELECTORS)}), d AS (SELECT s.M, s.run_id, s.comparator, round(b.score - s.score, 6) AS delta FROM s JOIN s b ON b.comparator = 'ECONOMY' AND b.M = s.M AND b.run_id = s.run_id AND b.fold = s.fold WHERE s.comparator <> 'ECONOMY'),
  runs AS (SELECT M, comparator, count(*) AS n_runs, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS positive_run_fraction FROM (SELECT M, comparator, run_id, avg(delta) AS x FROM d GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT M, comparator, count(*) AS n_pairs, avg(delta) AS mean_delta, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS positive_fraction FROM d GROUP BY ALL),
  a AS (SELECT M, unnest({ASKED}) AS comparator FROM (SELECT DISTINCT M FROM d)), j AS (SELECT a.M, a.comparator, g.M IS NOT NULL AS present, n_runs, n_pairs, mean_delta, positive_fraction, positive_run_fraction FROM a LEFT JOIN g USING (M, comparator) LEFT JOIN runs USING (M, comparator)),
  k AS (SELECT *, CASE WHEN NOT present THEN 'missing_or_duplicate_comparator' ELSE concat_ws(';', CASE WHEN n_runs < 10 THEN 'runs' END, CASE WHEN n_pairs < 40 THEN 'pairs' END, CASE WHEN mean_delta < 0 THEN 'mean_delta' END,
    CASE WHEN positive_fraction < 0.5 THEN 'positive_pairs' END, CASE WHEN positive_run_fraction < 0.5 THEN 'positive_runs' END) END AS failure_reason FROM j)
  SELECT M, comparator, present, coalesce(n_runs, 0) AS n_runs, coalesce(n_pairs, 0) AS n_pairs, {r('mean_delta', 'mean_delta')}, {r('positive_fraction', 'positive_fraction')}, {r('positive_run_fraction', 'positive_run_fraction')}, failure_reason = '' AS passes, failure_reason FROM k""")
def _(spark, sf):
    s = _view(spark, sf, SELECTORS)
    base = s.where("comparator = 'ECONOMY'").select("M", "run_id", "fold", F.col("score").alias("base"))
    deltas = s.where("comparator <> 'ECONOMY'").join(base, ["M", "run_id", "fold"]).withColumn("delta", F.round(F.col("base") - F.col("score"), 6))
    return rounded(gates.differentiation(gates.contrast(deltas, ["M", "comparator"], "delta", "run_id"), ["M"], ASKED, CHECKS))


#: Perturbations are M by parity of the fold; those of M = 'A' are the hard gate.
PERTURBED = """SELECT taxon, candidate, concat(M, CAST(fold % 2 AS STRING)) AS perturbation, CASE WHEN M = 'A' THEN 'resampling' ELSE 'effort' END AS kind, fold,
  presence_rank, overlap, centroid_distance, breadth_error, CAST(n_rows AS DOUBLE) AS size FROM {metrics}"""
_UP, _DOWN = ["overlap"], ["centroid_distance", "breadth_error"]


@register("perturbation_selection", f"""WITH d AS ({_own(PERTURBED).replace('STRING', 'VARCHAR')}),
  per AS (SELECT taxon, candidate, perturbation, kind = 'resampling' AS hard, avg(presence_rank) AS m, count(presence_rank) AS n, stddev_samp(presence_rank) AS sd, avg(quant) AS q, avg(overlap) AS overlap, avg(centroid_distance) AS centroid_distance, avg(breadth_error) AS breadth_error
    FROM (SELECT *, breadth_error AS quant FROM d) GROUP BY ALL),
  ok AS (SELECT *, coalesce(m >= 0.51 - 1e-12 AND m - CASE WHEN n = 1 THEN 0 ELSE sd / sqrt(n) END >= 0.5 - 1e-12 AND q <= 0.06 + 1e-12, false) AS ok FROM per),
  total AS (SELECT taxon, count(DISTINCT perturbation) AS every, count(DISTINCT perturbation) FILTER (WHERE hard) AS gates FROM per GROUP BY taxon),
  base AS (SELECT taxon, candidate, gates > 0 AND every > 1 AND count(*) FILTER (WHERE hard) = gates AND count(*) FILTER (WHERE hard AND ok) = gates AS eligible, any_value(every) AS every FROM ok JOIN total USING (taxon) GROUP BY taxon, candidate, gates, every),
  ranked AS (SELECT taxon, candidate, rank() OVER (PARTITION BY taxon, perturbation ORDER BY overlap DESC) AS a, rank() OVER (PARTITION BY taxon, perturbation ORDER BY centroid_distance) AS b, rank() OVER (PARTITION BY taxon, perturbation ORDER BY breadth_error) AS c
    FROM ok JOIN base USING (taxon, candidate) WHERE eligible),
  g AS (SELECT taxon, candidate, count(*) AS seen, max(a) AS wa, max(b) AS wb, max(c) AS wc, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM ranked GROUP BY taxon, candidate),
  size AS (SELECT taxon, candidate, avg(size) AS mean_complexity FROM d GROUP BY taxon, candidate),
  w AS (SELECT taxon, candidate, eligible, coalesce(seen = every, false) AS complete, wa, wb, wc, greatest(wa, wb, wc)::DOUBLE AS worst_rank, (wa + wb + wc) / 3.0::DOUBLE AS mean_worst_rank, greatest(ma, mb, mc) AS worst_mean_rank, (ma + mb + mc) / 3 AS mean_rank, mean_complexity
    FROM base LEFT JOIN g USING (taxon, candidate) JOIN size USING (taxon, candidate)),
  f AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY worst_rank, round(mean_worst_rank, 9), round(worst_mean_rank, 9), round(mean_rank, 9), mean_complexity, candidate) AS nth FROM w x WHERE complete
    AND NOT EXISTS (SELECT 1 FROM w y WHERE y.complete AND y.taxon = x.taxon AND y.candidate <> x.candidate AND y.wa <= x.wa AND y.wb <= x.wb AND y.wc <= x.wc AND (y.wa < x.wa OR y.wb < x.wb OR y.wc < x.wc)))
  SELECT w.taxon, w.candidate, w.eligible, w.complete, f.nth IS NOT NULL AS on_front, {", ".join(r(f"CASE WHEN w.complete THEN w.{c} END", c) for c in ("worst_rank", "mean_worst_rank", "worst_mean_rank", "mean_rank"))}, {r('w.mean_complexity', 'mean_complexity')}, coalesce(f.nth = 1, false) AS selected
  FROM w LEFT JOIN f USING (taxon, candidate)""")
def _(spark, sf):
    rows = _view(spark, sf, PERTURBED)
    return rounded(gates.perturbation_selection(rows, ["taxon"], "candidate", "perturbation", _UP, _DOWN, kind="kind", hard=["resampling"], complexity="size", most={"breadth_error": 0.06}))
