"""Queries over metric tables: roll-ups, stability, contrasts, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import rollups as R

from .adapters import metrics, read, strata
from .occurrence_queries import r, register, rounded

MEANS = "m AS (SELECT M, taxon, candidate, round(avg(presence_rank), 9) AS v, round(avg(overlap), 9) AS o, round(avg(centroid_distance), 9) AS c, sum(n_rows) AS size FROM metrics GROUP BY M, taxon, candidate)"


def means(spark, sf):
    g = metrics(spark, sf).groupBy("M", "taxon", "candidate")
    return g.agg(F.round(F.avg("presence_rank"), 9).alias("v"), F.round(F.avg("overlap"), 9).alias("o"), F.round(F.avg("centroid_distance"), 9).alias("c"), F.sum("n_rows").alias("size"))


@register("method_performance", f"""WITH {MEANS}, w AS (SELECT *, v >= max(v) OVER (PARTITION BY M, taxon) - 1e-12 AS won FROM m)
  SELECT candidate, count(*) AS n_cases, {r('avg(v)', 'mean_metric')}, {r('median(v)', 'median_metric')}, {r('avg(won::INT)', 'win_fraction')}, {r('avg(size)', 'mean_size')} FROM w GROUP BY candidate""")
def _(spark, sf):
    return rounded(R.method_performance(means(spark, sf), ["M", "taxon"], "candidate", "v", "size"))


@register("universe_strategy_summary", f"SELECT M, candidate, count(presence_rank) AS n, {r('avg(presence_rank)', 'mean_metric')}, {r('median(presence_rank)', 'median_metric')}, {r('min(presence_rank)', 'worst')}, {r('max(presence_rank)', 'best')} FROM metrics GROUP BY M, candidate")
def _(spark, sf):
    return rounded(R.pair_summary(metrics(spark, sf), ["M", "candidate"], "presence_rank"))


_CASE = f"""WITH {MEANS}, k AS (SELECT *, rank() OVER (PARTITION BY M, taxon ORDER BY v DESC) AS k, count(*) OVER (PARTITION BY M, taxon) AS n FROM m),
  s AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE 1 - (k - 1) / (n - 1)::DOUBLE END AS s, (k = 1)::INT AS w FROM k) """


@register("robust_case_rank", _CASE + f"SELECT M, taxon, candidate, k::INT AS case_rank, {r('s', 'rank_score')}, w AS case_win FROM s")
def _(spark, sf):
    return rounded(R.case_scores(means(spark, sf), ["M", "taxon"], "v").select("M", "taxon", "candidate", "case_rank", "rank_score", "case_win"))


@register("robust_across_specs", _CASE + f""", b AS (SELECT M, candidate, round(avg(s), 9) AS s, avg(w) AS w, avg(v) AS mv FROM s GROUP BY M, candidate), t AS (SELECT *, s >= max(s) OVER (PARTITION BY M) - 1e-12 AS q FROM b)
  SELECT candidate, count(*) AS n_specs, {r('avg(s)', 'mean_rank_score')}, {r('min(s)', 'worst_rank_score')}, {r('avg(w)', 'case_win_fraction')}, {r('avg(q::INT)', 'spec_win_fraction')}, {r('avg(mv)', 'mean_metric')} FROM t GROUP BY candidate""")
def _(spark, sf):
    return rounded(R.robust_across_specs(means(spark, sf), "M", "taxon", ["candidate"], "v"))


@register("transfer_summary", f"WITH t AS (SELECT M, candidate, avg(presence_rank) AS o, avg(overlap) AS i FROM metrics GROUP BY M, candidate) SELECT candidate, {r('min(o)', 'worst_spec')}, {r('max(o)', 'best_spec')}, {r('stddev_samp(o)', 'sd_spec')}, {r('avg(o)', 'mean_spec')}, {r('avg(i) - avg(o)', 'gap')} FROM t GROUP BY candidate")
def _(spark, sf):
    return rounded(R.transfer_summary(metrics(spark, sf), "M", ["candidate"], "overlap", "presence_rank"))


@register("best_combination", f"SELECT M, candidate, {r('avg(presence_rank)', 'mean_metric')}, count(presence_rank) AS n FROM metrics GROUP BY M, candidate ORDER BY round(avg(presence_rank), 9) DESC, M, candidate LIMIT 1")
def _(spark, sf):
    return rounded(R.best_combination(metrics(spark, sf), ["M", "candidate"], "presence_rank"))


_FREQ = "SELECT p_type AS item, count(DISTINCT l_suppkey) AS n_cases, median(l_discount) AS g, median(l_linenumber) AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30 GROUP BY p_type"
_TOTAL = "SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30"


def _frequency(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_quantity > 30")
    return R.selection_frequency(rows.withColumnRenamed("p_type", "item"), "item", "l_suppkey", "l_discount", "l_linenumber")


@register("selection_frequency", f"SELECT item, n_cases, {r(f'n_cases / ({_TOTAL})::DOUBLE', 'fraction')}, {r('g', 'median_gain')}, {r('s', 'median_step')} FROM ({_FREQ})")
def _(spark, sf):
    return rounded(_frequency(spark, sf))


@register("common_set", f"WITH f AS (SELECT item, round(n_cases / ({_TOTAL})::DOUBLE, 6) AS fraction, round(g, 6) AS g FROM ({_FREQ})) SELECT item FROM f WHERE fraction >= 0.9 OR NOT EXISTS (SELECT 1 FROM f WHERE fraction >= 0.9) ORDER BY fraction DESC, g DESC, item LIMIT 5")
def _(spark, sf):
    return R.common_set(rounded(_frequency(spark, sf)), "item", 0.9, 5).select("item")


@register("process_evidence", f"""WITH p AS (SELECT p_brand AS process, l_suppkey, sum(l_discount) AS g, max(l_tax - 0.04) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey)
  SELECT process, {r('avg(g)', 'mean_gain')}, {r('median(g)', 'median_gain')}, {r('avg(CASE WHEN d > 0 THEN 1 ELSE 0 END)', 'positive_drop_fraction')}, count(*) AS n_cases, {r('count(*) / (SELECT count(DISTINCT l_suppkey) FROM lineitem)::DOUBLE', 'coverage')} FROM p GROUP BY process""")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumns({"process": F.col("p_brand"), "drop": F.col("l_tax") - 0.04})
    return rounded(R.item_evidence(rows, "process", "l_suppkey", "l_discount", "drop"))


@register("equivalence_process_map", "SELECT p_size AS eq, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS items, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS processes, count(DISTINCT p_type) > 1 AS cross_process FROM part GROUP BY p_size")
def _(spark, sf):
    return R.group_map(read(spark, sf, "part").withColumnRenamed("p_size", "eq"), "eq", "p_brand", "p_type")


@register("heterogeneity", f"""WITH v AS (SELECT c_mktsegment AS item, r_name AS stratum, c_acctbal AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  m AS (SELECT item, stratum, avg(x) AS m FROM v GROUP BY item, stratum HAVING count(x) >= 30)
  SELECT item, count(*) AS n_strata, {r('min(m)', 'least', 4)}, {r('max(m)', 'most', 4)}, {r('stddev_pop(m)', 'sd', 4)}, arg_min(stratum, m) AS least_stratum, arg_max(stratum, m) AS most_stratum, {r('max(m) - min(m)', 'range', 4)} FROM m GROUP BY item""")
def _(spark, sf):
    place = strata(spark, sf)
    nation = read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("species"))
    rows = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(place, "species")
    return rounded(R.heterogeneity(rows.withColumnRenamed("c_mktsegment", "item"), "item", "stratum", "c_acctbal", 30), 4)


@register("split_stability", f"""SELECT p_brand AS item, count(DISTINCT l_linenumber) AS n_selected, {r('avg(l_tax - 0.04)', 'mean_drop')}, {r('median(l_tax - 0.04)', 'median_drop')}, {r('avg(CASE WHEN l_tax - 0.04 > 0 THEN 1 ELSE 0 END)', 'positive_fraction')},
  {r('count(DISTINCT l_linenumber) / (SELECT count(DISTINCT l_linenumber) FROM lineitem)::DOUBLE', 'selection_fraction')} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.09 AND l_quantity > 45 GROUP BY p_brand""")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumns({"item": F.col("p_brand"), "drop": F.col("l_tax") - 0.04})
    return rounded(R.split_stability(rows, "item", "l_linenumber", (F.col("l_discount") > 0.09) & (F.col("l_quantity") > 45), "drop"))


_CHOICE = """c AS (SELECT taxon, M, candidate, round(avg(presence_rank), 9) AS v FROM metrics GROUP BY ALL),
  f AS (SELECT M, candidate FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY v DESC, M, candidate) AS k FROM c) WHERE k = 1),
  st AS (SELECT M, candidate, count(*) AS runs_selected, (SELECT count(DISTINCT taxon) FROM metrics) AS n_runs FROM f GROUP BY M, candidate)"""


@register("component_stability", f"WITH {_CHOICE} SELECT *, {r('runs_selected / n_runs::DOUBLE', 'selection_fraction')} FROM st")
def choice(spark, sf):
    return rounded(R.choice_stability(metrics(spark, sf), "taxon", ["M", "candidate"], "presence_rank"))


_DELTA = """d AS (SELECT a.taxon, a.M, a.candidate, round(a.v - b.v, 9) AS delta FROM m a JOIN m b ON a.taxon = b.taxon AND a.M = b.M AND b.candidate = (SELECT min(candidate) FROM m) WHERE a.candidate <> b.candidate)"""


def deltas(spark, sf):
    m = means(spark, sf)
    base = m.agg(F.min("candidate")).first()[0]
    return R.paired_deltas(m, ["taxon", "M"], "candidate", "v", base).withColumn("delta", F.round("delta", 9))


@register("paired_deltas", f"WITH {MEANS}, {_DELTA} SELECT taxon, M, candidate, {r('delta', 'delta')} FROM d")
def _(spark, sf):
    return rounded(deltas(spark, sf))


@register("selector_contrast", f"""WITH {MEANS}, {_DELTA}, q AS (SELECT candidate, M, avg(delta) AS r FROM d GROUP BY candidate, M),
  a AS (SELECT candidate, count(*) AS n_runs, avg((round(r, 9) > 0)::INT) AS f, min(r) AS w, max(r) AS b FROM q GROUP BY candidate)
  SELECT d.candidate, count(*) AS n_pairs, {r('avg(delta)', 'mean_delta')}, {r('median(delta)', 'median_delta')}, {r('avg((delta > 0)::INT)', 'positive_fraction')}, any_value(n_runs) AS n_runs, {r('any_value(f)', 'positive_run_fraction')}, {r('any_value(w)', 'worst_run')}, {r('any_value(b)', 'best_run')}
  FROM d JOIN a ON d.candidate = a.candidate GROUP BY d.candidate""")
def _(spark, sf):
    return rounded(R.delta_summary(deltas(spark, sf), "candidate", "M"))


@register("retained_fraction", f"""WITH {MEANS}, f AS (SELECT taxon, candidate, v FROM m WHERE M = 'A'), g AS (SELECT taxon, candidate, v FROM m WHERE M = 'N')
  SELECT f.taxon, f.candidate, {r('f.v', 'full')}, {r('g.v', 'reduced')}, {r('f.v - g.v', 'loss')}, {r('(g.v - 0.5) / nullif(f.v - 0.5, 0)', 'retained')} FROM f JOIN g ON f.taxon = g.taxon AND f.candidate = g.candidate""".replace("AS full", 'AS "full"'))
def _(spark, sf):
    m = means(spark, sf)
    return rounded(R.retained_fraction(m.where("M = 'A'"), m.where("M = 'N'"), ["taxon", "candidate"], "v"))


_RANKS = f"""WITH {MEANS}, k AS (SELECT *, rank() OVER (PARTITION BY M, taxon ORDER BY v DESC) AS rank_v, rank() OVER (PARTITION BY M, taxon ORDER BY o DESC) AS rank_o, rank() OVER (PARTITION BY M, taxon ORDER BY c) AS rank_c FROM m),
  q AS (SELECT *, greatest(rank_v, rank_o, rank_c) AS worst_rank, (rank_v + rank_o + rank_c) / 3.0::DOUBLE AS mean_rank FROM k) """


def ranked(spark, sf):
    return R.perturbation_ranks(means(spark, sf), ["M", "taxon"], ["v", "o"], ["c"])


@register("perturbation_ranks", _RANKS + f"SELECT M, taxon, candidate, rank_v::INT AS rank_v, rank_o::INT AS rank_o, rank_c::INT AS rank_c, worst_rank::INT AS worst_rank, {r('mean_rank', 'mean_rank')} FROM q")
def _(spark, sf):
    return rounded(ranked(spark, sf).select("M", "taxon", "candidate", "rank_v", "rank_o", "rank_c", "worst_rank", "mean_rank"))


@register("truth_co_winners", _RANKS + """, w AS (SELECT *, min(worst_rank) OVER (PARTITION BY M, taxon) AS a FROM q), x AS (SELECT *, min(mean_rank) OVER (PARTITION BY M, taxon) AS b FROM w WHERE worst_rank = a)
  SELECT M, taxon, string_agg(DISTINCT candidate, ',' ORDER BY candidate) AS winners FROM x WHERE mean_rank <= b + 1e-12 GROUP BY M, taxon""")
def _(spark, sf):
    return R.co_winners(ranked(spark, sf), ["M", "taxon"], "candidate")


@register("inner_outer_diagnostics", f"""WITH {MEANS}, i AS (SELECT *, row_number() OVER (PARTITION BY M, taxon ORDER BY o DESC, candidate) AS a, row_number() OVER (PARTITION BY M, taxon ORDER BY v DESC, candidate) AS b, count(*) OVER (PARTITION BY M, taxon) AS n FROM m)
  SELECT x.M, x.taxon, x.n, x.candidate AS inner_winner, y.candidate AS outer_winner, {r('y.v - x.v', 'regret')}, x.candidate = y.candidate AS match, {r('x.o - x.v', 'gap')} FROM i x JOIN i y ON x.M = y.M AND x.taxon = y.taxon WHERE x.a = 1 AND y.b = 1""")
def _(spark, sf):
    return rounded(R.inner_outer(means(spark, sf), ["M", "taxon"], "candidate", "o", "v"))


@register("role_dominance", f"WITH t AS (SELECT o_orderpriority AS role, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT role, {r('t', 'total', 2)}, {r('t / sum(t) OVER ()', 'share', 2)}, t / sum(t) OVER () > 0.5 AS dominant FROM t")
def _(spark, sf):
    return rounded(R.role_dominance(read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "role"), "role", "o_totalprice"), 2)


@register("fold_resource_counts", f"""WITH p AS (SELECT c_mktsegment AS species, o_orderkey % 4 AS fold, count(*) FILTER (WHERE o_orderstatus = 'F') AS p, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
  SELECT species, count(*) AS n_folds, min(p) AS least_presence, min(b) AS least_background, {r('max(n) / avg(n)', 'imbalance')}, min(p) >= 50 AND min(b) >= 50 AS supported FROM p GROUP BY species""")
def _(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumns({"species": F.col("c_mktsegment"), "fold": F.col("o_orderkey") % 4})
    return rounded(R.fold_counts(rows, ["species"], "fold", F.col("o_orderstatus") == "F", 50))


@register("candidate_fold_means", f"SELECT taxon, candidate, {r('avg(presence_rank)', 'presence_rank_mean')}, count(presence_rank) AS presence_rank_folds, {r('min(presence_rank)', 'presence_rank_worst')}, {r('avg(overlap)', 'overlap_mean')}, count(overlap) AS overlap_folds, {r('min(overlap)', 'overlap_worst')} FROM metrics GROUP BY taxon, candidate")
def _(spark, sf):
    return rounded(R.fold_means(metrics(spark, sf), ["taxon", "candidate"], ["presence_rank", "overlap"]))
