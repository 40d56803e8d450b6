"""Queries over scores and environment tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import metrics as M
from tarnflow.operators import responses as R
from tarnflow.operators.audits import spearman_matrices

from .adapters import environment, scores
from .occurrence_queries import QUERIES, ORACLE_SQL, r, register, rounded  # noqa: F401


@register("presence_rank_by_group", f"""WITH v AS (SELECT grp, score, count(*) FILTER (WHERE is_presence) AS p, count(*) FILTER (WHERE NOT is_presence) AS b FROM scores WHERE score IS NOT NULL GROUP BY grp, score),
  c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
  SELECT grp, {r('sum(p * (below + 0.5::DOUBLE * b)) / nullif(sum(p) * sum(b), 0)', 'presence_rank', 9)} FROM c GROUP BY grp""")
def presence_rank_by_group(spark, sf):
    return rounded(M.presence_rank(scores(spark, sf), "grp"), 9)


@register("or10_by_group", f"SELECT s.grp, {r('avg(CASE WHEN score < cut THEN 1.0 ELSE 0.0 END)', 'or10')} FROM scores s JOIN (SELECT grp, quantile_cont(score, 0.1) AS cut FROM scores WHERE NOT is_presence GROUP BY grp) t ON s.grp = t.grp WHERE is_presence GROUP BY s.grp")
def _(spark, sf):
    return rounded(M.or10(scores(spark, sf), "grp"))


_BINS = """b AS (SELECT grp, least(CAST(floor((score - low) / nullif(high - low, 0) * 10) AS BIGINT), 9) AS bin, is_presence FROM (SELECT *, min(score) OVER (PARTITION BY grp) AS low, max(score) OVER (PARTITION BY grp) AS high FROM scores WHERE score IS NOT NULL) WHERE high > low),
  c AS (SELECT grp, bin, count(*) FILTER (WHERE is_presence) AS p, count(*) FILTER (WHERE NOT is_presence) AS n FROM b GROUP BY grp, bin),
  e AS (SELECT grp, bin, p / nullif(sum(p) OVER (PARTITION BY grp), 0)::DOUBLE AS observed, n / nullif(sum(n) OVER (PARTITION BY grp), 0)::DOUBLE AS expected FROM c)"""
_RHO = """, k AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0::DOUBLE AS y FROM v),
  g AS (SELECT grp, count(*) AS n, n * sum(x * y) - sum(x) * sum(y) AS xy, n * sum(x * x) - pow(sum(x), 2) AS xx, n * sum(y * y) - pow(sum(y), 2) AS yy FROM k GROUP BY grp)
  SELECT grp, n, CASE WHEN n >= 3 AND xx > 1e-12 AND yy > 1e-12 THEN round(xy / sqrt(xx * yy), 9) END AS spearman FROM g"""


@register("boyce_bins", f"WITH {_BINS} SELECT grp, bin, {r('observed', 'observed')}, {r('expected', 'expected')} FROM e")
def _(spark, sf):
    return rounded(M.boyce_bins(scores(spark, sf), "grp"))


@register("boyce_by_group", f"WITH {_BINS}, v AS (SELECT grp, bin AS x, round(observed / expected, 10) AS y FROM e WHERE expected > 0)" + _RHO)
def _(spark, sf):
    return rounded(M.binned_boyce(scores(spark, sf), "grp"))


@register("continuous_boyce_by_group", """WITH s AS (SELECT grp, min(score) AS low, max(score) AS high FROM scores WHERE NOT is_presence AND score IS NOT NULL GROUP BY grp),
  d AS (SELECT o.grp, score, low, high, count(*) FILTER (WHERE is_presence) AS p, count(*) FILTER (WHERE NOT is_presence) AS b FROM scores o JOIN s ON o.grp = s.grp WHERE score IS NOT NULL AND high > low GROUP BY ALL),
  t AS (SELECT grp, sum(p) AS np, sum(b) AS nb FROM d GROUP BY grp),
  w AS (SELECT d.grp, w, sum(p) AS p, sum(b) AS b FROM d, range(101) q(w) WHERE round(score - (low + w * ((high - low - (high - low) / 10.0) / 100.0::DOUBLE)), 10) >= 0 AND round(score - (low + w * ((high - low - (high - low) / 10.0) / 100.0::DOUBLE)) - (high - low) / 10.0, 10) <= 0 GROUP BY d.grp, w),
  q AS (SELECT w.grp, w, round((p / nullif(np, 0)::DOUBLE) / (b / nullif(nb, 0)::DOUBLE), 10) AS y FROM w JOIN t ON w.grp = t.grp WHERE b > 0),
  v AS (SELECT grp, w AS x, y FROM (SELECT *, lag(y) OVER (PARTITION BY grp ORDER BY w) AS z FROM q) WHERE z IS NULL OR z <> y)""" + _RHO)
def _(spark, sf):
    return rounded(M.continuous_boyce(scores(spark, sf), "grp"))


@register("spearman_by_group", "WITH v AS (SELECT species AS grp, e0 AS x, e1 AS y FROM env)" + _RHO)
def _(spark, sf):
    return rounded(M.spearman(environment(spark, sf).withColumnRenamed("species", "grp"), "grp", "e0", "e1"))


@register("weighted_quantile_profile", """WITH g AS (SELECT species, e0 AS v, sum(abs(e1) + 0.01) AS w FROM env GROUP BY species, e0),
  c AS (SELECT species, v, (sum(w) OVER (PARTITION BY species ORDER BY v ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY species) AS c FROM g),
  s AS (SELECT *, lead(v) OVER k AS v2, lead(c) OVER k AS c2, row_number() OVER k AS i FROM c WINDOW k AS (PARTITION BY species ORDER BY v))
  SELECT species, q, round(CASE WHEN v2 IS NULL OR q < c THEN v ELSE v + (q - c) / (c2 - c) * (v2 - v) END, 9) AS value FROM s, (VALUES (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE)) t(q)
  WHERE (i = 1 AND q < c) OR (v2 IS NULL AND q >= c) OR (c <= q AND q < c2)""")
def _(spark, sf):
    env = environment(spark, sf).withColumn("w", F.abs("e1") + 0.01)
    return rounded(M.weighted_quantiles(env, "species", "e0", "w", [0.05, 0.25, 0.5, 0.75, 0.95]))


@register("direction_changes", """WITH d AS (SELECT grp, k, sign(score - lag(score) OVER (PARTITION BY grp ORDER BY k)) AS d FROM (SELECT user_id % 7 AS grp, event_id AS k, value AS score FROM events)),
  t AS (SELECT grp, CASE WHEN d <> lag(d) OVER (PARTITION BY grp ORDER BY k) THEN 1 ELSE 0 END AS t FROM d WHERE d <> 0) SELECT CAST(grp AS BIGINT) AS grp, CAST(sum(t) AS BIGINT) AS changes FROM t GROUP BY grp""")
def _(spark, sf):
    from .adapters import read

    rows = read(spark, sf, "events").selectExpr("CAST(user_id % 7 AS BIGINT) AS grp", "event_id AS k", "value AS score")
    return M.direction_changes(rows, "grp", "k", "score")


@register("schoener_d", f"""WITH s AS (SELECT species, min(e0) AS a, max(e0) AS b, min(e1) AS c, max(e1) AS d FROM env GROUP BY species),
  g AS (SELECT env.species, floor((e0 - a + 1e-9) / (b - a + 2e-9) * 20) AS x, floor((e1 - c + 1e-9) / (d - c + 2e-9) * 20) AS y, count(*) FILTER (WHERE e2 > 0) AS p, count(*) FILTER (WHERE NOT e2 > 0) AS n FROM env JOIN s ON env.species = s.species GROUP BY 1, 2, 3),
  h AS (SELECT species, abs(p / nullif(sum(p) OVER (PARTITION BY species), 0)::DOUBLE - n / nullif(sum(n) OVER (PARTITION BY species), 0)::DOUBLE) AS d FROM g) SELECT species, {r('1 - 0.5 * sum(d)', 'overlap')} FROM h GROUP BY species""")
def _(spark, sf):
    return rounded(M.schoener_d(environment(spark, sf), "species", "e0", "e1", F.col("e2") > 0))


#: A predictor's rows by the bins between its quantiles, and the curve over them.
_CURVE = """l AS (SELECT species, 'e0' AS predictor, e0 AS x, abs(e1) AS s FROM env UNION ALL SELECT species, 'e4', e4, abs(e1) FROM env UNION ALL SELECT species, 'e5', round(e5, 1), abs(e1) FROM env),
  d AS (SELECT species, predictor, list_sort(list_distinct(quantile_cont(x, [i / 20.0::DOUBLE FOR i IN range(21)]))) AS e FROM l GROUP BY ALL),
  b AS (SELECT species, predictor, x, s, len(list_filter(e[2:-2], lambda v: v <= x)) AS bin FROM l JOIN d USING (species, predictor) WHERE len(e) >= 3),
  c AS (SELECT species, predictor, CAST(bin AS INT) AS bin, avg(x) AS centre, avg(s) AS mean_response, count(*) AS n FROM b GROUP BY ALL)"""
_RESPONSES = ["e0", "e4", "e5"]


def _responses(spark, sf):
    return environment(spark, sf).withColumn("a", F.abs("e1")).withColumn("e5", F.round("e5", 1))


@register("response_curve", f"WITH {_CURVE} SELECT species, predictor, bin, {r('centre', 'centre')}, {r('mean_response', 'mean_response')}, n FROM c")
def _(spark, sf):
    return rounded(R.response_curve(_responses(spark, sf), "species", _RESPONSES, "a"))


_PROFILE = _CURVE + """,
  t AS (SELECT species, predictor, count(*) AS n, min(x) AS lo, max(x) AS hi, sum(s) AS w, sum(s * x) / sum(s) AS centre FROM l GROUP BY ALL),
  v AS (SELECT species, predictor, sqrt(sum(s * pow(x - centre, 2)) / any_value(w)) AS breadth FROM l JOIN t USING (species, predictor) GROUP BY ALL),
  g AS (SELECT species, predictor, x, sum(s) AS w FROM l WHERE s > 0 GROUP BY ALL),
  m AS (SELECT species, predictor, x, (sum(w) OVER (PARTITION BY species, predictor ORDER BY x ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY species, predictor) AS c FROM g),
  z AS (SELECT *, lead(x) OVER k AS x2, lead(c) OVER k AS c2, row_number() OVER k AS i FROM m WINDOW k AS (PARTITION BY species, predictor ORDER BY x)),
  q AS (SELECT species, predictor, q, CASE WHEN x2 IS NULL OR q < c THEN x ELSE x + (q - c) / (c2 - c) * (x2 - x) END AS value FROM z, (VALUES (0.05::DOUBLE), (0.95::DOUBLE)) t(q) WHERE (i = 1 AND q < c) OR (x2 IS NULL AND q >= c) OR (c <= q AND q < c2)),
  ql AS (SELECT species, predictor, min(value) AS lower_limit, max(value) AS upper_limit FROM q GROUP BY ALL),
  o AS (SELECT species, predictor, arg_min(centre, bin) AS optimum, any_value(nb) AS n_bins FROM (SELECT *, max(round(mean_response, 12)) OVER p AS top, count(*) OVER p AS nb FROM c WINDOW p AS (PARTITION BY species, predictor)) WHERE round(mean_response, 12) = top GROUP BY ALL),
  kr AS (SELECT species, predictor, rank() OVER (PARTITION BY species, predictor ORDER BY centre) AS a, rank() OVER (PARTITION BY species, predictor ORDER BY round(mean_response, 12)) + (count(*) OVER (PARTITION BY species, predictor, round(mean_response, 12)) - 1) / 2.0::DOUBLE AS b FROM c),
  rc AS (SELECT species, predictor, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS rank_correlation FROM kr GROUP BY ALL),
  ds AS (SELECT species, predictor, bin, sign(round(mean_response, 12) - lag(round(mean_response, 12)) OVER (PARTITION BY species, predictor ORDER BY bin)) AS d FROM c),
  dt AS (SELECT species, predictor, CASE WHEN d <> lag(d) OVER (PARTITION BY species, predictor ORDER BY bin) THEN 1 ELSE 0 END AS t FROM ds WHERE d <> 0),
  dc AS (SELECT species, predictor, CAST(sum(t) AS BIGINT) AS changes FROM dt GROUP BY ALL),
  f AS (SELECT * FROM t JOIN v USING (species, predictor) JOIN ql USING (species, predictor) LEFT JOIN o USING (species, predictor) LEFT JOIN rc USING (species, predictor) LEFT JOIN dc USING (species, predictor))"""


@register("response_profile", f"""WITH {_PROFILE} SELECT species, predictor, n, {r('lo', 'environment_min')}, {r('hi', 'environment_max')}, {r('centre', 'niche_centre')}, {r('breadth', 'niche_breadth')}, {r('lower_limit', 'lower_limit')}, {r('upper_limit', 'upper_limit')},
  {r('optimum', 'optimum')}, {r('rank_correlation', 'rank_correlation')}, coalesce(changes, 0) AS direction_changes, coalesce(n_bins, 0) AS n_bins FROM f""")
def _(spark, sf):
    return rounded(R.response_profile(_responses(spark, sf), "species", _RESPONSES, "a"))


@register("response_estimates", f"WITH {_PROFILE} SELECT species, predictor, {r('coalesce(optimum, centre)', 'optimum')}, {r('lower_limit', 'lower')}, {r('upper_limit', 'upper')}, {r('hi - lo', 'span')} FROM f")
def _(spark, sf):
    return rounded(R.response_estimates(R.response_profile(_responses(spark, sf), "species", _RESPONSES, "a"), "species"))


@register("selector_ranges")
def _(spark, sf):
    """The profiles by two responses of the same rows; every axis of the environment."""
    env, axes = environment(spark, sf).withColumn("a", F.abs("e1")).withColumn("b", F.abs("e2")), [f"e{i}" for i in range(8)]
    return rounded(R.selector_ranges(*(R.response_profile(env, "species", axes, s) for s in "ab"), "species"))


@register("scaled_error", f"""WITH u AS (SELECT species, coalesce((e0 - min(e0) OVER p) / nullif(max(e0) OVER p - min(e0) OVER p, 0), 0) AS a, coalesce((e1 - min(e1) OVER p) / nullif(max(e1) OVER p - min(e1) OVER p, 0), 0) AS b FROM env WINDOW p AS (PARTITION BY species))
  SELECT species, {r('CASE WHEN count(*) >= 5 THEN sqrt(avg(pow(a - b, 2))) END', 'nrmse')} FROM u GROUP BY species""")
def _(spark, sf):
    return rounded(R.scaled_error(environment(spark, sf), "species", "e0", "e1"))


@register("surface_stability", f"""WITH s AS (SELECT species, vec_id AS place, 0 AS member, e0 AS v FROM env UNION ALL SELECT species, vec_id, 1, e0 + e1 FROM env UNION ALL SELECT species, vec_id, 2, round(e0 * 0.5, 1) FROM env UNION ALL SELECT species, vec_id, 3, 0.25 FROM env),
  p AS (SELECT a.species, a.member AS i, b.member AS j, a.v AS x, b.v AS y FROM s a JOIN s b ON a.species = b.species AND a.place = b.place AND a.member < b.member),
  k AS (SELECT species, i, j, x, y, rank() OVER (g ORDER BY x) + (count(*) OVER (PARTITION BY species, i, j, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (g ORDER BY y) + (count(*) OVER (PARTITION BY species, i, j, y) - 1) / 2.0::DOUBLE AS ry,
    coalesce((x - min(x) OVER g) / nullif(max(x) OVER g - min(x) OVER g, 0), 0) AS ux, coalesce((y - min(y) OVER g) / nullif(max(y) OVER g - min(y) OVER g, 0), 0) AS uy FROM p WINDOW g AS (PARTITION BY species, i, j)),
  e AS (SELECT species, i, j, CASE WHEN max(x) = min(x) OR max(y) = min(y) THEN 0 ELSE corr(rx, ry) END AS rk, sqrt(avg(pow(ux - uy, 2))) AS e FROM k GROUP BY ALL HAVING count(*) >= 5)
  SELECT species, count(*) AS n_pairs, {r('avg(rk)', 'rank_mean')}, {r('min(rk)', 'rank_min')}, {r('avg(e)', 'nrmse_mean')}, {r('max(e)', 'nrmse_max')} FROM e GROUP BY species""")
def _(spark, sf):
    env = environment(spark, sf)
    members = F.array(F.col("e0"), F.col("e0") + F.col("e1"), F.round(F.col("e0") * 0.5, 1), F.lit(0.25))
    return rounded(R.surface_stability(env.select("species", F.col("vec_id").alias("place"), F.posexplode(members).alias("member", "v")), "species", "member", "place", "v"))


@register("effective_size", f"""WITH o AS (SELECT species, (1 - p) / p AS w FROM (SELECT species, least(greatest(abs(e0) * 2, 1e-6), 1 - 1e-6) AS p FROM env)),
  c AS (SELECT species, quantile_cont(w, 0.99) AS cap FROM o GROUP BY species), t AS (SELECT o.species, least(w, cap) AS w FROM o JOIN c ON o.species = c.species)
  SELECT species, count(*) AS n, {r('pow(sum(w), 2) / sum(w * w)', 'effective_size', 4)} FROM t GROUP BY species""")
def _(spark, sf):
    weighted = M.density_weights(environment(spark, sf), "species", F.abs("e0") * 2)
    return rounded(M.effective_size(weighted, "species"), 4)


def _niche(spark, sf, axes):
    env = environment(spark, sf).withColumn("w", F.abs("e3") + 0.01)
    return R.niche_recovery(env.where("e2 <= 0"), env.where("e2 > 0"), "species", axes, "w")


#: Two standardised axes with correlation c have the principal axes (1, sign c) and (1, -sign c), of 1 + |c| and 1 - |c|.
@register("niche_profile", f"""WITH b AS (SELECT species, count(*) AS n, avg(e0) AS m0, avg(e1) AS m1, stddev_pop(e0) AS s0, stddev_pop(e1) AS s1, corr(e0, e1) AS c FROM env WHERE e2 <= 0 GROUP BY species),
  z AS (SELECT env.species, e2 <= 0 AS ref, CASE WHEN e2 <= 0 THEN abs(e3) + 0.01 ELSE 1 END AS w, n, c, (e0 - m0) / s0 AS a, (e1 - m1) / s1 AS d FROM env JOIN b USING (species)),
  k AS (SELECT species, ref, w, (a + sign(c) * d) / sqrt(2 * (1 + abs(c)) * n / (n - 1)) AS x, (a - sign(c) * d) / sqrt(2 * (1 - abs(c)) * n / (n - 1)) AS y FROM z),
  l AS (SELECT species, ref, w, 0 AS axis, x AS v FROM k UNION ALL SELECT species, ref, w, 1, y FROM k),
  s AS (SELECT species, axis, ref, sum(w * v) / sum(w) AS m, sqrt(sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2)) AS sd FROM l GROUP BY ALL),
  f AS (SELECT p.species, sqrt(avg(pow(p.m - o.m, 2))) AS centroid_distance, avg(abs(ln((p.sd + 1e-8) / (o.sd + 1e-8)))) AS breadth_error FROM s p JOIN s o USING (species, axis) WHERE p.ref AND NOT o.ref GROUP BY p.species),
  g AS (SELECT species, axis, v, sum(w) AS w FROM l WHERE ref GROUP BY ALL),
  h AS (SELECT species, axis, v, (sum(w) OVER (PARTITION BY species, axis ORDER BY v ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY species, axis) AS c FROM g),
  i AS (SELECT *, lead(v) OVER t AS v2, lead(c) OVER t AS c2, row_number() OVER t AS i FROM h WINDOW t AS (PARTITION BY species, axis ORDER BY v)),
  q AS (SELECT species, axis, q, CASE WHEN v2 IS NULL OR q < c THEN v ELSE v + (q - c) / (c2 - c) * (v2 - v) END AS pv FROM i, (VALUES (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE)) t(q) WHERE (i = 1 AND q < c) OR (v2 IS NULL AND q >= c) OR (c <= q AND q < c2)),
  o AS (SELECT species, axis, unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS q, unnest(v) AS ov FROM (SELECT species, axis, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS v FROM l WHERE NOT ref GROUP BY ALL)),
  e AS (SELECT species, sqrt(avg(pow(pv - ov, 2))) AS quantile_error FROM q JOIN o USING (species, axis, q) GROUP BY species),
  w AS (SELECT species, axis, min(pv) AS lo, max(pv) AS hi FROM q WHERE q IN (0.05, 0.95) GROUP BY ALL),
  j AS (SELECT k.species, avg(CASE WHEN x BETWEEN a.lo AND a.hi AND y BETWEEN d.lo AND d.hi THEN 1.0 ELSE 0.0 END) AS coverage90 FROM k JOIN w a ON a.species = k.species AND a.axis = 0 JOIN w d ON d.species = k.species AND d.axis = 1 WHERE NOT ref GROUP BY k.species),
  n AS (SELECT species, min(x) AS x0, max(x) - min(x) AS xr, min(y) AS y0, max(y) - min(y) AS yr, sum(w) FILTER (WHERE ref) AS tp, sum(w) FILTER (WHERE NOT ref) AS tq, count(*) FILTER (WHERE ref) AS n_reference, count(*) FILTER (WHERE NOT ref) AS n_sealed FROM k GROUP BY species),
  m AS (SELECT species, abs(coalesce(sum(w) FILTER (WHERE ref), 0) / any_value(tp) - coalesce(sum(w) FILTER (WHERE NOT ref), 0) / any_value(tq)) AS d FROM k JOIN n USING (species) GROUP BY species, least(floor((x - x0 + 1e-9 * xr) / (xr + 2e-9 * xr) * 20), 19), least(floor((y - y0 + 1e-9 * yr) / (yr + 2e-9 * yr) * 20), 19)),
  u AS (SELECT species, 1 - 0.5 * sum(d) AS overlap FROM m GROUP BY species)
  SELECT species, CAST(2 AS INT) AS n_components, n_reference, n_sealed, {r('overlap', 'overlap')}, {r('centroid_distance', 'centroid_distance')}, {r('breadth_error', 'breadth_error')}, {r('quantile_error', 'quantile_error')}, {r('coverage90', 'coverage90')}
  FROM n JOIN u USING (species) JOIN f USING (species) JOIN e USING (species) JOIN j USING (species)""")
def _(spark, sf):
    return rounded(_niche(spark, sf, ["e0", "e1"]))


@register("niche_recovery")
def _(spark, sf):
    """Four principal axes of all eight of the environment."""
    return rounded(_niche(spark, sf, [f"e{i}" for i in range(8)]))


@register("variance_inflation")
def _(spark, sf):
    return rounded(M.vif(environment(spark, sf), "species", [f"e{i}" for i in range(8)], 1.05))


@register("correlation_groups")
def _(spark, sf):
    names = [f"e{i}" for i in range(8)]
    out = []
    for key, n, m in spearman_matrices(environment(spark, sf), "species", names):
        pairs = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and abs(m[i, j]) >= 0.2]
        out += [(key, p, g, n) for p, g in M.equivalence_groups(pairs, names).items()]
    return spark.createDataFrame(out, "species int, predictor string, equivalence_group string, n long")
