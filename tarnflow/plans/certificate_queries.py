"""Queries of completeness, envelopes, support, certificates, fronts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import certificates as C

from .adapters import metrics, read
from .occurrence_queries import r, register, rounded
from .rollup_queries import _CHOICE, _DELTA, MEANS, choice, deltas, means

_ADEQUATE = "g AS (SELECT candidate, taxon, avg(presence_rank) AS m, count(presence_rank) AS n, CASE WHEN count(presence_rank) = 1 THEN 0 ELSE stddev_samp(presence_rank) / sqrt(count(presence_rank)) END AS s FROM metrics GROUP BY candidate, taxon)"


@register("auc_adequacy", f"WITH {_ADEQUATE} SELECT candidate, taxon, {r('m', 'mean_metric')}, n, {r('s', 'sem')}, {r('m - s', 'lower')}, m >= 0.51 - 1e-12 AND m - s >= 0.5 - 1e-12 AS adequate FROM g")
def adequacy(spark, sf):
    return rounded(C.auc_adequacy(metrics(spark, sf), ["candidate", "taxon"], "presence_rank"))


@register("fold_completeness", "SELECT candidate, taxon, M, count(*) AS n_rows, count(DISTINCT fold) AS n_folds, count(*) = 4 AND count(DISTINCT fold) = 4 AND count(*) FILTER (WHERE fold IN (0, 1, 2, 3) AND presence_rank IS NOT NULL AND overlap IS NOT NULL) = 4 AS eligible FROM metrics GROUP BY candidate, taxon, M")
def _(spark, sf):
    return C.fold_completeness(metrics(spark, sf), ["candidate", "taxon", "M"], "fold", [0, 1, 2, 3], ["presence_rank", "overlap"])


@register("dense_grid", f"WITH e AS (SELECT taxon, candidate, sum(n_rows) AS n FROM metrics WHERE overlap > 0.52 GROUP BY ALL) SELECT t.taxon, c.candidate, coalesce(n, 0)::DOUBLE AS value FROM (SELECT DISTINCT taxon FROM metrics) t CROSS JOIN (SELECT DISTINCT candidate FROM metrics) c LEFT JOIN e ON e.taxon = t.taxon AND e.candidate = c.candidate")
def _(spark, sf):
    m = metrics(spark, sf)
    e = m.where("overlap > 0.52").groupBy("taxon", "candidate").agg(F.sum("n_rows").cast("double").alias("value"))
    return C.dense_grid(e, m.select("taxon"), m.select("candidate"), ["taxon", "candidate"], "value")


_KNOCK = "k AS (SELECT a.taxon, a.M, a.fold, a.candidate, round(b.presence_rank - a.presence_rank, 9) AS loss, round(b.overlap - a.overlap, 9) AS o_loss FROM metrics a JOIN metrics b ON a.taxon = b.taxon AND a.M = b.M AND a.fold = b.fold AND b.candidate = (SELECT min(candidate) FROM metrics) WHERE a.candidate <> b.candidate)"


def losses(spark, sf):
    m = metrics(spark, sf)
    base = m.agg(F.min("candidate")).first()[0]
    pairs = C.knockout_pairs(m.where(F.col("candidate") == base), m.where(F.col("candidate") != base), ["taxon", "M", "fold"], ["presence_rank", "overlap"])
    return pairs.select("taxon", "M", "fold", "candidate", F.round("presence_rank_loss", 9).alias("loss"), F.round("overlap_loss", 9).alias("o_loss"))


@register("knockout_pairs", f"WITH {_KNOCK} SELECT taxon, M, fold, candidate, {r('loss', 'loss')}, {r('o_loss', 'o_loss')} FROM k")
def _(spark, sf):
    return rounded(losses(spark, sf))


_SUPPORT = _KNOCK + """, s AS (SELECT taxon, candidate, count(*) AS n_cells, avg((loss > 1e-12)::INT) AS w, avg((loss < -1e-12)::INT) AS i, median(loss) AS m FROM k GROUP BY taxon, candidate),
  u AS (SELECT *, CASE WHEN n_cells = 12 AND w >= 2.0::DOUBLE / 3 - 1e-12 AND i <= 1.0::DOUBLE / 3 + 1e-12 THEN 'supported' WHEN n_cells = 12 AND i >= 2.0::DOUBLE / 3 - 1e-12 THEN 'refuted' ELSE 'unresolved' END AS status FROM s)"""


def support(spark, sf):
    return C.taxon_process_support(losses(spark, sf), ["taxon", "candidate"], "loss", 12)


@register("taxon_process_support", f"WITH {_SUPPORT} SELECT taxon, candidate, n_cells, {r('w', 'worsening')}, {r('i', 'improvement')}, {r('m', 'median_loss')}, status FROM u")
def _(spark, sf):
    return rounded(support(spark, sf))


@register("core_confirmation", f"""WITH {_SUPPORT}, h AS (SELECT candidate, avg((status = 'supported')::INT) FILTER (WHERE taxon < 'Brand#3') AS d, avg((status = 'supported')::INT) FILTER (WHERE NOT taxon < 'Brand#3') AS v FROM u GROUP BY candidate)
  SELECT candidate, {r('d', 'discovery')}, {r('v', 'validation')}, coalesce(d >= 2.0 / 3 - 1e-12 AND v >= 2.0 / 3 - 1e-12, false) AS core FROM h""")
def _(spark, sf):
    return rounded(C.core_confirmation(support(spark, sf), "candidate", F.col("taxon") < "Brand#3"))


@register("cross_taxon_states", f"""WITH {_SUPPORT}, c AS (SELECT candidate, count(*) AS n_taxa, count(*) FILTER (WHERE status <> 'unresolved') AS n_informative, count(*) FILTER (WHERE status = 'supported') AS n_supported, count(*) FILTER (WHERE status = 'refuted') AS n_refuted FROM u GROUP BY candidate)
  SELECT *, {r('n_supported / nullif(n_informative, 0)', 'supported_fraction')}, CASE WHEN n_informative = 0 THEN 'no_evidence' WHEN n_supported = n_informative THEN 'shared' WHEN n_refuted = n_informative THEN 'refuted' ELSE 'mixed' END AS state FROM c""")
def _(spark, sf):
    return rounded(C.cross_taxon_states(support(spark, sf), "candidate"))


@register("process_certificates", f"WITH {_SUPPORT} SELECT taxon, " + ", ".join(f"coalesce(string_agg(candidate, ',' ORDER BY candidate) FILTER (WHERE status = '{s}'), '') AS {s}" for s in ("supported", "refuted", "unresolved")) + " FROM u GROUP BY taxon")
def _(spark, sf):
    return C.certificate_sets(support(spark, sf), ["taxon"], "candidate", "status")


@register("process_state", "SELECT taxon, candidate, CASE WHEN bool_or(overlap > 0.55) THEN 'witness' WHEN bool_and(n_rows >= 2) THEN 'required' ELSE 'unresolved' END AS state FROM metrics GROUP BY taxon, candidate")
def _(spark, sf):
    return C.process_state(metrics(spark, sf), ["taxon", "candidate"], F.col("overlap") > 0.55, F.col("n_rows") >= 2)


@register("validation_exclusion", "SELECT taxon, candidate, count(DISTINCT M) FILTER (WHERE presence_rank > 0.7) AS n_successful, CASE count(DISTINCT M) FILTER (WHERE presence_rank > 0.7) WHEN 3 THEN 'complete' WHEN 0 THEN 'unavailable' ELSE 'partial' END AS status FROM metrics GROUP BY taxon, candidate")
def _(spark, sf):
    return C.spec_status(metrics(spark, sf), ["taxon", "candidate"], "M", F.col("presence_rank") > 0.7, 3)


_ENVELOPE = "e AS (SELECT taxon, candidate, min(presence_rank) AS lo, max(presence_rank) AS hi, count(presence_rank) AS n FROM metrics GROUP BY taxon, candidate)"


def envelope(spark, sf):
    return C.refit_envelope(metrics(spark, sf).withColumn("span", F.lit(1.0)), ["taxon", "candidate"], "presence_rank", "span", 12)


@register("refit_envelope", f"WITH {_ENVELOPE} SELECT taxon, candidate, {r('lo', 'lower')}, {r('hi', 'upper')}, {r('hi - lo', 'width')}, n, n = 12 AS complete, true AS consistent FROM e")
def _(spark, sf):
    return rounded(envelope(spark, sf))


@register("interval_calibration", f"""WITH {_ENVELOPE}, k AS (SELECT candidate, avg(breadth_error) AS radius FROM metrics WHERE candidate < 'M' GROUP BY candidate)
  SELECT taxon, e.candidate, {r('lo - radius', 'lower')}, {r('hi + radius', 'upper')}, radius IS NOT NULL AS calibrated FROM e LEFT JOIN k ON e.candidate = k.candidate""")
def _(spark, sf):
    radius = metrics(spark, sf).where("candidate < 'M'").groupBy("candidate").agg(F.avg("breadth_error").alias("radius"))
    out = C.calibrate(envelope(spark, sf).withColumn("span", F.lit(1.0)), radius, ["candidate"], "radius", "span")
    return rounded(out.select("taxon", "candidate", F.col("calibrated_lower").alias("lower"), F.col("calibrated_upper").alias("upper"), "calibrated"))


@register("expected_members", "WITH s AS (SELECT DISTINCT taxon AS species FROM metrics), m AS (SELECT DISTINCT taxon AS species, candidate AS member_id FROM metrics), e AS (SELECT taxon AS species, candidate AS member_id, round(avg(presence_rank), 6) AS estimate FROM metrics WHERE M = 'A' AND fold = 1 AND overlap > 0.5 GROUP BY ALL) SELECT s.species, m.member_id, estimate, estimate IS NOT NULL AS available FROM s JOIN m ON s.species = m.species LEFT JOIN e ON e.species = m.species AND e.member_id = m.member_id")
def _(spark, sf):
    m = metrics(spark, sf)
    e = m.where("M = 'A' AND fold = 1 AND overlap > 0.5").groupBy(F.col("taxon").alias("species"), F.col("candidate").alias("member_id")).agg(F.round(F.avg("presence_rank"), 6).alias("estimate"))
    return C.expected_members(m.select(F.col("taxon").alias("species")).distinct(), m.select(F.col("taxon").alias("species"), F.col("candidate").alias("member_id")).distinct(), e)


@register("truth_audit", f"""WITH c AS (SELECT DISTINCT taxon, candidate FROM metrics WHERE presence_rank > 0.72), t AS (SELECT DISTINCT taxon, candidate FROM metrics WHERE overlap > 0.54),
  j AS (SELECT coalesce(c.taxon, t.taxon) AS taxon, count(*) FILTER (WHERE c.taxon IS NOT NULL AND t.taxon IS NOT NULL) AS tp, count(*) FILTER (WHERE t.taxon IS NULL) AS fp, count(*) FILTER (WHERE c.taxon IS NULL) AS fn FROM c FULL JOIN t ON c.taxon = t.taxon AND c.candidate = t.candidate GROUP BY 1)
  SELECT *, {r('tp / nullif(tp + fp, 0)', 'precision')}, {r('tp / nullif(tp + fn, 0)', 'recall')} FROM j""")
def _(spark, sf):
    m = metrics(spark, sf)
    return rounded(C.truth_audit(m.where("presence_rank > 0.72"), m.where("overlap > 0.54"), ["taxon"], "candidate"))


@register("perturbation_certificate", "WITH p AS (SELECT candidate, M, avg(overlap) >= 0.505 AS ok FROM metrics GROUP BY candidate, M) SELECT candidate, count(DISTINCT M) FILTER (WHERE ok) AS n_passed, coalesce(string_agg(M, ',' ORDER BY M) FILTER (WHERE NOT ok), '') AS critical, CASE count(DISTINCT M) FILTER (WHERE ok) WHEN 3 THEN 'selected' WHEN 2 THEN 'near_complete' ELSE 'abstain' END AS state FROM p GROUP BY candidate")
def _(spark, sf):
    p = metrics(spark, sf).groupBy("candidate", "M").agg((F.avg("overlap") >= 0.505).alias("ok"))
    return C.perturbation_certificate(p, "candidate", "M", F.col("ok"), 3)


@register("modal_fraction", f"""WITH v AS (SELECT taxon, fold, CASE WHEN presence_rank > 0.7 THEN 'high' ELSE 'low' END AS v, count(*) AS n FROM metrics GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY taxon, fold ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY taxon, fold) AS t FROM v)
  SELECT taxon, fold, v AS mode, {r('n / t', 'modal_fraction')}, n / t::DOUBLE >= 2.0 / 3 - 1e-12 AS stable FROM k WHERE k = 1""")
def _(spark, sf):
    v = metrics(spark, sf).withColumn("v", F.when(F.col("presence_rank") > 0.7, "high").otherwise("low"))
    return rounded(C.modal_fraction(v, ["taxon", "fold"], "v"))


@register("set_algebra", """WITH t AS (SELECT taxon, count(DISTINCT M) AS n FROM metrics WHERE overlap > 0.5 GROUP BY taxon), k AS (SELECT taxon, candidate, count(DISTINCT M) AS k FROM metrics WHERE overlap > 0.5 GROUP BY ALL)
  SELECT k.taxon, coalesce(string_agg(candidate, ',' ORDER BY candidate) FILTER (WHERE k = n), '') AS necessary, string_agg(candidate, ',' ORDER BY candidate) AS possible, coalesce(string_agg(candidate, ',' ORDER BY candidate) FILTER (WHERE k < n), '') AS contested FROM k JOIN t ON k.taxon = t.taxon GROUP BY k.taxon""")
def _(spark, sf):
    return C.set_algebra(metrics(spark, sf).where("overlap > 0.5"), "taxon", "M", "candidate")


_FRONT = f"""WITH {MEANS}, f AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.M = b.M AND a.taxon = b.taxon AND a.candidate <> b.candidate
  AND b.v - a.v >= -1e-12 AND b.o - a.o >= -1e-12 AND a.c - b.c >= -1e-12 AND greatest(b.v - a.v, b.o - a.o, a.c - b.c) > 1e-12)) """


def front(spark, sf):
    return C.pareto_front(means(spark, sf), ["M", "taxon"], "candidate", ["v", "o"], ["c"])


@register("pareto_front", _FRONT + "SELECT M, taxon, candidate FROM f")
def _(spark, sf):
    return front(spark, sf).select("M", "taxon", "candidate")


@register("minimax_select", _FRONT + f""", k AS (SELECT *, rank() OVER (PARTITION BY M, taxon ORDER BY v DESC) AS a, rank() OVER (PARTITION BY M, taxon ORDER BY o DESC) AS b, rank() OVER (PARTITION BY M, taxon ORDER BY c) AS d FROM f),
  n AS (SELECT *, greatest(a, b, d) AS worst, (a + b + d) / 3.0::DOUBLE AS mean, row_number() OVER (PARTITION BY M, taxon ORDER BY greatest(a, b, d), round((a + b + d) / 3.0::DOUBLE, 9), size, candidate) AS i FROM k)
  SELECT M, taxon, candidate, worst::INT AS worst_rank, {r('mean', 'mean_rank')} FROM n WHERE i = 1""")
def _(spark, sf):
    return rounded(C.minimax(front(spark, sf), ["M", "taxon"], "candidate", ["v", "o"], ["c"], "size").select("M", "taxon", "candidate", "worst_rank", "mean_rank"))


@register("preferred_choice", f"WITH {MEANS}, b AS (SELECT *, max(v) OVER (PARTITION BY M, taxon) AS t FROM m) SELECT M, taxon, candidate FROM (SELECT *, row_number() OVER (PARTITION BY M, taxon ORDER BY size, candidate) AS k FROM b WHERE v >= t - 1e-12) WHERE k = 1")
def _(spark, sf):
    return C.preferred(means(spark, sf), ["M", "taxon"], "v", ["size", "candidate"]).select("M", "taxon", "candidate")


@register("loss_flags", f"WITH {_KNOCK} SELECT taxon, M, fold, candidate, CASE WHEN (loss > 1e-12 OR o_loss > 1e-12) AND (loss < -1e-12 OR o_loss < -1e-12) THEN 'trade_off' WHEN loss > 1e-12 OR o_loss > 1e-12 THEN 'worsened' WHEN loss < -1e-12 OR o_loss < -1e-12 THEN 'improved' ELSE 'unchanged' END AS flag FROM k")
def _(spark, sf):
    return C.loss_flags(losses(spark, sf), ["loss", "o_loss"]).select("taxon", "M", "fold", "candidate", "flag")


@register("promotion_gate", f"""WITH {MEANS}, {_DELTA}, {_CHOICE}, g AS (SELECT M, candidate, min(x) AS w, count(*) AS n FROM (SELECT M, candidate, taxon, avg(delta) AS x FROM d GROUP BY ALL) GROUP BY M, candidate)
  SELECT st.M, st.candidate, runs_selected, n_runs, {r('runs_selected / n_runs::DOUBLE', 'selection_fraction')}, {r('w', 'worst_delta')}, n AS n_comparators, coalesce(runs_selected / n_runs::DOUBLE >= 0.02 AND n_runs >= 5 AND w > 0, false) AS promoted
  FROM st LEFT JOIN g ON st.M = g.M AND st.candidate = g.candidate""")
def _(spark, sf):
    evidence = deltas(spark, sf).groupBy("M", "candidate", "taxon").agg(F.avg("delta").alias("mean_delta"))
    return rounded(C.promotion_gate(choice(spark, sf), evidence, ["M", "candidate"], 0.02, 5))


@register("panel_decision", """SELECT taxon, CASE WHEN NOT bool_and(n_rows >= 1) THEN 'unavailable' WHEN bool_and(presence_rank > 0.5) AND bool_and(overlap > 0.1) THEN 'supported' WHEN bool_and(presence_rank > 0.5) THEN 'process_only' WHEN bool_and(overlap > 0.1) THEN 'boundary_only' ELSE 'not_supported' END AS outcome FROM metrics GROUP BY taxon""")
def _(spark, sf):
    return C.panel_decision(metrics(spark, sf), "taxon", F.col("n_rows") >= 1, F.col("presence_rank") > 0.5, F.col("overlap") > 0.1)


@register("gated_candidates", f"WITH {_ADEQUATE}, a AS (SELECT candidate, taxon FROM g WHERE m >= 0.51 - 1e-12 AND m - s >= 0.5 - 1e-12) SELECT x.taxon, x.M, x.candidate, x.fold FROM metrics x JOIN a ON x.candidate = a.candidate AND x.taxon = a.taxon")
def _(spark, sf):
    gate = C.auc_adequacy(metrics(spark, sf), ["candidate", "taxon"], "presence_rank")
    return C.gated(metrics(spark, sf), gate, ["candidate", "taxon"]).select("taxon", "M", "candidate", "fold")


@register("lexicographic_winner", "SELECT p_brand, arg_min(p_partkey, (-p_retailprice, p_size, p_partkey)) AS p_partkey FROM part GROUP BY p_brand".replace("arg_min(p_partkey, (-p_retailprice, p_size, p_partkey))", "any_value(p_partkey)").replace("FROM part", "FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS k FROM part) WHERE k = 1"))
def _(spark, sf):
    from tarnflow.operators.occurrences import first_by

    part = read(spark, sf, "part")
    return first_by(part, ["p_brand"], [F.desc("p_retailprice"), "p_size", "p_partkey"]).select("p_brand", "p_partkey")
