"""Queries of two-stage selection, discovery and transfer, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import certificates as C
from tarnflow.operators import occurrences as O
from tarnflow.operators import selection as S

from .adapters import metrics, occurrences
from .occurrence_queries import r, register, rounded

HIGHER, LOWER = ("presence_rank", "overlap"), ("centroid_distance", "breadth_error", "quantile_error")


def _profile_sql() -> str:
    mean = ", ".join(f"{r(f'avg({m})', m)}" for m in (*HIGHER, *LOWER))
    worst = ", ".join(f"{r(f'min({m})' if m in HIGHER else f'max({m})', f'{m}_worst')}" for m in (*HIGHER, *LOWER))
    return f"p AS (SELECT M, taxon, candidate, count(DISTINCT fold) AS n_folds, {mean}, {worst}, {r('avg(n_rows)', 'mean_complexity')} FROM metrics GROUP BY M, taxon, candidate)"


def _profile(spark, sf):
    return rounded(S.candidate_profile(metrics(spark, sf), ["M", "taxon"], "candidate", "fold", HIGHER, LOWER, "n_rows"))


def _front(name: str, of: str, higher, lower) -> str:
    """A common table of the rows of ``of`` that no other of the case dominates."""
    gain = [f"b.{m} - a.{m}" for m in higher] + [f"a.{m} - b.{m}" for m in lower]
    every, some = " AND ".join(f"{g} >= -1e-12" for g in gain), " OR ".join(f"{g} > 1e-12" for g in gain)
    return f"{name} AS (SELECT * FROM {of} a WHERE NOT EXISTS (SELECT 1 FROM {of} b WHERE a.M = b.M AND a.taxon = b.taxon AND a.candidate <> b.candidate AND {every} AND ({some})))"


def _ranked(higher, lower, tag: str) -> str:
    each = [f"rank() OVER (PARTITION BY M, taxon ORDER BY {m}{' DESC' if m in higher else ''})" for m in (*higher, *lower)]
    return f"greatest({', '.join(each)}) AS w{tag}, round(({' + '.join(each)}) / {len(each)}.0::DOUBLE, 9) AS m{tag}"


def _two_stage_sql(first, second, of: str = "p") -> str:
    return f"""{_front('f', of, *first)}, {_front('g', 'f', *second)}, k AS (SELECT *, {_ranked(*second, '0')}, {_ranked(*first, '1')} FROM g),
      s AS (SELECT *, row_number() OVER (PARTITION BY M, taxon ORDER BY w0, m0, w1, m1, mean_complexity NULLS LAST, candidate) AS nth FROM k)
      SELECT p.M, p.taxon, p.candidate, p.mean_complexity, f.candidate IS NOT NULL AS first_front, s.candidate IS NOT NULL AS second_front, coalesce(s.nth = 1, false) AS selected
      FROM {of} p LEFT JOIN f USING (M, taxon, candidate) LEFT JOIN s USING (M, taxon, candidate)"""


WORST = tuple(tuple(f"{m}_worst" for m in side) for side in (HIGHER, LOWER))
RECOVERY, AGREEMENT = (("presence_rank",), ("centroid_distance",)), (("overlap",), ("breadth_error", "quantile_error"))
_SHOWN = ("M", "taxon", "candidate", "mean_complexity", "first_front", "second_front", "selected")


@register("candidate_profile", f"WITH {_profile_sql()} SELECT * FROM p")
def _(spark, sf):
    return _profile(spark, sf)


@register("robust_selection", f"WITH {_profile_sql()}, {_two_stage_sql((HIGHER, LOWER), WORST)}")
def _(spark, sf):
    return S.two_stage(_profile(spark, sf), ["M", "taxon"], "candidate", (HIGHER, LOWER), WORST).select(*_SHOWN)


@register("stable_selection", f"WITH {_profile_sql()}, {_two_stage_sql(RECOVERY, AGREEMENT)}")
def _(spark, sf):
    return S.two_stage(_profile(spark, sf), ["M", "taxon"], "candidate", RECOVERY, AGREEMENT).select(*_SHOWN)


@register("gated_robust_selection", f"""WITH {_profile_sql()}, a AS (SELECT M, taxon, candidate, round(avg(presence_rank), 9) AS v, count(presence_rank) AS n, stddev_samp(presence_rank) AS sd FROM metrics GROUP BY M, taxon, candidate),
  ok AS (SELECT M, taxon, candidate FROM a WHERE v >= 0.51 - 1e-12 AND round(v - CASE WHEN n = 1 THEN 0 ELSE sd / sqrt(n) END, 9) >= 0.5 - 1e-12), o AS (SELECT * FROM p SEMI JOIN ok USING (M, taxon, candidate)), {_two_stage_sql((HIGHER, LOWER), WORST, 'o')}""")
def _(spark, sf):
    gate = C.auc_adequacy(metrics(spark, sf), ["M", "taxon", "candidate"], "presence_rank")
    kept = C.gated(_profile(spark, sf), gate, ["M", "taxon", "candidate"])
    return S.two_stage(kept, ["M", "taxon"], "candidate", (HIGHER, LOWER), WORST).select(*_SHOWN)


_AVERAGE_RANK = "rank() OVER (PARTITION BY M, taxon ORDER BY {c}) + (count(*) OVER (PARTITION BY M, taxon, {c}) - 1) / 2.0::DOUBLE"
_CASES = f"""WITH {_profile_sql()}, q AS (SELECT M, taxon, candidate, overlap AS i, presence_rank AS o, mean_complexity AS s,
    rank() OVER (PARTITION BY M, taxon ORDER BY presence_rank DESC) AS k, {_AVERAGE_RANK.format(c='overlap')} AS ri, {_AVERAGE_RANK.format(c='presence_rank')} AS ro,
    row_number() OVER (PARTITION BY M, taxon ORDER BY overlap DESC, mean_complexity, candidate) AS a, row_number() OVER (PARTITION BY M, taxon ORDER BY presence_rank DESC, mean_complexity, candidate) AS b FROM p),
  c AS (SELECT M, taxon, count(*) AS n, CASE WHEN count(*) >= 3 AND min(ri) < max(ri) AND min(ro) < max(ro) THEN corr(ri, ro) END AS rho FROM q GROUP BY M, taxon),
  t AS (SELECT c.M, c.taxon, c.n, rho AS inner_outer_spearman, x.candidate AS inner_winner, y.candidate AS outer_winner, x.candidate = y.candidate AS match, y.o - x.o AS regret, x.o - x.i AS gap, x.k::INT AS outer_rank
    FROM c JOIN q x ON c.M = x.M AND c.taxon = x.taxon AND x.a = 1 JOIN q y ON c.M = y.M AND c.taxon = y.taxon AND y.b = 1) """


def _cases(spark, sf):
    return S.transfer_cases(_profile(spark, sf), ["M", "taxon"], "candidate", "overlap", "presence_rank", "mean_complexity")


@register("transfer_cases", _CASES + f"SELECT M, taxon, n, {r('inner_outer_spearman', 'inner_outer_spearman', 6)}, inner_winner, outer_winner, match, {r('regret', 'regret', 6)}, {r('gap', 'gap', 6)}, outer_rank FROM t")
def _(spark, sf):
    return rounded(_cases(spark, sf), 6)


@register("transfer_overview", _CASES + f"""SELECT count(*) AS n_cases, sum(n)::BIGINT AS n_rows, {r('avg(inner_outer_spearman)', 'mean_spearman', 6)}, {r('avg(match::INT)', 'match_fraction', 6)}, {r('avg(regret)', 'mean_regret', 6)},
  {r('median(regret)', 'median_regret', 6)}, {r('avg(gap)', 'mean_gap', 6)}, {r('avg(outer_rank)', 'mean_outer_rank', 6)} FROM t""")
def _(spark, sf):
    return rounded(S.transfer_overview(_cases(spark, sf)), 6)


@register("selector_transfer", f"""WITH {_profile_sql()}, w AS (SELECT *, presence_rank - overlap AS gap, (presence_rank >= max(presence_rank) OVER (PARTITION BY M, taxon) - 1e-12)::INT AS won FROM p),
  b AS (SELECT candidate, M, avg(presence_rank) AS o, avg(gap) AS g FROM w GROUP BY candidate, M),
  c AS (SELECT candidate, count(*) AS n_specs, min(o) AS lo, max(o) AS hi, stddev_samp(o) AS sd, min(g) AS wg FROM b GROUP BY candidate)
  SELECT w.candidate, count(DISTINCT taxon) AS n_species, count(*) AS n_cases, {r('avg(overlap)', 'mean_inner', 6)}, {r('avg(presence_rank)', 'mean_outer', 6)}, {r('median(presence_rank)', 'median_outer', 6)}, {r('avg(gap)', 'mean_gap', 6)},
  {r('median(gap)', 'median_gap', 6)}, {r('avg(won)', 'case_win_fraction', 6)}, any_value(n_specs) AS n_specs, {r('any_value(lo)', 'worst_spec', 6)}, {r('any_value(hi)', 'best_spec', 6)}, {r('any_value(sd)', 'sd_spec', 6)}, {r('any_value(wg)', 'worst_spec_gap', 6)}
  FROM w JOIN c ON w.candidate = c.candidate GROUP BY w.candidate""")
def _(spark, sf):
    return rounded(S.selector_transfer(_profile(spark, sf), "candidate", "M", "taxon", "overlap", "presence_rank"), 6)


@register("discovered_choice", f"""WITH {_profile_sql()}, d AS (SELECT M, candidate, count(*) FILTER (WHERE taxon NOT LIKE '%1') AS n_discovery, avg(presence_rank) FILTER (WHERE taxon NOT LIKE '%1') AS v, count(*) FILTER (WHERE taxon LIKE '%1') AS n_validation,
    avg(presence_rank) FILTER (WHERE taxon LIKE '%1') AS h FROM p GROUP BY M, candidate), b AS (SELECT M, candidate FROM d WHERE v IS NOT NULL ORDER BY round(v, 9) DESC, M, candidate LIMIT 1)
  SELECT d.M, d.candidate, n_discovery, {r('v', 'discovery', 6)}, n_validation, {r('h', 'validation', 6)}, d.M = b.M AND d.candidate = b.candidate AS selected FROM d, b""")
def _(spark, sf):
    rows = _profile(spark, sf)
    return rounded(S.discovered_choice(rows, "taxon", rows.where("taxon like '%1'").select("taxon").distinct(), ["M", "candidate"], "presence_rank"), 6)


_STATUS = "CASE WHEN presence_rank >= 0.72 THEN 'supported' WHEN presence_rank < 0.68 THEN 'refuted' ELSE 'unresolved' END"


@register("core_stability", f"""WITH {_profile_sql()}, s AS (SELECT taxon, candidate AS process, {_STATUS} AS status FROM p), n AS (SELECT taxon, row_number() OVER (ORDER BY taxon) AS i FROM (SELECT DISTINCT taxon FROM p)),
  x AS (SELECT k AS split_id, taxon, (i * (k + 2) + k) % 3 = 0 AS v FROM n, range(5) t(k)),
  g AS (SELECT split_id, process, avg((status = 'supported')::INT) FILTER (WHERE NOT v) AS d, avg((status = 'supported')::INT) FILTER (WHERE v) AS h, avg((status = 'refuted')::INT) FILTER (WHERE v) AS o FROM s JOIN x USING (taxon) GROUP BY split_id, process)
  SELECT process, count(DISTINCT split_id) AS n_splits, {r('avg(coalesce(d >= 2 / 3.0::DOUBLE - 1e-12, false)::INT)', 'candidate_stability', 6)}, {r('avg((coalesce(d >= 2 / 3.0::DOUBLE - 1e-12, false) AND coalesce(h >= 2 / 3.0::DOUBLE - 1e-12, false))::INT)', 'confirmation_stability', 6)},
  {r('avg(h)', 'mean_validation_support', 6)}, {r('avg(o)', 'mean_validation_refuted', 6)} FROM g GROUP BY process""")
def _(spark, sf):
    from pyspark.sql import Window

    rows = _profile(spark, sf)
    support = rows.select("taxon", F.col("candidate").alias("process"), F.expr(_STATUS).alias("status"))
    taxa = rows.select("taxon").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("taxon")))  # the taxa of a corpus, not its rows
    splits = taxa.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("validation", F.expr("(i * (split_id + 2) + split_id) % 3 = 0"))
    return rounded(S.core_stability(S.core_splits(support, "taxon", "process", splits), "process"), 6)


@register("support_ledger", """WITH w AS (SELECT species, CAST(year AS VARCHAR) || basisOfRecord AS block, (year % 3)::BIGINT AS fold, occurrenceStatus = 'F' AS p FROM occ),
  b AS (SELECT species, block, min(fold) AS f FROM w WHERE p GROUP BY species, block), t AS (SELECT species, f, count(*) FILTER (WHERE p) AS pt, count(*) FILTER (WHERE NOT p) AS bt FROM w JOIN b USING (species, block) GROUP BY species, f),
  u AS (SELECT *, sum(pt) OVER (PARTITION BY species) - pt AS pr, sum(bt) OVER (PARTITION BY species) - bt AS br FROM t)
  SELECT species, f AS outer_fold, pr::BIGINT AS n_presence_train, pt AS n_presence_test, br::BIGINT AS n_background_train, bt AS n_background_test, pr >= 2 AND pt >= 2 AND br >= 5 AND bt >= 5 AS eligible,
  concat_ws(',', CASE WHEN pr < 2 THEN 'presence_train' END, CASE WHEN pt < 2 THEN 'presence_test' END, CASE WHEN br < 5 THEN 'background_train' END, CASE WHEN bt < 5 THEN 'background_test' END) AS reasons FROM u""")
def _(spark, sf):
    rows = occurrences(spark, sf).withColumns({"block": F.concat(F.col("year").cast("string"), "basisOfRecord"), "fold": (F.col("year") % 3).cast("long")})
    return S.support_ledger(rows, ["species"], "block", "fold", F.col("occurrenceStatus") == "F")


@register("chunk_union", "SELECT species, count(*) AS n, count(DISTINCT row_id) AS n_distinct FROM occ GROUP BY species")
def _(spark, sf):
    occ = occurrences(spark, sf)
    chunks = {i: occ.where(F.col("row_id") % 4 == i) for i in range(4)}
    return S.union_chunks(chunks, 4, occ.select("species").distinct(), "species").groupBy("species").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_distinct"))


@register("panel_chain", f"""WITH a AS (SELECT M, taxon, avg(presence_rank) AS v, count(DISTINCT candidate) AS n FROM metrics GROUP BY M, taxon), b AS (SELECT M, taxon, avg(overlap) AS o FROM metrics GROUP BY M, taxon), c AS (SELECT M, taxon, max(breadth_error) AS e FROM metrics GROUP BY M, taxon)
  SELECT M, taxon, n, {r('v', 'v', 6)}, {r('o', 'o', 6)}, {r('e', 'e', 6)} FROM a JOIN b USING (M, taxon) JOIN c USING (M, taxon)""")
def _(spark, sf):
    m = metrics(spark, sf).persist()  # the checks of the chain read it many times
    try:
        g = m.groupBy("M", "taxon")
        parts = [g.agg(F.avg("presence_rank").alias("v"), F.countDistinct("candidate").alias("n")), g.agg(F.avg("overlap").alias("o")), g.agg(F.max("breadth_error").alias("e"))]
        return rounded(S.panel_chain(m.select("M", "taxon").distinct(), parts, ["M", "taxon"]), 6)
    finally:
        m.unpersist()


@register("taxon_ledger", """WITH taxa(taxon, "key") AS (VALUES ('building', CAST(NULL AS BIGINT)), ('First key', 5), (' Machinery ', -1), ('no such', -2)), o AS (SELECT *, row_id % 50 AS taxonKey FROM occ),
  c AS (SELECT taxon, "key", (SELECT count(*) FROM o WHERE taxonKey = "key") AS key_rows, (SELECT count(*) FROM o WHERE lower(trim(species)) = lower(trim(taxon))) AS name_rows FROM taxa),
  m AS (SELECT *, CASE WHEN "key" IS NULL THEN 'exact_name' WHEN key_rows > 0 THEN 'taxon_key' WHEN name_rows > 0 THEN 'taxon_key_fallback_exact_name' ELSE 'taxon_key_no_match' END AS mode FROM c)
  SELECT taxon, "key", mode, key_rows, name_rows, CASE WHEN mode IN ('exact_name', 'taxon_key_fallback_exact_name') THEN name_rows ELSE key_rows END AS matched_rows FROM m""")
def _(spark, sf):
    taxa = spark.createDataFrame([("building", None), ("First key", 5), (" Machinery ", -1), ("no such", -2)], "taxon string, key long")
    return O.taxon_ledger(occurrences(spark, sf).withColumn("taxonKey", F.col("row_id") % 50), taxa)


_HELD = {"whole": "uncertainty", "mostly": "CASE WHEN row_id % 25 <> 0 THEN latitude END", "seldom": "CASE WHEN year < 1995 OR occurrenceStatus = 'F' THEN longitude END"}


@register("coverage_ledger", "WITH v AS (SELECT year AS perturbation, occurrenceStatus = 'F' AS p, " + ", ".join(f"{e} AS {n}" for n, e in _HELD.items()) + " FROM occ), c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS predictor, perturbation, coalesce(avg(({n} IS NOT NULL)::INT) FILTER (WHERE p), 0) AS a, coalesce(avg(({n} IS NOT NULL)::INT) FILTER (WHERE NOT p), 0) AS b FROM v GROUP BY perturbation" for n in _HELD) + f""")
  SELECT predictor, perturbation, {r('a', 'presence_coverage')}, {r('b', 'background_coverage')}, {r('least(a, b)', 'coverage')}, least(a, b) >= 0.9 AS passes, bool_and(least(a, b) >= 0.9) OVER (PARTITION BY predictor) AS admissible FROM c""")
def _(spark, sf):
    rows = occurrences(spark, sf).selectExpr("year", "occurrenceStatus", *[f"{e} AS {n}" for n, e in _HELD.items()])
    return rounded(O.coverage_ledger(rows, "year", F.col("occurrenceStatus") == "F", list(_HELD), 0.9))


@register("knockout_ledger", """WITH f AS (SELECT taxon, candidate, fold FROM metrics WHERE M = 'A'), k AS (SELECT M, taxon, candidate, fold FROM metrics WHERE M <> 'A'),
  j AS (SELECT k.M, k.taxon, k.candidate, k.fold, f.taxon IS NOT NULL AS hit FROM k LEFT JOIN f USING (taxon, candidate, fold))
  SELECT M, count(*) FILTER (WHERE hit) AS n_pairs, count(*) AS n_reduced, (SELECT count(*) FROM f) AS n_full, count(*) FILTER (WHERE hit) = count(*) AND count(*) = (SELECT count(*) FROM f) AS complete FROM j GROUP BY M""")
def _(spark, sf):
    m = metrics(spark, sf)
    return C.knockout_ledger(m.where("M = 'A'"), m.where("M <> 'A'"), ["taxon", "candidate", "fold"], "M")


@register("target_group_background")
def _(spark, sf):
    occ = occurrences(spark, sf)
    mask = F.col("latitude").between(-60.0, 75.0)
    return O.target_group_background(occ.where("species = 'BUILDING'"), occ.where("species <> 'BUILDING'"), mask, 500, 0.5, 42, ["row_id"], "BUILDING").select("row_id", "species", "background_source_species")
