"""Queries of the process registry, readiness, buffered bounds, roles by key, balanced evidence and frozen ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import occurrences as O
from tarnflow.operators import partitions as P
from tarnflow.operators import readiness as A

from .adapters import environment, metrics, occurrences, read
from .occurrence_queries import r, register, rounded

_MANIFEST = """SELECT n_name AS predictor, r_name AS process, CASE WHEN n_nationkey % 3 = 0 THEN r_name END AS equivalence_group,
  CASE WHEN n_nationkey % 5 = 0 THEN 'observation' END AS role, CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE n_name END AS rationale, r_name AS mechanism
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""


@register("process_registry", f"""SELECT predictor, process, coalesce(equivalence_group, predictor) AS equivalence_group, coalesce(role, 'ecological') AS role,
  'unspecified' AS source_family, 'unspecified' AS units, CASE WHEN trim(rationale) = '' THEN mechanism ELSE rationale END AS rationale
  FROM ({_MANIFEST.format(nation='nation', region='region')})""")  # fmt: skip
def _(spark, sf):
    return A.process_registry(spark.sql(_MANIFEST, nation=read(spark, sf, "nation"), region=read(spark, sf, "region")))


_EVIDENCE = """m AS (SELECT M AS candidate, taxon AS species, candidate LIKE 'E%' AS perturbation, fold,
  CASE WHEN M = 'R' AND taxon = 'Brand#11' AND fold = 0 THEN NULL ELSE presence_rank END AS presence_rank,
  CASE WHEN M = 'N' AND taxon = 'Brand#21' THEN NULL ELSE overlap END AS overlap FROM metrics WHERE candidate LIKE '%S%')"""
_READY = f"""{_EVIDENCE}, cells AS (SELECT DISTINCT species, perturbation FROM m),
  f AS (SELECT candidate, species, perturbation, fold, count(presence_rank) > 0 AS p, count(overlap) > 0 AS o FROM m GROUP BY ALL),
  c AS (SELECT candidate, count(*) AS n, bool_and(k = 4 AND p) AS p, bool_and(k = 4 AND p AND o) AS e
        FROM (SELECT candidate, species, perturbation, count(*) AS k, bool_and(p) AS p, bool_and(o) AS o FROM f GROUP BY ALL) GROUP BY candidate),
  ready AS (SELECT candidate, n = t AND p AS complete_prediction_evidence, n = t AND e AS complete_ecological_evidence, t AS expected_cells, 4 AS expected_folds
            FROM c, (SELECT count(*) AS t FROM cells))"""


def _evidence(spark, sf):
    fold, taxon, m = F.col("fold"), F.col("taxon"), F.col("M")
    return metrics(spark, sf).where("candidate like '%S%'").select(
        m.alias("candidate"), taxon.alias("species"), F.col("candidate").like("E%").alias("perturbation"), "fold",
        F.when(~((m == "R") & (taxon == "Brand#11") & (fold == 0)), F.col("presence_rank")).alias("presence_rank"),
        F.when(~((m == "N") & (taxon == "Brand#21")), F.col("overlap")).alias("overlap"),
    )


@register("candidate_readiness", f"WITH {_READY} SELECT * FROM ready")
def _(spark, sf):
    rows = _evidence(spark, sf)
    return A.candidate_readiness(rows, rows, 4, ["overlap"])


@register("readiness_decision", f"""WITH {_READY}, n AS (SELECT (SELECT count(*) FROM cells) AS n_cells, count(*) AS n_candidates,
  count_if(complete_prediction_evidence) AS n_prediction, count_if(complete_ecological_evidence) AS n_ecological FROM ready)
  SELECT CASE WHEN n_cells = 0 THEN 'abstain_no_predeclared_discovery_cells' WHEN n_candidates = 0 THEN 'abstain_no_candidate_fold_metrics'
    WHEN n_prediction = 0 THEN 'abstain_no_complete_prediction_candidate' WHEN n_ecological = 0 THEN 'abstain_no_complete_ecological_candidate'
    ELSE 'ready_for_known_truth' END AS status, n_cells, n_candidates, n_prediction::BIGINT AS n_prediction, n_ecological::BIGINT AS n_ecological, 0 AS n_sealed_artifacts FROM n""")  # fmt: skip
def _(spark, sf):
    rows = _evidence(spark, sf)
    return A.readiness_decision(A.candidate_readiness(rows, rows, 4, ["overlap"]), rows)


def _grown(by: str) -> str:
    whole, under, over = f"e - w + 2 * {by} >= 360", f"w - {by} < -180", f"e + {by} > 180"
    west = f"CASE WHEN {whole} THEN -180 WHEN {under} THEN w - {by} + 360 ELSE w - {by} END"
    east = f"CASE WHEN {whole} THEN 180 WHEN NOT {under} AND {over} THEN e + {by} - 360 ELSE e + {by} END"
    return f"{r(west, 'west')}, {r(east, 'east')}"


@register("buffered_boxes", f"""WITH g AS (SELECT species, min(longitude) AS w, max(longitude) AS e, min(latitude) AS s, max(latitude) AS n, 250::DOUBLE / 111.195::DOUBLE AS d
    FROM occ WHERE abs(longitude) < 150 AND abs(latitude) < 60 GROUP BY species),
  h AS (SELECT *, least(180, d / cos(radians(least(89.999::DOUBLE, greatest(abs(s - d), abs(n + d)))))) AS b FROM g)
  SELECT species, {_grown('b')}, {r('greatest(-90, s - d)', 'south')}, {r('least(90, n + d)', 'north')} FROM h""")  # fmt: skip
def _(spark, sf):
    return rounded(O.buffered_boxes(occurrences(spark, sf).where("abs(longitude) < 150 and abs(latitude) < 60"), 250.0))


@register("tile_boxes", f"""WITH g AS (SELECT CAST(floor((longitude + 180) / 20::DOUBLE) AS BIGINT) AS tx, CAST(floor((latitude + 90) / 20::DOUBLE) AS BIGINT) AS ty,
    min(longitude) AS w, max(longitude) AS e, min(latitude) AS s, max(latitude) AS n FROM occ GROUP BY 1, 2)
  SELECT tx, ty, {_grown('2.5::DOUBLE')}, {r('greatest(-90, s - 2.5::DOUBLE)', 'south')}, {r('least(90, n + 2.5::DOUBLE)', 'north')} FROM g""")  # fmt: skip
def _(spark, sf):
    return rounded(O.tile_boxes(occurrences(spark, sf), 20.0, 2.5))


_BLOCK = "CAST(floor((longitude + 180) / 30::DOUBLE) AS INT)"


def _blocks(spark, sf):
    return occurrences(spark, sf).withColumn("block", F.floor((F.col("longitude") + 180) / 30).cast("int"))


@register("roles_by_key", f"""WITH o AS (SELECT *, {_BLOCK} AS block FROM occ),
  b AS (SELECT species, block, row_number() OVER (PARTITION BY species ORDER BY md5('11|' || species || '|' || block), block) AS nth,
      count(*) OVER (PARTITION BY species) AS n, sum(k) OVER (PARTITION BY species) AS rows FROM (SELECT species, block, count(*) AS k FROM o GROUP BY ALL))
  SELECT row_id, o.species, o.block, CASE WHEN nth <= least(greatest(1, round_even(n * 0.3::DOUBLE, 0)), n - 1) THEN 'sealed' ELSE 'model' END AS role
  FROM o JOIN b USING (species, block) WHERE n > 1 AND rows >= 4""")  # fmt: skip
def _(spark, sf):
    return P.seal_by_key(_blocks(spark, sf), "species", 0.3, 11).select("row_id", "species", "block", "role")


@register("blocks_by_key")
def _(spark, sf):
    return P.blocks_by_key(occurrences(spark, sf), "species", 8, 7).select("row_id", "species", "block")


@register("evidence_folds")
def _(spark, sf):
    return P.evidence_folds(_blocks(spark, sf), 4, F.col("occurrenceStatus") == "F", "species")[0].select("row_id", "block", "fold")


@register("evidence_fold_ledger")
def _(spark, sf):
    return P.evidence_folds(_blocks(spark, sf), 4, F.col("occurrenceStatus") == "F", "species")[1]


@register("frozen_ablation")
def _(spark, sf):
    from tarnflow.operators.models import ModelSpec
    from tarnflow.operators.procedures import frozen_ablation

    rows = environment(spark, sf).withColumns({"outer": (F.col("vec_id") % 4).cast("int"), "all": F.lit("all"), "y": F.col("e0") + F.col("e1") * F.col("e1") > 0.02})
    features = [f"e{i}" for i in range(8)]
    process = {p: "heat" if i < 3 else "water" if i < 6 else p for i, p in enumerate(features)}
    return frozen_ablation(rows, "all", F.col("y"), {("all", f): features for f in range(4)}, process, features, "outer", ModelSpec())
