"""Queries of models, partitions and samples; most are beyond SQL and tested by their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import models as L
from tarnflow.operators import partitions as P

from .adapters import environment, metrics, occurrences
from .occurrence_queries import r, register, rounded



def _cells(spark, sf):
    return environment(spark, sf).withColumns({"fold": (F.col("vec_id") % 3).cast("int"), "all": F.lit("all"), "y": F.col("e0") + F.col("e1") * F.col("e1") > 0.02})


@register("logistic_scores")
def _(spark, sf):
    rows = _cells(spark, sf)
    fit = L.fit_tasks(rows, "all", F.col("y"), [L.Task("all", None, ("e0", "e1", "e2"))], L.ModelSpec(degree=2))[0]
    return rows.select("vec_id", fit.score().alias("score"))


@register("forward_selection")
def _(spark, sf):
    got = L.forward_selection(_cells(spark, sf), "all", F.col("y"), ["all"], [f"e{i}" for i in range(8)], [0, 1, 2], L.ModelSpec())
    return spark.createDataFrame(got, "taxon string, step int, predictor string, score double, gain double")


@register("drop_one_importance")
def _(spark, sf):
    got = L.drop_one(_cells(spark, sf), "all", F.col("y"), "all", ["e0", "e1", "e2"], [0, 1, 2], L.ModelSpec())
    return spark.createDataFrame(got, "predictor string, loss double")


@register("marginal_scores")
def _(spark, sf):
    rows = _cells(spark, sf)
    fit = L.fit_tasks(rows, "all", F.col("y"), [L.Task("all", None, ("e0", "e1", "e2"))], L.ModelSpec())[0]
    return L.marginal_score(rows, fit, ["e2"], rows).select("vec_id", "score")


@register("spatial_blocks")
def _(spark, sf):
    return P.spatial_blocks(occurrences(spark, sf), 8, 7).select("row_id", "block")


@register("outer_roles")
def _(spark, sf):
    return P.seal_blocks(P.spatial_blocks(occurrences(spark, sf), 8, 7), 0.3, 11).select("row_id", "block", "role")


@register("block_folds")
def _(spark, sf):
    return P.block_folds(P.spatial_blocks(occurrences(spark, sf), 8, 7), 3, F.col("occurrenceStatus") == "F").select("row_id", "block", "fold")


@register("balanced_folds")
def _(spark, sf):
    return P.balanced_folds(P.spatial_blocks(occurrences(spark, sf), 12, 7), 3, F.col("occurrenceStatus") == "F", 50)[0].select("row_id", "block", "fold")


@register("background_sample")
def _(spark, sf):
    return P.sample_rows(occurrences(spark, sf), 200, ["species"], ["row_id"], 42).select("row_id", "species")


@register("taxon_split")
def _(spark, sf):
    taxa = [t[0] for t in metrics(spark, sf).select("taxon").distinct().collect()]
    found, held = P.split_taxa(taxa, 0.3, 3)
    return spark.createDataFrame([(t, "discovery") for t in found] + [(t, "validation") for t in held], "taxon string, part string")


@register("nearest_planar", f"SELECT a.vec_id, {r('min(sqrt(pow(a.e0 - b.e0, 2) + pow(a.e1 - b.e1, 2)))', 'distance')} FROM env a JOIN env b ON a.species = b.species WHERE NOT a.e2 > 0 AND b.e2 > 0 GROUP BY a.vec_id")
def _(spark, sf):
    from tarnflow.operators.occurrences import nearest_planar

    env = environment(spark, sf)
    return rounded(nearest_planar(env.where("not e2 > 0"), env.where("e2 > 0"), ["species"], "e0", "e1", "vec_id"))


@register("method_benchmark")
def _(spark, sf):
    from tarnflow.operators.procedures import method_benchmark

    rows = _cells(spark, sf).withColumn("role", F.when(F.col("vec_id") % 5 == 0, "sealed").otherwise("model"))
    return method_benchmark(rows, "all", F.col("y"), ["all"], [f"e{i}" for i in range(8)], [0, 1, 2], L.ModelSpec())


@register("nested_benchmark")
def _(spark, sf):
    from tarnflow.operators.procedures import nested_benchmark

    rows = _cells(spark, sf).withColumn("outer", (F.col("vec_id") % 4).cast("int"))
    features = [f"e{i}" for i in range(8)]
    return nested_benchmark(rows, "all", F.col("y"), ["all"], features, features, "outer", [0, 1, 2], L.ModelSpec())


@register("signal_gate")
def _(spark, sf):
    return L.signal_gate(_cells(spark, sf), "all", F.col("y"), ["all"], ["e6", "e7"], [0, 1, 2])
