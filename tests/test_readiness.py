"""Registry, readiness, buffered bounds, roles by key, balanced evidence and frozen ablation against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import models as L
from tarnflow.operators import occurrences as O
from tarnflow.operators import partitions as P
from tarnflow.operators import procedures as B
from tarnflow.operators import readiness as A
from tarnflow.sources import tables as T


def test_registry(spark):
    rows = spark.createDataFrame([("a", "heat", None, None, " ", "why"), ("b", "heat", "g", "observation", "so", None)], "predictor string, process string, equivalence_group string, role string, rationale string, mechanism string")
    got = {r.predictor: r for r in A.process_registry(rows).collect()}
    assert (got["a"].equivalence_group, got["a"].role, got["a"].rationale, got["a"].units) == ("a", "ecological", "why", "unspecified")
    assert (got["b"].equivalence_group, got["b"].role, got["b"].rationale) == ("g", "observation", "so")
    assert [tuple(r) for r in A.aliases(A.process_registry(rows)).collect()] == [("a", "heat")]
    for bad in ([("a", "x"), ("a", "y")], [("", "x")], [("a", " ")], [("a", None)], []):
        with pytest.raises(ValueError):
            A.process_registry(spark.createDataFrame(bad, "predictor string, process string"))
    with pytest.raises(ValueError, match="z"):
        A.assert_registered(spark.createDataFrame([("a",), ("z",)], "predictor string"), A.process_registry(rows))
    assert A.sealed_columns(["sealed_auc", "n_sealed_rows", "auc"]) == ["n_sealed_rows", "sealed_auc"]


def test_readiness(spark):
    full = [("good", s, "p", f, 0.7, 0.5) for s in "xy" for f in (0, 1)]
    rows = [
        *full,
        *[("pred", s, "p", f, 0.7, None if s == "y" and f else 0.5) for s in "xy" for f in (0, 1)],
        *[("nan", s, "p", f, float("nan") if f else 0.7, 0.5) for s in "xy" for f in (0, 1)],
        *[("short", "x", "p", f, 0.7, 0.5) for f in (0, 1)],
        *[("more", s, "p", f, 0.7, 0.5) for s in "xyz" for f in (0, 1)],
        *[("beyond", s, "p", f, 0.7, 0.5) for s in "xy" for f in (0, 1, 2)],
        *[("lost", s, "p", f, 0.7, 0.5) for s in "xy" for f in (0, 1, None)],
        *[("twice", s, "p", f, v, 0.5) for s in "xy" for f in (0, 1) for v in (None, 0.6)],
    ]
    df = spark.createDataFrame(rows, "candidate string, species string, perturbation string, fold int, presence_rank double, overlap double")
    cells = spark.createDataFrame([("x", "p"), ("y", "p"), ("y", "p")], "species string, perturbation string")
    ready = A.candidate_readiness(df, cells, 2, ["overlap"])
    got = {r.candidate: (r.complete_prediction_evidence, r.complete_ecological_evidence) for r in ready.collect()}
    complete = {"good": (True, True), "twice": (True, True), "pred": (True, False)}
    assert got == {c: complete.get(c, (False, False)) for c in {r[0] for r in rows}}
    say = lambda only, c=cells, sealed=(): A.readiness_decision(ready.where(F.col("candidate").isin(only)), c, sealed).first().status
    assert say(["good", "nan"]) == "ready_for_known_truth" and say(["good"], sealed=["sealed_validation.csv"]) == "invalid_sealed_artifact_present"
    assert say(["pred"]) == "abstain_no_complete_ecological_candidate" and say(["nan"]) == "abstain_no_complete_prediction_candidate"
    assert say([]) == "abstain_no_candidate_fold_metrics" and say(["good"], cells.limit(0)) == "abstain_no_predeclared_discovery_cells"
    assert A.candidate_readiness(df.limit(0), cells, 2, ["overlap"]).count() == 0


def test_bounds(spark):
    df = spark.createDataFrame([("a", -179.0, 0.0), ("a", -170.0, 10.0), ("b", 178.0, -5.0), ("c", -170.0, 89.9), ("c", 100.0, 89.9)], "species string, longitude double, latitude double")
    got = {r.species: r for r in O.buffered_boxes(df, 222.39).collect()}
    assert got["a"].west == pytest.approx(-179 - 2 / 0.9781476 + 360) and got["a"].east == pytest.approx(-170 + 2 / 0.9781476) and got["a"].north == pytest.approx(12)
    assert got["b"].west < 178 and -180 < got["b"].east < -179
    assert (got["c"].west, got["c"].east, got["c"].north) == (-180, 180, 90)
    tile = [r for r in O.tile_boxes(df, 10.0, 2.0).collect() if r.tx == 35][0]
    assert (tile.west, tile.east, tile.south, tile.north) == (176, 180, -7, -3)
    with pytest.raises(ValueError):
        O.buffered_boxes(df, 0.0)


def test_roles_by_key(spark):
    rng = random.Random(4)
    rows = [(i, "many", rng.choice([0, 40, 80, 120]) + rng.random(), rng.random()) for i in range(200)]
    rows += [(900 + i, "few", 10.0 * i, 0.0) for i in range(3)] + [(950 + i, "one", 1.0, 1.0) for i in range(9)] + [(990, "many", None, 1.0), (991, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id int, species string, longitude double, latitude double")
    blocks = P.blocks_by_key(df, "species", 4, 1)
    got = blocks.collect()
    assert len(got) == 212 and blocks.columns == [*df.columns, "block"]
    many = {}
    for r in got:
        if r.species == "many":
            many.setdefault(r.block, set()).add(int(r.longitude) // 40)
    assert 2 <= len(many) <= 4
    assert {r.block for r in got if r.species == "one"} == {1} and len({r.block for r in got if r.species == "few"}) == 3
    blocks = spark.createDataFrame(got, blocks.schema)
    roles = P.seal_by_key(blocks, "species", 0.5, 3)
    by = {}
    for r in roles.collect():
        by.setdefault(r.block, set()).add(r.role)
        assert r.species == "many"
    assert all(len(x) == 1 for x in by.values()) and {x for y in by.values() for x in y} == {"model", "sealed"}
    assert {tuple(r) for r in roles.collect()} == {tuple(r) for r in P.seal_by_key(blocks.repartition(3), "species", 0.5, 3).collect()}
    assert P.seal_background(df.where("species = 'many'"), 4, 0.5, 1).select("role").distinct().count() == 2
    with pytest.raises(ValueError):
        P.seal_background(df.where("species = 'few'"), 4, 0.5, 1)


def test_evidence_folds(spark):
    rng = random.Random(2)
    rows = [(i, b := rng.randrange(12), k == "", k or None) for i in range(3000) for k in [rng.choice(["", "m1", "m2", "m2"])] for _ in [0]]
    df = spark.createDataFrame(rows, "row_id int, block int, p boolean, kind string")
    out, ledger, attempts = P.evidence_folds(df, 4, F.col("p"), "kind", 20, 50, 100)
    want = {}
    for r in out.collect():
        k = r.kind or "presence"
        want[r.fold, k] = want.get((r.fold, k), 0) + 1
    assert {(r.fold, r.kind): r.n_evaluation for r in ledger.collect()} == want
    total = {k: sum(n for (_, kk), n in want.items() if kk == k) for k in ("presence", "m1", "m2")}
    assert all(r.n_evaluation + r.n_training == total[r.kind] for r in ledger.collect())
    tried = attempts.collect()
    apart = [abs(n * 4 / total[k] - 1) for (_, k), n in want.items()]
    assert len(tried) == 32 and max(apart) == pytest.approx(min(t.worst_imbalance for t in tried if t.supported))
    assert out.groupBy("block").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0
    for wrong in ({"least_presence": 10**6}, {"least_training": 10**6}, {"attempts": 0}):
        with pytest.raises(ValueError):
            P.evidence_folds(df, 4, F.col("p"), "kind", **wrong)
    with pytest.raises(ValueError):
        P.evidence_folds(df.where("block > 0 or not p"), 4, F.col("p"), "kind")
    with pytest.raises(ValueError):
        P.evidence_folds(df.where("p"), 4, F.col("p"), "kind")


def test_frozen_ablation(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, "k", i % 3, a, b, c, a + 0.5 * b + rng.gauss(0, 0.5) > 0))
    df = spark.createDataFrame(rows, "row_id int, key string, outer int, a double, b double, c double, y boolean")
    spec, base = L.ModelSpec(), {("k", 0): ["a", "b"], ("k", 1): ["a", "b", "c"], ("k", 2): ["a"]}
    got = {(r.outer_fold, r.process): r for r in B.frozen_ablation(df, "key", F.col("y"), base, {"a": "heat", "b": "heat"}, ["a", "b"], "outer", spec, ["c"]).collect()}
    assert set(got) == {(f, "heat") for f in range(3)}
    assert got[0, "heat"].null_representation and got[0, "heat"].presence_rank == 0.5 and got[0, "heat"].n_predictors == 0
    assert not got[1, "heat"].null_representation and got[1, "heat"].null_ecological_representation and got[1, "heat"].predictors == "c"
    got = {(r.outer_fold, r.process): r for r in B.frozen_ablation(df, "key", F.col("y"), base, {"a": "heat"}, ["a", "b"], "outer", spec).collect()}
    assert set(got) == {(f, p) for f in range(3) for p in ("heat", "b", "c")}
    want = {(names, f): v for _, names, f, v in L.fold_ranks(df, "key", F.col("y"), [("k", ("a",)), ("k", ("a", "b")), ("k", ("b", "c"))], [0, 1, 2], spec, "outer")}
    for f, p, rest in ((0, "b", ("a",)), (0, "c", ("a", "b")), (1, "heat", ("b", "c")), (2, "b", ("a",))):
        assert got[f, p].presence_rank == pytest.approx(want[rest, f]) and got[f, p].predictors == ",".join(rest)
    assert got[0, "c"].excluded == "" and got[2, "heat"].null_representation
    for wrong in ({("k", 0): ["a"]}, {**base, ("k", 2): []}):
        with pytest.raises(ValueError):
            B.frozen_ablation(df, "key", F.col("y"), wrong, {}, ["a"], "outer", spec)


def test_alias_names(spark):
    got = T.normalise_columns(spark.createDataFrame([(1, 2, 3, 4.0)], "datasetKEY int, acceptedtaxonkey int, institutionCode int, decimalLatitude double"))
    assert got.columns == ["datasetKey", "acceptedTaxonKey", "institutionCode", "latitude"]
