import datetime
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import values as V
from tarnflow.operators import certificates as C
from tarnflow.operators import metrics as M
from tarnflow.operators import models as L
from tarnflow.operators import occurrences as O
from tarnflow.operators import partitions as P
from tarnflow.operators import rollups as R
from tarnflow.sources import rasters, tables


def test_presence_rank_literals(spark):
    rows = [("a", True, 0.8), ("a", True, 0.9), ("a", False, 0.1), ("a", False, 0.2), ("a", False, 0.3), ("b", True, 0.5), ("b", False, 0.5), ("c", False, 0.5), ("d", True, None), ("d", False, float("nan"))]
    df = spark.createDataFrame(rows, "grp string, is_presence boolean, score double")
    assert {r.grp: r.presence_rank for r in M.presence_rank(df.repartition(7), "grp").collect()} == {"a": 1.0, "b": 0.5, "c": None}


def test_presence_rank_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, rng.random() < 0.4, float(rng.randint(0, 12))) for g in range(3) for _ in range(200)]
    got = {r.grp: r.presence_rank for r in M.presence_rank(spark.createDataFrame(rows, "grp int, is_presence boolean, score double"), "grp").collect()}
    for g in range(3):
        p, b = ([s for k, y, s in rows if k == g and y == side] for side in (True, False))
        assert got[g] == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in p for y in b) / (len(p) * len(b)), abs=1e-12)


def test_or10_and_criteria(spark):
    rows = [(1, False, i / 10) for i in range(1, 11)] + [(1, True, s) for s in (0.05, 0.25, 0.8, 0.9)]
    assert M.or10(spark.createDataFrame(rows, "grp int, is_presence boolean, score double"), "grp").first().or10 == 0.25
    got = spark.createDataFrame([(-10.0, 2.0, 30.0), (-10.0, 10.0, 11.0), (None, 1.0, 9.0)], "ll double, k double, n double").select(V.aicc(F.col("ll"), F.col("k"), F.col("n")).alias("a")).collect()
    assert got[0].a == pytest.approx(24 + 12 / 27) and got[1].a == math.inf and got[2].a is None


def test_continuous_boyce_signs(spark):
    fit = [(False, i / 2000) for i in range(2001)]
    high = [(1, *r) for r in fit] + [(1, True, 0.65 + 0.35 * i / 300) for i in range(301)]
    low = [(2, *r) for r in fit] + [(2, True, 0.35 * i / 300) for i in range(301)]
    flat = [(3, False, 0.5)] * 9 + [(3, True, 0.5)] * 4
    got = {r.grp: r.spearman for r in M.continuous_boyce(spark.createDataFrame(high + low + flat, "grp int, is_presence boolean, score double"), "grp").collect()}
    assert got[1] > 0.8 and got[2] < -0.7 and 3 not in got


def test_weighted_quantiles_and_directions(spark):
    df = spark.createDataFrame([("g", v, w, i) for i, (v, w) in enumerate([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 1.0), (None, 1.0), (9.0, 0.0)])], "k string, v double, w double, i int")
    got = {r.q: r.value for r in M.weighted_quantiles(df, "k", "v", "w", [0.0, 0.125, 0.5, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.125: 1.0, 0.5: 2.5, 1.0: 4.0}
    steps = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 1.0, 1.0, 4.0])] + [("h", 0, 1.0)], "k string, i int, v double")
    assert {r.k: r.changes for r in M.direction_changes(steps, "k", "i", "v").collect()} == {"g": 2, "h": 0}


def test_distance_join_brute_force(spark):
    rng = random.Random(3)
    point = lambda: (rng.uniform(-180, 180), rng.uniform(-90, 90))
    focal = [point() for _ in range(60)] + [(179.9, 0.0), (-179.8, 10.0), (12.0, 89.6), (-100.0, -89.9)]
    rows = [(i, *point()) for i in range(1500)] + [(2000 + i, lon, lat) for i, (lon, lat) in enumerate([(-179.9, 0.1), (179.7, 10.1), (-170.0, 89.5), (100.0, -89.5), (200.0, 0.0), (None, 1.0)])]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    df, f = spark.createDataFrame(rows, "row_id int, longitude double, latitude double"), spark.createDataFrame(focal, "longitude double, latitude double")
    for reach in (50.0, 400.0, 1500.0):
        got = {r.row_id: r.nearest_km for r in O.within_distance(df, f, reach).collect()}
        want = {i: d for i, lon, lat in rows if lon is not None and -180 <= lon <= 180 and (d := min(km((lon, lat), x) for x in focal)) <= reach}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_thinning_ignores_order(spark):
    rows = [("a", 1, 10.01, 20.01), ("a", 2, 10.01, 20.01), ("a", 3, 10.04, 20.04), ("b", 4, 10.02, 20.02), ("a", 5, 10.09, 20.01)]
    df = spark.createDataFrame(rows, "species string, gbifID long, longitude double, latitude double")
    for d in (df, df.orderBy(F.desc("gbifID")).repartition(3)):
        assert sorted(r.gbifID for r in O.thin_to_grid(d, 0.05).collect()) == [1, 4, 5]
    parts = [df.where(F.col("gbifID") % 2 == i) for i in (0, 1)]
    merged = O.footprint(O.footprint(parts[0].withColumn("species", F.lit("x")), 1.0).unionByName(O.footprint(parts[1], 1.0)).withColumn("species", F.lit("x")), 1.0)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, O.footprint(df, 1.0).collect()))


def test_admission_reasons(spark):
    rows = [(1, "a", "10", "20", "PRESENT", "HUMAN", 5.0, 2000), (2, "a", "x", "20", None, None, None, None), (3, "a", "999", "20", "absent", "HUMAN", 9e9, 1800), (4, "a", "10", "20", None, "HUMAN", None, 2001), (5, "a", None, None, "PRESENT", "HUMAN", 1.0, 2000)]
    df = spark.createDataFrame(rows, "row_id int, species string, longitude string, latitude string, occurrenceStatus string, basisOfRecord string, uncertainty double, year int")
    got = {r.row_id: r.reasons for r in O.admit(df, "row_id", 100.0, 1900, 2020, ["HUMAN"]).collect()}
    assert got == {1: "", 2: "missing_coordinate;basis_of_record_not_allowed", 3: "invalid_coordinate;occurrence_not_present;coordinate_uncertainty_too_high;year_before_min", 4: "duplicate_coordinate", 5: "missing_coordinate"}
    with pytest.raises(ValueError):
        O.snapshot_filter(df)
    with pytest.raises(KeyError):
        O.admit(df.drop("species"), "row_id")


def test_checked_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, "z"), (2, "w")], "k int, u string")
    assert V.checked_join(a, b, ["k"], "inner", "many_to_one").count() == 2
    for how in ("one_to_one", "one_to_many"):
        with pytest.raises(ValueError):
            V.checked_join(a, b, ["k"], "inner", how)
    with pytest.raises(ValueError):
        V.lookup(b, a.where("v = 'x'"), ["k"])
    t = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert V.table_fingerprint(t, ["k", "v"]) == V.table_fingerprint(t.orderBy(F.desc("k")).repartition(3), ["k", "v"]) != V.table_fingerprint(t.limit(1), ["k", "v"])


def test_completeness_and_adequacy(spark):
    rows = [("full", f, 0.6) for f in (0, 1)] + [("partial", 0, 0.6)] + [("double", 0, 0.6), ("double", 0, 0.6), ("double", 1, 0.6)] + [("nan", 0, float("nan")), ("nan", 1, 0.6)]
    got = {r.c: r.eligible for r in C.fold_completeness(spark.createDataFrame(rows, "c string, fold int, m double"), ["c"], "fold", [0, 1], ["m"]).collect()}
    assert got == {"full": True, "partial": False, "double": False, "nan": False}
    one = C.auc_adequacy(spark.createDataFrame([("a", 0.51), ("b", None), ("c", 0.52), ("c", 0.46)], "c string, m double"), ["c"], "m").collect()
    assert {r.c: (r.sem, r.adequate) for r in one if r.c != "c"} == {"a": (0.0, True), "b": (None, False)}


def test_front_brute_force(spark):
    rng = random.Random(5)
    rows = [(case, f"c{i}", float(rng.randint(0, 5)), float(rng.randint(0, 5)) if i else None) for case in "xy" for i in range(25)]
    got = {(r.case, r.c) for r in C.pareto_front(spark.createDataFrame(rows, "case string, c string, up double, down double"), ["case"], "c", ["up"], ["down"]).collect()}
    for case, c, u, d in rows:
        if d is None:
            continue
        beaten = any(k == case and d2 is not None and u2 >= u and d2 <= d and (u2 > u or d2 < d) for k, _, u2, d2 in rows)
        assert ((case, c) in got) == (not beaten)


def test_rank_scores(spark):
    rows = [("s", "t", "a", 0.9), ("s", "t", "b", 0.9), ("s", "t", "c", 0.1), ("s", "u", "a", 0.2)]
    got = {(r.case, r.m): (r.case_rank, r.rank_score, r.case_win) for r in R.case_scores(spark.createDataFrame(rows, "spec string, case string, m string, v double"), ["spec", "case"], "v").collect()}
    assert got == {("t", "a"): (1, 1.0, 1), ("t", "b"): (1, 1.0, 1), ("t", "c"): (3, 0.0, 0), ("u", "a"): (1, 1.0, 1)}


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_fits_are_optimal(spark, penalty):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] - 0.5)))
    rows = [("k", i % 4, bool(y[i]), *map(float, x[i])) for i in range(400)] + [("k", 0, True, None, 1.0, 1.0), ("small", 0, True, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, fold int, y boolean, a double, b double, c double")
    spec = L.ModelSpec(cost=0.5, penalty=penalty)
    fit, none = L.fit_tasks(df, "key", F.col("y"), [L.Task("k", None, ("a", "b", "c")), L.Task("small", None, ("a", "b", "c"))], spec)
    assert none is None and fit.rows == {"presence": int(y.sum()), "background": int(400 - y.sum())}
    z = np.c_[np.ones(400), (x - fit.centre) / fit.scale]
    cw = np.where(y, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    g = spec.cost * (z.T @ (cw * (1 / (1 + np.exp(-z @ fit.weights)) - y)))
    if penalty == "l2":
        assert np.abs(g + fit.weights).max() < 1e-5
    else:
        on = np.abs(fit.weights) > 1e-9
        assert np.abs(g[on] + np.sign(fit.weights[on])).max() < 1e-4 and (np.abs(g[~on]) <= 1 + 1e-4).all()
    assert df.select(fit.score().alias("s")).where("s is null").count() == 1
    assert L.cross_validated_rank(df, "key", F.col("y"), [("k", ("a", "b"))], [0, 1, 2, 3], spec)["k", ("a", "b")] > 0.7
    with pytest.raises(ValueError):
        L.ModelSpec(cost=0)


def test_partitions(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, i % 6, rng.random() < 0.5) for i in range(600)], "row_id int, block int, p boolean")
    sealed = P.seal_blocks(df, 0.3, 1).groupBy("block").agg(F.countDistinct("role").alias("n"), F.first("role").alias("role")).collect()
    assert all(r.n == 1 for r in sealed) and {r.role for r in sealed} == {"model", "sealed"}
    folds = P.block_folds(df, 3, F.col("p"))
    assert folds.groupBy("block").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0 and folds.select("fold").distinct().count() == 3
    assert P.balanced_folds(df, 3, F.col("p"), 20)[1]["worst_imbalance"] < 1.5 and P.balanced_folds(df, 3, F.col("p"), 10**6)[1] is None
    found, held = P.split_taxa(list("fedcba"), 0.3, 7)
    assert sorted(found + held) == list("abcdef") and len(held) == 2
    sample = P.sample_rows(df, 40, ["block"], ["row_id"], 3)
    assert {r["count"] for r in sample.groupBy("block").count().collect()} == {40} and sample.columns == df.columns
    assert sorted(r[0] for r in P.sample_rows(df.repartition(5), 40, ["block"], ["row_id"], 3).select("row_id").collect()) == sorted(r[0] for r in sample.select("row_id").collect())
    assert P.contiguous_chunks(list("abcde"), 2) == [["a", "b"], ["c", "d", "e"]]


def test_rasters(spark):
    grid = rasters.Grid(west=0.0, north=4.0, pixel=1.0, width=4, height=4, tile=2)
    tiles = [("t", ty, tx, [float(100 * ty + 10 * tx + i) for i in range(4)]) for ty in range(2) for tx in range(2)]
    pts = spark.createDataFrame([(1, 0.5, 3.5), (2, 3.5, 0.5), (3, 9.0, 0.5), (4, 2.5, 3.5)], "id int, longitude double, latitude double")
    got = {r.id: r.value for r in rasters.sample_points(pts, spark.createDataFrame(tiles, "predictor string, ty long, tx long, values array<double>"), grid, nodata=10.0, scale=2.0).collect()}
    assert got == {1: 0.0, 2: 226.0, 3: None, 4: None}
    months = [f"m{i}" for i in range(1, 13)]
    df = spark.createDataFrame([tuple(map(float, range(1, 13))), tuple([*map(float, range(1, 12)), None])], ", ".join(f"{m} double" for m in months))
    first, second = rasters.annual_features(df, months).collect()
    assert (first.annual_mean, first.annual_min, first.annual_max, first.annual_sum) == (6.5, 1.0, 12.0, 78.0) and second.annual_mean is None
    layers = spark.createDataFrame([("a", "open", "x.tif"), ("b", "closed", "y.tif"), ("c", "open", None)], "predictor string, availability string, remote_name string")
    assert {r.predictor: (r.status, r.uri) for r in rasters.resolve_layers(layers, "s3://l").collect()} == {"a": ("resolved", "s3://l/x.tif"), "b": ("excluded_availability", None), "c": ("unresolved", None)}
    with pytest.raises(ValueError):
        rasters.resolve_layers(layers, "s3://l", strict=True)


def test_sources(spark, tmp_path):
    text = "gbifID\tdecimalLongitude\tdecimalLatitude\tscientificName\n" + "".join(f"{i}\t{i}.5\t1\tname {i}\n" for i in range(5)) + "9\t\t2\tlast\n"
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("meta.xml", "<x/>")
        z.writestr("verbatim_long_name.txt", "no")
        z.writestr("occurrence.txt", text)
    rows, origin = tables.read_bulk(spark, str(tmp_path / "d.zip"))
    assert rows.columns == ["gbifID", "longitude", "latitude", "scientificName", "species"] and rows.count() == 6 and rows.where("longitude is null").count() == 1
    assert origin.first().n_rows == 6 and len(origin.first().sha256) == 64
    with pytest.raises(ValueError):
        tables.read_bulk(spark, "x.docx")
    (tmp_path / "c.txt").write_text("# note\na = 1\nb=x=y\n\n")
    assert {r.key: r.value for r in tables.read_choices(spark, str(tmp_path / "c.txt")).collect()} == {"a": "1", "b": "x=y"}

    def service(q):
        every = [{"key": i, "species": f"s{i}"} for i in range(7)]
        return {"count": 7, "results": every[q["offset"] : q["offset"] + q["limit"]]}

    assert sorted(r.key for r in tables.search_occurrences(spark, service, {}, "key int, species string", page=3).collect()) == list(range(7))
    with pytest.raises(tables.BulkDownloadRequired):
        tables.search_occurrences(spark, lambda q: {"count": 10**6}, {}, "key int")
    answers, waits = iter([(429, ""), (503, ""), (200, "see https://doi.org/10.15468/dl.abc12.")]), []
    assert tables.citation_doi(lambda: next(answers), "10.15468/DL.abc12", sleep=waits.append) == "10.15468/dl.abc12" and waits == [1.0, 2.0]
    out = tables.extract_snapshot(rows, str(tmp_path / "o"), "10.15468/dl.abc12", "SELECT 1")
    assert out.count() == 6
    with pytest.raises(Exception, match="(?i)exist"):
        tables.extract_snapshot(rows, str(tmp_path / "o"), "10.15468/dl.abc12", "SELECT 1")
    for bad in ("2024-1-01", "2024-02-02"):
        with pytest.raises(ValueError):
            tables.snapshot_uri("aws", bad)
    for family in tables.FAMILIES:
        truth = tables.known_truth(spark, 400, family, 1)
        n = truth.agg(F.count_if("is_presence"), F.min("true_suitability"), F.max("true_suitability")).first()
        assert 0 < n[0] < 400 and 0 <= n[1] <= n[2] <= 1


def test_streamed_rollup(spark, tmp_path):
    from tarnflow.streaming.rollups import append_once, stream_parts, windowed_ranks

    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(180)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    parts = stream_parts(spark, str(tmp_path / "in"), "ts timestamp, k string, v double")
    append_once(windowed_ranks(parts, "ts", "10 minutes", "1 hour", "k", "v"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.start.hour, r.k): (r.n, r.mean_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0, "a"] == (30, 29.0) and got[1, "b"] == (30, 90.0)


def test_methods_are_frozen_before_sealed_rows(spark):
    from tarnflow.operators import procedures as B

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = rng.random(500) < 1 / (1 + np.exp(-2.5 * x[:, 0]))
    rows = [("k", i % 3, "sealed" if i % 5 == 0 else "model", bool(y[i]), *map(float, x[i]), float(x[i][0] + 1e-4 * x[i][1])) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, fold int, role string, y boolean, a double, b double, c double, twin double")
    got = {r.strategy: r for r in B.method_benchmark(df, "key", F.col("y"), ["k"], ["a", "b", "c", "twin"], [0, 1, 2], B.ModelSpec(), repeats=1, most=1).collect()}
    assert set(got) == {"all", "vif", "predictive", "random1"} and got["all"].n_predictors == 4 and got["vif"].n_predictors == 3
    assert got["predictive"].predictors in ("a", "twin") and got["predictive"].presence_rank > 0.8
    with pytest.raises(ValueError):
        B.ModelPool(df.withColumn("role", F.lit("other")))


def test_audits(spark):
    from tarnflow.operators import audits as A

    df = spark.createDataFrame([(i % 2, float(i), None if i < 3 else 1.0, float("nan") if i % 2 else 2.0) for i in range(20)], "cell int, a double, b double, c double")
    assert A.audit_space(df, {"x": ["a", "c"], "y": ["b"], "z": ["c"]}, 0.8) == ["a", "b"]
    assert A.prune_audit_space(df, ["cell"], ["a", "b", "c"], 5) == ["a", "b"]
    c = spark.createDataFrame([(1, ["n", "m"]), (2, ["n"]), (3, None)], "k int, d array<string>")
    assert {r.k: r.admissible for r in A.admissible(c, "d", ["n", "m"]).collect()} == {1: True, 2: False, 3: False}
    old = spark.createDataFrame([(1, 2)], "sealed_auc int, other int")
    assert A.rename_legacy(old, {"sealed_auc": "presence_rank"}).columns == ["presence_rank", "other"]
    with pytest.raises(ValueError):
        A.rename_legacy(old, {})
    gate = A.mechanical_gate(df, ["cell"], {"a_known": F.col("a") >= 0, "b_known": F.col("b") > 0})
    assert {(r.cell, r.passed, r.failed) for r in gate.collect()} == {(0, False, "b_known"), (1, False, "b_known")}
    est = spark.createDataFrame([("s", "optimum", 2.0, 4.0)], "species string, quantity string, estimate double, environment_span double")
    true = spark.createDataFrame([("s", "optimum", 3.0)], "species string, quantity string, true_value double")
    assert tuple(A.response_errors(est, true, ["species"]).first()) == ("s", "optimum", 1.0, 0.25)
    ranks = spark.createDataFrame([("g", float(i), float(i) ** 3, -float(i)) for i in range(9)], "k string, a double, b double, c double")
    ((_, n, m),) = list(A.spearman_matrices(ranks, "k", ["a", "b", "c"]))
    assert n == 9 and np.allclose(m, [[1, 1, -1], [1, 1, -1], [-1, -1, 1]])


def test_marginal_score_spans_the_reference(spark, monkeypatch):
    import random

    import numpy as np

    from tarnflow.operators import models as L

    rng = random.Random(3)
    fit = L.Fit(L.Task("all", None, ("a", "b", "c")), L.ModelSpec(degree=2), np.array([0.1, 0.2, 0.3]), np.array([1.0, 2.0, 0.5]), np.array([rng.uniform(-1, 1) for _ in range(10)]))
    rows = [(i, rng.gauss(0, 1), rng.choice([0.0, 1.5, rng.gauss(0, 2)]), None if i % 17 == 0 else float("nan") if i % 19 == 0 else rng.gauss(0, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)

    def p(*x):
        z = [(v - m) / s for v, m, s in zip(x, fit.centre, fit.scale, strict=True)]
        return 1 / (1 + np.exp(-(fit.weights[0] + np.dot(fit.weights[1:], z + [z[i] * z[j] for i in range(3) for j in range(i, 3)]))))

    for size in (50_000, 40):
        monkeypatch.setattr(L, "SHARE_ROWS", size, raising=False)
        for nuisance in (["b"], ["b", "c"]):
            at = [{"a": 1, "b": 2, "c": 3}[n] for n in nuisance]
            whole = sorted(tuple(r[k] for k in at) for r in rows if all(r[k] is not None and r[k] == r[k] for k in at))
            held = [whole[k] for k in np.unique(np.rint(np.linspace(0, len(whole) - 1, 64)).astype(int))]
            got = {r["id"]: r["score"] for r in L.marginal_score(df, fit, nuisance, df).collect()}
            for i, a, b, c in rows:
                if len(nuisance) == 1 and (c is None or c != c):
                    assert got[i] is None
                else:
                    assert abs(got[i] - np.mean([p(a, *h) if len(h) == 2 else p(a, h[0], c) for h in held])) < 1e-9
    assert {r["score"] for r in L.marginal_score(df, fit, ["b"], df.where("b is null")).collect()} == {None}


@pytest.fixture
def shuffled_joins(spark):
    """Joins as large tables have them: by a shuffle, as planned."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / sum(n)


def test_one_name_is_dealt_to_many_tasks(spark, shuffled_joins):
    from tarnflow.operators import occurrences as O

    df = spark.range(8000).selectExpr("id AS row_id", "' Wolf' AS species", "CAST(7 AS long) AS taxonKey")
    for taxa, mode in (([("wolf", None), ("lynx", 3)], "name"), ([("any", 7)], "key")):
        got = O.select_taxa(df, spark.createDataFrame(taxa, "taxon string, key long"))
        assert {(r["mode"], r["taxon"], r["count"]) for r in got.groupBy("mode", "taxon").count().collect()} == {(mode, taxa[0][0], 8000)}
        assert largest_share(got) < 0.5


def test_blocks_of_one_key_are_dealt_to_many_tasks(spark, shuffled_joins):
    from tarnflow.operators import partitions as P

    df = spark.range(8000).selectExpr("id AS row_id", "'k' AS key", "CAST(id % 100 AS double) AS longitude", "CAST(id div 100 AS double) AS latitude")
    got = P.blocks_by_key(df, "key", 5, 3, rounds=1)
    assert largest_share(got) < 0.5 and got.count() == 8000 and got.select("block").distinct().count() == 5


def test_near_points_are_looked_for_first(spark):
    """Many points close together, at a pole and over the dateline: small radii first, and the same nearest points."""
    from tarnflow.operators import occurrences as O

    rng = np.random.default_rng(8)
    near = lambda lon, lat, n: np.stack([(lon + rng.normal(size=n) * 0.1 + 180) % 360 - 180, np.clip(lat + rng.normal(size=n) * 0.1, -90, 90)], 1)
    rows = np.concatenate([near(179.95, 10, 300), near(0, 90, 200), near(5, 5, 100), near(5.9, 5, 50), near(7.5, 5, 50)])
    focal = np.concatenate([near(-179.95, 10, 300), near(120, 90, 200), near(5, 5, 300)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "row_id int, longitude double, latitude double")
    f = spark.createDataFrame([tuple(map(float, r)) for r in focal], "longitude double, latitude double")
    got = {r.row_id: r.nearest_km for r in O.within_distance(df, f, 150.0).collect()}
    a, b = np.radians(rows)[:, None], np.radians(focal)[None]
    h = np.sin((b[..., 1] - a[..., 1]) / 2) ** 2 + np.cos(a[..., 1]) * np.cos(b[..., 1]) * np.sin((b[..., 0] - a[..., 0]) / 2) ** 2
    km = (2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(h, 1)))).min(1)
    assert set(got) == set(np.flatnonzero(km <= 150).tolist()) and np.allclose([got[i] for i in sorted(got)], km[km <= 150])
    x, y, z = O.unit_sphere(F.col("longitude"), F.col("latitude"))
    assert O._first_radius(f.select(x.alias("_fx"), y.alias("_fy"), z.alias("_fz")), 150.0) < 10
