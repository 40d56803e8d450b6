"""Selectors, ledgers and nested procedures against plain Python versions written from their definitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import models as L
from tarnflow.operators import procedures as B
from tarnflow.operators import selection as S


def dominates(a, b, higher, lower):
    gain = [a[m] - b[m] for m in higher] + [b[m] - a[m] for m in lower]
    return all(g >= -1e-12 for g in gain) and any(g > 1e-12 for g in gain)


def front(rows, higher, lower):
    return [b for b in rows if not any(a is not b and dominates(a, b, higher, lower) for a in rows)]


def place(rows, r, m, up):
    return 1 + sum(1 for o in rows if (o[m] > r[m] if up else o[m] < r[m]))


def test_two_stage(spark):
    rng = np.random.default_rng(3)
    rows = []
    for case, i in itertools.product("ab", range(9)):
        a, b, c, d = (float(x) for x in rng.integers(0, 5, 4))
        rows.append({"case": case, "cand": f"c{i}", "a": a, "b": b, "c": c, "d": d, "mean_complexity": float(i % 3) if i % 4 else None})
    rows += [{"case": "a", "cand": "nan", "a": math.nan, "b": 0.0, "c": 9.0, "d": 0.0, "mean_complexity": 0.0}, {"case": "b", "cand": "null", "a": 9.0, "b": 0.0, "c": None, "d": 0.0, "mean_complexity": 0.0}]
    schema = "case string, cand string, a double, b double, c double, d double, mean_complexity double"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {(r.case, r.cand): r for r in S.two_stage(df, ["case"], "cand", (["a"], ["b"]), (["c"], ["d"])).collect()}
    assert len(got) == len(rows)
    assert not got["a", "nan"].eligible and not got["b", "null"].eligible
    for case in "ab":
        known = [r for r in rows if r["case"] == case and r["cand"].startswith("c")]
        one = front(known, ["a"], ["b"])
        two = front(one, ["c"], ["d"])

        def order(r):
            s, f = [place(two, r, "c", True), place(two, r, "d", False)], [place(two, r, "a", True), place(two, r, "b", False)]
            size = r["mean_complexity"]
            return max(s), sum(s) / 2, max(f), sum(f) / 2, size is None, size or 0.0, r["cand"]

        best = min(two, key=order)["cand"]
        assert {k[1] for k, r in got.items() if k[0] == case and r.first_front} == {r["cand"] for r in one}
        assert {k[1] for k, r in got.items() if k[0] == case and r.second_front} == {r["cand"] for r in two}
        assert [k[1] for k, r in got.items() if k[0] == case and r.selected] == [best]


def test_candidate_profile_directions(spark):
    rows = [("x", "c", 0, 1.0, 5.0), ("x", "c", 1, 3.0, math.inf), ("x", "c", 2, None, 7.0), ("x", "d", 0, None, None)]
    got = {r.cand: r for r in S.candidate_profile(spark.createDataFrame(rows, "k string, cand string, fold int, up double, down double"), ["k"], "cand", "fold", ["up"], ["down"], "fold").collect()}
    assert (got["c"].n_folds, got["c"].up, got["c"].up_worst, got["c"].down, got["c"].down_worst, got["c"].mean_complexity) == (3, 2.0, 1.0, 6.0, 7.0, 1.0)
    assert got["d"].up is None and got["d"].down_worst is None


def test_support_ledger(spark):
    rows = []
    for sp, blocks in {"good": (0, 1, 2), "thin": (0, 1), "one": (4,)}.items():
        for b in blocks:
            rows += [(sp, b, b % 3, True)] * (4 if sp != "thin" else 1) + [(sp, b, b % 3, False)] * (6 if b else 3)
    rows += [("good", 9, 2, False)] * 50 + [("few", 0, 0, True), ("few", 1, 1, False), ("few", 1, 1, False)]
    got = {(r.sp, r.outer_fold): r for r in S.support_ledger(spark.createDataFrame(rows, "sp string, block int, fold int, p boolean"), ["sp"], "block", "fold", F.col("p")).collect()}
    assert set(got) == {("good", 0), ("good", 1), ("good", 2), ("thin", 0), ("thin", 1), ("one", -1), ("few", -1)}
    assert got["good", 0].reasons == "background_test" and not got["good", 0].eligible
    assert got["good", 1].eligible and (got["good", 1].n_background_train, got["good", 1].n_presence_train) == (9, 8)
    assert got["thin", 1].reasons == "presence_train,presence_test,background_train"
    assert (got["one", -1].reasons, got["one", -1].n_presence_train, got["one", -1].n_background_train) == ("fewer_than_two_folds", 4, 6)
    assert (got["few", -1].reasons, got["few", -1].n_presence_train) == ("too_few_rows", 0)


def test_chunks_and_panels_are_whole(spark):
    one = spark.createDataFrame([("a", 1), ("a", 1)], "t string, v int")
    taxa = spark.createDataFrame([("a",), ("b",)], "t string")
    two = spark.createDataFrame([("b", 2)], "t string, v int")
    assert S.union_chunks({0: one, 1: two}, 2, taxa, "t").count() == 3
    with pytest.raises(ValueError):
        S.union_chunks({0: one}, 2, taxa, "t")
    with pytest.raises(ValueError):
        S.union_chunks({0: one, 1: one}, 2, taxa, "t")
    assert S.panel_chain(taxa, [spark.createDataFrame([("a", 1), ("b", 2)], "t string, w int"), spark.createDataFrame([("b", 3), ("a", 4)], "t string, x int")], ["t"]).orderBy("t").collect() == [("a", 1, 4), ("b", 2, 3)]
    for bad in ([("a", 1)], [("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("a", 2), ("b", 1)]):
        with pytest.raises(ValueError):
            S.panel_chain(taxa, [spark.createDataFrame(bad, "t string, w int")], ["t"])


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    rows = []
    for sp in ("u", "v"):
        for i in range(240):
            x, y, z = rng.normal(size=3)
            rows.append((sp, i, float(x), float(y) if i % 40 else None, float(z), bool(rng.random() < 1 / (1 + math.exp(-2 * x))), i % 3, i // 3 % 4))
    return spark.createDataFrame(rows, "sp string, i int, x double, y double, z double, p boolean, fold int, outer int").repartition(3)


def auc(p, b):
    return float(np.mean([(u > v) + (u == v) / 2 for u in p for v in b]))


def test_joined_coefficients_score_as_one_fit_does(spark, cells, tmp_path):
    fits = [f for d in (1, 2) for f in L.fit_tasks(cells, "sp", F.col("p"), [L.Task("u", None, ("x", "y")), L.Task("v", None, ("z", "x"))], L.ModelSpec(degree=d))]
    got = {}
    for r in L.score_tasks(cells, "sp", fits, ["i", F.col("p").alias("is_presence")]).collect():
        got[r.task, r.i] = r.score
    for t, f in enumerate(fits):
        for r in cells.where(F.col("sp") == f.task.key).select("i", f.score().alias("s")).collect():
            assert got.pop((t, r.i)) == (None if r.s is None else pytest.approx(r.s, abs=1e-12))
    assert not got
    path = f"file://{tmp_path}/fits"
    L.write_fits(spark, fits, path)
    back = L.read_fits(spark, path)
    assert [(f.task, f.spec, f.rows) for f in back] == [(f.task, f.spec, f.rows) for f in fits]
    assert all(np.array_equal(getattr(a, n), getattr(b, n)) for a, b in zip(fits, back, strict=True) for n in ("centre", "scale", "weights"))
    with pytest.raises(Exception, match="exist"):
        L.write_fits(spark, fits, path)


def test_signal_gate(spark, cells):
    gate = lambda names: {r.sp: r for r in L.signal_gate(cells, "sp", F.col("p"), ["u", "v"], names, [0, 1, 2]).collect()}
    strong, none = gate(["x"]), gate([])
    assert all(r.active and r.n_folds == 3 for r in strong.values())
    assert all(not r.active and (r.n_folds, r.mean, r.lower) == (0, 0.5, 0.5) for r in none.values())
    ranks = []
    for k in range(3):
        rest = cells.where((F.col("sp") == "u") & (F.col("fold") != k))
        fit = L.fit_tasks(rest, "sp", F.col("p"), [L.Task("u", None, ("x",))], L.ModelSpec())[0]
        held = cells.where((F.col("sp") == "u") & (F.col("fold") == k)).select("p", fit.score().alias("s")).collect()
        ranks.append(auc([r.s for r in held if r.p], [r.s for r in held if not r.p]))
    sem = np.std(ranks, ddof=1) / math.sqrt(3)
    assert (strong["u"].mean, strong["u"].sem, strong["u"].lower) == pytest.approx((np.mean(ranks), sem, np.mean(ranks) - sem))


def test_nested_benchmark_never_sees_its_fold(spark, cells):
    args = ("sp", F.col("p"), ["u"], ["x", "y", "z"], ["x", "z"], "outer", [0, 1, 2], L.ModelSpec())
    got = {(r.outer_fold, r.strategy): r for r in B.nested_benchmark(cells, *args).collect()}
    assert set(got) == {(o, s) for o in range(4) for s in ("all", "vif", "predictive", "recovery")}
    for o in range(4):
        rest = cells.where((F.col("sp") == "u") & (F.col("outer") != o))
        want = [r[2] for r in L.forward_selection(rest, "sp", F.col("p"), ["u"], ["x", "y", "z"], [0, 1, 2], L.ModelSpec())]
        r = got[o, "predictive"]
        assert r.taxon == "u" and r.predictors == ",".join(want)
        fit = L.fit_tasks(rest, "sp", F.col("p"), [L.Task("u", None, tuple(want))], L.ModelSpec())[0]
        held = [h for h in cells.where((F.col("sp") == "u") & (F.col("outer") == o)).select("p", fit.score().alias("s")).collect() if h.s is not None]
        seen = [h.s for h in rest.where("p").select(fit.score().alias("s")).collect() if h.s is not None]
        assert r.presence_rank == pytest.approx(auc([h.s for h in held if h.p], [h.s for h in held if not h.p]))
        assert r.or10 == pytest.approx(np.mean([h.s < np.quantile(seen, 0.1) for h in held if h.p]))
        assert r.n_components == 2 and 0 <= r.overlap <= 1
    changed = cells.withColumn("x", F.when(F.col("outer") == 1, -F.col("x")).otherwise(F.col("x")))
    again = {(r.outer_fold, r.strategy): r.predictors for r in B.nested_benchmark(changed, *args).collect()}
    assert all(again[1, s] == got[1, s].predictors for s in ("predictive", "recovery"))
    with pytest.raises(ValueError):
        B.nested_benchmark(cells.where("outer = 0"), *args)


def test_target_group_background(spark):
    from tarnflow.operators import occurrences as O

    rng = np.random.default_rng(8)
    schema = "row_id long, species string, longitude double, latitude double"
    pool = [(i, f"s{i % 5}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (400, 2)))] + [(900, "s1", None, 1.0), (901, "s1", 0.5, None), (902, None, 2.9, 2.9)]
    focal = [(1, "f", float(x), float(y)) for x, y in rng.uniform(-3, 3, (6, 2))] + [(2, "f", None, None)]
    cell = lambda r: (math.floor((r[2] + 180) / 1.0), math.floor((r[3] + 90) / 1.0))
    taken = {cell(r) for r in focal if r[2] is not None}
    free = {}
    for r in sorted(r for r in pool if r[2] is not None and r[3] is not None and r[3] > -2):
        if cell(r) not in taken:
            free.setdefault(cell(r), r[0])
    assert len(free) > 12
    run = lambda n, where=F.col("latitude") > -2: O.target_group_background(spark.createDataFrame(focal, schema), spark.createDataFrame(pool, schema).repartition(3), where, n, 1.0, 7, ["row_id"], "f").collect()
    assert {r.row_id for r in run(1000)} == set(free.values())
    some = run(12)
    assert len({r.row_id for r in some}) == 12 and {r.row_id for r in some} <= set(free.values()) and {r.row_id for r in run(12)} == {r.row_id for r in some}
    assert all(r.species == "f" and r.background_source_species == dict((p[0], p[1]) for p in pool)[r.row_id] for r in some)
    with pytest.raises(ValueError):
        run(5, F.col("latitude") > 80)


@pytest.mark.parametrize("reach", [2.0, 5.0, 40.0])
def test_short_reaches_use_small_cells_and_find_the_same(spark, reach):
    from tarnflow.functions.values import EARTH_KM
    from tarnflow.operators import occurrences as O

    rng = np.random.default_rng(11)
    spots = [(0.0, 0.0), (179.99, 10.0), (-179.99, 10.01), (30.0, 89.95), (-150.0, -89.98), (12.3, 51.05)]
    at = lambda n: [(float((x + dx + 180) % 360 - 180), float(np.clip(y + dy, -90, 90))) for x, y in spots for dx, dy in rng.normal(scale=0.03, size=(n, 2))]
    rows, focal = [(i, *p) for i, p in enumerate(at(30))], at(4)
    got = {r.row_id: r.nearest_km for r in O.within_distance(spark.createDataFrame(rows, "row_id int, longitude double, latitude double"), spark.createDataFrame(focal, "longitude double, latitude double"), reach).collect()}

    def km(a, b):
        (x, y), (u, v) = np.radians(a), np.radians(b)
        return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))

    want = {i: min(km((x, y), f) for f in focal) for i, x, y in rows}
    want = {i: d for i, d in want.items() if d <= reach}
    assert set(got) == set(want) and all(got[i] == pytest.approx(d, abs=1e-6) for i, d in want.items())


def test_matched_specifications(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", None)]
    df = lambda r: spark.createDataFrame(r, "t string, v double")
    one = S.assert_matched({"x": df(rows), "y": df(rows[::-1]).repartition(3).withColumn("more", F.lit(1))}, ["t", "v"])
    assert len(one) == 64
    for other in (rows[1:], [*rows[:2], ("b", 0.0)]):
        with pytest.raises(ValueError, match="differ"):
            S.assert_matched({"x": df(rows), "y": df(other)}, ["t", "v"])


def test_panels_are_checked_over_kept_metrics(spark, monkeypatch):
    """The joins behind the metrics, and what they broadcast, are not done again for each check of the chain."""
    from tarnflow.operators import selection
    from tarnflow.plans.registry import QUERIES

    chain, plans = selection.panel_chain, []

    def seen(panels, parts, on):
        plans.extend(t._jdf.queryExecution().executedPlan().toString() for t in (panels, *parts))
        return chain(panels, parts, on)

    monkeypatch.setattr(selection, "panel_chain", seen)
    assert QUERIES["panel_chain"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 4 and all("InMemoryTableScan" in p for p in plans)
