"""Gates and protocols on literal rows, and selection over perturbations against a plain replay."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import gates as G
from tarnflow.operators import protocols as T
from tarnflow.operators.gates import CORE_FULL, CORE_RANDOM, NECESSITY, NOMINATION, Rule

RULES = [Rule(NOMINATION, "core_stability", 0.5), Rule(NECESSITY, "mean_drop", 0.0), Rule(CORE_FULL, "n_pairs", 2), Rule(CORE_FULL, "mean_delta", -0.01), Rule(CORE_RANDOM, "n_runs", 2), Rule(CORE_RANDOM, "positive_fraction", 0.5)]
_DELTA = "c string, split_id int, delta double"


def _promotion(spark, stability, full, random_):
    held = G.process_promotion(spark.createDataFrame(stability, "c string, process string, core_stability double, mean_drop double"), spark.createDataFrame(full, _DELTA), spark.createDataFrame(random_, _DELTA), ["c"], "process", RULES)
    return held, {r.c: r for r in G.process_decision(held, ["c"]).collect()}


def test_process_promotion(spark):
    stability = [("good", "water", 0.9, 0.1), ("good", "soil", 0.2, None), ("weak", "water", 0.9, -0.1), ("weak", "soil", 0.8, 0.2), ("none", "water", 0.1, 0.3), ("bare", "water", 0.6, float("nan"))]
    both = [(c, s, 0.02) for c in ("good", "weak", "none") for s in (0, 1)]
    held, got = _promotion(spark, stability, both, both)
    assert got["good"].promoted and (got["good"].n_nominated, got["good"].n_validated) == (1, 1)
    assert not got["weak"].promoted and got["weak"].failures == "necessity:water:mean_drop" and got["weak"].n_validated == 1
    assert got["none"].failures == "nomination:n_nominated" and got["none"].n_nominated == 0
    assert set(got["bare"].failures.split(";")) == {"necessity:water:mean_drop", "core_over_full:n_pairs", "core_over_full:mean_delta", "core_over_random:n_runs", "core_over_random:positive_fraction"}
    soil = held.where("c = 'good' and subject = 'soil'").collect()
    assert len(soil) == 2 and not any(r.failure for r in soil) and not any(r.nominated for r in soil)
    with pytest.raises(ValueError, match="0 to 1"):
        G.ledger(held, [], NOMINATION, F.lit(None), [Rule(NOMINATION, "core_stability", 2.0)])


def test_contrast(spark):
    rows = [("a", 1, 0.2), ("a", 1, -0.1), ("a", 2, -0.3), ("a", 2, None), ("a", 3, float("nan"))]
    got = G.contrast(spark.createDataFrame(rows, "k string, run int, delta double"), ["k"], "delta", "run").first()
    assert (got.n_pairs, got.n_runs) == (5, 3) and got.mean_delta == pytest.approx(-0.2 / 3) and got.median_delta == pytest.approx(-0.1)
    assert got.positive_fraction == pytest.approx(0.2) and got.positive_run_fraction == pytest.approx(1 / 3)


def test_method_promotion(spark):
    stable = spark.createDataFrame([("M", "u", "a", 0.6, 6), ("M", "u", "b", 0.4, 4), ("N", "u", "b", 0.5, 3), ("N", "u", "a", 0.5, 3)], "c string, universe string, strategy string, selection_fraction double, runs_selected int")
    runs = spark.createDataFrame([("M", "u", "a", 2, 0.5, "p2"), ("M", "u", "a", 1, 0.9, "p1"), ("N", "u", "a", 1, None, "p3")], "c string, universe string, strategy string, run_id int, wins double, predictors string")
    deltas = spark.createDataFrame([("M", "u", "a", 1, "b", 0.1), ("M", "u", "a", 2, "b", 0.2), ("M", "u", "b", 1, "a", 9.0), ("N", "u", "a", 1, "b", -0.1)], "c string, universe string, strategy string, run_id int, comparator string, delta double")
    rules = [Rule("protocol", "selection_fraction", 0.5), Rule("protocol", "least_wins", 0.5), Rule("comparator", "n_pairs", 1), Rule("comparator", "mean_delta", 0.0)]
    held = G.method_promotion(stable, runs, deltas, ["c"], ["universe", "strategy"], ["a", "b", "x"], rules)
    status = {(r.c, r.subject): (r.status, r.passes) for r in held.where("figure = 'mean_delta'").collect()}
    assert status == {("M", "a"): ("self", True), ("M", "b"): ("evaluated", True), ("M", "x"): ("missing", False), ("N", "a"): ("self", True), ("N", "b"): ("evaluated", False), ("N", "x"): ("missing", False)}
    got = {r.c: r for r in G.method_decision(held, runs, ["c"], ["universe", "strategy"], ["predictors"]).collect()}
    assert (got["M"].strategy, got["M"].run_id, got["M"].predictors, got["M"].promoted) == ("a", 1, "p1", False)
    assert got["M"].failures == "comparator:x:mean_delta;comparator:x:n_pairs" and "protocol:least_wins" in got["N"].failures
    whole = G.method_promotion(stable, runs, deltas, ["c"], ["universe", "strategy"], ["a", "b"], rules)
    assert {r.c: r.promoted for r in G.method_decision(whole, runs, ["c"], ["universe", "strategy"], ["predictors"]).collect()} == {"M": True, "N": False}


def test_differentiation(spark):
    rows = [("a", 5, 20, 0.1, 0.7, 0.9), ("b", 2, 20, -0.1, 0.7, 0.9), ("c", 5, 20, 0.1, 0.7, 0.9), ("c", 5, 20, 0.1, 0.7, 0.9), ("d", 5, 20, None, 0.7, 0.9)]
    summary = spark.createDataFrame(rows, "comparator string, n_runs long, n_pairs long, mean_delta double, positive_fraction double, positive_run_fraction double")
    bounds = {"n_runs": 3, "n_pairs": 10, "mean_delta": 0.0, "positive_fraction": 0.5, "positive_run_fraction": 0.5}
    got = {r.comparator: r for r in G.differentiation(summary, [], ["a", "b", "c", "d", "e"], bounds).collect()}
    assert got["a"].passes and got["a"].failure_reason == "" and got["b"].failure_reason == "runs;mean_delta" and got["d"].failure_reason == "mean_delta"
    assert all(not got[c].present and got[c].n_pairs == 0 and got[c].failure_reason == "missing_or_duplicate_comparator" for c in "ce")


def _replay(rows, hard, bound):
    """The selection of one case by its definition: (eligible, complete, front, winner)."""
    perturbations = sorted({r[1] for r in rows})
    mean = lambda v: sum(v) / len(v)
    per = {}
    for c, p, kind, _, rank, up, down in rows:
        per.setdefault((c, p), []).append((kind, rank, up, down))
    gates = [p for p in perturbations if any(r[1] == p and r[2] in hard for r in rows)]

    def passes(v):
        ranks = [x[1] for x in v]
        m = mean(ranks)
        sem = math.sqrt(sum((x - m) ** 2 for x in ranks) / (len(ranks) - 1) / len(ranks)) if len(ranks) > 1 else 0.0
        return m >= 0.51 - 1e-12 and m - sem >= 0.5 - 1e-12 and mean([x[3] for x in v]) <= bound + 1e-12

    names = sorted({r[0] for r in rows})
    eligible = [c for c in names if gates and all((c, p) in per and passes(per[c, p]) for p in gates)]
    ranks = {c: [] for c in eligible}
    for p in perturbations:
        own = {c: (mean([x[2] for x in per[c, p]]), mean([x[3] for x in per[c, p]])) for c in eligible if (c, p) in per}
        for c, (u, d) in own.items():
            ranks[c].append((1 + sum(x > u for x, _ in own.values()), 1 + sum(x < d for _, x in own.values())))
    complete = [c for c in eligible if len(ranks[c]) == len(perturbations)]
    worst = {c: tuple(max(r[i] for r in ranks[c]) for i in (0, 1)) for c in complete}
    means = {c: tuple(mean([r[i] for r in ranks[c]]) for i in (0, 1)) for c in complete}
    front = [c for c in complete if not any(all(a <= b for a, b in zip(worst[o], worst[c], strict=True)) and worst[o] != worst[c] for o in complete)]
    order = sorted(front, key=lambda c: (max(worst[c]), round(mean(worst[c]), 9), round(max(means[c]), 9), round(mean(means[c]), 9), c))
    return set(eligible), set(complete), set(front), order[0] if order else None


@pytest.mark.parametrize("seed", range(2))
def test_perturbation_selection(spark, seed):
    rng = random.Random(seed)
    rows = []
    for case in "xyz":
        for c in "abcdef":
            for p in range(4):
                if rng.random() < 0.06:
                    continue
                rows += [(case, c, f"p{p}", "hard" if p < 2 else "soft", f, round(rng.gauss(0.6, 0.07), 3), rng.choice((0.125, 0.25, 0.5, 0.75)), rng.choice((0.125, 0.25, 0.375))) for f in range(rng.choice((1, 3)))]
    df = spark.createDataFrame(rows, "c string, candidate string, perturbation string, kind string, fold int, presence_rank double, up double, down double")
    got = G.perturbation_selection(df, ["c"], "candidate", "perturbation", ["up"], ["down"], kind="kind", hard=["hard"], most={"down": 0.28}).collect()
    for case in "xyz":
        own = [r for r in got if r.c == case]
        names = lambda flag: {r.candidate for r in own if r[flag]}  # noqa: E731, B023
        want = _replay([r[1:] for r in rows if r[0] == case], {"hard"}, 0.28)
        assert (names("eligible"), names("complete"), names("on_front")) == want[:3] and names("selected") == ({want[3]} if want[3] else set())
    with pytest.raises(ValueError, match="hard kinds"):
        G.perturbation_selection(df, ["c"], "candidate", "perturbation", ["up"], ["down"], hard=["hard"])
    mixed = df.withColumn("kind", F.when(F.col("candidate") == "a", "hard").otherwise(F.col("kind")))
    with pytest.raises(Exception, match="hard and of other kinds"):
        G.perturbation_selection(mixed, ["c"], "candidate", "perturbation", ["up"], ["down"], kind="kind", hard=["hard"]).collect()


def test_selectors_share_cases(spark):
    rows = [("M", u, s, t, 0.5 + i / 50, 0.1 * i, 0.9 - i / 50, i, 4) for t in ("t1", "t2") for i, (u, s) in enumerate([("u", "a"), ("u", "b"), ("v", "a")])]
    figures = spark.createDataFrame(rows, "specification string, universe string, strategy string, taxon string, presence_rank double, boyce double, inner_presence_rank double, n_predictors int, n_candidates int")
    choices = T.frozen_selectors(figures, "M", ("u", "a"))
    assert {r.selector: (r.universe, r.strategy, r.same_as_robust) for r in choices.collect()} == {"m_robust": ("u", "a", True), "canonical_presence_rank": ("v", "a", False), "canonical_boyce": ("v", "a", False)}
    transfer = T.selector_figures(figures, choices)
    got = {(r.selector, r.taxon): (r.universe, r.strategy) for r in transfer.collect()}
    assert len(got) == 8 and got["local_nested", "t1"] == ("u", "a") and got["canonical_boyce", "t2"] == ("v", "a")
    assert {r.comparator: round(r.delta, 9) for r in T.selector_deltas(transfer).where("taxon = 't1'").collect()} == {"canonical_presence_rank": -0.04, "canonical_boyce": -0.04, "local_nested": 0.0}
    with pytest.raises(Exception, match="exactly one figure"):
        T.selector_figures(figures.where("taxon = 't1' or universe = 'u'"), choices).collect()
    with pytest.raises(Exception, match="finite inner rank"):
        T.selector_figures(figures.withColumn("inner_presence_rank", F.lit(float("nan"))), choices).collect()
