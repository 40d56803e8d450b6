import os
import random
from collections import defaultdict

import pytest

from tarnflow.llm import common as C
from tarnflow.llm import jaccard as J


def brute(rows, size, like):
    sets = []
    for _, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= like * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d is None, d or 0), len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for length in (*range(1, 45), 60, 90, 130, 200):
        base = [word() for _ in range(length)]
        for edits in (0, 0, 1, 1, 2, 4, 9):
            w = list(base)
            for _ in range(edits if length > 8 else edits % 2):
                at = rng.randrange(len(w))
                w[at : at + rng.choice((0, 1, 1))] = [word()] * rng.choice((0, 1, 1))
            rows.append((n, ("\t " if n % 5 else " \n").join(w).upper() if n % 3 == 0 else " ".join(w)))
            n += 1
    passage = " ".join(word() for _ in range(30))
    rows += [(n + i, passage + " " + " ".join(word() for _ in range(i % 17))) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (7, rows[0][1]), (7, rows[0][1]), (None, rows[20][1]), (9000, "é É ü"), (9001, "é É ü")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "like"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, monkeypatch, size, like):
    monkeypatch.setattr(J, "FREQUENT", 25)
    rows = corpus(size)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    got = J.jaccard_components(docs, size, like).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == brute(rows, size, like)


def test_light_alone_and_heavy_alone(spark, monkeypatch):
    rows = [r for r in corpus(9) if len((r[1] or "").split()) < 22]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 18):
        monkeypatch.setattr(J, "boundary_of", lambda sizes, like=85, most=most: most)
        got = J.jaccard_components(docs).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)


def test_long_lists_in_blocks(spark, monkeypatch):
    """Lists over a block's rows are dealt in blocks, and scratch tables go once nothing reads them."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 5)
    monkeypatch.setattr(J, "NEIGHBOURS", 2)
    monkeypatch.setattr(J, "ROUNDS", 1)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(J, "boundary_of", lambda sizes, like=85: 3)
    rows = corpus(31)
    written = []
    with C.owning(written):
        out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85)
    left = {p.rsplit("-", 1)[0].rsplit("/", 1)[1] for p in written if os.path.exists(p.removeprefix("file://"))}
    assert left == {"jaccard-signatures", "components", "jaccard-least", "jaccard-drawn-links"}


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    near = list(words)
    near[1000:1000] = ["one", "more"]
    docs = [(1, " ".join(words), "a", "b"), (2, " ".join(near), "a", "b"), (3, " ".join(words[:100_000]), "a", "b")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, token string, component string")
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_boundary_follows_cost():
    assert J.boundary_of({3: 10**6, 200: 5}) > 0
    assert J.boundary_of({39: 10**6}) < 39


def test_nothing(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert J.jaccard_components(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].component_id == 1


def test_maps_are_compared_a_few_at_a_time(monkeypatch):
    """Pairs beyond what is compared at once give the same distances."""
    import numpy as np

    from tarnflow.llm import jaccard as J

    rng = np.random.default_rng(4)
    maps = rng.integers(0, 1 << 63, size=(50, 16), dtype=np.uint64)
    width, x, y = np.where(np.arange(50) % 2, 512, 1024), rng.integers(0, 50, 1000), rng.integers(0, 50, 1000)
    whole = J._apart(maps, width, x, y)
    monkeypatch.setattr(J, "MAPS_AT_ONCE", 64)
    assert (J._apart(maps, width, x, y) == whole).all()
