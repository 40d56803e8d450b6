"""The removal polynomial against plain walks over all orders, and odd rows."""

import random
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tarnflow.llm import interactions as I

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def _fails(doc, docs):
    text = doc[1] or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    first = min((d[0] for d in docs if (d[1] or "") == text and d[0] is not None), default=None)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": doc[0] is not None and doc[0] > first,
    }


def _brute(docs, labels):
    marks = {}
    for i, q, t in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (max(old[0], q == 1), max(old[1], t == 1))
    parts = {}
    for d in docs:
        parts.setdefault(d[2] or "", []).append((_fails(d, docs), *(marks.get(d[0], (0, 0)) if d[0] is not None else (0, 0))))
    rows = set()
    for part, members in parts.items():
        total, walks = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[0][f]]
                left = [m for m in left if not m[0][f]]
                total[f] += len(gone)
                walks.append(("".join(order), step, f, len(left), len(gone), sum(m[0][f] for m in members) - len(gone), sum(m[0][f] and sum(m[0].values()) == 1 for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)))
        rows |= {(part, o, s, *rest, total[f]) for o, s, f, *rest in walks}
    return rows


def _got(spark, docs, labels, schema=DOCS):
    got = I.audit_orders(I.filter_masks(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, LABELS)), "ABCDE").collect()
    rows = {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(rows) == len(got)
    return rows


def _corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(("ab", "Cd", "e#", "f", "gh")) + str(rng.randrange(rng.choice((3, 500)))) for _ in range(rng.choice((3, 210, 260)))) for _ in range(12)]
    docs = [(i, rng.choice(texts), rng.choice(("s", "t", None, ""))) for i in range(60)]
    return docs, [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 60, 2)]


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, seed):
    docs, labels = _corpus(seed)
    assert _got(spark, docs, labels) == _brute(docs, labels)


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", None), (2, "", None), (None, "", "a"), (3, "x" * 3_000_000 + " Y", "a"), (4, "x " * 400_000, "a"), (5, "w\tv\x0bu\x0c\r", ""), (None, "$", "b"), (6, "É" * 10, "b")]
    labels = [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9, 1, 1), (3, None, 1)]
    assert _got(spark, docs, labels) == _brute(docs, labels)
    assert _got(spark, [(*d, 1, 2, True) for d in docs], labels, DOCS + ", mask int, part long, repeats boolean") == _brute(docs, labels)
    assert _got(spark, [], labels) == set() and _got(spark, docs, []) == _brute(docs, [])


def test_sql(spark):
    docs, labels = _corpus(5)
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar, source varchar)")
    c.sql("create table labels (doc_id bigint, quality int, toxic int)")
    c.executemany("insert into documents values (?, ?, ?)", docs)
    c.executemany("insert into labels values (?, ?, ?)", labels)
    assert set(c.sql(f"select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from ({I.OP12_SQL})").fetchall()) == _got(spark, docs, labels)


def test_shapley_values_are_fair(spark):
    counts = spark.createDataFrame([("p", 0b011, 6, 0, 0), ("p", 0b100, 5, 1, 0), ("p", 0, 7, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = I.audit_orders(counts, "XYZ").where("step = 1").collect()
    assert {r.filter_order[0]: r.shapley for r in rows} == {"X": 18, "Y": 18, "Z": 30}
    assert sum({r.filter_order[0]: r.shapley for r in rows}.values()) == 6 * (6 + 5)
