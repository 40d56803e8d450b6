import hashlib
import random

import numpy as np

from tarnflow.llm import fingerprint as P


def test_multiset_homomorphism():
    rng = random.Random(1)
    parts = [f"paragraph {i}." for i in range(50)] + ["twice.", "twice."]
    whole = P.vector(parts)
    rng.shuffle(parts)
    assert np.array_equal(whole, P.vector(parts))
    assert np.array_equal(P.delete(P.insert(whole, ["new."]), ["new."]), whole)
    assert not np.array_equal(P.delete(whole, ["twice."]), whole)
    assert np.array_equal(P.vector([]), np.zeros(P.LANES)) and np.array_equal(P.from_text(P.as_text(whole)), whole)
    assert P.likeness(whole, whole) == 1.0 and 0.8 < P.likeness(whole, P.insert(whole, ["one more."])) < 1
    assert P.likeness(whole, P.vector([f"other {i}." for i in range(50)])) < 0.3


def test_edited_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["alpha", "béta.", "gamma\n", "δέλτα"]) for _ in range(rng.randint(0, 90)))) for _ in range(300)]
    rows += [(-5, None), (10**7, ""), (77, "tie b"), (77, "tie a"), (88, "same"), (88, "same"), (None, "first of all")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(6)
    got = P.edited_fingerprints(docs).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = []
    for k, (known, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        cut = len(t) // 4
        e = t[: len(t) - cut] + after[:cut]
        a, b, c = (P.vector(P.paragraphs(x)) for x in (t, e, after))
        want.append((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), P.as_text(a), P.as_text(b), P.likeness(a, b), P.likeness(a, c)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_and_none(spark):
    one = P.edited_fingerprints(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    assert P.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
