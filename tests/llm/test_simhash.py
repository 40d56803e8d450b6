"""Fingerprints against their definition, close pairs against all pairs, components and odd rows."""

import random

import numpy as np
import pytest
import xxhash

from tarnflow.llm import simhash as H

DOCS = "doc_id long, text string"


def _print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in words).split(b" ") if w]
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute(docs):
    prints = [_print(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((d[0] for d, x in zip(docs, group, strict=True) if x == g and d[0] is not None), default=None) for g in group}
    return sorted(((d[0], f"{p:016x}", least[g]) for d, p, g in zip(docs, prints, group, strict=True)), key=str)


def _got(spark, docs, schema=DOCS):
    return sorted((tuple(r) for r in H.simhash_components(spark.createDataFrame(docs, schema)).collect()), key=str)


def test_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(str(rng.randrange(5000)) for _ in range(rng.randint(40, 200))) for _ in range(6)]
    docs = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2))):
            w[rng.randrange(len(w))] = "Edit" + str(rng.randrange(9))
        docs.append((i, " ".join(w)))
    got = _got(spark, docs)
    assert got == _brute(docs) and len({r[2] for r in got}) < 60


def test_odd_rows(spark):
    long = " ".join(str(i % 977) for i in range(150_000))
    docs = [(5, None), (3, ""), (4, " \t"), (9, "one"), (8, "ONE"), (7, "a b"), (None, "a b"), (2, long), (2, long), (None, "lonely words here now")]
    assert _got(spark, docs) == _brute(docs)
    assert _got(spark, [(*d, 1, "x") for d in docs], DOCS + ", print int, component string") == _brute(docs)
    assert _got(spark, []) == []


@pytest.mark.parametrize("bucket", [8, 512])
def test_close_pairs_in_split_buckets(spark, bucket):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    # few bits vary, so that most masks put them all into one bucket
    near = {base ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(300)}
    far = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 200, dtype=np.int64, endpoint=False)} | {0, -1, 7, -(1 << 63), 15}
    every = sorted(near | far)
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    got = [(r.a, r.b) for r in H.close_pairs(spark.createDataFrame([(x,) for x in every], "print long"), bucket=bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_masks():
    masks = H.bucket_masks()
    assert len(masks) == 20 and all(20 <= m.bit_count() <= 34 for m in masks)
    for _ in range(200):
        bits = random.sample(range(64), 3)
        assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_hexadecimal_of_the_highest_bit(spark):
    df = spark.createDataFrame([(-1,), (0,), (-(1 << 63),), (255,)], "p long")
    assert [r[0] for r in df.select(H.hexadecimal(df.p)).collect()] == ["f" * 16, "0" * 16, "8" + "0" * 15, "0" * 14 + "ff"]
