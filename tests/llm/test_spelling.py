"""Spelling variants against all pairs of words, split blocks, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from tarnflow.llm import spelling as S

DOCS = "doc_id long, text string"


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return rows


def _got(spark, docs, schema=DOCS):
    return {tuple(r) for r in S.spelling_variants(spark.createDataFrame(docs, schema)).collect()}


def _corpus(seed: int, letters: str = "abcé") -> list[tuple[int, str]]:
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(12)]

    def word() -> str:
        w = rng.choice(stems[: rng.choice((1, 3, 12))])
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]))
        return w.upper() if rng.random() < 0.1 else w

    return [(i, rng.choice((" ", "-", ", ")).join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    docs = _corpus(seed)
    assert _got(spark, docs) == _brute(docs)


def test_blocks_are_split_without_loss(spark):
    docs = _corpus(7, "ab")
    words = S.word_counts(spark.createDataFrame(docs, DOCS)).cache()
    every = [r.word for r in words.collect()]
    want = {tuple(sorted((a, b))) for a in every for b in every if a < b and _near(a, b)}
    assert len(want) > 50
    for most in (2, 5, 400):
        got = [(r.a, r.b) for r in S.near_words(words, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_edit_of_one_letter_words():
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaa", "abaaaaaa"]
    got = {tuple(sorted((words[i], words[j]))) for i, j in S.one_edit(words, 7)}
    assert got == {tuple(sorted((a, b))) for a in words for b in words if a < b and _near(a, b) and min(len(a), len(b)) == 7}


def test_odd_rows(spark):
    long = "verlangen " * 60_000 + "verlangem verlangem"
    docs = [(1, None), (2, ""), (None, "Zeitung zeitung zeitunG"), (None, "Zeitung zeitung zeitunG"), (3, long), (4, "zeitang zeitang ×÷×÷×÷× ×÷×÷×÷×")]
    assert _got(spark, docs) == _brute(docs)
    wide = [(*d, "x", 1) for d in docs]
    assert _got(spark, wide, "doc_id long, text string, word string, n int") == _brute(docs)
    assert _got(spark, []) == set() and _got(spark, [(1, None)]) == set()


def test_ties_and_chains(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefx": 20, "zzzzzzz": 2, "zzzzzza": 20, "zzzzzzb": 20}
    docs = [(None, " ".join([w] * n)) for w, n in counts.items()]
    got = {r[0]: r for r in _got(spark, docs)}
    assert got["abcdefg"][1:3] == ("abcdefgh", "abcdefghi") and got["zzzzzzz"][1] == "zzzzzza"
    assert set(got.values()) == _brute(docs)
