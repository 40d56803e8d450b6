import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnflow.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [7, 10, 37, 100, 2048])
def test_plans_hold_every_item(capacity):
    rng = random.Random(capacity)
    for n in (1, 2, 5, 40, 300):
        counts = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3)), capacity]) for _ in range(n))
        held, bins = Counter(), 0
        for items, times in K.plan(dict(counts), capacity):
            assert sum(items) <= capacity
            bins += times
            for w in items:
                held[w] += times
        assert held == counts
        assert bins >= -(-sum(w * c for w, c in counts.items()) // capacity)


def least_bins(items, capacity):
    """By trying every place, for small instances."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {*bins}:
            if room >= items[i]:
                left = list(bins)
                left.remove(room)
                go(i + 1, [*left, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_fixed_sets_never_cost_a_bin():
    rng = random.Random(2)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fixed, left = K.reduce_instance(dict(Counter(items)), 20)
        rest = [w for w, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + (least_bins(rest, 20) if rest else 0) == least_bins(items, 20)


def test_words_held_are_bounded(monkeypatch):
    monkeypatch.setattr(K, "CACHE_WORDS", 100)
    held, plain = K._Words(PATH), Tokenizer.from_file(PATH)
    letters = "bcdfghklmn"
    words = [a + b + c + "ar" for a in letters for b in letters for c in letters]
    for i in range(0, 600, 60):
        own = {*words[i : i + 60], "again"}
        held.learn(own)
        assert len(held) <= 101 and own <= held.keys()
        for w in own:
            assert held[w] == np.array(plain.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_tokens_are_the_tokenizers():
    held = Tokenizer.from_file(PATH)
    texts = ["", " a  b\t", "Hello, WORLD.!\r\nit's I'LL", "İstanbul ΑΣ straße ﬁ é 漢字", "x<|endoftext|>y <|STARTOFTEXT|>", "q" * 3000]
    texts += [" ".join("w" + chr(i) + "Z." for i in range(33, 500))]
    for t, got in zip(texts, K.token_bytes(texts, PATH), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == held.encode(t, add_special_tokens=False).ids


def test_pieces_are_cut_as_the_tokenizer_cuts():
    held, rng = Tokenizer.from_file(PATH), random.Random(4)
    every = [chr(i) for i in range(1, 256)]
    some = [*"sSdmtT'’eELlVvr.,|<>% \n\t09²½éÉßµªÿ×\xa0\x85\x1cœΣ\u0301漢", "'s", "'LL", "<|", "|>", "<|endoftext|>", "word", "Élan", "  "]
    texts = ["".join(rng.choices(every, k=60)) for _ in range(300)] + ["".join(rng.choices(some, k=25)) for _ in range(1500)]
    texts += [f"a{x}b {x} 1{x}'s" for x in every] + ["\u0301", " \u0301x", "e\u0301 <|", "<|endoftext|> <|endoftext|>"]
    for t, got in zip(texts, K.token_bytes(texts, PATH), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == held.encode(t, add_special_tokens=False).ids, repr(t)


def counted(monkeypatch, held):
    """What ``held`` gives to the tokenizer from now on."""
    merge, encode, seen = held.merge, held.encode, Counter()
    monkeypatch.setattr(held, "merge", lambda w: (seen.update([w]), merge(w))[1])
    monkeypatch.setattr(held, "encode", lambda w, **k: (seen.update([w]), encode(w, **k))[1])
    return seen


def test_forms_of_a_word_are_learnt_once(monkeypatch):
    K._words.cache_clear()
    seen = counted(monkeypatch, K._words(PATH))
    K.token_bytes(["Blorvane blorvane, BLORVANE; (blorvane) blorvane's", "blorvane.%%% <blorvane>\tblorvane"], PATH)
    K._words.cache_clear()
    assert seen["blorvane"] == 1 and not any("blorvane" in w.lower() for w in seen if w != "blorvane")


def test_words_wanted_again_stay(monkeypatch):
    monkeypatch.setattr(K, "CACHE_WORDS", 100)
    held = K._Words(PATH)
    seen = counted(monkeypatch, held)
    letters = "bcdfghklmn"
    words = [a + b + c + "ar" for a in letters for b in letters for c in letters]
    for i in range(0, 600, 30):  # every third group makes others go; this one is in the two before it only
        held.learn({*words[i : i + 30], *(["again"] if i // 30 % 3 else [])})
        assert len(held) <= 100
    assert seen["again"] == 1


def test_documents_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(K, "RANK_ROWS", 5)
    rows = [(i, "word " * (i * 53 % 700)) for i in range(120)] + [(900, None), (901, ""), (902, "long " * 5000), (3, "twice"), (3, "twice"), (None, "no id")]
    rows += [(1000 + i, "hot length here") for i in range(100)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(4)
    got = K.pack_documents(docs, PATH).collect()
    held = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = [*held.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], dtype="<u4")
            want[(i, p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_nothing(spark):
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
