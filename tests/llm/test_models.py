import random

import numpy as np

from tarnflow.llm import decontamination as D
from tarnflow.llm import quality as Q
from tarnflow.llm import toxicity as X
from tarnflow.llm.fitting import labelled_sample


def _words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") + rng.choice("aeiou") for _ in range(n)]


def test_wand_equals_full_scoring():
    rng = random.Random(4)
    items = [(i, " ".join(_words(rng, 30)) + ". " + " ".join(_words(rng, 6)) + ".") for i in range(90)]
    index = D.Index(items + [(900, ""), (901, None)])
    for i in range(60):
        text = " ".join(_words(rng, 40)) + (items[i][1] if i % 2 else "")
        ids = np.unique([index.terms[w] for w in D.words(text) if w in index.terms])
        score = np.zeros(len(index.items))
        for t in ids:
            score[index.docs[t]] += index.impacts[t]
        for threshold in (0.15, 0.3, 0.5):
            assert sorted(d for d, _ in index.search(ids, threshold)) == np.flatnonzero(score >= threshold - 1e-6).tolist()
    assert index.search(np.zeros(0, int)) == []


def test_leaks_found_and_clean_left(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(_words(rng, 20)).capitalize() + ".\n" + " ".join(_words(rng, 7)) + ".") for i in range(40)] + [(77, None), (78, "")]
    prose = lambda n: " ".join(_words(rng, n))
    docs = [(i, prose(rng.randint(0, 300)) + " " + items[i][1].upper().replace(" ", "  ") + " " + prose(rng.randint(0, 300))) for i in range(25)]
    docs += [(100 + i, prose(400) + " ".join(items[i][1].split()[:4]) + prose(50)) for i in range(25)]
    docs += [(200, items[3][1].split("\n")[0] + prose(30)), (300, None), (301, ""), (None, items[5][1]), (4, items[4][1]), (4, items[4][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, i) for i in range(25)] + [(-1, 5), (4, 4), (4, 4)])
    for size in (1 << 19, 500):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in D.find_leaks(frame, bench).collect())
        assert got == want
    assert D.find_leaks(frame, bench.limit(0)).count() == 0 and D.find_leaks(frame.limit(0), bench).count() == 0


def test_leaks_do_not_depend_on_index_parts(spark, monkeypatch):
    rng = random.Random(9)
    common, rare = _words(rng, 12), _words(rng, 400)
    mixed = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(mixed(rng.randint(6, 40))) + ". " + " ".join(mixed(rng.randint(2, 8))) + ".") for i in range(60)]
    docs = []
    for i in range(180):
        w = items[i % 60][1].split()
        for _ in range(len(w) // 8 + i % 3):
            w[rng.randrange(len(w))] = rng.choice(rare)
        docs.append((i, " ".join(mixed(rng.randint(0, 60)) + w + mixed(rng.randint(0, 60)))))
    index = D.Index(items)
    want = sorted((i, x[0], round(x[1], 9), *x[2:]) for i, t in docs for x in index.verified(t))
    assert 20 < len({i for i, *_ in want}) < 180
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (1 << 19, 1500):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        got = D.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r[0], r[1], round(r[2], 9), *r[3:]) for r in got) == want


def test_toxic_words_are_learnt(spark):
    rng = random.Random(8)
    bad = ["vexgrumble", "zoqhatter", "wibblescorn"]
    texts, labels = [], []
    for i in range(600):
        w = _words(rng, 60)
        if i % 4 == 0:
            for b in rng.sample(bad, 2):
                w[rng.randrange(60)] = b
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = X.train(texts[:400], labels[:400])
    s = model.scores(texts[400:])
    assert ((s >= X.THRESHOLD) == np.array(labels[400:])).mean() > 0.97
    docs = spark.createDataFrame([(1, texts[0], 5), (1, texts[0], 5), (2, None, 5), (3, "", 5), (4, texts[1] * 500, 5)], "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert got[1] > 0.5 and got[2] == got[3] < 0.5 and 0 <= got[4] <= 1
    assert X.score(docs.limit(0), model).count() == 0
    assert X.train([], []).scores(["x"])[0] == 0.5 and X.train(["a", "b"], [1, 1]).scores(["x"])[0] > 0.5


def test_rules_separate_and_compile(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(_words(rng, rng.randint(5, 60))) if i % 3 else " ".join(w + "!!" for w in _words(rng, 30))) for i in range(600)]
    docs = spark.createDataFrame([*rows, (7000, None), (7001, ""), (7002, "x" * 100000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i, _ in rows] + [(8000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    assert 0 < len(model.rules) < 80
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert len(got) == 603 and all((got[i] >= 0.7) == bool(i % 3) for i in range(600)) and all(0 <= s <= 1 for s in got.values())
    assert Q.score(docs.limit(0), model).count() == 0
    assert Q.fit(docs, labels.limit(0)).rules == []


def test_sample_is_bounded_and_never_held_out(spark):
    import zlib

    docs = spark.createDataFrame([(i, str(i)) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "quality", 300, ["text"]).collect()
    assert 200 < len(got) <= 300 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r["_label"] == r.doc_id % 2 for r in got)


def test_rule_column_equals_rules_in_numpy(spark):
    """The compiled column gives each row, whatever its columns, the score of the rules evaluated one by one."""
    rng = random.Random(15)
    texts = [" ".join(_words(rng, rng.randint(0, 60))) for _ in range(300)]
    texts = [("### !! " * (i % 7) + t) if i % 3 == 0 else t.upper() if i % 11 == 0 else t for i, t in enumerate(texts)] + ["", None, "a" * 3_000_000, "x\ny\n\n x", texts[0]]
    docs = spark.createDataFrame([(i, t, "k", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, words string, chars double")
    rows = Q.with_statistics(docs, ["doc_id"]).collect()
    names = list(Q.statistics(docs.text))
    x = {n: np.array([r[n] for r in rows]) for n in names}
    y = np.array([float("#" in (t or "") or (t or "").isupper()) for t in texts])
    model = Q.train(x, y)
    assert model.rules
    z = model.intercept + sum(w * np.all([(x[s] > c) if above else (x[s] <= c) for s, above, c in r.parts], axis=0) for r, w in model.rules)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], 1 / (1 + np.exp(-z)), atol=1e-12)
    assert got[0] == got[len(texts) - 1] and got[300] == got[301]
    assert Q.score(docs.limit(0), model).count() == 0


def test_statistics_by_hand(spark):
    t = "Ab cd ab,\ncd ab! ééé 12\n\nAb cd ab,"
    r = Q.with_statistics(spark.createDataFrame([(1, t)], "doc_id long, text string"), ["doc_id"]).first()
    words = t.split()
    pairs = list(zip(words, words[1:], strict=False))
    assert (r["chars"], r["words"], r["longest_word"]) == (len(t), len(words), 3)
    assert r["distinct_words"] == len(set(words)) / len(words) and r["distinct_lines"] == 2 / 3
    assert r["short_words"] == sum(len(w) <= 3 for w in words) / len(words)
    assert np.isclose(r["repeats"], 1 - len({*pairs, (words[-1],)}) / len(words))
    assert r["digits"] == 2 / len(t) and np.isclose(r["wide"], 3 / len(t)) and r["exclaim"] == 1 / len(t)


def test_lasso_is_optimal():
    """Zero weights have a gradient within the penalty, others one of just the penalty against their sign."""
    rng = np.random.default_rng(3)
    a = (rng.random((400, 25)) < 0.3).astype(float)
    y = (a[:, 0] + a[:, 1] - a[:, 2] + rng.normal(0, 0.5, 400) > 0.5).astype(float)
    w = Q.lasso_logistic(a, y, 0.01, rounds=20_000)
    g = a.T @ (1 / (1 + np.exp(-(w[0] + a @ w[1:]))) - y) / len(y)
    on = w[1:] != 0
    assert 0 < on.sum() < 25 and np.all(np.abs(g[~on]) <= 0.01 + 1e-5) and np.allclose(g[on], -0.01 * np.sign(w[1:][on]), atol=1e-4)


def test_windows_by_plain_compression(spark):
    """Each window's lengths are those that a fresh compressor with the same dictionary gives, on repeats and long texts too."""
    rng = random.Random(16)
    bad = ["vexgrumble", "zoqhatter"]
    texts = [" ".join(_words(rng, 40) + ([rng.choice(bad)] * 3 if i % 3 == 0 else [])) for i in range(240)]
    model = X.train(texts, [int(i % 3 == 0) for i in range(240)])
    long = " ".join(_words(rng, 300_000))
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (3, None), (4, ""), (None, texts[3]), (5, long)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, data string")
    got = X.score(docs, model, "_s").collect()
    assert all(r.score == 0.5 and r.data == "x" for r in got) and len(got) == len(rows)
    for r in got:
        w = (r.text or "").lower().split()
        d = []
        for i in range(0, len(w), X.WINDOW_WORDS):
            body = X._MARK + b" " + " ".join(w[i : i + X.WINDOW_WORDS]).encode() + b" "
            if i < 4000:
                d.append(len(X._compressor(model.ordinary).compress(body)) - len(X._compressor(model.toxic).compress(body)))
        if len(w) < 4000:
            top = sorted(d, reverse=True)[:3]
            hits = [sum(x >= k for x in d) for k in (2, 3, 4, 5)]
            f = [min(top[0], 8), np.mean(d), np.mean(top), hits[0] / len(d), hits[1] / len(d), *np.log1p(hits[1:]), np.log1p(sum(max(x - 1, 0) for x in d))] if d else [0.0] * 9
            z = model.weights[0] + ((np.array(f) - model.centre) / model.scale) @ model.weights[1:]
            assert np.isclose(r["_s"], 1 / (1 + np.exp(-z)), atol=1e-9)
    assert X.score(docs.limit(0), model).count() == 0


def test_leaks_in_very_long_and_tied_texts(spark):
    rng = random.Random(17)
    items = [(i, " ".join(_words(rng, 20)).capitalize() + ". " + " ".join(_words(rng, 7)) + ".") for i in range(30)] + [(99, None)]
    items.append((50, items[4][1]))  # two items of one text
    long = " ".join(_words(rng, 150_000)) + " " + items[4][1] + " " + " ".join(_words(rng, 150_000))
    docs = spark.createDataFrame([(1, long, 7.0), (2, long[:2_000_000], 7.0), (3, items[2][1], 7.0)], "doc_id long, text string, score double")
    got = sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    want = sorted((r[0], i) for r in docs.collect() for i, t in items if t and t in r[1])
    assert got == want and (1, 50) in got and (3, 2) in got
