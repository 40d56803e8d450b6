"""The pipeline's stages on a small corpus, each against a plain version on its own input."""

import random

import corpus_pipeline as P
from test_jaccard import brute as components
from test_substrings import brute as removed

WORDS = [a + b + c for a in "bcdfghklm" for b in "aeiou" for c in "npqrstvw"]


def corpus(rng):
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, prose(16).capitalize() + ". " + prose(6) + ".") for i in range(6)]
    rows = [(i, prose(rng.randint(20, 120))) for i in range(240)]
    toxic = set(range(0, 240, 6))
    rows = [(i, t.replace(" ", " vexgrumble zoqhatter ", 2) if i in toxic else t) for i, t in rows]
    for i in range(20):
        w = rows[i * 6 + 1][1].split()
        w[len(w) // 2] = "changed"
        rows.append((300 + i, " ".join(w)))
    passage = prose(45)
    rows += [(400 + i, prose(30) + " " + passage + " " + prose(30)) for i in range(6)]
    rows += [(500 + i, prose(30) + " " + items[i][1] + " " + prose(30)) for i in range(5)]
    rows += [(600, ""), (601, None), (602, prose(2500))]
    return rows, items, toxic


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows, items, toxic = corpus(rng)
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{i}")
        docs = spark.read.parquet(f"{sf}/stage{i}")
        seen[name] = (before, docs.collect())
        if i + 1 < len(P.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    _, after = seen["toxicity"]
    assert {i for i, _ in rows} - {r.doc_id for r in after} == toxic
    before, after = seen["ngram_jaccard"]
    kept = {d[1] for d, _, c in components(before, 5, 80) if c == d[1]}
    assert sorted(r.doc_id for r in after) == sorted(kept)
    before, after = seen["substring_dedup"]
    order = sorted(before)
    masks = removed([(i, (t or "").encode()) for i, t in order], 100)
    want = {i: t if t is None else bytes(c for c, m in zip(t.encode(), mask, strict=True) if not m).decode() for (i, t), mask in zip(order, masks, strict=True)}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after if r.text is not None)
    before, after = seen["decontamination"]
    assert {i for i, _ in before} - {r.doc_id for r in after} == set(range(500, 505))
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {i for i, _ in before}
    assert sorted(map(str, P.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(str(r) for r in docs.select("doc_id", "piece", "length", "ids_crc32").collect())


def test_shared_and_null_ids(spark, tmp_path):
    rng = random.Random(13)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    near = lambda t: t + " changed"
    item, a, b, c, d, e, f, g = prose(16).capitalize() + ". " + prose(6) + ".", *(prose(60) for _ in range(7))
    leak, leak2 = prose(20) + " " + item + " " + prose(20), prose(15) + " " + item + " " + prose(25)
    rows = [(1, a), (5, near(a)), (5, b), (6, c), (6, d), (7, e), (7, e), (None, f), (None, near(f)), (None, near(near(f))), (8, near(g)), (None, g), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/near.parquet")
    got = [(r.doc_id, r.text) for r in P.keep_one_of_near_copies(spark, spark.read.parquet(f"{tmp_path}/near.parquet"), str(tmp_path)).collect()]
    kept = [x for x in got if x[1] not in (f, near(f), near(near(f)))]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (5, b), (6, c), (6, d), (7, e), (8, near(g)), (9, ""), (9, ""), (None, None)]))
    assert len(got) == len(kept) + 1
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, leak), (1, a), (None, leak2), (None, b), (2, leak), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/leaks.parquet")
    got = P.drop_leaks(spark, spark.read.parquet(f"{tmp_path}/leaks.parquet"), str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, [(1, a), (None, b), (3, None)]))


def test_clashing_columns_repeats_and_no_rows(spark, tmp_path):
    """Columns named as the stages' own stay as they are; rows repeated whole, nulls and empty tables have their results."""
    rng = random.Random(14)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    sf, item = str(tmp_path), prose(16).capitalize() + ". " + prose(6) + "."
    passage = prose(45)
    rows = [(i, prose(60)) for i in range(30)] + [(40, None), (40, None), (41, ""), (41, ""), (None, prose(50))]
    rows += [(50, prose(30) + " " + item + " " + prose(30))] * 2 + [(60 + i, prose(30) + " " + passage + " " + prose(30)) for i in range(3)] + [(70, passage)]
    rows += [(3, rows[3][1])]
    names = ["score", "_score", "data", "doc", "tie", "found", "_DOC", "_found", "n_bytes", "n_removed", "kept_sha256", "_row", "key", "token", "component_id", "piece", "length"]
    docs = [(i, t, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 5 == 0) for i in range(30)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    given = {tuple(r)[2:]: r for r in docs.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{i}")
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and empty.columns == docs.columns
        before, docs = docs, spark.read.parquet(f"{sf}/stage{i}")
        assert docs.columns == before.columns
        for r in docs.collect():
            was = given[tuple(r)[2:]]
            assert r.doc_id == was.doc_id and (r.text == was.text or name == "substring_dedup" or i > 2), name
        n = {x: docs.where(f"doc_id = {x}").count() for x in (3, 40, 41, 50)}
        assert n == ({3: 2, 40: 2, 41: 2, 50: 2} if i == 0 else {3: 1, 40: 2, 41: 2, 50: 1} if i < 3 else {3: 1, 40: 2, 41: 2, 50: 0}), name
    assert docs.where("doc_id = 70").count() == 0 and docs.where("doc_id is null").count() == 1
    packed = P.pack_sequences(spark, docs, sf)
    assert packed.count() == docs.count() and P.pack_sequences(spark, docs.limit(0), sf).count() == 0


def test_two_results_of_a_stage_live_side_by_side(spark, tmp_path):
    rng = random.Random(15)
    rows, items, toxic = corpus(rng)
    sf, schema = str(tmp_path), "doc_id long, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        a, b = stage(spark, docs, sf), stage(spark, docs.where("doc_id >= 100"), sf)
        n, m = a.count(), b.count()
        assert n > m > 0 and a.count() == n, name


def test_a_very_long_text_goes_through_all_stages(spark, tmp_path):
    rng = random.Random(16)
    sf, prose = str(tmp_path), lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    long = prose(200_000)
    spark.createDataFrame([(1, long), (2, long), (3, prose(50)), (4, prose(40) + long[:400])], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, prose(20))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = P.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert len(long) > 1 << 20 and {r[0] for r in got} == {1, 3, 4} and {r[0]: r[1] for r in got}[1] > 200_000
