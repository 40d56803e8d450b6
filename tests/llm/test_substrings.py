import hashlib
import random

import numpy as np

from tarnflow.llm import substrings as S


def brute(rows, width):
    """rows: (key, bytes) in document order; the removed mask of each."""
    seen, out = set(), []
    for _, data in rows:
        mask = bytearray(len(data))
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                mask[i : i + width] = b"\x01" * width
            seen.add(w)
        out.append(bytes(mask))
    return out


def test_collection_bwt_orders_suffixes():
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh", "".join(map(chr, range(256)))):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).encode("latin-1") for _ in range(25)] + [b"", b"aaaaaaaa", b"aaaaaaaa"]
        text, length, common = S.collection_bwt(texts)
        got = [texts[t][len(texts[t]) - n :] for t, n in zip(text, length, strict=True)]
        assert got == sorted(got) and len(set(zip(text.tolist(), length.tolist(), strict=True))) == sum(map(len, texts)) + len(texts)
        for i in range(len(texts), len(got)):
            a, b = got[i - 1], got[i]
            k = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert common[i] == k


def test_segments_cover_every_window_once():
    rng = random.Random(5)
    for n in (0, 99, 100, 101, 500, 3000):
        data = bytes(rng.choice(b"abcd ") for _ in range(n))
        _, _, first, windows = S.segments(data)
        assert sum(windows.tolist()) == max(0, n - 99)
        assert first.tolist() == np.r_[0, np.cumsum(windows)][: len(first)].tolist()


def test_segments_of_long_texts():
    rng = random.Random(6)
    block = (1 << 20) - 100
    text = rng.randbytes(2_300_000)
    for n in (block - 1, block, block + 1, block + 98, block + 99, block + 100, 1 << 20, 2 * block + 99, 2 * block + 100, len(text)):
        data = text[:n]
        mer, seg, first, windows = S.segments(data)
        assert first.tolist() == np.r_[0, np.cumsum(windows)][:-1].tolist() and sum(windows.tolist()) == n - 99
        # each window by itself has the k-mer of the segment it lies in, and a segment's text by itself its hash
        near = [i for b in range(0, n, block) for i in range(b - 120, b + 120) if 0 <= i <= n - 100] + [n - 100] + rng.sample(range(n - 99), 200)
        for i in near:
            k = int(np.searchsorted(first, i, side="right")) - 1
            assert S.segments(data[i : i + 100])[0].tolist() == [mer[k]], (n, i)
            assert S.segments(data[first[k] : first[k] + windows[k] + 99])[1].tolist() == [seg[k]], (n, i)


def test_long_document_against_brute_force(spark):
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh ", k=2_200_000))
    block = (1 << 20) - 100
    rows = [(1, long), (2, "x" + long[block - 200 : block + 300] + "y" + long[2 * block - 60 : 2 * block + 60]), (3, long[-150:]), (4, long[: 1 << 20])]
    _check(spark, rows, S.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect())


def _docs():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(40), prose(3)
    rows = [(i, prose(rng.randint(0, 80))) for i in range(40)]
    rows += [(100 + i, prose(rng.randint(0, 20)) + passage + prose(rng.randint(0, 20))) for i in range(15)]
    rows += [(200 + i, passage[i : i + 150]) for i in range(0, 60, 7)]
    rows += [(300, "a" * 700), (301, "ab" * 300), (302, "a" * 99), (303, "a" * 100), (304, ""), (305, None), (306, (line + "\n") * 60)]
    base = prose(120)
    for i in range(30):
        w = base.split()
        w[rng.randrange(120)] = word()
        rows.append((400 + i, " ".join(w)))
    rows += [(500 + i, rows[3][1] + passage) for i in range(5)]
    return rows


def _check(spark, rows, got):
    order = sorted(rows, key=lambda r: r[0])
    data = [(i, (t or "").encode()) for i, t in order]
    masks = dict(zip([i for i, _ in data], brute(data, 100), strict=True))
    assert len(got) == len(rows)
    for r in got:
        d, m = dict(data)[r.doc_id], masks[r.doc_id]
        kept = bytes(c for c, x in zip(d, m, strict=True) if not x)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(d), sum(m), hashlib.sha256(kept).hexdigest()), r.doc_id
        assert r.n_spans == sum(1 for j in range(len(m)) if m[j] and not (j and m[j - 1]))


def test_against_brute_force(spark):
    rows = _docs()
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, data string, tie int").repartition(5)
    got = S.remove_duplicates(docs)
    assert "text" in got.columns
    _check(spark, rows, got.collect())


def test_frequent_kmers(spark, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 2)
    monkeypatch.setattr(S, "SAMPLE_DOCS", 60)
    rows = _docs()
    _check(spark, rows, S.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect())


def test_crowded_kmers(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 2)
    rows = _docs()
    _check(spark, rows, S.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect())


def test_repeats_nulls_and_nothing(spark):
    t = "the same long text " * 9
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed, r.text is None) for r in S.remove_duplicates(docs).collect())
    inside = sum(brute([(0, t.encode())], 100)[0])
    assert got == [(False, 0, inside, False), (True, 1, len(t), False), (True, 1, len(t), False), (True, 2, 0, False), (True, 2, 0, True)]
    assert S.remove_duplicates(docs.limit(0)).count() == 0
