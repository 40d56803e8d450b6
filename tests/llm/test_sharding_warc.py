import base64
import hashlib
import io
import zlib
from collections import Counter, defaultdict

import pytest

from tarnflow.llm.common import scratch_path
from tarnflow.llm.sharding import shard
from tarnflow.llm.warc import _record, read_archives, records_in, write_archives

DOCS = "doc_id long, text string, size string, shard int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in rows], DOCS)


def test_shard_whole_and_balanced(spark):
    rows = [(i, "w" * (i * 37 % 900)) for i in range(3000)] + [(9000 + i, "copy" * 20) for i in range(1500)] + [(7, "again"), (7, "again"), (8, None), (None, "")]
    got = shard(_docs(spark, rows).repartition(5), 8).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    load, slots = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(load) == 8 and max(load.values()) < 1.03 * sum(load.values()) / 8 and min(load.values()) > 0.97 * sum(load.values()) / 8
    homes = defaultdict(set)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        if r.doc_id is not None and r.doc_id < 3000 and r.doc_id not in (7, 8):
            homes[t].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_shard_splits_groups_of_shared_and_null_ids(spark):
    for shared in (None, 5):
        rows = [(i, f"{i} " + "w" * 350) for i in range(800)] + [(shared, "copy" * 40)] * 4000 + [(900, "long " * 300_000)]
        got = shard(_docs(spark, rows).repartition(5), 8).collect()
        load, slots = defaultdict(int), defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            if r.doc_id != 900:
                load[r.shard] += r["size"]
        assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        alone = next(r.shard for r in got if r.doc_id == 900)
        rest = [v for s, v in load.items() if s != alone]
        assert len(rest) == 7 and max(rest) < 1.03 * sum(rest) / 7 and min(rest) > 0.97 * sum(rest) / 7


def test_shard_empty_and_one(spark):
    assert shard(_docs(spark, []), 4).count() == 0
    assert [tuple(r) for r in shard(_docs(spark, [(1, "é")]), 4).select("doc_id", "size", "slot").collect()] == [(1, 18, 0)]
    with pytest.raises(ValueError):
        shard(_docs(spark, []), 0)


def test_reader_owns_by_start():
    data = b"".join(_record(i, f"http://u/{i}", "x\x1f" * i * 13, None if i % 3 else 7, 4) for i in range(60))
    for step in (1, 13, 500, len(data)):
        got = [r["page_id"] for s in range(0, len(data), step) for r in records_in(io.BytesIO(data), len(data), s, min(len(data), s + step), chunk=64)]
        assert got == list(range(60))


def test_reader_refuses_false_magic():
    fake = b"\x1f\x8b\x08" + bytes(40) + zlib.compress(b"nothing")
    other = (z := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(b"no archive here") + z.flush()
    data = fake + _record(1, "u", "one", None, 4) + other + fake + _record(2, "u", "two", None, 4) + fake
    assert [r["page_id"] for r in records_in(io.BytesIO(data), len(data), 0, len(data))] == [1, 2]


def test_archive_round_trip(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 == 0 else "p" * (i * 991 % 5000), "extra") for i in range(200)]
    rows += [(500, None, None, None), (501, "u", "", None), (7, "again", "p" * (7 * 991 % 5000), None), (None, "u", "no id", None), (502, "u", "é" * 200_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = write_archives(pages.repartition(3), scratch_path(spark, "w"))
    got = read_archives(manifest, split_bytes=700).collect()
    last = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    want = Counter()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        refers = last[p] if i is not None and i < last[p] else None
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = {i: (h or "").encode() for i, _, h, _ in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")


def test_archive_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(pages, scratch_path(spark, "w"))).count() == 0


def test_groups_up_to_a_shard_stay_whole(spark):
    """A group of equal texts of 0.2 to 0.95 of a shard lies in one shard; only one over a shard is dealt out."""
    rows = [(i, f"{i} " + "w" * (i * 37 % 300)) for i in range(4000)]
    total, n = sum(len(t) + 16 for _, t in rows), 10_000
    for k, share in enumerate((0.2, 0.5, 0.95)):
        copy = "abc"[k] * 84
        rows += [(n + i, copy) for i in range(int(share * total / 10 / 100))]
        n += 10_000
    rows += [(n + i, "z" * 84) for i in range(int(2.5 * total / 10 / 100))]
    text_of = dict(rows)
    got = shard(_docs(spark, rows).repartition(6), 12).collect()
    homes, load = defaultdict(set), Counter()
    for r in got:
        homes[text_of[r.doc_id]].add(r.shard)
        load[r.shard] += r["size"]
    assert [t[0] for t, h in homes.items() if len(h) > 1] == ["z"]
    assert max(load.values()) < 1.02 * sum(load.values()) / 12 and min(load.values()) > 0.98 * sum(load.values()) / 12
