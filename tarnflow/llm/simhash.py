"""Near copies by SimHash: fingerprints of 64 bits, linked where 3 bits or fewer differ, exactly.

Pigeonhole: bits are cut into blocks, and a pair that differs in at most 3 of them leaves all blocks but 3 alike, so it
meets in the bucket of one choice of the other blocks. Buckets are joined with themselves and pairs verified by their
Hamming distance. A bucket with many fingerprints is split by the same argument over the bits that it has not fixed: one
of 4 further blocks is alike in every pair. Members are distinct, so a bucket whose free bits run out is small, and the
splitting ends with nothing dropped. Only distinct fingerprints are joined; copies are members of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, materialise, table

SHINGLE, SEED, BITS = 3, 42, 64
#: Bits in which linked fingerprints differ at most; blocks of the first cut; fingerprints of a bucket before it is split.
NEAR, BLOCKS, BUCKET = 3, 6, 512
#: Hashes whose bits are counted at once: a text's length does not bound memory.
_AT_ONCE = 1 << 15
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the XXH64 hashes of the text's word shingles; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    k = min(size, len(words))
    n = len(words) - k + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    hashed, view, counts = xxhash.xxh64_intdigest, memoryview(joined), np.zeros(BITS, np.int64)
    for at in range(0, n, _AT_ONCE):
        to = min(n, at + _AT_ONCE)
        spans = zip(starts[at:to].tolist(), (ends[at + k - 1 : to + k - 1] - 1).tolist(), strict=True)
        h = np.fromiter((hashed(view[i:j], SEED) for i, j in spans), np.uint64, to - at)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the fingerprint of each row of ``docs`` (doc_id, text) as a signed long; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, print long")


def cut(mask: int, parts: int) -> list[int]:
    """The bits of ``mask`` in ``parts`` masks of neighbouring bits, as even as can be; empty ones are left out."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    ends = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(ends, ends[1:], strict=False) if j > i]


def bucket_masks(near: int = NEAR, blocks: int = BLOCKS) -> list[int]:
    """The bits that a bucket fixes: every choice of all blocks but ``near``."""
    every = cut((1 << BITS) - 1, blocks)
    return [sum(x) for x in combinations(every, blocks - near)]


def _long(mask: int) -> int:
    return mask - (1 << BITS) if mask >> 63 else mask


def _bucketed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """A row per fingerprint and mask: (mask, bits, print), ``bits`` those that the bucket fixes."""
    each = F.explode(F.array(*[F.lit(_long(m)) for m in masks])).alias("mask")
    return prints.select("print", each).select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("bits"), "print")


def _pairs(rows: DataFrame, near: int) -> DataFrame:
    b = rows.select("mask", "bits", F.col("print").alias("other"))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    return rows.join(b, ["mask", "bits"]).where((F.col("print") < F.col("other")) & (apart <= near)).select(F.col("print").alias("a"), F.col("other").alias("b"))


def close_pairs(prints: DataFrame, near: int = NEAR, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs ``prints.print`` that differ in ``near`` bits at most, each once."""
    assert bucket >= 1 << near, "a bucket of as many free bits cannot be split"
    spark, found, level = prints.sparkSession, [], 0
    masks = bucket_masks(near, blocks)
    rows = _bucketed(prints, masks)
    while True:
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("rows")).where("rows > 1")
        sizes = materialise(spark, sizes, "simhash-buckets")
        shared = rows.join(sizes, ["mask", "bits"])
        done = F.col("rows") <= bucket
        pairs = materialise(spark, _pairs(shared.where(done).drop("rows"), near), "simhash-pairs")
        found.append(pairs)
        large = sizes.where(~done)
        full = [r["mask"] for r in large.select("mask").distinct().collect()]  # no more than there are masks
        if not full:
            discard(spark, sizes)
            break
        # each mask's free bits are cut anew: a pair of a bucket is alike in one part of near + 1
        finer = {m: [(m % (1 << BITS)) | part for part in cut(~m % (1 << BITS), near + 1)] for m in full}
        finer = {m: x for m, x in finer.items() if x}
        wider = F.create_map(*[c for m, x in finer.items() for c in (F.lit(m), F.array(*[F.lit(_long(y)) for y in x]))])
        split = shared.where(~done).select("print", F.explode(wider[F.col("mask")]).alias("mask")).distinct()
        rows = materialise(spark, split.select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("bits"), "print"), f"simhash-split-{level}")
        discard(spark, sizes)
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def simhash_components(docs: DataFrame, size: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links. A null, empty or wordless text has fingerprint zero and is
    linked like any other; a null doc_id takes part but is a component's id only where no other is; repeated rows are rows
    of one fingerprint; no rows give no rows; other columns are ignored. Whole texts count, whatever their length.
    """
    spark = docs.sparkSession
    prints = materialise(spark, fingerprints(docs, size), "simhash-prints")
    distinct = materialise(spark, prints.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    pairs = close_pairs(distinct.select("print"), near)
    comp = components(spark, pairs)
    placed = distinct.join(comp.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    placed = materialise(spark, placed, "simhash-placed")
    discard(spark, comp, distinct)
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.select("print", "component").join(least, "component").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), BITS // 4, "0"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
