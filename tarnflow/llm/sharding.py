"""Size-balanced sharding with sampled splitters.

A size-weighted sample of the key (a hash of the text, so equal texts lie side by side) gives quantile boundaries;
records are range-partitioned by them, overfull ranges are subdivided, and whole ranges go to shards so that their
bytes are near equal. The law kept is ``bytes``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Ranges for each shard, at least; the largest bytes of a range; sample draws for each range.
RANGES_PER_SHARD, RANGE_BYTES, DRAWS = 24, 1 << 30, 12
_KEY_BITS = 62


def _sample(rows: DataFrame, draws: float, total: int) -> np.ndarray:
    """Sorted keys drawn with a chance in proportion to size; a hash decides, so a rerun draws the same."""
    chance = F.pmod(F.xxhash64(F.lit(7), "doc_id", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(chance < F.col("size") * F.lit(draws / max(total, 1))).select("key")
    return np.sort(np.array([r[0] for r in drawn.toLocalIterator()], dtype=np.int64))


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    if len(keys) == 0 or parts < 2:
        return np.zeros(0, np.int64)
    return np.unique(keys[(np.arange(1, parts) * len(keys)) // parts])


def _ranges(cuts: np.ndarray, heavy: np.ndarray, parts: np.ndarray):
    """A key's range: that of the splitters, or for a key heavier than a range one of its own pieces."""
    base = len(cuts) + 1 + np.cumsum(parts) - parts

    def place(key: pd.Series, salt: pd.Series) -> pd.Series:
        k = key.to_numpy()
        out = np.searchsorted(cuts, k, side="right").astype(np.int64)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, k), len(heavy) - 1)
            hit = heavy[at] == k
            out[hit] = base[at[hit]] + salt.to_numpy()[hit] % parts[at[hit]]
        return pd.Series(out)

    return F.pandas_udf(place, "long")


def _lookup(values: np.ndarray):
    def take(at: pd.Series) -> pd.Series:
        return pd.Series(values[at.to_numpy()])

    return F.pandas_udf(take, "long")


def shard(docs: DataFrame, shards: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Equal texts share a shard unless they outweigh a shard's equal part. A null text counts as empty for the key and the checksum,
    with size 16; repeated rows each get a slot, and are dealt like others where their group is split; null ids are kept;
    no rows give no rows; other columns are ignored. Which part of a split group a row joins depends on where it was read.
    The driver holds the splitters alone: ``RANGES_PER_SHARD`` a shard, or one a ``RANGE_BYTES``.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(1 << _KEY_BITS)).alias("key"),
        # of the row, not of its id: ids may be shared or null. It is written, so that no later read draws it anew
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), id_col), F.lit(1 << 40)).alias("salt"),
    )
    rows = materialise(spark, rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    limit = max(1, 2 * total // wanted)
    # a key (a group of equal texts) over the limit cannot be cut by splitters; there are at most total / limit of them.
    # Each is a range by itself, or several if it outweighs a whole shard
    heavy_rows = rows.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) & (F.col("n") > 1)).orderBy("key").collect()
    heavy = np.array([r[0] for r in heavy_rows], dtype=np.int64)
    parts = np.array([1 if r[1] * shards <= total else -(-r[1] * 2 // limit) for r in heavy_rows], dtype=np.int64)
    cuts = _quantiles(_sample(rows, wanted * DRAWS, total), wanted)
    for _ in range(4):
        placed = rows.withColumn("range", _ranges(cuts, heavy, parts)("key", "salt"))
        sizes = {r[0]: (r[1], r[2]) for r in placed.groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
        over = [r for r, (b, n) in sizes.items() if r <= len(cuts) and b > limit and n > 1]
        if not over:
            break
        inside = _sample(placed.where(F.col("range").isin(over)), sum(sizes[r][0] for r in over) * 4 * DRAWS / limit, sum(sizes[r][0] for r in over))
        at = np.searchsorted(cuts, inside, side="right")
        finer = [_quantiles(inside[at == r], 2 * -(-sizes[r][0] // limit)) for r in over]
        more = np.unique(np.concatenate([cuts, *finer]))
        if len(more) == len(cuts):
            break
        cuts = more
    # whole ranges go to the lightest shard, largest first; slots follow the ranges of a shard
    load, fill = [(0, s) for s in range(shards)], [0] * shards
    where, first = np.zeros(max(sizes, default=0) + 1, np.int64), np.zeros(max(sizes, default=0) + 1, np.int64)
    for r, (b, n) in sorted(sizes.items(), key=lambda x: (-x[1][0], x[0])):
        bytes_now, s = heapq.heappop(load)
        where[r], first[r] = s, fill[s]
        fill[s] += n
        heapq.heappush(load, (bytes_now + b, s))
    in_range = Window.partitionBy("range").orderBy("key", "doc_id")
    return placed.withColumn("nth", F.row_number().over(in_range)).select(
        "doc_id", "size", "text_crc32", _lookup(where)("range").cast("int").alias("shard"), (_lookup(first)("range") + F.col("nth") - 1).alias("slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
