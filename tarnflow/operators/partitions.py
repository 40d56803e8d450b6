"""Spatial blocks, folds, roles and samples."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import DEALT, dealt_join, unit_sphere

ROLE, BLOCK = "role", "block"


def spatial_blocks(df: DataFrame, n_blocks: int, seed: int) -> DataFrame:
    """``df`` with ``block``: clusters of places on the unit sphere, found by Spark's k-means on distinct cells.

    The labels are those of the seeded clustering; what is relied on is that blocks are whole and disjoint.
    """
    if n_blocks < 4:
        raise ValueError("at least four blocks")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x, y, z = unit_sphere(F.round("longitude", 2), F.round("latitude", 2))
    rows = df.where("longitude is not null and latitude is not null").withColumns({"_x": x, "_y": y, "_z": z})
    vectors = VectorAssembler(inputCols=["_x", "_y", "_z"], outputCol="_v").transform(rows)
    model = KMeans(featuresCol="_v", predictionCol=BLOCK, k=n_blocks, seed=seed, maxIter=20).fit(vectors.select("_v"))
    return model.transform(vectors).drop("_x", "_y", "_z", "_v")


def seal_blocks(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``df`` with ``role``: whole blocks drawn until the share of blocks is sealed, at least one and not all."""
    blocks = sorted(r[0] for r in df.select(BLOCK).distinct().collect())
    if len(blocks) < 2:
        raise ValueError("fewer than two blocks")
    n = min(max(1, round(len(blocks) * fraction)), len(blocks) - 1)
    sealed = np.random.default_rng(seed).permutation(blocks)[:n].tolist()
    return df.withColumn(ROLE, F.when(F.col(BLOCK).isin([int(b) for b in sealed]), "sealed").otherwise("model"))


def block_folds(df: DataFrame, n_folds: int, presence) -> DataFrame:
    """``df`` with ``fold``: blocks, the fullest of presences first, go to the lightest fold; background follows."""
    counts = sorted(((-r["n"], r[BLOCK]) for r in df.groupBy(BLOCK).agg(F.count_if(presence).alias("n")).collect()))
    load = [0] * n_folds
    of: dict[int, int] = {}
    for n, b in counts:
        i = min(range(n_folds), key=lambda k: (load[k], k))
        of[b] = i
        load[i] -= n
    fold = F.lit(None).cast("int")
    for b, i in of.items():
        fold = F.when(F.col(BLOCK) == b, i).otherwise(fold)
    return df.withColumn("fold", fold)


def balanced_folds(df: DataFrame, n_folds: int, presence, least: int, attempts: int = 32, seed: int = 0) -> tuple[DataFrame, dict[str, float] | None]:
    """``df`` with ``fold`` and its figures: of seeded assignments of micro-blocks that give every fold ``least`` rows of
    both kinds, that with the least worst, then mean, imbalance; folds are null if none does."""
    rows = [(r[BLOCK], r["p"], r["b"]) for r in df.groupBy(BLOCK).agg(F.count_if(presence).alias("p"), F.count_if(~presence).alias("b")).orderBy(BLOCK).collect()]
    counts = np.array([[p, b] for _, p, b in rows], dtype=float)
    best = None
    for a in range(attempts):
        order = np.random.default_rng(seed + a).permutation(len(rows))
        assigned = np.empty(len(rows), int)
        assigned[order] = np.arange(len(rows)) % n_folds
        got = np.array([counts[assigned == f].sum(0) for f in range(n_folds)])
        if got.min() < least:
            continue
        uneven = got.max(0) / got.mean(0)
        key = (round(float(uneven.max()), 12), round(float(uneven.mean()), 12), assigned.tolist())
        if best is None or key < best:
            best = key
    if best is None:
        return df.withColumn("fold", F.lit(None).cast("int")), None
    fold = F.lit(None).cast("int")
    for (b, _, _), i in zip(rows, best[2], strict=True):
        fold = F.when(F.col(BLOCK) == b, int(i)).otherwise(fold)
    return df.withColumn("fold", fold), {"worst_imbalance": best[0], "mean_imbalance": best[1]}


def _even_assignment(counts: np.ndarray, n_folds: int, rng: np.random.Generator) -> np.ndarray:
    """A fold for each block (a row of counts by kind): blocks shuffled, those of the most uneven kinds first, each to the
    fold that leaves the kinds' shares most even, of equals to the one with the fewest rows."""
    order = rng.permutation(len(counts))
    order = order[np.argsort(-counts[order].std(axis=1), kind="stable")]
    share = counts / np.maximum(counts.sum(0), 1)
    load, rows, out = np.zeros((n_folds, counts.shape[1])), np.zeros(n_folds), np.zeros(len(counts), int)
    for b in order:
        def spread(f: int) -> tuple[float, float, int]:
            grown = load.copy()
            grown[f] += share[b]
            return round(float(grown.std(0).mean()), 12), rows[f], f

        f = min(range(n_folds), key=spread)
        out[b], load[f], rows[f] = f, load[f] + share[b], rows[f] + counts[b].sum()
    return out


def evidence_folds(
    df: DataFrame, n_folds: int, presence: Column, background: str | None = None, least_presence: int = 2,
    least_background: int = 5, least_training: int = 5, attempts: int = 32, seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``df`` with ``fold``, ledger, attempts): micro-blocks dealt to folds by counts of rows alone.

    Every fold must hold ``least_presence`` presences and, of each kind of background named in column ``background``,
    ``least_background`` rows, with ``least_training`` outside it. Of the stratified attempts for which that holds, the
    one with the least worst, then mean, distance from equal counts is taken, ties by the blocks' folds numbered as they
    appear. Only counts by block and kind reach the driver. Too few blocks, a block without presences, no background,
    and no attempt that serves are errors.
    """
    if n_folds < 2 or attempts < 1:
        raise ValueError("at least two folds and one attempt")
    kind = F.when(presence, F.lit("")).otherwise(F.coalesce(F.col(background).cast("string"), F.lit("background")) if background else F.lit("background"))
    got = df.where(F.col(BLOCK).isNotNull()).groupBy(BLOCK, kind.alias("_kind")).agg(F.count("*").alias("n")).collect()
    blocks, kinds = sorted({r[BLOCK] for r in got if r["_kind"] == ""}), sorted({r["_kind"] for r in got})
    if len(blocks) < n_folds or {r[BLOCK] for r in got} != set(blocks) or kinds[:1] != [""] or len(kinds) < 2:
        raise ValueError("every micro-block needs presences, there must be as many as folds, and some background")
    counts = np.zeros((len(blocks), len(kinds)))
    for r in got:
        counts[blocks.index(r[BLOCK]), kinds.index(r["_kind"])] = r["n"]
    tried, best = [], None
    for a in range(attempts):
        fold = _even_assignment(counts, n_folds, np.random.default_rng(seed + a))
        held = np.array([counts[fold == f].sum(0) for f in range(n_folds)])
        rest = counts.sum(0) - held
        serves = (held[:, 0] >= least_presence) & (held[:, 1:] >= least_background).all(1) & (rest[:, 1:] >= least_training).all(1)
        apart = np.abs(held - held.mean(0)) / held.mean(0)
        seen: dict[int, int] = {}
        key = (float(apart.max()), float(apart.mean()), [seen.setdefault(int(f), len(seen)) for f in fold])
        tried.append((a, seed + a, bool(serves.all()), int(serves.sum()), key[0], key[1], ",".join(f"{b}:{f}" for b, f in zip(blocks, fold, strict=True))))
        if serves.all() and (best is None or key < best[0]):
            best = key, fold, held, rest
    if best is None:
        raise ValueError(f"no attempt of {attempts} gives every fold enough rows; at best {max(t[3] for t in tried)} of {n_folds} have them")
    spark, (_, fold, held, rest) = df.sparkSession, best
    of = F.lit(None).cast("int")
    for b, f in zip(blocks, fold, strict=True):
        of = F.when(F.col(BLOCK) == b, int(f)).otherwise(of)
    rows = [(f, kinds[k] or "presence", int(held[f, k]), int(rest[f, k])) for f in range(n_folds) for k in range(len(kinds))]
    ledger = spark.createDataFrame(rows, "fold int, kind string, n_evaluation long, n_training long")
    about = "attempt int, seed long, supported boolean, n_supported_folds int, worst_imbalance double, mean_imbalance double, folds string"
    return df.withColumn("fold", of), ledger, spark.createDataFrame(tried, about)


def blocks_by_key(df: DataFrame, key: str, n_blocks: int, seed: int, rounds: int = 8) -> DataFrame:
    """``df`` with ``block``: for every key by itself at most ``n_blocks`` clusters of its places on the unit sphere.

    Lloyd's steps for all keys together: each is a join of places (hundredths of a degree, once each) with their key's few
    centres, which are copied into shares of the key, and one aggregation by (key, centre), so no key's rows meet in one
    task. Centres start at places drawn by a seeded hash, the first of each share before those of the key; a key with fewer places has as many blocks. Rows without coordinates are left out.
    """
    lon, lat = F.round("longitude", 2), F.round("latitude", 2)
    placed = df.where(F.col(key).isNotNull() & F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).withColumns({"_lon": lon, "_lat": lat})
    x, y, z = unit_sphere(F.col("_lon"), F.col("_lat"))
    places = placed.select(key, "_lon", "_lat").distinct().withColumns({"_x": x, "_y": y, "_z": z})
    order = (F.xxhash64(F.lit(seed), key, "_lon", "_lat"), "_lon", "_lat")
    shared = places.withColumn("_share", F.pmod(F.xxhash64("_lon", "_lat"), F.lit(DEALT)))
    first = shared.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_share").orderBy(*order))).where(F.col("_i") <= n_blocks).drop("_share")
    centres = first.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_i") <= n_blocks)
    apart = lambda c: F.round((F.col("_x") - c["_x"]) ** 2 + (F.col("_y") - c["_y"]) ** 2 + (F.col("_z") - c["_z"]) ** 2, 12)

    def nearest(rows: DataFrame, now: DataFrame) -> DataFrame:
        few = now.groupBy(key).agg(F.collect_list(F.struct("_i", "_x", "_y", "_z")).alias("_c"))  # n_blocks at most
        return dealt_join(rows, few, [key], ["_lon", "_lat"]).withColumn(BLOCK, F.array_min(F.transform("_c", lambda c: F.struct(apart(c).alias("d"), c["_i"].alias("i"))))["i"]).drop("_c")

    for _ in range(rounds):
        centres = nearest(places, centres).groupBy(key, F.col(BLOCK).alias("_i")).agg(*[F.round(F.avg(c), 12).alias(c) for c in ("_x", "_y", "_z")])
    a, b, c = unit_sphere(F.col("_lon"), F.col("_lat"))
    return nearest(placed.withColumns({"_x": a, "_y": b, "_z": c}), centres).select(*[x for x in df.columns if x != BLOCK], BLOCK)


def seal_by_key(df: DataFrame, key: str, fraction: float, seed: int, least_rows: int = 4) -> DataFrame:
    """``df`` with ``role``: of every key's blocks a share, at least one and not all, is sealed, drawn by a seeded hash.

    Keys with fewer than ``least_rows`` rows, or with one block, cannot be split and are left out. Blocks are few, so the
    window is over their table alone.
    """
    by_block = df.where(F.col(key).isNotNull() & F.col(BLOCK).isNotNull()).groupBy(key, BLOCK).agg(F.count("*").alias("_rows"))
    every = Window.partitionBy(key)
    nth = F.row_number().over(every.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col(BLOCK).cast("string"))), BLOCK))
    blocks = by_block.withColumns({"_nth": nth, "_n": F.count("*").over(every), "_all": F.sum("_rows").over(every)}).where((F.col("_all") >= least_rows) & (F.col("_n") > 1))
    sealed = F.least(F.greatest(F.lit(1), F.rint(F.col("_n") * F.lit(float(fraction)))), F.col("_n") - 1)
    roles = blocks.select(key, BLOCK, F.when(F.col("_nth") <= sealed, "sealed").otherwise("model").alias(ROLE))
    return df.drop(ROLE).join(roles, [key, BLOCK]).select(*[c for c in df.columns if c != ROLE], ROLE)


def seal_background(df: DataFrame, n_blocks: int, fraction: float, seed: int) -> DataFrame:
    """``df`` with ``block`` and ``role``: reference background held out by places, without a look at sealed presences.

    Fewer than four rows, or two on a side, are errors.
    """
    out = seal_by_key(blocks_by_key(df.withColumn("_all_rows", F.lit(1)), "_all_rows", n_blocks, seed), "_all_rows", fraction, seed).drop("_all_rows")
    n, sealed = out.agg(F.count("*"), F.count_if(F.col(ROLE) == "sealed")).first()
    if n < 4 or min(sealed, n - sealed) < 2:
        raise ValueError("too little background for a sealed reference")
    return out


def split_taxa(taxa: Sequence[str], fraction: float, seed: int) -> tuple[list[str], list[str]]:
    """Discovery and validation taxa: the sorted taxa shuffled by a seed, at least one validated and two left."""
    names = np.array(sorted(set(taxa)), dtype=object)
    if len(names) < 3:
        raise ValueError("fewer than three taxa")
    np.random.default_rng(seed).shuffle(names)
    n = min(max(1, round(len(names) * fraction)), len(names) - 2)
    return sorted(names[n:].tolist()), sorted(names[:n].tolist())


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], identity: Sequence[str], seed: int) -> DataFrame:
    """At most ``n`` rows of each key without replacement, by a seeded hash of their identity.

    Rows whose hash cannot be among the first are dropped before the ranking, so that a key of any size is ranked on
    about twice the sample; a key that the cut leaves short is ranked whole.
    """
    h = F.xxhash64(F.lit(seed), *identity)
    share = F.pmod(h, F.lit(1 << 40)) / float(1 << 40)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = df.withColumn("_u", share).join(sizes, list(keys))
    near = rows.where(F.col("_u") <= F.lit(2.0 * n + 50) / F.col("_n"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_u", *identity))
    first = near.withColumn("_k", nth).where(F.col("_k") <= n)
    enough = first.groupBy(*keys).agg(F.count("*").alias("_got")).join(sizes, list(keys)).where(F.col("_got") < F.least(F.col("_n"), F.lit(n))).select(*keys)
    whole = rows.join(enough, list(keys), "left_semi").withColumn("_k", nth).where(F.col("_k") <= n)
    return first.join(enough, list(keys), "left_anti").unionByName(whole).select(*df.columns)


def contiguous_chunks(names: Sequence[str], k: int) -> list[list[str]]:
    """``k`` runs of a sorted catalogue without repeats, as even as can be."""
    if not names or len(set(names)) != len(names) or list(names) != sorted(names):
        raise ValueError("a catalogue is sorted, not empty and without repeats")
    n = len(names)
    return [list(names[n * i // k : n * (i + 1) // k]) for i in range(k)]


def seed_of(*parts: object) -> int:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
