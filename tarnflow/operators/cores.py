"""Process cores: found in some taxa, held against unseen ones, beside the full set and random cores of equal size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import TOLERANCE, finite, positive_fraction, ratio

from .models import ModelSpec, Task, fit_tasks, score_tasks
from .metrics import presence_rank
from .partitions import seed_of, split_taxa


def core_members(frequency: DataFrame, case: Sequence[str], process: str, share: str, least: float = 0.25, top: int | None = 6) -> DataFrame:
    """The rows of ``frequency`` that make each case's core: at least that ``share``, the ``top`` of them by share, then
    by name. A case where none is frequent enough takes its most frequent process, so that a core is never empty."""
    nth = F.row_number().over(Window.partitionBy(*case).orderBy(F.desc(share), process))
    most = F.lit(True) if top is None else F.col("_nth") <= top
    return frequency.withColumn("_nth", nth).where((most & (F.col(share) >= least - TOLERANCE)) | (F.col("_nth") == 1)).drop("_nth")


def core_evidence(cores: DataFrame, splits: DataFrame, drops: DataFrame, case: Sequence[str], process: str, split: str = "split_id", delta: str = "delta") -> DataFrame:
    """By case and process of any core: (splits_selected, n_splits, core_stability, validation_drop_pairs,
    validation_drop_splits, mean, median and positive share of the drops).

    ``cores`` has a row for each split and process in its core, ``splits`` one a split, ``drops`` what unseen taxa lose
    without a process. A process without drops has none of their figures.
    """
    total = splits.groupBy(*case).agg(F.countDistinct(split).alias("n_splits"))
    held = cores.groupBy(*case, process).agg(F.countDistinct(split).alias("splits_selected")).join(total, list(case))
    held = held.withColumn("core_stability", F.col("splits_selected") / F.col("n_splits").cast("double"))
    loss = finite(delta)
    lost = drops.groupBy(*case, process).agg(
        F.count("*").alias("validation_drop_pairs"), F.countDistinct(split).alias("validation_drop_splits"), F.avg(loss).alias("mean_validation_process_drop"),
        F.median(loss).alias("median_validation_process_drop"), positive_fraction(loss).alias("positive_validation_drop_fraction"))
    return held.join(lost, [*case, process], "left")


def null_rank(figures: DataFrame, case: Sequence[str], repeat: str, value: str) -> DataFrame:
    """Where the core stands among random cores: (case, core, n_random, mean_random, sd_random, n_at_least, rank, p_value,
    z). ``repeat`` is null in the core's row. The rank counts from the best, equals before the core; p adds the core itself."""
    is_core = F.col(repeat).isNull()
    v = finite(value)
    core = figures.where(is_core).select(*case, v.alias("core"))
    g = figures.where(~is_core).join(core, list(case)).groupBy(*case, "core").agg(
        F.count(v).alias("n_random"), F.avg(v).alias("mean_random"), F.stddev_samp(v).alias("sd_random"), F.count_if(v >= F.col("core") - TOLERANCE).alias("n_at_least"))
    return g.withColumns({"rank": F.col("n_at_least") + 1, "p_value": (F.col("n_at_least") + 1) / (F.col("n_random") + 1).cast("double"), "z": ratio(F.col("core") - F.col("mean_random"), F.col("sd_random"))})


def _drawn(processes: Sequence[str], size: int, repeats: int, seed: int, split: int) -> list[tuple[str, ...]]:
    """Different sets of ``size`` processes, as many as asked or as there are; drawn anew for each split."""
    rng, found = np.random.default_rng(seed_of(seed, split)), []
    for _ in range(20 * repeats):
        if len(found) == repeats:
            break
        drawn = tuple(sorted(rng.choice(list(processes), size, replace=False).tolist()))
        if drawn not in found:
            found.append(drawn)
    return found


def process_core_splits(
    df: DataFrame, key: str, label: Column, taxa: Sequence[str], processes: Mapping[str, Sequence[str]], seeds: Sequence[int], folds: Sequence[int], spec: ModelSpec | None = None,
    fold: str = "fold", validation: float = 0.2, least: float = 0.25, top: int | None = 6, repeats: int = 20, gain: float = 0.001,
) -> DataFrame:
    """Every split of the taxa at once: (split_id, seed, taxon, half, fold, kind, process, repeat, predictors, presence_rank).

    A split sends a share of the taxa to validation. In discovery each process is left out of the full set, and one whose
    loss is over ``gain`` is frequent by the share of taxa that lose it: the core. Unseen taxa are scored with the full
    set, the core, the core without each process, and random cores of the core's size. Rows of a taxon are read once a
    Newton step for all splits, kinds and repeats: each set of predictors is a keyed task, and sets that splits share are
    fitted once. A set without predictors ranks one half.
    """
    spec = spec or ModelSpec()
    every = tuple(p for names in processes.values() for p in names)
    whole = tuple(processes)
    halves = {i: split_taxa(list(taxa), validation, s) for i, s in enumerate(seeds)}
    of = lambda chosen: tuple(p for q in whole if q in chosen for p in processes[q])

    def ranks(sets: set[tuple[str, tuple[str, ...]]]) -> dict[tuple[str, tuple[str, ...], int], float]:
        tasks = [Task(t, f, names) for t, names in sorted(sets) if names for f in folds]
        fits = [x for x in fit_tasks(df, key, label, tasks, spec, fold) if x is not None]
        got = {(t, (), f): 0.5 for t, names in sets if not names for f in folds}
        if fits:
            found = presence_rank(score_tasks(df, key, fits, [label.alias("is_presence")], fold), "task").where("presence_rank is not null")
            got |= {(x.key, x.predictors, x.fold): r["presence_rank"] for r in found.collect() for x in [fits[r["task"]].task]}  # a row a fit
        return got

    mean = lambda got, t, names: (lambda v: float(np.mean(v)) if v else None)([got[t, names, f] for f in folds if (t, names, f) in got])
    without = {q: of([x for x in whole if x != q]) for q in whole}
    found = ranks({(t, names) for t in {t for d, _ in halves.values() for t in d} for names in (every, *without.values())})
    cores, drawn = {}, {}
    for i, (discovery, _) in halves.items():
        lost = {q: [a - b > gain for t in discovery if (a := mean(found, t, every)) is not None and (b := mean(found, t, without[q])) is not None] for q in whole}
        share = {q: float(np.mean(v)) if v else 0.0 for q, v in lost.items()}
        order = sorted(whole, key=lambda q: (-share[q], q))
        cores[i] = tuple(q for q in order[: top or len(order)] if share[q] >= least - TOLERANCE) or (order[0],)
        drawn[i] = _drawn(whole, len(cores[i]), repeats, seeds[i], i)
    wanted: dict[int, list[tuple[str, str | None, int | None, tuple[str, ...]]]] = {}
    for i, core in cores.items():
        rows = [("full", None, None, every), ("core", None, None, of(core))]
        rows += [("without", q, None, of([x for x in core if x != q])) for q in core]
        wanted[i] = rows + [("random", None, n, of(chosen)) for n, chosen in enumerate(drawn[i])]
    unseen = ranks({(t, names) for i, rows in wanted.items() for t in halves[i][1] for _, _, _, names in rows})
    out = [(i, int(seeds[i]), str(t), "validation", f, kind, q, n, ",".join(names), unseen.get((t, names, f))) for i, rows in wanted.items() for kind, q, n, names in rows for t in halves[i][1] for f in folds]
    out += [(i, int(seeds[i]), str(t), "discovery", f, "without" if q else "full", q, None, ",".join(names), found.get((t, names, f))) for i, (d, _) in halves.items() for q, names in ((None, every), *without.items()) for t in d for f in folds]
    return df.sparkSession.createDataFrame(out, "split_id int, seed long, taxon string, half string, fold int, kind string, process string, repeat int, predictors string, presence_rank double")
