"""Selection of candidates in two stages, discovery to validation, and transfer of what was selected."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import TOLERANCE, assert_unique, checked_join, finite, table_fingerprint

from .certificates import SUPPORT, pareto_front
from .metrics import spearman
from .rollups import perturbation_ranks

#: The least rows of either kind on each side of a fold.
LEAST_PRESENCE, LEAST_BACKGROUND = 2, 5


def candidate_profile(df: DataFrame, case: Sequence[str], candidate: str, fold: str, higher: Sequence[str], lower: Sequence[str], complexity: str | None = None) -> DataFrame:
    """(case, candidate, n_folds, each metric's mean, ``<metric>_worst`` fold by its direction, mean_complexity).

    Missing and infinite values are left out of each metric by itself.
    """
    metrics = [*higher, *lower]
    worst = [(F.min if m in higher else F.max)(finite(m)).alias(f"{m}_worst") for m in metrics]
    size = F.avg(finite(F.col(complexity).cast("double"))) if complexity else F.lit(None).cast("double")
    return df.groupBy(*case, candidate).agg(F.countDistinct(fold).alias("n_folds"), *[F.avg(finite(m)).alias(m) for m in metrics], *worst, size.alias("mean_complexity"))


def two_stage(profile: DataFrame, case: Sequence[str], candidate: str, first: tuple[Sequence[str], Sequence[str]], second: tuple[Sequence[str], Sequence[str]]) -> DataFrame:
    """``profile`` with ``eligible``, ``first_front``, ``second_front`` and ``selected``, one row selected a case.

    Candidates with every metric are eligible. Those that none dominates in the ``first`` (higher, lower) metrics are
    compared in the ``second``; of those left, the least worst rank, then mean rank, in the second metrics wins, then the
    same in the first, the lower complexity and the name. With worst folds as second metrics this is the robust selector,
    with agreement of surfaces the stable one.
    """
    names = [*first[0], *first[1], *second[0], *second[1]]
    base = profile.withColumn("eligible", reduce(lambda a, b: a & b, [F.coalesce(finite(m).isNotNull(), F.lit(False)) for m in names]))
    front = pareto_front(base.where("eligible"), case, candidate, *first)
    last = pareto_front(front, case, candidate, *second)
    keys = [*case, candidate]
    ranks = [perturbation_ranks(last, case, *m).select(*keys, F.col("worst_rank").alias(f"_w{i}"), F.round("mean_rank", 9).alias(f"_m{i}")) for i, m in enumerate((second, first))]
    order = ["_w0", "_m0", "_w1", "_m1", F.asc_nulls_last("mean_complexity"), candidate]
    nth = F.row_number().over(Window.partitionBy(*case).orderBy(*order))
    final = last.select(*keys, "mean_complexity").join(ranks[0], keys).join(ranks[1], keys).select(*keys, (nth == 1).alias("selected"), F.lit(True).alias("second_front"))
    out = base.join(front.select(*keys, F.lit(True).alias("first_front")), keys, "left").join(final, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("first_front", "second_front", "selected")})


def transfer_cases(df: DataFrame, case: Sequence[str], candidate: str, inner: str, outer: str, size: str) -> DataFrame:
    """By case: what the inner score selects and what the outer one would have, and how far apart they are.

    Equal scores go to the smaller, then the first by name. (case, n, inner_outer_spearman, inner_winner, outer_winner,
    match, regret, gap of the selected from inner to outer, outer_rank of the selected, the least place of equals.)
    """
    rows = df.where(finite(inner).isNotNull() & finite(outer).isNotNull()).withColumn("_r", F.rank().over(Window.partitionBy(*case).orderBy(F.desc(outer))))
    best = lambda c: F.min(F.struct((-F.col(c)).alias("v"), F.col(size).alias("s"), F.col(candidate).alias("c"), F.col(inner).alias("i"), F.col(outer).alias("o"), "_r"))
    g = rows.groupBy(*case).agg(F.count("*").alias("n"), best(inner).alias("a"), best(outer).alias("b"))
    rank = spearman(rows.withColumn("_k", F.struct(*case)), "_k", inner, outer).select(*[F.col(f"_k.{c}").alias(c) for c in case], F.col("spearman").alias("inner_outer_spearman"))
    return g.join(rank, list(case), "left").select(
        *case, "n", "inner_outer_spearman", F.col("a.c").alias("inner_winner"), F.col("b.c").alias("outer_winner"), (F.col("a.c") == F.col("b.c")).alias("match"),
        (F.col("b.o") - F.col("a.o")).alias("regret"), (F.col("a.o") - F.col("a.i")).alias("gap"), F.col("a._r").alias("outer_rank"),
    )


def transfer_overview(cases: DataFrame) -> DataFrame:
    """One row over ``transfer_cases``: their number and the means of what they say."""
    return cases.agg(
        F.count("*").alias("n_cases"), F.sum("n").alias("n_rows"), F.avg("inner_outer_spearman").alias("mean_spearman"), F.avg(F.col("match").cast("double")).alias("match_fraction"),
        F.avg("regret").alias("mean_regret"), F.median("regret").alias("median_regret"), F.avg("gap").alias("mean_gap"), F.avg("outer_rank").alias("mean_outer_rank"),
    )


def selector_transfer(df: DataFrame, selector: str, spec: str, species: str, inner: str, outer: str) -> DataFrame:
    """By selector over species and specifications: means, medians, the share of cases won, and the spread over
    specifications (worst, best and sample deviation of their means, worst mean gap from inner to outer)."""
    won = F.col(outer) >= F.max(outer).over(Window.partitionBy(spec, species)) - TOLERANCE
    rows = df.withColumns({"_gap": F.col(outer) - F.col(inner), "_won": won.cast("double")})
    specs = rows.groupBy(selector, spec).agg(F.avg(outer).alias("o"), F.avg("_gap").alias("g"))
    spread = specs.groupBy(selector).agg(F.count("*").alias("n_specs"), F.min("o").alias("worst_spec"), F.max("o").alias("best_spec"), F.stddev_samp("o").alias("sd_spec"), F.min("g").alias("worst_spec_gap"))
    flat = rows.groupBy(selector).agg(
        F.countDistinct(species).alias("n_species"), F.count("*").alias("n_cases"), F.avg(inner).alias("mean_inner"), F.avg(outer).alias("mean_outer"), F.median(outer).alias("median_outer"),
        F.avg("_gap").alias("mean_gap"), F.median("_gap").alias("median_gap"), F.avg("_won").alias("case_win_fraction"),
    )
    return checked_join(flat, spread, [selector], "left", "one_to_one")


def discovered_choice(df: DataFrame, taxon: str, validation: DataFrame, choice: Sequence[str], metric: str) -> DataFrame:
    """(choice, figures of both halves of the taxa, selected): the choice with the highest mean on discovery taxa, the
    first of equals, beside what it does on taxa that had no say. ``validation`` holds the taxa that only confirm."""
    held = assert_unique(validation.select(taxon), [taxon], "validation taxa")
    rows = df.join(held.withColumn("_v", F.lit(True)), taxon, "left").withColumn("_v", F.coalesce("_v", F.lit(False)))
    seen, kept = F.when(~F.col("_v"), F.col(metric)), F.when(F.col("_v"), F.col(metric))
    g = rows.groupBy(*choice).agg(F.count(seen).alias("n_discovery"), F.avg(seen).alias("discovery"), F.count(kept).alias("n_validation"), F.avg(kept).alias("validation"))
    best = g.where("discovery is not null").agg(F.min(F.struct((-F.round("discovery", 9)).alias("v"), *choice)).alias("b"))
    return g.crossJoin(F.broadcast(best)).withColumn("selected", F.coalesce(reduce(lambda a, c: a & c, [F.col(c) == F.col(f"b.{c}") for c in choice]), F.lit(False))).drop("b")


def core_splits(support: DataFrame, taxon: str, process: str, splits: DataFrame, split: str = "split_id", half: str = "validation") -> DataFrame:
    """(split, process, support and refutation shares of both halves, candidate, confirmed): a process that enough
    discovery taxa support, and enough validation taxa too. ``splits`` holds a row for each split and taxon."""
    is_in, is_out = ((F.col("status") == s).cast("double") for s in ("supported", "refuted"))
    rows = checked_join(support, assert_unique(splits.select(split, taxon, half), [split, taxon], "splits"), [taxon])
    v = F.col(half)
    g = rows.groupBy(split, process).agg(
        F.avg(F.when(~v, is_in)).alias("discovery_support"), F.avg(F.when(v, is_in)).alias("validation_support"), F.avg(F.when(v, is_out)).alias("validation_refuted"))
    passes = lambda c: F.coalesce(F.col(c) >= SUPPORT - TOLERANCE, F.lit(False))
    return g.withColumn("candidate", passes("discovery_support")).withColumn("confirmed", F.col("candidate") & passes("validation_support"))


def core_stability(by_split: DataFrame, process: str, split: str = "split_id") -> DataFrame:
    """(process, n_splits, share of splits in which it is a candidate, and confirmed, mean validation shares)."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return by_split.groupBy(process).agg(
        F.countDistinct(split).alias("n_splits"), share("candidate").alias("candidate_stability"), share("confirmed").alias("confirmation_stability"),
        F.avg("validation_support").alias("mean_validation_support"), F.avg("validation_refuted").alias("mean_validation_refuted"))


def support_ledger(df: DataFrame, case: Sequence[str], block: str, fold: str, presence: Column) -> DataFrame:
    """(case, fold, rows of both kinds in training and test, eligible, reasons) before any model is fitted.

    A block's fold is that of its presences; background of blocks without presences takes no part. A case with fewer than
    two rows of either kind, or with presences in fewer than two folds, has one row of fold -1 that says so.
    """
    rows = df.withColumn("_p", presence)
    folds = rows.where(F.col("_p") & F.col(fold).isNotNull()).groupBy(*case, block).agg(F.min(fold).alias("outer_fold"))
    sizes = rows.groupBy(*case).agg(F.count_if("_p").alias("tp"), F.count_if(~F.col("_p")).alias("tb"))
    per = rows.join(folds, [*case, block]).groupBy(*case, "outer_fold").agg(F.count_if("_p").alias("presence_test"), F.count_if(~F.col("_p")).alias("background_test"))
    w = Window.partitionBy(*case)
    both = per.withColumns({"n": F.count("*").over(w), "presence_train": F.sum("presence_test").over(w) - F.col("presence_test"), "background_train": F.sum("background_test").over(w) - F.col("background_test")})
    out = sizes.join(both, list(case), "left")
    few, single = (F.col("tp") < 2) | (F.col("tb") < 2), F.coalesce(F.col("n") < 2, F.lit(True))
    least = {"presence_train": LEAST_PRESENCE, "presence_test": LEAST_PRESENCE, "background_train": LEAST_BACKGROUND, "background_test": LEAST_BACKGROUND}
    why = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) < n, c) for c, n in least.items()])), ",")
    whole = {"presence_train": "tp", "background_train": "tb"}
    return out.select(
        *case, F.when(few | single, -1).otherwise(F.col("outer_fold")).cast("long").alias("outer_fold"),
        *[F.when(few, 0).when(single, F.col(whole[c]) if c in whole else 0).otherwise(F.col(c)).cast("long").alias(f"n_{c}") for c in least],
        (~(few | single) & (why == "")).alias("eligible"),
        F.when(few, "too_few_rows").when(single, "fewer_than_two_folds").otherwise(why).alias("reasons"),
    ).distinct()


def panel_chain(panels: DataFrame, parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """``panels`` with each part's columns: every part must hold each panel exactly once, and no other."""
    out = assert_unique(panels, on, "panels")
    for part in parts:
        if not panels.join(part, list(on), "left_anti").isEmpty() or not part.join(panels, list(on), "left_anti").isEmpty():
            raise ValueError("parts and panels differ")
        out = checked_join(out, part, on, "inner", "one_to_one")
    return out


def union_chunks(chunks: dict[int, DataFrame], expected: int, taxa: DataFrame, taxon: str) -> DataFrame:
    """All rows of the chunks, repeats included; chunks 0 to ``expected`` - 1 must be there, and together hold exactly the
    expected taxa."""
    if set(chunks) != set(range(expected)):
        raise ValueError(f"chunks {sorted(chunks)} of {expected}")
    out = reduce(lambda a, b: a.unionByName(b), [chunks[i] for i in range(expected)])
    seen = out.select(taxon).distinct()
    if not seen.join(taxa, taxon, "left_anti").isEmpty() or not taxa.join(seen, taxon, "left_anti").isEmpty():
        raise ValueError("taxa differ from those expected")
    return out


def assert_matched(specifications: dict[str, DataFrame], columns: Sequence[str]) -> str:
    """The fingerprint that all specifications share over ``columns``, so that contrasts between them compare treatments
    of the same rows; an error names those that differ. One aggregation a specification, whatever the order of rows."""
    prints = {name: table_fingerprint(df, columns) for name, df in sorted(specifications.items())}
    if len(set(prints.values())) != 1:
        raise ValueError("specifications differ in their rows: " + ", ".join(f"{n} {p[:12]}" for n, p in prints.items()))
    return next(iter(prints.values()))
