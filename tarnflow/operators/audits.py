"""Audit spaces, admissibility, blind artefacts, mechanical gates and errors against a known truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.values import checked_join, finite

from .metrics import average_rank, correlation_matrices


def spearman_matrices(df: DataFrame, key: str, columns: Sequence[str]):
    """(key, rows, matrix) of rank correlations: average-tie ranks of complete rows, then sums."""
    rows = df
    for c in columns:
        rows = rows.where(finite(c).isNotNull())
    return correlation_matrices(rows.select(key, *[average_rank(c, key).alias(c) for c in columns]), key, columns)


def joint_coverage(df: DataFrame, predictors: Sequence[str]) -> float:
    """Share of rows whose predictors are all finite; 0 for no rows."""
    full = F.lit(True)
    for p in predictors:
        full = full & finite(p).isNotNull()
    return df.agg(F.avg(full.cast("double"))).first()[0] or 0.0


def audit_space(df: DataFrame, processes: Mapping[str, Sequence[str]], floor: float) -> list[str]:
    """The best covered predictor of each process, then, best first, those that keep joint coverage at the floor."""
    names = sorted({p for ps in processes.values() for p in ps})
    if not names:
        return []
    got = df.agg(*[F.avg(finite(p).isNotNull().cast("double")).alias(p) for p in names]).first().asDict()
    best = [min(ps, key=lambda p: (-(got[p] or 0.0), p)) for _, ps in sorted(processes.items()) if ps]
    kept: list[str] = []
    for p in sorted(set(best), key=lambda p: (-(got[p] or 0.0), p)):
        if joint_coverage(df, [*kept, p]) >= floor:
            kept.append(p)
    return kept


def prune_audit_space(df: DataFrame, cells: Sequence[str], predictors: Sequence[str], least: int) -> list[str]:
    """While a cell has fewer than ``least`` complete rows, the predictor leaves whose absence helps most: by cells
    supported, then the smallest share of a cell, then joint coverage, then name."""
    kept = list(predictors)

    def support(names: Sequence[str]) -> tuple[int, int, float, float]:
        full = F.lit(True)
        for p in names:
            full = full & finite(p).isNotNull()
        per = df.groupBy(*cells).agg(F.count_if(full).alias("n"), F.count("*").alias("t"))
        r = per.agg(F.count("*").alias("cells"), F.count_if(F.col("n") >= least).alias("ok"), F.min(F.col("n") / F.col("t")).alias("low"), (F.sum("n") / F.sum("t")).alias("joint")).first()
        return r["cells"], r["ok"], r["low"] or 0.0, r["joint"] or 0.0

    while len(kept) > 1:
        total, ok, _, _ = support(kept)
        if ok == total:
            break
        options = [(tuple(-x for x in support([q for q in kept if q != p])[1:]), p) for p in kept]
        kept.remove(min(options)[1])
    return kept


def admissible(candidates: DataFrame, declared: str, required: Sequence[str]) -> DataFrame:
    """``candidates`` with ``admissible``: whether the declared list holds every required nuisance predictor."""
    ok = F.lit(True)
    for r in required:
        ok = ok & F.coalesce(F.array_contains(declared, r), F.lit(False))
    return candidates.withColumn("admissible", ok)


def rename_legacy(df: DataFrame, allowed: Mapping[str, str]) -> DataFrame:
    """Known old columns under their new names; any other column that begins with sealed_ is refused."""
    if unknown := [c for c in df.columns if c.startswith("sealed_") and c not in allowed]:
        raise ValueError(f"unknown sealed columns: {', '.join(unknown)}")
    return df.withColumnsRenamed({k: v for k, v in allowed.items() if k in df.columns})


def mechanical_gate(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """(keys, passed, failed): whether all rows of a key pass every check, and the failed checks in order of name."""
    rows = df.select(*keys, *[F.coalesce(c, F.lit(False)).alias(f"_{n}") for n, c in checks.items()])
    g = rows.groupBy(*keys).agg(*[F.bool_and(f"_{n}").alias(f"_{n}") for n in checks])
    failed = F.array_join(F.filter(F.array(*[F.when(~F.col(f"_{n}"), F.lit(n)) for n in sorted(checks)]), lambda x: x.isNotNull()), ",")
    return g.select(*keys, (failed == "").alias("passed"), failed.alias("failed"))


def response_errors(estimates: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, quantity, error, relative_error) of estimated against true quantities, by span where there is one."""
    both = checked_join(estimates, truth, [*keys, "quantity"], "inner", "one_to_one")
    error = F.abs(F.col("estimate") - F.col("true_value"))
    return both.select(*keys, "quantity", error.alias("error"), (error / F.nullif(F.col("environment_span"), F.lit(0.0))).alias("relative_error"))
