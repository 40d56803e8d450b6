"""Raster layers as tables of tiles, point sampling, and annual features of monthly layers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A north-up grid: the outer corner, the pixel size in degrees and the tile's side in pixels."""

    west: float
    north: float
    pixel: float
    width: int
    height: int
    tile: int = 256


def sample_points(points: DataFrame, pixels: DataFrame, grid: Grid, nodata: float | None = None, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """``points`` with (predictor, value): the pixel that holds each point, scaled; null outside or where there is no data.

    ``pixels`` is (predictor, ty, tx, values): one row a tile of a layer, values row by row. The layers of a tile become
    one row, and points are joined to it by tile: each tile is read once however many points lie in it, and points are not
    multiplied by layers before the join. ``geotiff.sample_layers`` reads files themselves.
    """
    col = F.floor((F.col("longitude") - grid.west) / grid.pixel)
    row = F.floor((grid.north - F.col("latitude")) / grid.pixel)
    inside = col.between(0, grid.width - 1) & row.between(0, grid.height - 1)
    placed = points.withColumns({"_c": F.when(inside, col), "_r": F.when(inside, row)})
    placed = placed.withColumns({"tx": F.floor(F.col("_c") / grid.tile), "ty": F.floor(F.col("_r") / grid.tile)})
    at = (F.col("_r") % grid.tile) * grid.tile + F.col("_c") % grid.tile
    names = [r[0] for r in pixels.select("predictor").distinct().orderBy("predictor").collect()]  # a row a layer
    tiles = pixels.groupBy("ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("predictor", "values"))).alias("_tiles"))
    held = placed.join(tiles, ["ty", "tx"], "left").select(*points.columns, at.cast("int").alias("_at"), "_tiles", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("predictor"))
    raw = F.get(F.try_element_at("_tiles", F.col("predictor")), F.col("_at"))
    if nodata is not None:
        raw = F.when(raw != nodata, raw)
    return held.select(*points.columns, "predictor", (raw * scale + offset).alias("value"))


def annual_features(df: DataFrame, months: Sequence[str], require_complete_year: bool = True) -> DataFrame:
    """``df`` with annual_mean, annual_min, annual_max and annual_sum of twelve columns; null if a month is missing."""
    if len(months) != 12:
        raise ValueError("twelve months are needed")
    present = F.filter(F.array(*[F.col(m).cast("double") for m in months]), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    ok = F.size(present) == 12 if require_complete_year else F.size(present) > 0
    return df.withColumns({
        "annual_mean": F.when(ok, total / F.size(present)), "annual_min": F.when(ok, F.array_min(present)),
        "annual_max": F.when(ok, F.array_max(present)), "annual_sum": F.when(ok, total),
    })


#: Layer states (fixed values).
RESOLVED, EXCLUDED, UNRESOLVED = "resolved", "excluded_availability", "unresolved"


def resolve_layers(manifest: DataFrame, base_uri: str, availability: Sequence[str] = ("open",), strict: bool = False) -> DataFrame:
    """``manifest`` with ``uri`` and ``status``; no row is dropped, and ``strict`` refuses unresolved ones."""
    status = F.when(~F.col("availability").isin(list(availability)), EXCLUDED).when(F.coalesce(F.trim("remote_name"), F.lit("")) == "", UNRESOLVED).otherwise(RESOLVED)
    out = manifest.withColumn("status", status).withColumn("uri", F.when(F.col("status") == RESOLVED, F.concat(F.lit(base_uri.rstrip("/") + "/"), F.trim("remote_name"))))
    if strict and not out.where(F.col("status") == UNRESOLVED).isEmpty():
        raise ValueError("unresolved layers")
    return out
