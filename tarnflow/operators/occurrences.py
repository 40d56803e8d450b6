"""Scans of occurrence tables: bounds, admission, thinning, gates, tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.values import EARTH_KM, dealt_join, finite, grid_cell, haversine_km, number, require_columns, unit_sphere

from .metrics import running_totals
from .partitions import sample_rows

Box = tuple[float, float, float, float]


def in_box(longitude: Column, latitude: Column, box: Box) -> Column:
    """Inside (west, east, south, north); west beyond east crosses the dateline."""
    west, east, south, north = box
    across = (longitude >= west) | (longitude <= east) if west > east else longitude.between(west, east)
    return across & latitude.between(south, north)


def snapshot_filter(df: DataFrame, species: Sequence[str] = (), boxes: Sequence[Box] = ()) -> DataFrame:
    """Rows of the species inside any box with coordinates in range; a scan without any scope is refused."""
    if not species and not boxes:
        raise ValueError("name species or boxes: an unscoped scan is refused")
    lon, lat = F.col("longitude"), F.col("latitude")
    keep = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    if species:
        keep = keep & F.col("species").isin(list(species))
    if boxes:
        inside = F.lit(False)
        for b in boxes:
            inside = inside | in_box(lon, lat, b)
        keep = keep & inside
    return df.where(keep)


#: Reasons of rejection in their order (fixed values); duplicates are looked for among the rest.
REASONS = (
    "missing_coordinate", "invalid_coordinate", "occurrence_not_present", "coordinate_uncertainty_too_high",
    "year_before_min", "year_after_max", "basis_of_record_not_allowed", "duplicate_coordinate",
)


def admit(
    df: DataFrame, order: str, max_uncertainty: float | None = None, min_year: int | None = None, max_year: int | None = None,
    basis: Sequence[str] | None = None, present: Sequence[str] = ("PRESENT",), unique_coordinates: bool = True,
) -> DataFrame:
    """``df`` with ``reasons``: those that reject a row joined by ';', empty for accepted rows.

    A missing status passes, a missing basis does not. Of accepted rows of a species at one coordinate the first by
    ``order`` stays.
    """
    require_columns(df, ["species", "longitude", "latitude", order])
    lon, lat = number("longitude"), number("latitude")
    missing = lon.isNull() | lat.isNull()
    tests = {
        "missing_coordinate": missing,
        "invalid_coordinate": ~missing & ~(lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)),
        "occurrence_not_present": ~F.coalesce(F.upper(F.trim("occurrenceStatus")).isin([p.upper() for p in present]), F.lit(True)),
    }
    if max_uncertainty is not None:
        tests["coordinate_uncertainty_too_high"] = number("uncertainty") > max_uncertainty
    if min_year is not None:
        tests["year_before_min"] = F.col("year") < min_year
    if max_year is not None:
        tests["year_after_max"] = F.col("year") > max_year
    if basis is not None:
        tests["basis_of_record_not_allowed"] = ~F.coalesce(F.col("basisOfRecord").isin(list(basis)), F.lit(False))
    named = [F.when(F.coalesce(tests[r], F.lit(False)), F.lit(r)) for r in REASONS if r in tests]
    out = df.withColumn("reasons", F.concat_ws(";", *named))
    if not unique_coordinates:
        return out
    ok = F.col("reasons") == ""
    nth = F.row_number().over(Window.partitionBy("species", "longitude", "latitude", ok).orderBy(order))
    return out.withColumn("reasons", F.when(ok & (nth > 1), F.lit("duplicate_coordinate")).otherwise(F.col("reasons")))


def admission_ledger(admitted: DataFrame) -> DataFrame:
    """(reason, n): how many rows each reason rejects, and the accepted and rejected totals."""
    each = admitted.select(F.explode(F.when(F.col("reasons") == "", F.array(F.lit("accepted"))).otherwise(F.concat(F.array(F.lit("rejected")), F.split("reasons", ";")))).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def thin_to_grid(df: DataFrame, cell: float, keys: Sequence[str] = ("species",), identity: Sequence[str] = ("gbifID",)) -> DataFrame:
    """One row a cell and key: the first by longitude, latitude and the identity as text."""
    gx, gy = grid_cell(F.col("longitude"), F.col("latitude"), cell)
    placed = df.where(finite("longitude").isNotNull() & finite("latitude").isNotNull()).withColumns({"gx": gx, "gy": gy})
    first = Window.partitionBy(*keys, "gx", "gy").orderBy("longitude", "latitude", *[F.col(i).cast("string") for i in identity])
    return placed.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def thin_snapshot(df: DataFrame, cell: float, order: str) -> DataFrame:
    """One row a cell: that with the smallest ``order``, missing ones last."""
    gx, gy = grid_cell(F.col("longitude"), F.col("latitude"), cell)
    nth = F.row_number().over(Window.partitionBy("gx", "gy").orderBy(F.col(order).asc_nulls_last()))
    return df.withColumns({"gx": gx, "gy": gy}).withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def footprint(df: DataFrame, cell: float, excluded: Sequence[str] = ()) -> DataFrame:
    """(gx, gy, gbifID, longitude, latitude): the record of each cell with the smallest id, found by partial minima."""
    gx, gy = grid_cell(F.col("longitude"), F.col("latitude"), cell)
    rows = df.where(~F.col("species").isin(list(excluded))) if excluded else df
    least = rows.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.min(F.struct("gbifID", "longitude", "latitude")).alias("one"))
    return least.select("gx", "gy", "one.*")


def species_gate(df: DataFrame, cell: float, least_rows: int, least_cells: int) -> DataFrame:
    """(species, n_occurrences, n_unique_cells, eligible)."""
    gx, gy = grid_cell(F.col("longitude"), F.col("latitude"), cell)
    counts = df.groupBy("species").agg(F.count("*").alias("n_occurrences"), F.countDistinct(gx, gy).alias("n_unique_cells"))
    return counts.withColumn("eligible", (F.col("n_occurrences") >= least_rows) & (F.col("n_unique_cells") >= least_cells))


def select_taxa(df: DataFrame, taxa: DataFrame) -> DataFrame:
    """Rows of ``df`` for each configured taxon (taxon, key): by key if any row has it, else by case-folded name.

    ``mode`` tells which; a row may serve more than one taxon. A configuration of any size joins as Spark sees fit; rows
    of a common key or name are dealt to many tasks.
    """
    by = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    by_key = dealt_join(df.withColumn("_key", F.col("taxonKey")), taxa.select("taxon", F.col("key").alias("_key")), ["_key"], by).drop("_key").withColumn("mode", F.lit("key"))
    found = by_key.select("taxon").distinct()
    names = taxa.join(found, "taxon", "left_anti").select("taxon", F.lower(F.trim("taxon")).alias("_name"))
    by_name = dealt_join(df.withColumn("_name", F.lower(F.trim("species"))), names, ["_name"], by).drop("_name")
    return by_key.unionByName(by_name.withColumn("mode", F.lit("name")))


def taxon_ledger(df: DataFrame, taxa: DataFrame) -> DataFrame:
    """(taxon, key, mode, key_rows, name_rows, matched_rows) of each configured taxon with a name, matched or not.

    Modes are taxon_key, taxon_key_fallback_exact_name, taxon_key_no_match and, without a key, exact_name. Rows are
    counted by key and by name first, so that the joins are of counts.
    """
    keys = df.where("taxonKey is not null").groupBy(F.col("taxonKey").alias("key")).agg(F.count("*").alias("key_rows"))
    names = df.where("species is not null").groupBy(F.lower(F.trim("species")).alias("_name")).agg(F.count("*").alias("name_rows"))
    named = taxa.where("trim(taxon) <> ''").withColumn("_name", F.lower(F.trim("taxon")))
    out = named.join(keys, "key", "left").join(names, "_name", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("key_rows", "name_rows")})
    mode = (
        F.when(F.col("key").isNull(), "exact_name").when(F.col("key_rows") > 0, "taxon_key")
        .when(F.col("name_rows") > 0, "taxon_key_fallback_exact_name").otherwise("taxon_key_no_match")
    )
    by_name = F.col("mode").isin("exact_name", "taxon_key_fallback_exact_name")
    return out.withColumn("mode", mode).select("taxon", "key", "mode", "key_rows", "name_rows", F.when(by_name, F.col("name_rows")).otherwise(F.col("key_rows")).alias("matched_rows"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` are all finite."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(c).isNotNull()
    return df.where(keep)


def coverage(df: DataFrame, predictors: Sequence[str], key: str) -> DataFrame:
    """(key, predictor, coverage): share of a key's rows with a finite value."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), finite(p).isNotNull().cast("double").alias("has")) for p in predictors])).alias("x"))
    return long.groupBy(key, "x.predictor").agg(F.avg("x.has").alias("coverage"))


def coverage_ledger(df: DataFrame, perturbation: str, presence: Column, predictors: Sequence[str], least: float = 0.95) -> DataFrame:
    """(predictor, perturbation, coverage of both kinds and the lesser, passes, admissible): a predictor is admissible if
    the share of its finite values reaches ``least`` among presences and background of every perturbation; a kind without
    rows covers nothing."""
    kind = df.select(F.col(perturbation).alias("perturbation"), presence.alias("_p"), *[finite(p).isNotNull().cast("double").alias(p) for p in predictors])
    per = kind.groupBy("perturbation").agg(*[F.coalesce(F.avg(F.when(F.col("_p") == side, F.col(p))), F.lit(0.0)).alias(f"{n}_{i}") for i, p in enumerate(predictors) for side, n in ((True, "p"), (False, "b"))])
    long = per.select("perturbation", F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(f"p_{i}").alias("p"), F.col(f"b_{i}").alias("b")) for i, p in enumerate(predictors)])).alias("x"))
    out = long.select("x.predictor", "perturbation", F.col("x.p").alias("presence_coverage"), F.col("x.b").alias("background_coverage"), F.least("x.p", "x.b").alias("coverage"))
    return out.withColumn("passes", F.col("coverage") >= least).withColumn("admissible", F.bool_and("passes").over(Window.partitionBy("predictor")))


def query_boxes(df: DataFrame, buffer_deg: float) -> DataFrame:
    """(species, west, east, south, north): each species' bounds grown by a buffer and kept on the globe."""
    g = df.groupBy("species").agg(F.min("longitude").alias("w"), F.max("longitude").alias("e"), F.min("latitude").alias("s"), F.max("latitude").alias("n"))
    clip = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    return g.select("species", clip(F.col("w") - buffer_deg, -180.0, 180.0).alias("west"), clip(F.col("e") + buffer_deg, -180.0, 180.0).alias("east"), clip(F.col("s") - buffer_deg, -90.0, 90.0).alias("south"), clip(F.col("n") + buffer_deg, -90.0, 90.0).alias("north"))


#: Kilometres of a degree of latitude (fixed value).
KM_PER_DEGREE = 111.195


def buffer_degrees(south: Column, north: Column, km: float) -> tuple[Column, Column]:
    """(latitude, longitude) degrees that hold a distance everywhere between two latitudes grown by it.

    Degrees of longitude are those at the latitude furthest from the equator, at most 89.999, and at most 180.
    """
    if km <= 0:
        raise ValueError("a buffer of more than nothing")
    lat = F.lit(km / KM_PER_DEGREE)
    far = F.least(F.lit(89.999), F.greatest(F.abs(south - lat), F.abs(north + lat)))
    shrunk = F.cos(F.radians(far))
    return lat, F.when(shrunk <= 1e-6, F.lit(180.0)).otherwise(F.least(F.lit(180.0), lat / shrunk))


def expand_longitude(west: Column, east: Column, by: Column) -> tuple[Column, Column]:
    """(west, east) grown by some degrees, over the dateline where it is passed; the whole circle where both ends meet."""
    w, e = west - by, east + by
    whole, under, over = e - w >= 360.0, w < -180.0, e > 180.0
    left = F.when(whole, F.lit(-180.0)).when(under, w + 360.0).otherwise(w)
    return left, F.when(whole, F.lit(180.0)).when(~under & over, e - 360.0).otherwise(e)


def buffered_boxes(df: DataFrame, km: float) -> DataFrame:
    """(species, west, east, south, north): each species' bounds grown by a distance; a west beyond its east crosses the
    dateline."""
    g = df.groupBy("species").agg(F.min("longitude").alias("w"), F.max("longitude").alias("e"), F.min("latitude").alias("s"), F.max("latitude").alias("n"))
    lat, lon = buffer_degrees(F.col("s"), F.col("n"), km)
    west, east = expand_longitude(F.col("w"), F.col("e"), lon)
    return g.select("species", west.alias("west"), east.alias("east"), F.greatest(F.lit(-90.0), F.col("s") - lat).alias("south"), F.least(F.lit(90.0), F.col("n") + lat).alias("north"))


def tile_boxes(df: DataFrame, tile_deg: float, buffer_deg: float) -> DataFrame:
    """(tx, ty, west, east, south, north) of every occupied tile: the bounds of its rows grown by a buffer."""
    tx, ty = grid_cell(F.col("longitude"), F.col("latitude"), tile_deg)
    g = df.groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.min("longitude").alias("w"), F.max("longitude").alias("e"), F.min("latitude").alias("s"), F.max("latitude").alias("n"))
    west, east = expand_longitude(F.col("w"), F.col("e"), F.lit(buffer_deg))
    return g.select("tx", "ty", west.alias("west"), east.alias("east"), F.greatest(F.lit(-90.0), F.col("s") - buffer_deg).alias("south"), F.least(F.lit(90.0), F.col("n") + buffer_deg).alias("north"))


def tiles(df: DataFrame, tile_deg: float) -> DataFrame:
    """(tx, ty, n): occupied tiles."""
    tx, ty = grid_cell(F.col("longitude"), F.col("latitude"), tile_deg)
    return df.groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"))


def top_tiles(df: DataFrame, tile_deg: float, k: int) -> DataFrame:
    """The ``k`` fullest tiles; ties go to the smaller tile."""
    return tiles(df, tile_deg).orderBy(F.desc("n"), "tx", "ty").limit(k)


def outside_focal_cells(df: DataFrame, focal: DataFrame, cell: float) -> DataFrame:
    """Rows of ``df`` in cells that no focal row occupies."""
    gx, gy = grid_cell(F.col("longitude"), F.col("latitude"), cell)
    taken = focal.select(gx.alias("gx"), gy.alias("gy")).distinct()
    return df.withColumns({"gx": gx, "gy": gy}).join(taken, ["gx", "gy"], "left_anti")


def target_group_background(focal: DataFrame, pool: DataFrame, mask: Column, n: int, cell: float, seed: int, order: Sequence[str], focal_species: str) -> DataFrame:
    """At most ``n`` rows of the pool as background of one focal species, one a cell, from cells without focal rows.

    Rows outside the mask or without coordinates are left out; a cell gives its first row by ``order``, and cells are
    drawn without replacement by a seeded hash of it. Rows keep their species as ``background_source_species``. An empty
    mask, or no cell left, is an error.
    """
    inside = pool.where(mask & F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    if inside.isEmpty():
        raise ValueError("no row of the pool lies inside the mask")
    open_cells = first_by(outside_focal_cells(inside, focal.where("longitude is not null and latitude is not null"), cell), ["gx", "gy"], order)
    if open_cells.isEmpty():
        raise ValueError("no cell is left outside the focal cells")
    drawn = sample_rows(open_cells.withColumn("_all", F.lit(1)), n, ["_all"], order, seed)
    return drawn.withColumn("background_source_species", F.col("species")).withColumn("species", F.lit(focal_species)).drop("_all", "gx", "gy")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


#: Radii of the distance join are halved this often at most to find the first; focal points of a cell that it may hold on
#: average; how much wider each radius is than the one before.
HALVINGS, CELL_POINTS, WIDER = 10, 16, 4.0


def _chord(km: float) -> float:
    """The straight distance on the unit sphere of points that far apart."""
    return 2.0 * math.sin(min(km / EARTH_KM, math.pi) / 2.0)


def _cube(size: float, *at: Column) -> list[Column]:
    return [F.floor(c / F.lit(size)) for c in at]


def _first_radius(near: DataFrame, reach_km: float) -> float:
    """The widest of the halved radii at which a focal point shares its cell with few others on average; the reach if there
    is room enough. Counts of all points decide it, and it changes no result."""
    sizes = [2.0 * _chord(reach_km / 2**j) for j in range(HALVINGS + 1)]
    cells = near.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), *[c.alias(n) for n, c in zip("abc", _cube(s, F.col("_fx"), F.col("_fy"), F.col("_fz")), strict=True)]) for j, s in enumerate(sizes)])).alias("c")).select("c.*")
    held = cells.groupBy("j", "a", "b", "c").agg(F.count("*").cast("double").alias("n")).groupBy("j").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("mean"))
    mean = {r["j"]: r["mean"] for r in held.collect()}
    return reach_km / 2 ** next((j for j in range(HALVINGS + 1) if mean.get(j, 0.0) <= CELL_POINTS), HALVINGS)


def _nearest_within(rows: DataFrame, near: DataFrame, km: float, identity: str) -> DataFrame:
    """(identity, nearest_km) of the rows that have a focal point within ``km``: cubes twice as wide as the reach hold the
    focal points that reach into them, and rows are joined by their one cube, alike at the poles and over the dateline."""
    size, reach = 2.0 * _chord(km), _chord(km) * (1.0 + 1e-6)
    spans = [F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)) for c in ("_fx", "_fy", "_fz")]
    cubes = F.flatten(F.transform(spans[0], lambda a: F.flatten(F.transform(spans[1], lambda b: F.transform(spans[2], lambda c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))))))
    focal = near.select("flon", "flat", F.explode(cubes).alias("_c")).select("flon", "flat", "_c.*")
    a, b, c = _cube(size, *unit_sphere(F.col("longitude"), F.col("latitude")))
    d = haversine_km(F.col("longitude"), F.col("latitude"), F.col("flon"), F.col("flat"))
    both = rows.withColumns({"a": a, "b": b, "c": c}).join(focal, ["a", "b", "c"]).select(identity, d.alias("km"))
    return both.where(F.col("km") <= km).groupBy(identity).agg(F.min("km").alias("nearest_km"))


def within_distance(df: DataFrame, focal: DataFrame, reach_km: float, identity: str = "row_id") -> DataFrame:
    """(identity, nearest_km) of the rows of ``df`` within reach of any focal row.

    Rows look for focal points within a small radius first, which follows how close those are, and only rows that find none
    look within wider ones, up to the reach: a nearest point within a radius is the nearest of all, so that pairs grow
    with the rows and not with their square where points lie ever closer. Equal focal points count once. What a radius
    finds is kept as a local checkpoint. No side is broadcast whole by plan.
    """
    valid = lambda d: d.where(F.col("longitude").between(-180.0, 180.0) & F.col("latitude").between(-90.0, 90.0))
    x, y, z = unit_sphere(F.col("flon"), F.col("flat"))
    near = valid(focal).select(F.col("longitude").alias("flon"), F.col("latitude").alias("flat")).distinct().withColumns({"_fx": x, "_fy": y, "_fz": z})
    rest = valid(df).select(identity, "longitude", "latitude")
    radius, found = _first_radius(near, reach_km), []
    while radius < reach_km:
        found.append(_nearest_within(rest, near, radius, identity).localCheckpoint())
        done = found[-1].select(F.col(identity).alias("_done"))
        rest = rest.join(done, F.col(identity).eqNullSafe(F.col("_done")), "left_anti")
        radius *= WIDER
    return reduce(DataFrame.unionByName, [*found, _nearest_within(rest, near, reach_km, identity)])


def nearest_centre(df: DataFrame, centres: Sequence[tuple[float, float, float]]) -> DataFrame:
    """``df`` with ``centre``: the number of the nearest of a few unit vectors, the lowest of equals."""
    x, y, z = unit_sphere(F.col("longitude"), F.col("latitude"))
    d = [F.struct(F.round((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, 12).alias("d"), F.lit(i).alias("i")) for i, (a, b, c) in enumerate(centres)]
    return df.withColumn("centre", F.array_min(F.array(*d))["i"])


def largest_gap(df: DataFrame, key: str) -> DataFrame:
    """(key, gap, west, east): the largest empty arc between a key's longitudes and the interval outside it.

    Longitudes are taken to a hundredth of a degree, so a key has at most 36000 of them.
    """
    lon = df.select(key, (F.pmod(F.round(F.col("longitude") * 100).cast("long"), F.lit(36000))).alias("a")).distinct()
    w = Window.partitionBy(key).orderBy("a")
    every = Window.partitionBy(key)
    nxt = F.coalesce(F.lead("a").over(w), F.min("a").over(every) + 36000)
    gaps = lon.withColumn("b", nxt).withColumn("gap", F.col("b") - F.col("a"))
    best = gaps.groupBy(key).agg(F.max(F.struct("gap", (-F.col("a")).alias("na"), "b")).alias("g"))
    signed = lambda c: F.when(F.pmod(c, F.lit(36000)) > 18000, F.pmod(c, F.lit(36000)) - 36000).otherwise(F.pmod(c, F.lit(36000))) / 100.0
    return best.select(key, (F.col("g.gap") / 100.0).alias("gap"), signed(F.col("g.b")).alias("west"), signed(-F.col("g.na")).alias("east"))


def evenly_spaced(df: DataFrame, order: str, k: int, key: str) -> DataFrame:
    """Of each key's rows in order, those at the rounded places of ``k`` even steps from first to last.

    Places come from totals over the values of ``order`` that run in shares; only rows of a value that holds a wanted
    place are numbered, among themselves.
    """
    values = df.groupBy(F.col(key).alias("_k"), F.col(order).alias("_v")).agg(F.count("*").alias("_n"))
    totals = running_totals(values, "_k", "_v", ["_n"]).withColumn("_first", F.col("_n_to") - F.col("_n"))
    step = (F.col("_n_all") - 1) / F.lit(float(max(k - 1, 1)))
    places = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda j: F.rint(j * step).cast("long")) if k >= 2 else F.array(F.lit(0).cast("long"))
    inside = F.array_distinct(F.filter(places, lambda i: (i >= F.col("_first")) & (i < F.col("_n_to"))))
    wanted = totals.select("_k", "_v", "_first", inside.alias("_at")).where(F.size("_at") > 0)
    rows = df.join(wanted, F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_v")))
    nth = F.row_number().over(Window.partitionBy("_k", "_v").orderBy(order)) - 1 + F.col("_first")
    return rows.withColumn("_i", nth).where(F.array_contains("_at", F.col("_i"))).select(*df.columns)


def nearest_planar(df: DataFrame, focal: DataFrame, keys: Sequence[str], x: str, y: str, identity: str) -> DataFrame:
    """(identity, distance): to the nearest focal point of the same key, within keys' small tables of points."""
    near = focal.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    d = F.sqrt((F.col(x) - F.col("_x")) ** 2 + (F.col(y) - F.col("_y")) ** 2)
    return df.join(near, list(keys)).groupBy(identity).agg(F.min(d).alias("distance"))
