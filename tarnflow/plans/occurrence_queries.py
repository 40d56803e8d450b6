"""Queries over occurrence-like tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.functions import values as V
from tarnflow.operators import occurrences as O

from .adapters import occurrences, oracle, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return keep


#: Added before rounding, far below the last digit kept, so that exact halves round alike whatever the order of a sum.
_NUDGE = 1e-12


def r(expression: str, alias: str, digits: int = 9) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {_NUDGE}, {digits}) AS {alias}"


def rounded(df, digits: int = 9):
    return df.select(*[F.round(F.col(c) + _NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


BOXES = [(-20.0, 60.0, -30.0, 45.0), (170.0, -150.0, -50.0, 10.0)]
GX, GY = "CAST(floor((longitude + 180) / {c}) AS BIGINT)", "CAST(floor((latitude + 90) / {c}) AS BIGINT)"
CELL = lambda c: (GX.format(c=f"CAST({c} AS DOUBLE)"), GY.format(c=f"CAST({c} AS DOUBLE)"))


@register("snapshot_filter", """SELECT row_id, species, longitude, latitude FROM occ WHERE species IN ('BUILDING', 'MACHINERY') AND longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90
  AND ((longitude BETWEEN -20 AND 60 AND latitude BETWEEN -30 AND 45) OR ((longitude >= 170 OR longitude <= -150) AND latitude BETWEEN -50 AND 10))""")
def _(spark, sf):
    return O.snapshot_filter(occurrences(spark, sf), ["BUILDING", "MACHINERY"], BOXES).select("row_id", "species", "longitude", "latitude")


_ADMIT = """WITH t AS (SELECT *, concat_ws(';', CASE WHEN coalesce(upper(trim(occurrenceStatus)) NOT IN ('F', 'O'), false) THEN 'occurrence_not_present' END,
    CASE WHEN uncertainty > 250000 THEN 'coordinate_uncertainty_too_high' END, CASE WHEN year < 1993 THEN 'year_before_min' END, CASE WHEN year > 1997 THEN 'year_after_max' END,
    CASE WHEN basisOfRecord IS NULL OR basisOfRecord NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'basis_of_record_not_allowed' END) AS first FROM occ),
  a AS (SELECT *, CASE WHEN first = '' AND row_number() OVER (PARTITION BY species, longitude, latitude, first = '' ORDER BY row_id) > 1 THEN 'duplicate_coordinate' ELSE first END AS reasons FROM t) """


def _admitted(spark, sf):
    return O.admit(occurrences(spark, sf), "row_id", 250000, 1993, 1997, ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["F", "O"])


@register("admit_accepted", _ADMIT + "SELECT row_id, species FROM a WHERE reasons = ''")
def _(spark, sf):
    return _admitted(spark, sf).where("reasons = ''").select("row_id", "species")


@register("admit_rejected", _ADMIT + "SELECT row_id, reasons FROM a WHERE reasons <> ''")
def _(spark, sf):
    return _admitted(spark, sf).where("reasons <> ''").select("row_id", "reasons")


@register("admit_ledger", _ADMIT + """SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN reasons = '' THEN ['accepted'] ELSE list_concat(['rejected'], string_split(reasons, ';')) END) AS reason FROM a) GROUP BY reason""")
def _(spark, sf):
    return O.admission_ledger(_admitted(spark, sf))


@register("thin_to_grid", f"SELECT row_id, species, gx, gy FROM (SELECT *, row_number() OVER (PARTITION BY species, gx, gy ORDER BY longitude, latitude, CAST(gbifID AS VARCHAR)) AS k FROM (SELECT *, {CELL(2.5)[0]} AS gx, {CELL(2.5)[1]} AS gy FROM occ)) WHERE k = 1")
def _(spark, sf):
    return O.thin_to_grid(occurrences(spark, sf), 2.5).select("row_id", "species", "gx", "gy")


@register("thin_snapshot", f"SELECT row_id, gx, gy FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY gbifID NULLS LAST) AS k FROM (SELECT *, {CELL(5)[0]} AS gx, {CELL(5)[1]} AS gy FROM occ)) WHERE k = 1")
def _(spark, sf):
    return O.thin_snapshot(occurrences(spark, sf), 5.0, "gbifID").select("row_id", "gx", "gy")


@register("footprint_argmin", f"SELECT {CELL(5)[0]} AS gx, {CELL(5)[1]} AS gy, min(gbifID) AS gbifID, arg_min(longitude, gbifID) AS longitude, arg_min(latitude, gbifID) AS latitude FROM occ WHERE species NOT IN ('FURNITURE') GROUP BY 1, 2")
def _(spark, sf):
    return O.footprint(occurrences(spark, sf), 5.0, ["FURNITURE"])


@register("species_gate", f"SELECT species, count(*) AS n_occurrences, count(DISTINCT ({CELL(2.5)[0]}, {CELL(2.5)[1]})) AS n_unique_cells, count(*) >= 100 AND count(DISTINCT ({CELL(2.5)[0]}, {CELL(2.5)[1]})) >= 80 AS eligible FROM occ GROUP BY species")
def _(spark, sf):
    return O.species_gate(occurrences(spark, sf), 2.5, 100, 80)


@register("select_taxa", """WITH taxa(taxon, k) AS (VALUES ('building', CAST(NULL AS BIGINT)), ('First key', 5), (' Machinery ', -1)), o AS (SELECT *, row_id % 50 AS taxonKey FROM occ),
  by_key AS (SELECT row_id, taxon, 'key' AS mode FROM o JOIN taxa ON taxonKey = k)
  SELECT * FROM by_key UNION ALL SELECT row_id, taxon, 'name' FROM o JOIN taxa ON lower(trim(species)) = lower(trim(taxon)) WHERE taxon NOT IN (SELECT taxon FROM by_key)""")
def _(spark, sf):
    taxa = spark.createDataFrame([("building", None), ("First key", 5), (" Machinery ", -1)], "taxon string, key long")
    return O.select_taxa(occurrences(spark, sf).withColumn("taxonKey", F.col("row_id") % 50), taxa).select("row_id", "taxon", "mode")


@register("query_boxes", "SELECT species, greatest(min(longitude) - 1.5, -180.0)::DOUBLE AS west, least(max(longitude) + 1.5, 180.0)::DOUBLE AS east, greatest(min(latitude) - 1.5, -90.0)::DOUBLE AS south, least(max(latitude) + 1.5, 90.0)::DOUBLE AS north FROM occ GROUP BY species")
def _(spark, sf):
    return O.query_boxes(occurrences(spark, sf), 1.5)


@register("tile_list", f"SELECT {CELL(10)[0]} AS tx, {CELL(10)[1]} AS ty, count(*) AS n FROM occ GROUP BY 1, 2")
def _(spark, sf):
    return O.tiles(occurrences(spark, sf), 10.0)


@register("top_tiles", f"SELECT {CELL(10)[0]} AS tx, {CELL(10)[1]} AS ty, count(*) AS n FROM occ GROUP BY 1, 2 ORDER BY n DESC, tx, ty LIMIT 20")
def _(spark, sf):
    return O.top_tiles(occurrences(spark, sf), 10.0, 20)


@register("anti_focal_cells", f"SELECT row_id FROM occ WHERE ({CELL(2.5)[0]}, {CELL(2.5)[1]}) NOT IN (SELECT ({CELL(2.5)[0]}, {CELL(2.5)[1]}) FROM occ WHERE species = 'BUILDING')")
def _(spark, sf):
    occ = occurrences(spark, sf)
    return O.outside_focal_cells(occ, occ.where("species = 'BUILDING'"), 2.5).select("row_id")


@register("first_by_coordinate", "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY longitude, latitude ORDER BY row_id) AS k FROM occ) WHERE k = 1")
def _(spark, sf):
    return O.first_by(occurrences(spark, sf), ["longitude", "latitude"], ["row_id"]).select("row_id")


_HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(f.latitude - c.latitude) / 2), 2) + cos(radians(c.latitude)) * cos(radians(f.latitude)) * pow(sin(radians(f.longitude - c.longitude) / 2), 2), 1.0)))"


@register("distance_semi_join", f"SELECT c.row_id, {r('min(' + _HAVERSINE + ')', 'nearest_km', 3)} FROM (SELECT * FROM occ WHERE species <> 'BUILDING') c JOIN (SELECT DISTINCT longitude, latitude FROM occ WHERE species = 'BUILDING') f ON abs(f.latitude - c.latitude) <= 2 WHERE {_HAVERSINE} <= 150 GROUP BY c.row_id")
def _(spark, sf):
    occ = occurrences(spark, sf)
    return rounded(O.within_distance(occ.where("species <> 'BUILDING'"), occ.where("species = 'BUILDING'"), 150.0), 3)


_CENTRES = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (-0.6, -0.8, 0.0), (0.0, 0.6, 0.8), (0.0, 0.0, -1.0)]
_SQ = lambda c: "round(" + " + ".join(f"pow({e} - CAST({v} AS DOUBLE), 2)" for e, v in zip(("cos(radians(latitude)) * cos(radians(longitude))", "cos(radians(latitude)) * sin(radians(longitude))", "sin(radians(latitude))"), c, strict=True)) + ", 12)"


@register("nearest_centre", "SELECT row_id, CAST(list_position(d, list_min(d)) - 1 AS INT) AS centre FROM (SELECT row_id, [" + ", ".join(map(_SQ, _CENTRES)) + "] AS d FROM occ)")
def _(spark, sf):
    return O.nearest_centre(occurrences(spark, sf), _CENTRES).select("row_id", "centre")


@register("circular_gap", """WITH a AS (SELECT DISTINCT species, CAST((CAST(round(longitude * 100) AS BIGINT) + 36000) % 36000 AS BIGINT) AS a FROM occ),
  b AS (SELECT species, a, coalesce(lead(a) OVER (PARTITION BY species ORDER BY a), min(a) OVER (PARTITION BY species) + 36000) - a AS gap FROM a),
  k AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY gap DESC, a) AS n FROM b)
  SELECT species, gap / 100.0::DOUBLE AS gap, (CASE WHEN (a + gap) % 36000 > 18000 THEN (a + gap) % 36000 - 36000 ELSE (a + gap) % 36000 END) / 100.0::DOUBLE AS west, (CASE WHEN a > 18000 THEN a - 36000 ELSE a END) / 100.0::DOUBLE AS east FROM k WHERE n = 1""")
def _(spark, sf):
    return O.largest_gap(occurrences(spark, sf), "species")


@register("evenly_spaced", """WITH o AS (SELECT row_id, species, row_number() OVER (PARTITION BY species ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY species) AS n FROM occ),
  p AS (SELECT DISTINCT species, CAST(round_even(j * ((n - 1) / 63.0::DOUBLE), 0) AS BIGINT) AS i FROM (SELECT DISTINCT species, n FROM o), range(64) t(j)) SELECT row_id, o.species FROM o JOIN p ON o.species = p.species AND o.i = p.i""")
def _(spark, sf):
    return O.evenly_spaced(occurrences(spark, sf), "row_id", 64, "species").select("row_id", "species")


@register("unit_sphere", f"SELECT row_id, {r('cos(radians(latitude)) * cos(radians(longitude))', 'x')}, {r('cos(radians(latitude)) * sin(radians(longitude))', 'y')}, {r('sin(radians(latitude))', 'z')} FROM occ")
def _(spark, sf):
    x, y, z = V.unit_sphere(F.col("longitude"), F.col("latitude"))
    return rounded(occurrences(spark, sf).select("row_id", x.alias("x"), y.alias("y"), z.alias("z")))


@register("basis_intersection", "SELECT basisOfRecord FROM occ WHERE uncertainty > 300000 INTERSECT SELECT basisOfRecord FROM occ WHERE uncertainty < 5000")
def _(spark, sf):
    occ = occurrences(spark, sf)
    return occ.where("uncertainty > 300000").select("basisOfRecord").intersect(occ.where("uncertainty < 5000").select("basisOfRecord"))


@register("missing_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey").subtract(read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")))


@register("list_codec", "SELECT p_partkey, array_to_string(list_filter([trim(x) for x in string_split(concat(p_brand, ', ', p_type, ',,', p_brand), ',')], lambda x, i: x <> '' AND i = list_position([trim(x) for x in string_split(concat(p_brand, ', ', p_type, ',,', p_brand), ',')], x)), ',') AS items FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", V.encode_list(V.decode_list(F.concat("p_brand", F.lit(", "), "p_type", F.lit(",,"), "p_brand"))).alias("items"))


@register("month_starts", "SELECT o_orderkey, CASE WHEN day(o_orderdate) = 1 THEN CAST(o_orderdate AS DATE) END AS month FROM orders")
def _(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", V.month_start(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("month"))


@register("information_criterion", f"SELECT p_partkey, CASE WHEN p_size - 10 - 1 <= 0 THEN 'infinity'::DOUBLE ELSE {r('20 + 2 * p_retailprice + 220.0::DOUBLE / (p_size - 11)', 'aicc')[:-8]} END AS aicc FROM part")
def _(spark, sf):
    return rounded(read(spark, sf, "part").select("p_partkey", V.aicc(-F.col("p_retailprice"), F.lit(10), F.col("p_size")).alias("aicc")))


@register("monthly_reducers", "SELECT c, avg(v) AS annual_mean, max(v) AS annual_max, min(v) AS annual_min, sum(v) AS annual_sum FROM (SELECT o_custkey AS c, month(o_orderdate) AS m, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) GROUP BY c HAVING count(*) = 12".replace("avg(v) AS", "round(avg(v), 2) AS").replace("sum(v) AS", "round(sum(v), 2) AS"))
def _(spark, sf):
    from tarnflow.sources.rasters import annual_features

    orders = read(spark, sf, "orders")
    months = orders.withColumn("m", F.month("o_orderdate").cast("string")).groupBy(F.col("o_custkey").alias("c")).pivot("m", [str(m) for m in range(1, 13)]).agg(F.round(F.sum("o_totalprice"), 2))
    return rounded(annual_features(months, [str(m) for m in range(1, 13)]).where("annual_mean is not null").select("c", "annual_mean", "annual_max", "annual_min", "annual_sum"), 2)
