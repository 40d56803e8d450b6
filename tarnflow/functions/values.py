"""Null rules, casts, checked joins and scalar functions shared by the operators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def number(c: Column | str) -> Column:
    """A double, or null where the value is no finite number."""
    c = F.col(c) if isinstance(c, str) else c
    return finite(c.try_cast("double"))


def positive_fraction(c: Column) -> Column:
    """Share of all rows, missing ones included, whose value is above zero."""
    return F.avg(F.coalesce((c > 0).cast("double"), F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """``df`` itself, if no key repeats; the check is one aggregation with map-side combining."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{what} are not unique by {', '.join(keys)}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_many") -> DataFrame:
    """A join that first checks the sides that ``validate`` calls one."""
    one_left, one_right = (x == "one" for x in validate.split("_to_"))
    if one_left:
        assert_unique(left, on, "left rows")
    if one_right:
        assert_unique(right, on, "right rows")
    return left.join(right, list(on), how)


#: Shares that the rows of a key are dealt into for a join with few rows a key.
DEALT = 64


def dealt_join(rows: DataFrame, few: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """An inner join of ``rows`` with a table of few rows a key, which is copied into shares that ``rows`` are dealt to by a
    hash of columns ``by``, so that no task reads or sorts a key whole, however few the keys."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(DEALT)).cast("int"))
    copies = few.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return dealt.join(copies, [*on, "_deal"]).drop("_deal")


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left many-to-one join that refuses rows without a match."""
    if not left.join(right, list(on), "left_anti").isEmpty():
        raise ValueError(f"rows without a match by {', '.join(on)}")
    return checked_join(left, right, on, "left", "many_to_one")


def expected_grid(*dimensions: DataFrame) -> DataFrame:
    """Every combination of the distinct rows of small dimensions."""
    return reduce(lambda a, b: a.crossJoin(b), [d.distinct() for d in dimensions])


def grid_cell(longitude: Column, latitude: Column, cell: float) -> tuple[Column, Column]:
    """Cell numbers east of -180 and north of -90."""
    if cell <= 0:
        raise ValueError("cell size must be positive")
    return F.floor((longitude + 180.0) / cell).cast("long"), F.floor((latitude + 90.0) / cell).cast("long")


def unit_sphere(longitude: Column, latitude: Column) -> tuple[Column, Column, Column]:
    lon, lat = F.radians(longitude), F.radians(latitude)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


#: Mean radius of the Earth in km (fixed value).
EARTH_KM = 6371.0088


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def odds(p: Column, low: float = 1e-6) -> Column:
    """Inverse odds (1 - p) / p of a clamped probability."""
    q = F.least(F.greatest(p, F.lit(low)), F.lit(1 - low))
    return (1 - q) / q


def aicc(log_likelihood: Column, k: Column, n: Column) -> Column:
    """Small-sample AIC: infinite where n - k - 1 is not positive, null where an input is missing."""
    spare = n - k - 1
    plain = 2.0 * k - 2.0 * log_likelihood
    return F.when(log_likelihood.isNull() | k.isNull() | n.isNull(), None).when(spare <= 0, F.lit(float("inf"))).otherwise(plain + 2.0 * k * (k + 1) / F.when(spare > 0, spare).cast("double"))


def month_start(c: Column) -> Column:
    """The date of a YYYY-MM-DD text that is the first of a month, else null."""
    d = F.try_to_date(c, "yyyy-MM-dd")
    return F.when(F.dayofmonth(d) == 1, d)


def decode_list(c: Column) -> Column:
    """A comma-joined text as its trimmed distinct items, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def encode_list(c: Column) -> Column:
    return F.array_join(c, ",")


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """SHA-256 that does not depend on row order: rows are hashed where they lie and hashes are added by parts."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    got = df.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join([",".join(columns), *map(str, got)]).encode()).hexdigest()
