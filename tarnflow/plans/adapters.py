"""The library's inputs over the test tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OCCURRENCES = """SELECT o_orderkey AS row_id, c_mktsegment AS species, o_orderkey AS gbifID,
  CAST((o_custkey * 7919 + o_orderkey) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS longitude,
  CAST((o_orderkey * 104729) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS latitude,
  CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS basisOfRecord, o_orderstatus AS occurrenceStatus, o_totalprice AS uncertainty
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

SCORES = "SELECT CAST(user_id % 7 AS BIGINT) AS grp, event_type = 'purchase' AS is_presence, value AS score FROM {events}"

METRICS = """SELECT p_brand AS taxon, l_returnflag AS M, p_type AS candidate, CAST(l_linenumber % 4 AS BIGINT) AS fold,
  round(CAST(0.5 AS DOUBLE) + CAST(4 AS DOUBLE) * avg(l_discount), 6) AS presence_rank, round(avg(l_quantity) / CAST(50 AS DOUBLE), 6) AS overlap,
  round(avg(l_extendedprice) / CAST(100000 AS DOUBLE), 6) AS centroid_distance, round(avg(l_tax), 6) AS breadth_error,
  round(avg(l_discount), 6) AS quantile_error, count(*) AS n_rows
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag, p_type, l_linenumber % 4"""

STRATA = "SELECT n_name AS species, r_name AS stratum FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, OCCURRENCES)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SCORES)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, METRICS)


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, STRATA)


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id", "label AS species", *[f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(8)])


def oracle(text: str) -> str:
    """The SQL of a query for DuckDB, with the adapters it names as common tables."""
    plain = {t: t for t in TABLES}
    env = "SELECT vec_id, label AS species, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(8)) + " FROM embeddings"
    known = {"occ": OCCURRENCES.format(**plain), "scores": SCORES.format(**plain), "metrics": METRICS.format(**plain), "strata": STRATA.format(**plain), "env": env}
    import re

    used = [f"{k} AS ({v})" for k, v in known.items() if re.search(rf"\b{k}\b", text)]
    body = text.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join([*used, body[5:]])
    return ("WITH " + ", ".join(used) + " " if used else "") + body
