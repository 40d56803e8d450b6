"""Shared helpers of the training-data operators: scratch tables, typed inputs, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees.

    Where it is unset, a temporary one if the session is local to one machine, as in tests; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch at most: texts may be long, and a worker holds a batch and what it makes of it.
BATCH_ROWS = 1000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS``, if they are larger or unbounded."""
    now = int(spark.conf.get(_ROWS_CONF, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))


_kept: dict[str, object] = {}


def hold(name: str | None = None, clear=None) -> None:
    """Called where a task begins: drops what other operators keep in this worker, which lives on between tasks, and gives
    back what Arrow keeps of the batches before."""
    for other in [n for n in _kept if n != name]:
        _kept.pop(other)()
    pa.default_memory_pool().release_unused()
    if name:
        _kept[name] = clear


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_owners: list[list[str]] = []


@contextmanager
def owning(paths: list[str]) -> Iterator[None]:
    """Notes in ``paths`` the scratch tables that are written inside, so that their owner can discard them."""
    _owners.append(paths)
    try:
        yield
    finally:
        _owners[:] = [x for x in _owners if x is not paths]


def materialise(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it again, so that its lineage ends in files."""
    bounded_batches(spark)
    path = path or scratch_path(spark, name)
    for paths in _owners:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Removes scratch tables that nothing reads any more, given as their paths or as ``materialise`` returned them."""
    for t in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._scratch)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession, least: int = 12) -> int:
    """Partitions for an explicit repartition by key."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges`` (a, b): the component is its smallest node.

    Large-star and small-star steps alternate until no edge changes. Each step groups edges by a node only through
    minima (``groupBy().min`` with map-side combining) and a join that adaptive execution can split, and each round is
    written to the shared folder, so that nothing is gathered in one task and a lost executor costs one round. What a
    round leaves behind is discarded; the result is a scratch table that the caller may discard.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = materialise(spark, edges.select("a", "b").where("a <> b").distinct(), "edges")
    before, state = None, ()
    while state != before:
        before = state
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        sides = both(now)
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour and the node itself are tied to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        down = materialise(spark, down, "large-star")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        settled = materialise(spark, small, "small-star")
        discard(spark, now, down)
        now = settled
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    stars = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    out = materialise(spark, stars, "components")
    discard(spark, now)
    return out


def release(spark: SparkSession) -> None:
    """Lets the context cleaner remove the shuffle files of plans that nothing holds any more, between long phases."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
