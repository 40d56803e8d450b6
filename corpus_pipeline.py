"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes rows with any columns besides doc_id and text and, but for the last, returns the columns it was given
with their values, whatever their names. A stage's scratch tables in the shared folder go before it returns, but for the
small ones that its result reads; these are its result's ``_reads``, to be discarded when nothing reads it any more. No
stage touches what another one made.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import decontamination, jaccard, packing, substrings, toxicity
from tarnflow.llm.common import discard, free_name, materialise, owning, release, table

#: Words of a shingle and the percentage of likeness of the near-duplicate stage.
SHINGLE, LIKE = 5, 80


def _stage(work: Callable[[SparkSession, DataFrame, str], tuple[DataFrame, list[DataFrame] | None]]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that discards its own scratch tables but those that its result reads; None stands for all it has left."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch: list[str] = []
        with owning(scratch):
            out, read = work(spark, docs, sf_dir)
        kept = scratch if read is None else [t._scratch for t in read]
        discard(spark, *[path for path in scratch if path not in kept])
        release(spark)
        out._reads = kept
        return out

    return stage


def _rows_named(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a 64-bit hash of id and whole text, which is never null, and that column's name.

    It names a row: doc_ids may be shared by different texts, or null.
    """
    row = free_name(docs, "_row")
    return docs.withColumn(row, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text"))), row


def _without(docs: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """Named ``docs`` less those in ``rows``."""
    return docs.join(rows.select(row).distinct(), row, "left_anti").select(*docs.columns)


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[DataFrame] | None]:
    """Documents whose toxicity is below the threshold; the model is fitted on the labels of the whole corpus.

    A null or empty text has no window and stays where texts without a sign of either class stay; equal texts, of
    repeated rows as well, are judged alike; ids are not looked at; no rows give no rows.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns), None


@_stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[DataFrame] | None]:
    """The document with the smallest doc_id of each component of near copies; rows repeated whole count as one.

    A null doc_id comes after all others; rows that share one are told apart by their texts' hashes. Null, empty and
    wordless texts are near nothing and stay, repeated or not. No rows give no rows.
    """
    named, row = _rows_named(docs)
    found = jaccard.jaccard_components(named.select(F.col(row).alias("doc_id"), "text"), size=SHINGLE, like=LIKE)
    found = materialise(spark, found.where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id"), "pipeline-components")
    several = found.groupBy("component_id").count().where("count > 1").select("component_id")
    members = materialise(spark, found.join(several, "component_id").groupBy(row, "component_id").agg(F.count("*").alias("n")), "pipeline-members")
    if members.isEmpty():
        return docs.select("*"), []
    ids = named.select(row, "doc_id").join(members, row)
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))).alias("first")).select(F.col("first.row").alias(row))
    first = materialise(spark, first, "pipeline-first")
    rest = _without(named, members.join(first, row, "left_anti"), row)
    twice = members.where("n > 1").select(row)
    if twice.isEmpty():
        return rest.drop(row), [members, first]
    again = rest.join(twice, row, "left_semi").select(*named.columns)
    return _without(rest, twice, row).unionByName(again.dropDuplicates([row])).drop(row), [members, first]


@_stage
def cut_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[DataFrame] | None]:
    """Texts without strings of 100 bytes that start earlier in the corpus; a document of which nothing is left goes.

    Null and empty texts stay; rows repeated whole are one document and are cut alike; a null doc_id comes first. A
    column n_chars is set to the length of the text that is left. No rows give no rows.
    """
    left = substrings.remove_duplicates(docs, figures=False)
    changed = {"n_chars": F.length("text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
    return left.withColumns(changed).select(*docs.columns), None


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[DataFrame] | None]:
    """Documents that hold no item of ``benchmark``.

    Null and empty texts hold none; each of repeated rows is judged alike, and rows that share an id by their own
    texts; an empty benchmark, or no rows, leave the rows as they are.
    """
    named, row = _rows_named(docs)
    leaks = decontamination.find_leaks(named.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = materialise(spark, leaks.select(F.col("doc_id").alias(row)), "pipeline-leaks")
    return _without(named, leaks, row).drop(row), [leaks]


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, list[DataFrame] | None]:
    """The pieces of every document with their places in sequences.

    A null text is empty; an empty document is the one piece of its end mark; long ones are cut; each of repeated rows
    is packed; columns of the rows but doc_id and text are not carried on. No rows give no pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")), None


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_substrings),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Models, tokens and suffix order are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            read, docs = docs._reads, materialise(spark, docs, f"pipeline-{name}")
            discard(spark, *read, *before)
            release(spark)
            before = [docs._scratch]
    return docs
