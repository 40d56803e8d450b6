"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a sentence of a line, long ones in parts) is hashed to a wide vector of signs, times the root of its
length; a document's fingerprint is the sum modulo 2^24 in each lane. Order does not count, a paragraph is inserted or
deleted by adding or subtracting its vector, and the cosine of two fingerprints estimates the share of text they have
in common.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parallelism, table

LANES, MODULUS = 256, 1 << 24
_PARAGRAPH = re.compile(r"[^\n.!?]{1,240}[.!?]*")


def paragraphs(text: str) -> list[str]:
    return [p for x in _PARAGRAPH.findall(text) if (p := x.strip())]


def vector(parts: list[str]) -> np.ndarray:
    """The sum of the vectors of ``parts``, each lane from 0 to MODULUS - 1."""
    if not parts:
        return np.zeros(LANES, np.int64)
    raw = [p.encode("utf-8", "surrogatepass") for p in parts]
    bits = np.unpackbits(np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=LANES // 8).digest() for p in raw]), np.uint8).reshape(len(raw), -1), axis=1)
    weight = np.array([math.isqrt(len(p)) for p in raw], dtype=np.float64)
    return (2 * (weight @ bits).astype(np.int64) - int(weight.sum())) % MODULUS


def insert(fingerprint: np.ndarray, parts: list[str]) -> np.ndarray:
    return (fingerprint + vector(parts)) % MODULUS


def delete(fingerprint: np.ndarray, parts: list[str]) -> np.ndarray:
    return (fingerprint - vector(parts)) % MODULUS


def as_text(fingerprint: np.ndarray) -> str:
    lanes = fingerprint.astype("<u4").view(np.uint8).reshape(LANES, 4)[:, :3]
    return base64.b64encode(lanes.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    lanes = np.zeros((LANES, 4), np.uint8)
    lanes[:, :3] = np.frombuffer(base64.b64decode(text), np.uint8).reshape(LANES, 3)
    return lanes.reshape(-1).view("<u4").astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the cosine of the sums, from 0 to just under 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (np.where(v >= MODULUS // 2, v - MODULUS, v).astype(float) for v in (a, b))
    norm = math.sqrt((x @ x) * (y @ y))
    return min(max(float(x @ y) / norm, 0.0), 0.999999) if norm else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the text's fingerprint; a null text counts as empty, other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([as_text(vector(paragraphs(t.as_py() or ""))) for t in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=["doc_id", "text", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, fingerprint string")


def _bucket(at: Column, cuts: list[float], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted ``cuts`` are at most the value, by halving."""
    high = len(cuts) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(at < F.lit(int(cuts[mid])), _bucket(at, cuts, low, mid)).otherwise(_bucket(at, cuts, mid + 1, high))


def with_next(docs: DataFrame, step, schema: str) -> DataFrame:
    """``step(rows)`` over every run of documents in ascending doc_id, each run followed by the one after its last.

    ``step`` gets an iterator of (doc_id, text, is_own) and yields a row for each own document. Ids are cut into ranges
    at their quantiles; the first document of a range also goes to the range before, and that of the first to the last,
    so that no task needs more than its range. Null ids come first; equal ids follow the order of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parallelism(docs.sparkSession)
    n = 4 * parts
    at = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n))}) if n > 1 else []
    placed = rows.withColumn("range", _bucket(at, cuts))
    heads = {r[0]: r[1] for r in placed.groupBy("range").agg(F.min(at)).collect()}
    order = sorted(heads)
    if not order:
        heads, order = {0: 0}, [0]
    head = F.array(*[F.lit(heads.get(i)).cast("long") for i in range(len(cuts) + 1)])
    prior = {r: order[i - 1] for i, r in enumerate(order)}
    before = F.array(*[F.lit(prior.get(i, 0)) for i in range(len(cuts) + 1)])
    own = F.struct(F.col("range").alias("range"), F.lit(True).alias("own"))
    lent = F.struct(F.element_at(before, F.col("range") + 1).alias("range"), F.lit(False).alias("own"))
    spread = placed.select("doc_id", "text", F.explode(F.when(at == F.element_at(head, F.col("range") + 1), F.array(own, lent)).otherwise(F.array(own))).alias("r"))
    spread = spread.select(F.col("r.range").alias("range"), F.col("r.own").alias("own"), "doc_id", "text")
    spread = spread.repartition(parts, "range").sortWithinPartitions("range", F.desc("own"), F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        yield from step(stream())

    return spread.mapInArrow(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text: its last quarter replaced by as much of the next document's beginning.

    One document alone is its own next. A null text is empty; repeated rows are documents of their own; no rows give
    no rows; other columns are ignored.
    """
    names = [x.split()[0] for x in EDITED.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in EDITED.split(", ")])

    def compare(doc: int, text: str, mark: np.ndarray, after: str, after_mark: np.ndarray) -> tuple:
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        other = vector(paragraphs(edited))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), digest, as_text(mark), as_text(other), likeness(mark, other), likeness(mark, after_mark)

    def step(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for where, own, doc, text in rows:
            if held and held[0] != where:
                held = None
            if held is None and not own:
                continue
            mark = vector(paragraphs(text))
            if held:
                out.append(compare(*held[1:], text, mark))
            held = (where, doc, text, mark) if own else None
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    return with_next(docs, step, EDITED)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
