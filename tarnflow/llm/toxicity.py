"""Toxicity by compression distance: windows compressed against a toxic and an ordinary zstandard dictionary.

Each dictionary holds the word beginnings that mark its class, found greedily on a bounded labelled sample: the
beginning with the largest likelihood ratio first, documents already well covered counting no more. Both end in one
marker, which also begins every window: its match makes zstandard write a compressed block even for a short window, so
that the two lengths differ by what the dictionaries explain alone. A logistic fit of the differences' statistics
calibrates the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .fitting import held_out, labelled_sample, logistic
from .common import hold, table

#: Chosen by cross-validation over the rows that are not held out (crc32 remainders 0, 1 and 3 in turn).
#: Labelled rows that a fit reads at most; words in a window; a beginning's least support, lift and likelihood ratio; how often a document is covered.
SAMPLE_ROWS, WINDOW_WORDS, LEAST_SHARE, LEAST_LIFT, LEAST_RATIO, COVER = 8000, 4, 0.01, 3.0, 25.0, 4
THRESHOLD = 0.3
_MARK = bytes(range(1, 8)) + bytes(range(14, 23))


def _beginnings(text: str) -> set[str]:
    out = set()
    for w in set(text.lower().split()):
        out.add(w + " ")
        out.update(w[:k] for k in (4, 5, 6, 7) if len(w) >= k)
    return out


def _ratio(a: int, b: int, n: int, m: int) -> float:
    """Twice the log likelihood ratio of a of n against b of m."""
    e, out = (a + b) / (n + m), 0.0
    for k, of in ((a, n), (b, m)):
        for o, x in ((k, e * of), (of - k, (1 - e) * of)):
            if o > 0:
                out += o * math.log(o / x)
    return 2 * out


def distinctive(own: list[str], other: list[str]) -> list[str]:
    """Word beginnings that mark the texts ``own`` against ``other``, the most telling first."""
    n, m = len(own), len(other)
    if not n or not m:
        return []
    here: Counter = Counter()
    for t in own:
        here.update(_beginnings(t))
    here = Counter({k: c for k, c in here.items() if c >= max(2, LEAST_SHARE * n)})
    there: Counter = Counter()
    for t in other:
        there.update(k for k in _beginnings(t) if k in here)
    rest: dict[str, set[int]] = {k: set() for k, c in here.items() if c / n > LEAST_LIFT * (there[k] + 0.5) / m and _ratio(c, there[k], n, m) > LEAST_RATIO}
    for i, t in enumerate(own):  # texts are read again rather than all their beginnings held
        for k in _beginnings(t):
            if k in rest:
                rest[k].add(i)
    chosen, cover = [], Counter()
    while rest:
        best = max(rest, key=lambda k: (_ratio(len(rest[k]), there[k], n, m), k))
        if _ratio(len(rest[best]), there[best], n, m) < LEAST_RATIO or len(rest[best]) / n <= 2 * there[best] / m:
            break
        chosen.append(best)
        hit = rest.pop(best)
        cover.update(hit)
        full = {i for i in hit if cover[i] >= COVER}
        rest = {k: left for k, v in rest.items() if (left := v - full)}
    return chosen


def _compressor(marks: list[str]) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        compression_level=3, window_log=17, min_match=5, strategy=zstandard.STRATEGY_DFAST,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    content = (" " + " ".join(k.strip() for k in reversed(marks)) + " ").encode() if marks else b""
    held = zstandard.ZstdCompressionDict(content + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


@dataclass
class Toxicity:
    """The two dictionaries and the calibration; small, so it travels with a task's closure."""

    toxic: list[str]
    ordinary: list[str]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, texts: Iterator[str]) -> np.ndarray:
        of_toxic, of_ordinary = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        out, head = [], _MARK + b" "
        for t in texts:
            w = t.lower().split()
            d = np.array(
                [len(of_ordinary(x)) - len(of_toxic(x)) for i in range(0, len(w), WINDOW_WORDS) if (x := head + " ".join(w[i : i + WINDOW_WORDS]).encode("utf-8", "surrogatepass") + b" ")],
                dtype=np.int32,
            )
            if not len(d):
                out.append((0.0,) * 9)
                continue
            top = np.sort(d)[::-1][:3]
            hits = [int((d >= k).sum()) for k in (2, 3, 4, 5)]
            out.append((min(top[0], 8), d.mean(), top.mean(), hits[0] / len(d), hits[1] / len(d), *map(math.log1p, hits[1:]), math.log1p(np.maximum(d - 1, 0).sum())))
        return np.array(out, dtype=float).reshape(-1, 9)

    def scores(self, texts: Iterator[str]) -> np.ndarray:
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -35, 35)))


def train(texts: list[str], labels: list[int]) -> Toxicity:
    """Fits on distinct texts; with one class alone every score is that class's smoothed share."""
    seen = {t: y for t, y in zip(texts, labels, strict=True)}
    toxic, ordinary = [t for t, y in seen.items() if y], [t for t, y in seen.items() if not y]
    model = Toxicity(distinctive(toxic, ordinary), distinctive(ordinary, toxic), np.zeros(9), np.ones(9), np.zeros(10))
    x, y = model.features(seen), np.array(list(seen.values()), dtype=float)
    if 0 < y.sum() < len(y):
        model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
        model.weights = logistic((x - model.centre) / model.scale, y)
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.weights[0] = math.log(share / (1 - share))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Toxicity:
    """A model learnt from at most ``rows`` labelled documents that are not held out."""
    got = labelled_sample(docs, labels, "toxic", rows, [F.coalesce("text", F.lit("")).alias("text")]).collect()
    return train([r["text"] for r in got], [r["_label"] for r in got])


def score(docs: DataFrame, model: Toxicity, name: str = "score") -> DataFrame:
    """Every row of ``docs`` with a column ``name``; a null or empty text gets the score of no window.

    Whole texts are read, of any length. Columns of ``docs`` stay, but one called ``name`` is replaced. Equal texts have
    equal scores, rows repeated give rows repeated, no rows give no rows.
    """
    rows = docs.drop(name)
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in batches:
            s = model.scores(t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*kinds.fields, StructField(name, DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
