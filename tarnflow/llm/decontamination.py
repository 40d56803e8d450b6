"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items.

Every passage of every training document is a query. Impacts are divided by an item's score against itself, so one
threshold serves all items; all items above it are retrieved, then verified by the overlap of word sequences with the
item's question (all but its last sentence) and its answer (the last sentence).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, materialise, table

#: Share of an item's own score that a passage must reach; share of its word triples that question and answer need; items in a block.
THRESHOLD, OVERLAP, GRAM, BLOCK = 0.5, 0.5, 3, 4
K1, B = 1.2, 0.75
#: Bytes of test items in one index that goes to tasks; more items make more indexes, each with its pass over the corpus.
INDEX_BYTES = 8 << 20
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(w: list[str]) -> set[tuple[str, ...]]:
    k = min(GRAM, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer; one sentence alone is a question."""
    parts = [w for s in _SENTENCE.split(text.strip()) if (w := words(s))]
    return [x for p in parts[: max(1, len(parts) - 1)] for x in p], parts[-1] if len(parts) > 1 else []


class Index:
    """Postings with an upper bound for each term and for each term in each block of items.

    An index of a part of the items takes ``whole``, the (items, mean words, most words, items by term) of all of them.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, int, dict[str, int]] | None = None):
        kept = sorted((i, t) for i, t in items if words(t or ""))
        self.items, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.parts: dict[int, tuple] = {}
        counts = [Counter(words(t)) for _, t in kept]
        if whole is None:
            sizes = [sum(c.values()) for c in counts]
            whole = len(sizes), sum(sizes) / max(1, len(sizes)), max(sizes, default=1), Counter(w for c in counts for w in c)
        total, mean, self.longest, df = whole
        self.terms = {w: n for n, w in enumerate(sorted({w for c in counts for w in c}))}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, c in enumerate(counts):
            norm = K1 * (1 - B + B * sum(c.values()) / mean)
            raw = {w: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in c.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                postings[self.terms[w]].append((d, x / own))
        self.docs = [np.array([d for d, _ in postings[t]], np.int32) for t in range(len(self.terms))]
        self.impacts = [np.array([x for _, x in postings[t]]) for t in range(len(self.terms))]
        # the blocks of a term and its bound in each; one more term without any: a word of no item
        self.n_blocks = max(1, -(-len(kept) // BLOCK))
        self.blocks, self.block_bounds = [], []
        for d, x in zip(self.docs, self.impacts, strict=True):
            first = np.flatnonzero(np.r_[True, np.diff(d // BLOCK) > 0]) if len(d) else np.zeros(0, np.int64)
            self.blocks.append(d[first] // BLOCK)
            self.block_bounds.append(np.maximum.reduceat(x, first))
        self.bound = np.array([*(x.max() for x in self.block_bounds), 0.0])

    def search(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (item number, score) of at least ``threshold`` for the distinct ``terms``: block-max WAND.

        What the blocks of all terms allow is summed once, so that lists skip to the next block that can pass.
        """
        eps = 1e-6
        if not len(terms):
            return []
        blocks, bounds = np.concatenate([self.blocks[t] for t in terms]), np.concatenate([self.block_bounds[t] for t in terms])
        passing = np.flatnonzero(np.bincount(blocks, bounds, self.n_blocks) >= threshold - 1e-5) * BLOCK
        if not len(passing):
            return []
        lists = [(self.docs[t].tolist(), self.impacts[t], float(self.bound[t]), t) for t in terms]
        at = [bisect_left(x[0], int(passing[0])) for x in lists]
        out = []
        live = [i for i, x in enumerate(lists) if at[i] < len(x[0])]
        while live:
            live.sort(key=lambda i: lists[i][0][at[i]])
            total, pivot = 0.0, None
            for n, i in enumerate(live):
                total += lists[i][2]
                if total >= threshold - eps:
                    pivot = n
                    break
            if pivot is None:
                break
            d = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == d:
                pivot += 1
            ahead = live[: pivot + 1]
            block = d // BLOCK * BLOCK
            n = int(np.searchsorted(passing, block))
            if n == len(passing):
                break
            if passing[n] != block:
                # no item of this block can pass: every list goes on to the next block that can
                to, ahead = int(passing[n]), live
            elif lists[ahead[0]][0][at[ahead[0]]] == d:
                score = sum(float(lists[i][1][at[i]]) for i in ahead)
                if score >= threshold - eps:
                    out.append((d, score))
                to = d + 1
            else:
                to = d
            for i in ahead:
                if lists[i][0][at[i]] < to:
                    at[i] = bisect_left(lists[i][0], to, at[i])
            live = [i for i in live if at[i] < len(lists[i][0])]
        return out

    def passages(self, text: str) -> Iterator[tuple[int, list[str], list[tuple[int, float]]]]:
        """(first word, words, retrieved items) of each passage that retrieves any.

        A passage is twice as long as the longest item and begins every such length, so an item copied whole lies in
        one. Bounds are summed for all passages at once: passages, then blocks, that cannot pass are not searched.
        """
        w = words(text)
        step = self.longest
        none = len(self.terms)
        get = self.terms.get
        ids = np.fromiter([get(x, none) for x in w], np.int32, len(w))
        if not len(ids) or (ids == none).all():
            return
        starts = np.arange(0, max(1, len(w) - step), step)
        half = np.add.reduceat(self.bound[ids].astype(np.float64), np.arange(0, len(w), step))
        sums = half[: len(starts)] + np.append(half, 0.0)[1 : len(starts) + 1]
        for s in starts[sums >= THRESHOLD - 1e-6]:
            distinct = np.unique(ids[s : s + 2 * step])
            distinct = distinct[distinct != none]
            if hits := self.search(distinct):
                yield int(s), w[s : s + 2 * step], hits

    def grams(self, d: int) -> tuple[set, set]:
        """The word triples of an item's question and answer."""
        if d not in self.parts:
            if len(self.parts) > 2000:
                self.parts.clear()
            self.parts[d] = tuple(map(_grams, question_answer(self.texts[d])))
        return self.parts[d]

    def verified(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word of the passage), the best passage of each item."""
        best: dict[int, tuple] = {}
        for s, w, hits in self.passages(text):
            here = _grams(w) if len(w) >= GRAM else set()
            for d, score in hits:
                share = []
                for grams in self.grams(d):
                    k = len(next(iter(grams))) if grams else GRAM
                    seen = here if k == GRAM else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
                    share.append(len(grams & seen) / len(grams) if grams else 1.0)
                if min(share) >= OVERLAP:
                    best[d] = max(best.get(d, (-1,)), (score, *share, -s))
        return [(self.items[d], b[0], b[1], b[2], -b[3]) for d, b in sorted(best.items())]


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, words) of each term of an item, and a row without term that has the item's words."""
    for b in batches:
        rows = []
        for part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if w := words(text):
                rows += [(part, None, len(w)), *((part, x, None) for x in set(w))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["part", "term", "words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, ...) for each document that holds a test item, with its best passage.

    Null or empty texts of either side hold nothing; a repeated document gives its rows again, a repeated item its own;
    rows with a null doc_id are searched too; texts may be of any length; no rows of either side give no rows. Columns other than doc_id, text, item_id are ignored. Items go to tasks in
    indexes of at most about ``INDEX_BYTES``; weights and passages are those of all items, however many indexes there are.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // INDEX_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    if parts > 1:
        terms = materialise(docs.sparkSession, items.select(part_of.alias("part"), "text").mapInArrow(_item_terms, "part long, term string, words long"), "leak-terms")
        count, mean, longest = terms.where("term is null").agg(F.count("*"), F.avg("words"), F.max("words")).first()
        by_term = terms.where("term is not null").groupBy("term").count()
        by_term = materialise(docs.sparkSession, by_term, "leak-items-by-term")
    out = None
    for part in range(parts):
        whole = None
        if parts > 1 and count:
            mine = terms.where((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct()
            whole = count, mean, longest, {r[0]: r[1] for r in by_term.join(mine, "term").select("term", "count").collect()}
        index = Index([(r[0], r[1]) for r in items.where(part_of == part).collect()], whole)
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            hold()
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in held.value.verified(t.as_py() or "")]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LEAKS.split(", ")])

        found = texts.mapInArrow(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
