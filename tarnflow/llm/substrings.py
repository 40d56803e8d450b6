"""Exact duplicate substrings by a column-wise multi-document suffix array.

Every window of ``width`` bytes belongs to the segment of its minimiser, the smallest hashed k-mer inside it, so equal
windows meet at equal k-mers and only segments whose k-mer repeats are candidates. Equal segments are collapsed to their
first occurrence. The distinct segments of one k-mer go to one bucket, where the Burrows-Wheeler transform and the
common prefixes of the whole collection are built column by column: each round inserts one symbol of every segment,
from the right, and writes the next transform in one sequential pass over the last. Windows that stand together under
common prefixes of ``width`` are equal, and all but the first in document order are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, hold, materialise, owning, parallelism, release, table

WIDTH, KMER = 100, 32
_RANDOM = np.random.default_rng(20240117)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 1 << 14)
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            table = np.ones(n, np.uint64)
            table[1:] = np.uint64(base)
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of ``w`` values."""
    n = len(v)
    whole = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    whole[:n] = v
    rows = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: bytes, width: int = WIDTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """(k-mer hash, segment hash, first window, windows) of each segment of a text.

    A segment is a run of windows with one minimiser; its text is the bytes from its first window to the end of its
    last. Texts of more windows than a block are cut so that blocks share width - 1 bytes and every window lies in one.
    """
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    block = (1 << _POSITION_BITS) - width
    if n - width + 1 > block:
        parts = [(at, segments(data[at : at + block + width - 1], width, kmer)) for at in range(0, n - width + 1, block)]
        return tuple(np.concatenate([p[i] + at if i == 2 else p[i] for at, p in parts]) for i in range(4))
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * power[:n], out=sums[1:])
    mers = _mix((sums[kmer:] - sums[:-kmer]) * inverse[: n - kmer + 1])
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    at = (_sliding_least((mers & ~mask) | np.arange(len(mers), dtype=np.uint64), width - kmer + 1) & mask).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    ends = last + width
    texts = _mix((sums[ends] - sums[first]) * inverse[first] + (ends - first).astype(np.uint64) * np.uint64(_STEP))
    return mers[at[first]].view(np.int64), texts.view(np.int64), first, last - first + 1


def collection_bwt(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, suffix length, common prefix with the row before) of every suffix of the collection, in order.

    The empty suffixes come first, in the order of the texts, and end marks compare as smaller than every byte and
    unequal to each other. Common prefixes are counted to 255.
    """
    n = len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    longest = int(size.max()) if n else 0
    # column j holds each text's symbol j from its end; 0 is the end mark, so bytes become 1 to 256, or ranks if they fit
    flat = np.frombuffer(b"".join(texts), np.uint8)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    kind = np.uint8 if len(used) < 256 else np.uint16
    code = np.zeros(256, kind)
    code[used] = np.arange(1, len(used) + 1)
    column = np.zeros((longest + 1, n), kind)
    for i, t in enumerate(texts):
        column[: len(t), i] = code[np.frombuffer(t, np.uint8)[::-1]]
    bwt, common = column[0].copy(), np.zeros(n, np.uint8)
    # the rows put in by the last round, ascending, and whose they are
    fresh, rows, owner = np.ones(n, bool), np.arange(n), np.arange(n)
    for j in range(longest):
        order = np.argsort(bwt, kind="stable")[int(np.count_nonzero(bwt == 0)) :]
        added = fresh[order]
        at = np.flatnonzero(added)
        kept = ~added
        owner = owner[np.searchsorted(rows, order[at])]
        rows = n + at
        total = n + len(order)
        grown, prefix = np.empty(total, kind), np.zeros(total, np.uint8)
        grown[:n] = bwt[:n]
        grown[n:][kept] = bwt[n:]
        grown[rows] = column[j + 1][owner]
        tail = prefix[n:]
        tail[kept] = common[n:]
        # a new row and the one after it: one more than the least common prefix between the rows they extend
        above = np.concatenate([at, at + 1])
        above = above[(above > 0) & (above < len(order))]
        low, high = order[above - 1], order[above]
        same = bwt[low] == bwt[high]
        tail[above[~same]] = 0
        above, low, high = above[same], low[same] + 1, high[same]
        size_of = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        by = np.argsort(size_of, kind="stable")
        above, low, high = above[by], low[by], high[by]
        cuts = np.searchsorted(size_of[by], np.arange(int(size_of.max(initial=-1)) + 2))
        level = common
        for k in range(len(cuts) - 1):
            if cuts[k] < cuts[k + 1]:
                part = slice(cuts[k], cuts[k + 1])
                tail[above[part]] = np.minimum(np.minimum(level[low[part]], level[high[part] - (1 << k) + 1]), 254) + 1
            if k + 2 < len(cuts):
                level = np.minimum(level[: -(1 << k)], level[1 << k :])
        bwt, common = grown, prefix
        fresh = np.zeros(total, bool)
        fresh[rows] = True
    follow = np.full(len(bwt), -1)
    order = np.argsort(bwt, kind="stable")[int(np.count_nonzero(bwt == 0)) :]
    follow[order] = n + np.arange(len(order))
    text, length = np.zeros(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    rows, ids = np.arange(n), np.arange(n)
    for j in range(longest + 1):
        text[rows], length[rows] = ids, j
        ahead = follow[rows]
        rows, ids = ahead[ahead >= 0], ids[ahead >= 0]
    return text, length, common


def repeated_windows(texts: list[bytes], doc: np.ndarray, tie: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the windows that also begin earlier, by (doc, tie, first + offset), in another or the same text."""
    text, length, common = collection_bwt(texts)
    group = np.cumsum(common < width)
    linked = common >= width
    inside = linked | np.r_[linked[1:], False]
    text, length, group = text[inside], length[inside], group[inside]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    offset = size[text] - length
    order = np.lexsort((first[text] + offset, tie[text], doc[text], group))
    later = np.r_[False, group[order][1:] == group[order][:-1]] if len(order) else np.zeros(0, bool)
    keep = order[later]
    return text[keep], offset[keep]


#: Distinct segments of one k-mer beyond which they are compared window by window; bytes of segments in one collection.
MANY, BUCKET_BYTES = 3000, 192 << 10
_WHERE = "doc long, tie long"
_SPAN = _WHERE + ", start long, stop long"
_span_schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _batches(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], names=names)


_SEGMENT = f"mer long, seg long, {_WHERE}, start long, windows long, later boolean, often boolean"
#: Documents of the sample that finds frequent k-mers; of how many of their segments a k-mer is called frequent.
SAMPLE_DOCS, FREQUENT = 4000, 8


def _frequent_mers(docs: DataFrame, width: int, kmer: int) -> np.ndarray:
    """Sorted k-mers of several segments of a bounded sample: they repeat for certain, and no list of another is long."""
    n_docs = docs.count()
    drawn = docs if n_docs <= SAMPLE_DOCS else docs.where(F.pmod(F.xxhash64(F.lit(3), "doc", "tie"), F.lit(1 << 30)) < int(SAMPLE_DOCS / n_docs * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(segments(x.as_py() or b"", width, kmer)[0])], names=["mer"])

    often = drawn.select("data").mapInArrow(run, "mer long").groupBy("mer").count().where(F.col("count") >= FREQUENT)
    return np.sort(np.array([r[0] for r in often.select("mer").toLocalIterator()], dtype=np.int64))


def _emit(width: int, kmer: int, frequent, together: int = 200_000):
    """Every segment. One that occurs before in the rows sent together is marked as later and gets a k-mer of its own,
    so that a text that very many documents hold does not make a heavy key; those of ``frequent`` k-mers are marked."""

    def done(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        mer, seg, doc, tie, start, windows = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((start, tie, doc, seg, mer))
        same = (mer[order][1:] == mer[order][:-1]) & (seg[order][1:] == seg[order][:-1])
        later = np.zeros(len(mer), bool)
        later[order[1:]] = same
        often = frequent.value[np.minimum(np.searchsorted(frequent.value, mer), len(frequent.value) - 1)] == mer if len(frequent.value) else np.zeros(len(mer), bool)
        mer[later] = _mix((doc[later] + tie[later] + (start[later] << 20)).view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (mer, seg, doc, tie, start, windows, later, often)], names=["mer", "seg", "doc", "tie", "start", "windows", "later", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        parts, held = [], 0
        for b in batches:
            for i, (doc, tie) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                mer, seg, first, windows = segments(b.column(2)[i].as_py() or b"", width, kmer)
                if len(mer):
                    parts.append([mer, seg, np.full(len(mer), doc), np.full(len(mer), tie), first, windows])
                    held += len(mer)
                if held > together:
                    yield done(parts)
                    parts, held = [], 0
        if parts:
            yield done(parts)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each segment that a document's row names."""
    for b in batches:
        mers, docs, ties, starts, cuts = [], [], [], [], []
        for r in zip(*(c for c in b.columns), strict=True):
            doc, tie, data, wanted = (x.as_py() for x in r)
            for w in wanted:
                mers.append(w["mer"])
                docs.append(doc)
                ties.append(tie)
                starts.append(w["start"])
                cuts.append(data[w["start"] : w["stop"]])
            if len(mers) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(mers, pa.int64()), pa.array(docs, pa.int64()), pa.array(ties, pa.int64()), pa.array(starts, pa.int64()), pa.array(cuts, pa.binary())], names=["mer", "doc", "tie", "start", "cut"])
                mers, docs, ties, starts, cuts = [], [], [], [], []
        if mers:
            yield pa.RecordBatch.from_arrays([pa.array(mers, pa.int64()), pa.array(docs, pa.int64()), pa.array(ties, pa.int64()), pa.array(starts, pa.int64()), pa.array(cuts, pa.binary())], names=["mer", "doc", "tie", "start", "cut"])


def _spans(doc: np.ndarray, tie: np.ndarray, at: np.ndarray, width: int) -> pa.RecordBatch:
    """Runs of the bytes that windows cover."""
    order = np.lexsort((at, tie, doc))
    doc, tie, at = doc[order], tie[order], at[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > at[:-1] + width)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tie[first]), pa.array(at[first]), pa.array(at[last] + width)], schema=_span_schema)


def _suffix_arrays(width: int):
    """Spans of repeated windows from rows sorted by k-mer; whole k-mers fill a collection up to its bound."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        doc, tie, first = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
        text, offset = repeated_windows([r[4] for r in rows], doc, tie, first, width)
        return _spans(doc[text], tie[text], first[text] + offset, width) if len(text) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if weight > BUCKET_BYTES and r[0] != held[-1][0]:
                    if (got := solve(held)) is not None:
                        yield got
                    held, weight = [], 0
                held.append(r)
                weight += len(r[4])
        if held and (got := solve(held)) is not None:
            yield got

    return run


def _windows(width: int):
    """Each window of a segment by itself, as (mer, h1, h2, doc, tie, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for mer, doc, tie, start, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i in range(len(cut) - width + 1):
                    h = xxhash.xxh3_128_intdigest(cut[i : i + width])
                    out.append((mer, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), doc, tie, start + i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["mer", "h1", "h2", "doc", "tie", "start"])

    return run


def duplicate_spans(docs: DataFrame, width: int = WIDTH, kmer: int = KMER) -> DataFrame:
    """(doc, tie, start, stop): bytes of ``docs`` (doc, tie, data) covered by windows that also begin earlier.

    Spans of a document may touch or overlap. (doc, tie) names a document and orders them all.
    """
    spark = docs.sparkSession
    docs = docs.select("doc", "tie", "data")
    frequent = spark.sparkContext.broadcast(_frequent_mers(docs, width, kmer))
    every = docs.mapInArrow(_emit(width, kmer, frequent), _SEGMENT)
    # frequent k-mers need not be counted, so their rows are spread
    spread = F.when(F.col("often"), F.xxhash64("doc", "tie", "start")).otherwise(F.lit(0).cast("long"))
    alike = every.withColumn("spread", spread).withColumn("n", F.count("*").over(Window.partitionBy("mer", "spread"))).where("n > 1 or later or often")
    found = materialise(spark, alike.drop("n", "spread", "often"), "substring-candidates")
    release(spark)
    # equal segments: all but the first are repeated whole
    kept = found.where("not later").groupBy("mer", "seg").agg(F.min(F.struct("doc", "tie", "start")).alias("one"), F.first("windows").alias("windows"), F.count("*").alias("n"))
    kept = materialise(spark, kept.select("mer", "seg", "one.*", "windows", "n"), "substring-segments")
    firsts = kept.where("n > 1").select("mer", "seg", F.col("doc").alias("doc1"), F.col("tie").alias("tie1"), F.col("start").alias("start1"))
    later = found.where("not later").join(firsts.hint("shuffle_hash"), ["mer", "seg"]).where("doc <> doc1 or tie <> tie1 or start <> start1")
    later = later.select("doc", "tie", "start", "windows").union(found.where("later").select("doc", "tie", "start", "windows"))
    spans = materialise(spark, later.select("doc", "tie", "start", (F.col("start") + F.col("windows") + width - 1).alias("stop")), "substring-later")
    discard(spark, found)
    release(spark)
    # segments that share a k-mer with another: cut from their documents and sorted
    many = materialise(spark, kept.groupBy("mer").count().where("count > 1"), "substring-shared")
    shared = kept.join(many, "mer").select("mer", "doc", "tie", "start", (F.col("start") + F.col("windows") + width - 1).alias("stop"))
    wanted = materialise(spark, shared.groupBy("doc", "tie").agg(F.collect_list(F.struct("mer", "start", "stop")).alias("wanted")), "substring-wanted")
    discard(spark, kept)
    cuts = docs.join(wanted.hint("shuffle_hash"), ["doc", "tie"]).select("doc", "tie", "data", "wanted")
    cuts = materialise(spark, cuts.mapInArrow(_cut, f"mer long, {_WHERE}, start long, cut binary"), "substring-cuts")
    discard(spark, wanted)
    release(spark)
    crowded = materialise(spark, many.where(F.col("count") > MANY).select("mer"), "substring-crowded")
    usual = cuts.join(crowded, "mer", "left_anti").repartition(parallelism(spark), "mer").sortWithinPartitions("mer")
    sorted_spans = materialise(spark, usual.mapInArrow(_suffix_arrays(width), _SPAN), "substring-sorted")
    crowd = materialise(spark, cuts.join(crowded, "mer", "left_semi").mapInArrow(_windows(width), f"mer long, h1 long, h2 long, {_WHERE}, start long"), "substring-windows")
    discard(spark, cuts, many, crowded)
    earliest = crowd.groupBy("mer", "h1", "h2").agg(F.min(F.struct("doc", "tie", "start")).alias("one"), F.count("*").alias("n")).where("n > 1")
    again = crowd.join(materialise(spark, earliest, "substring-earliest"), ["mer", "h1", "h2"]).where(F.struct("doc", "tie", "start") != F.col("one"))
    return spans.unionByName(sorted_spans).unionByName(again.select("doc", "tie", "start", (F.col("start") + width).alias("stop")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


_FIGURES = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}


def remove_duplicates(docs: DataFrame, width: int = WIDTH, with_text: bool = True, figures: bool = True) -> DataFrame:
    """Every row of ``docs`` with its text cut, if asked for, and n_bytes, n_removed, n_spans and kept_sha256.

    A byte of the text's UTF-8 is removed if a string of ``width`` bytes covers it that also starts earlier: in a
    smaller doc_id, or before in the same document; overlaps count, and strings are judged on the input. The cut text
    leaves out what removal left of a split character; kept_sha256 is of the bytes. A null text is empty, and stays
    null when cut. Rows that share a doc_id are ordered by their texts' hashes; rows repeated whole are one document and
    get the same result each; a null doc_id comes first. Texts may be of any length: over a megabyte they are looked
    through in overlapping blocks. Other columns stay, but those named as the four figures are replaced. Without
    ``figures`` the rows keep their own columns alone, whatever their names, and rows of which nothing is left go, but
    for empty texts. No rows give no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(*_FIGURES) if figures else docs
    docs = docs if with_text else docs.select("doc_id", "text")
    doc, tie, data, found_in = (free_name(docs, f"_{n}") for n in ("doc", "tie", "data", "found"))
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    shared = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), tie: F.xxhash64(body) if shared else F.lit(0).cast("long"), data: body})
    keys = keyed.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), F.col(data).alias("data"))
    if shared:
        keys = keys.dropDuplicates(["doc", "tie"])
    scratch: list[str] = []
    with owning(scratch):
        spans = duplicate_spans(keys, width)
    found = materialise(spark, spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "stop")).alias(found_in)), "substring-spans")
    discard(spark, *scratch)
    release(spark)
    given = [c for c in docs.columns if with_text or c != "text"]
    rows = keyed.join(found.withColumnsRenamed({"doc": doc, "tie": tie}).hint("shuffle_hash"), [doc, tie], "left")
    rows = rows.select(*given, F.when(F.col("text").isNotNull(), F.col(data)).alias(data), found_in)
    made = _FIGURES if figures else {}
    schema = T.StructType([*(f for f in docs.schema if f.name in given), *(T.StructField(k, T.StringType() if v == pa.string() else T.LongType()) for k, v in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, numbers, stay = [], [], []
            for text, spans in zip(b.column(len(given)), b.column(len(given) + 1), strict=True):
                raw, runs = text.as_py(), merged([(x["start"], x["stop"]) for x in spans.as_py() or ()])
                body, at, kept = raw or b"", 0, []
                for start, stop in runs:
                    kept.append(body[at:start])
                    at = stop
                left = b"".join((*kept, body[at:]))
                texts.append(None if raw is None else left.decode("utf-8", "ignore"))
                numbers.append((len(body), len(body) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                stay.append(figures or len(left) > 0 or not body)
            columns = [pa.array(texts, b.schema.field(i).type) if n == "text" else b.column(i) for i, n in enumerate(given)]
            columns += [pa.array(c, k) for c, k in zip(list(zip(*numbers, strict=True)) or [()] * 4, made.values(), strict=False)]
            yield pa.RecordBatch.from_arrays(columns, names=[*given, *made]).filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(run, schema)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(table(spark, sf_dir, "documents"), with_text=False)


#: Every window of 100 bytes by itself, for tables whose doc_ids are distinct.
OP3_SQL = """
with given as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select doc_id, unnest(range(0, len(h) // 2 - 99)) as start, h from given where len(h) >= 200),
keyed as (select doc_id, start, md5(substr(h, 2 * start + 1, 200)) as k from windows),
ranked as (select doc_id, start, row_number() over (partition by k order by doc_id, start) as nth from keyed),
later as (select doc_id, start, lag(start) over (partition by doc_id order by start) as before from ranked where nth > 1),
runs as (select doc_id, start, sum(case when before is null or start > before + 100 then 1 else 0 end) over (partition by doc_id order by start) as run from later),
spans as (select doc_id, run, min(start) as start, max(start) + 100 as stop from runs group by all),
gaps as (select doc_id, stop, start, coalesce(lag(stop) over (partition by doc_id order by start), 0) as before from spans),
kept as (select doc_id, count(*) as n_spans, sum(stop - start) as n_removed, max(stop) as last,
    string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' order by start) as head from gaps join given using (doc_id) group by doc_id)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) as kept_sha256
from given left join kept using (doc_id)
"""
