"""Spelling variants: words of a corpus that one inserted, deleted or replaced code point turns into each other.

One edit leaves a half of a word intact, so two near words share a prefix or a suffix block. The dictionary is sorted
twice by Spark, forward and reversed: words are dealt in ranges of (length class, half) and sorted in them, and a task
scans the blocks of equal halves, comparing within a block only. A class holds words of its length and of one more, cut at
the shorter's half. A block with many words is split by the same argument over its free middle, whose edit leaves a half
of it intact, until a code point or less is free: blocks then are as small as the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, parallelism, table

#: Letters of a run (fixed values); the least length and occurrences of a word; one in so many runs loses a letter.
LEAST_LENGTH, LEAST_COUNT, DROPPED = 7, 2, 31
#: How many times a word's count its form has at least.
FORM = 10
#: Words of a block before it is split; words that a task counts before it sends them on.
BLOCK, COUNTED = 400, 200_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def damaged(doc_id: int | None, run: str) -> str:
    """``run`` less one code point where a hash of document and run says so; without an id it stays whole."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROPPED:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of ``docs`` (doc_id, text) with their occurrences, of at least that length and number.

    A run of a document is one word throughout it. Null and empty texts have no words; repeated rows count again.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            ids = b.column(0).to_pylist()
            for doc_id, text in zip(ids, b.column(1), strict=True):
                own: dict[str, int] = {}
                for run in runs((text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")):
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    word = damaged(doc_id, run)
                    if len(word) >= least_length:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield sent()
                    counts.clear()
        yield sent()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


#: A block: words of a class (that length or one more) with a common prefix and suffix of given lengths.
_BLOCK = ["class", "prefix", "suffix", "fixed"]


def _halves(words: DataFrame) -> DataFrame:
    """Each word in its prefix and its suffix block, in the class of its length and of one less."""
    n = F.char_length("word")
    of_class = words.select("word", F.explode(F.array(n, n - 1)).alias("class"))
    half = F.floor(F.col("class") / 2).cast("int")
    none = F.lit(0)
    return _fixed(of_class.select("word", "class", F.explode(F.array(F.struct(half.alias("prefix"), none.alias("suffix")), F.struct(none.alias("prefix"), (F.col("class") - half).alias("suffix")))).alias("b")).select("word", "class", "b.*"))


def _fixed(rows: DataFrame) -> DataFrame:
    # a blank is no letter: it keeps prefix and suffix apart
    return rows.withColumn("fixed", F.concat(F.expr("left(word, prefix)"), F.lit(" "), F.expr("right(word, suffix)")))


def _finer(rows: DataFrame) -> DataFrame:
    """Blocks cut at half of their free middle: a longer prefix, or a longer suffix."""
    middle = F.col("class") - F.col("prefix") - F.col("suffix")
    half = F.floor(middle / 2).cast("int")
    two = F.array(F.struct((F.col("prefix") + half).alias("prefix"), F.col("suffix")), F.struct(F.col("prefix"), (F.col("suffix") + middle - half).alias("suffix")))
    return _fixed(rows.select("word", "class", F.explode(two).alias("b")).select("word", "class", "b.*"))


def one_edit(words: list[str], length: int) -> list[tuple[int, int]]:
    """Places (i, j), i before j, of the distinct ``words`` of ``length`` or one more that are one edit apart; pairs of
    the longer ones are left to their own class."""
    short, long = [i for i, w in enumerate(words) if len(w) == length], [i for i, w in enumerate(words) if len(w) == length + 1]
    if not short or len(words) < 2:
        return []
    codes = lambda at: np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), -1)
    s, found = codes(short), []
    t = codes(long) if long else None
    for at in range(0, len(short), 64):
        a = s[at : at + 64]
        x, y = np.nonzero((a[:, None, :] != s[None, :, :]).sum(2) == 1)
        found += [(short[i + at], short[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True) if i + at < j]
        if t is not None:
            # code points that agree from the left, and from the right, leave out the inserted one
            left = np.logical_and.accumulate(a[:, None, :] == t[None, :, :-1], axis=2).sum(2)
            right = np.logical_and.accumulate((a[:, None, :] == t[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
            x, y = np.nonzero(left + right >= length)
            found += [(short[i + at], long[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs one edit apart of rows (class, prefix, suffix, fixed, word) that come sorted; a block may go on in the next batch."""
    block, words = None, []

    def pairs() -> Iterator[pa.RecordBatch]:
        if len(words) > 1 and (near := one_edit(words, block[0])):
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i, _ in near], pa.string()), pa.array([words[j] for _, j in near], pa.string())], names=["a", "b"])

    for b in batches:
        for *now, word in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != block:
                yield from pairs()
                block, words = now, []
            words.append(word)
    yield from pairs()


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of the distinct ``words.word`` that are one edit apart, each once."""
    spark, found = words.sparkSession, []
    rows = _halves(words.select("word"))
    while True:
        short = (F.char_length("word") == F.col("class")).cast("long")
        sizes = rows.groupBy(*_BLOCK).agg(F.count("*").alias("rows"), F.sum(short).alias("short")).where("rows > 1 and short > 0")
        sizes = materialise(spark, sizes, "spelling-blocks")
        shared = materialise(spark, rows.join(sizes, _BLOCK).select(*_BLOCK, "word", "rows"), "spelling-shared")
        large = (F.col("rows") > most) & (F.col("class") - F.col("prefix") - F.col("suffix") > 1)
        ranged = shared.where(~large).select(*_BLOCK, "word").repartitionByRange(parallelism(spark), *_BLOCK).sortWithinPartitions(*_BLOCK, "word")
        pairs = ranged.mapInArrow(_scan, "a string, b string")
        found.append(materialise(spark, pairs, "spelling-pairs"))
        discard(spark, sizes)
        rest = shared.where(large).drop("rows")
        if rest.isEmpty():
            discard(spark, shared)
            break
        rows = materialise(spark, _finer(rest), "spelling-split")
        discard(spark, shared)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variant_forms(words: DataFrame, pairs: DataFrame, times: int = FORM) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n) and their near ``pairs`` (a, b)."""
    spark = words.sparkSession
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("form"))).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= times * F.col("n")
    known = known.withColumn("form_n", F.when(enough, F.col("form_n"))).withColumn("form", F.when(F.col("form_n").isNotNull(), F.col("form")))
    known = materialise(spark, known, "spelling-forms")
    # forms have many times the count of their words, so chains are short; each turn doubles what a root has passed
    now = materialise(spark, known.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = materialise(spark, moved, "spelling-roots")
        discard(spark, now)
        now = after.select("word", "root")
        now._scratch = after._scratch
        if after.where("moved").isEmpty():
            break
    return known.join(now, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``docs`` (doc_id, text) with the form each is a variant of.

    A null or empty text has no words; a row with a null doc_id loses no letters; repeated rows count again; of near words
    with equal counts the first in code-point order is the form; no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    words = materialise(spark, word_counts(docs), "spelling-words")
    return variant_forms(words, near_words(words))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The hash bit by bit, over a table by rule; near words by the words that a letter less, or a gap for one, leaves of both.
OP11_SQL = r"""
with recursive crc_table as (
    select list(c order by i) as t from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i))
), runs as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents
), counted as (select doc_id, run, count(*) as n, encode(doc_id || ':' || run) as b from runs where length(run) >= 7 group by doc_id, run),
hashed as (
    select run, n, xor(list_reduce(list_transform(range(octet_length(b)), lambda k: ('0x' || substr(hex(b), 2 * k + 1, 2))::bigint),
        lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) as h from counted, crc_table
), words as (
    select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, 2 + h % length(run)) else run end as word, sum(n)::bigint as n
    from hashed group by 1 having length(word) >= 7 and sum(n) >= 2
), places as (select word, unnest(range(length(word))) as i from words),
gaps as (select word, left(word, i) || '_' || substr(word, i + 2) as gap, left(word, i) || substr(word, i + 2) as less from places),
near as (
    select a.word, b.word as other from gaps a join gaps b on a.gap = b.gap and a.word <> b.word
    union select g.word, w.word from gaps g join words w on g.less = w.word
    union select w.word, g.word from gaps g join words w on g.less = w.word
), ranked as (
    select near.word, other, w.n as m, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by w.n desc, encode(other)) as place
    from near join words w on w.word = other
), forms as (
    select word, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n
    from words left join (select * from ranked where place = 1) using (word)
), followed as (
    select word, word as root, form as next from forms
    union all select f.word, f.next, g.form from followed f join forms g on g.word = f.next
)
select word, form, root, n, n_near, form_n from forms join (select word, root from followed where next is null) using (word)
"""
