"""How filters share their removals: the removal game of each part of a corpus, as a polynomial.

A document fails a set of filters, its mask. Over x in [0, 1]^k, x_i the chance that filter i is applied, the expected
number of removed documents of a part is the multilinear extension of "removed by a set of filters":

    R(x) = sum over masks m of n_m (1 - prod_{i in m} (1 - x_i)) = sum over sets T of c_T prod_{i in T} x_i,
    c_T = (-1)^(|T| + 1) * (documents that fail all of T).

A corner of the cube is a set of filters applied, and R there its removals; orders of filters are walks over corners. The
Shapley value of i is the integral of dR/dx_i along the diagonal, the sum of c_T / |T| over the sets T with i: exact
rationals, which k! makes whole.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Characters between words (fixed values: blank, tab, line feed, vertical tab, form feed, carriage return).
_BLANKS = " \t\n\x0b\x0c\r"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text, by letter; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def repeats_earlier(rows: DataFrame, digest: str = "digest", doc_id: str = "doc_id", name: str = "repeats") -> DataFrame:
    """``rows`` with whether a smaller id has the same digest. Rows that share the smallest id are no repeats of each
    other; a null id is neither smaller nor larger than any.

    The smallest id of a digest is a minimum with map-side combining, and it is joined by (digest, id): copies of one
    text differ in their ids, so no group of copies meets in a task.
    """
    first = rows.groupBy(digest).agg(F.min(doc_id).alias(doc_id)).withColumn(name, F.lit(False))
    return rows.join(first, [digest, doc_id], "left").withColumn(name, F.coalesce(name, F.col(doc_id).isNotNull()))


def removal_polynomial(counts: DataFrame, part: str, mask: str, measures: list[str], filters: int) -> DataFrame:
    """(part, <measure> for each): coefficients c_T of each measure's removals as an array over the sets T, the empty
    set's place holding the total. ``counts`` has a part's measures by mask; they are summed with map-side combining.
    """
    sign = lambda t: "" if t.bit_count() % 2 else "-"
    fails_all = lambda m, t: F.expr(f"{sign(t)}sum(if({mask} & {t} = {t}, {m}, 0))")
    return counts.groupBy(part).agg(*[F.array(F.sum(m), *[fails_all(m, t) for t in range(1, 1 << filters)]).cast("array<bigint>").alias(m) for m in measures])


def corner(coefficients: str, applied: int) -> str:
    """The removal polynomial where the filters of the set ``applied`` are on and all others off, as an expression."""
    return " + ".join(f"{coefficients}[{t}]" for t in range(1, applied + 1) if t & applied == t) or "0L"


def shapley(coefficients: str, i: int, filters: int) -> str:
    """``filters``! times the Shapley value of filter ``i``, as an expression: the derivative by x_i, integrated over the
    diagonal. The integral of x^(|T| - 1) is an exact fraction, and its product with the factorial is whole."""
    with_i = [t for t in range(1, 1 << filters) if t >> i & 1]
    weights = [factorial(filters) * Fraction(1, t.bit_count()) for t in with_i]
    return " + ".join(f"{coefficients}[{t}] * {w.numerator // w.denominator}L" for t, w in zip(with_i, weights, strict=True))


def audit_orders(counts: DataFrame, filters: str, part: str = "part", mask: str = "mask") -> DataFrame:
    """A row per part, order of ``filters`` (a letter each, the bits of ``mask`` in turn) and step.

    ``counts`` (part, mask, n, good, toxic) may have several rows a mask. All figures are corners of the three removal
    polynomials but the Shapley value, which is an integral. A part without rows has no row.
    """
    k, measures = len(filters), ("n", "good", "toxic")
    whole = (1 << k) - 1
    corners = [f"array({', '.join(corner(m, s) for s in range(whole + 1))}) as {m}_removed" for m in measures]
    values = f"array({', '.join(shapley('n', i, k) for i in range(k))}) as shapley_values"
    polynomials = removal_polynomial(counts, part, mask, list(measures), k)
    known = materialise(counts.sparkSession, polynomials.selectExpr(part, "n[0] as total", *corners, values), "filter-corners")
    walks = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            walks.append(f"struct('{''.join(filters[j] for j in order)}' as filter_order, {step} as step, {i} as i, {before} as before, {before | 1 << i} as after)")
            before |= 1 << i
    rows = known.select("*", F.expr(f"inline(array({', '.join(walks)}))")).withColumn("alone", F.expr("shiftleft(1, i)"))
    lost = lambda m: f"{m}_removed[after] - {m}_removed[before]"
    return rows.selectExpr(
        part, "filter_order", "step", "total - n_removed[after] as kept", f"{lost('n')} as removed", f"n_removed[alone] - ({lost('n')}) as redundant",
        f"n_removed[{whole}] - n_removed[{whole} - alone] as unique_fails", f"{lost('good')} as good_lost", f"{lost('toxic')} as toxic_lost", "shapley_values[i] as shapley",
    )


def filter_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the set of filters A to E that they fail.

    Null texts are empty and equal to each other; a null source is the empty one; a null id repeats nothing (it has no
    smaller one) and no label; each of repeated rows counts; an id labelled twice has its larger labels; other columns
    are ignored; no rows give no rows. Texts are equal if their 256-bit hashes are. Texts are read once and never shuffled.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    conditions = text_conditions(text)
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits.alias("mask"))
    rows = materialise(spark, rows, "filter-masks")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 or toxic = 1")
    rows = repeats_earlier(rows).withColumn("mask", F.col("mask") + F.when(F.col("repeats"), 1 << len(conditions)).otherwise(0)).drop("digest")
    rows = rows.join(marks, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("good", "toxic")])


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_orders(filter_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


#: Masks by plain conditions; every order is walked by counting, and Shapley values are sums over all orders.
OP12_SQL = r"""
with recursive listed as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), judged as (
    select doc_id, part, (len(w) < 200)::int as a, (100 * len(list_distinct(w)) < 50 * len(w))::int as b,
        (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::int as c, regexp_matches(text, '[#$%&*|]')::int as d,
        (doc_id > min(doc_id) over (partition by text))::int as e from listed
), marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
masks as (
    select part, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
    from judged left join marks using (doc_id) group by all
), letters as (select i, substr('ABCDE', i + 1, 1) as letter from range(5) t(i)),
orders as (
    select letter as filter_order, [1 << i] as bits from letters
    union all select filter_order || letter, list_append(bits, 1 << i) from orders, letters where not contains(filter_order, letter)
), steps as (
    select filter_order, s as step, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::bigint as before from orders, range(1, 6) t(s) where length(filter_order) = 5
), walked as (
    select part, filter_order, step, bit,
        sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint as kept,
        sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end)::bigint as removed,
        sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end)::bigint as redundant,
        sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
        sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end)::bigint as good_lost,
        sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end)::bigint as toxic_lost
    from masks, steps group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, bit)::bigint as shapley from walked
"""
