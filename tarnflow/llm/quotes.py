"""Chat formatting by quotation linking: quotes are parsed by level, joined to the messages they come from, and removed.

A quoted passage is hashed after folding case, blanks and line breaks; it belongs to the earliest message of its
conversation that says it itself. A message replies to the original of its shallowest linked quote, of several to the
latest; sentences of few words count only where no longer passage is linked. Messages that reply, directly or not, to one message form its thread; a conversation is ordered by thread, then
turn, so a reply never stands before what it answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

_QUOTE = re.compile(r"\s{0,3}((?:>\s?)+)")
#: Lines that introduce a quote in mail and chat clients, in four languages.
_INTRO = re.compile(r"^\s*(?:on|am|le|el)\b.{0,300}(?:wrote|schrieb\b.{0,80}|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
#: Turns that one task numbers, shares of the rows of a turn; words below which a hit counts after all longer ones.
TURNS_TOGETHER, SHARES, LEAST_WORDS = 512, 256, 4


def levels(text: str) -> list[tuple[int, str]]:
    """Each line's quote level and what stands behind the marks."""
    out = []
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def passages(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes and their introductions, and the quoted passages as (level, text)."""
    lines = levels(text)
    own, quoted, held, level = [], [], [], 0

    def close() -> None:
        if held and level:
            quoted.append((level, "\n".join(held)))
        held.clear()

    for i, (at, line) in enumerate(lines):
        if at != level or not line.strip():
            close()
        level = at
        if at:
            if line.strip() and not _INTRO.match(line):
                held.append(line)
            continue
        nearest = next((x for x in lines[i + 1 : i + 3] if x[0] or x[1].strip()), (0, ""))
        if not (_INTRO.match(line) and nearest[0]):
            own.append(line)
    close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if quoted else text, quoted


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(text.casefold().split()).encode("utf-8", "surrogatepass")) - (1 << 63)


def units(text: str) -> dict[int, bool]:
    """Hashes of what can be quoted: the whole text, its paragraphs, lines and sentences; and whether it is short."""
    out = {}
    for p in (text, *re.split(r"\n\s*\n", text)):
        for line in (p, *p.split("\n")):
            for s in (line, *_SENTENCE.split(line)):
                if n := len(s.split()):
                    out[_key(s)] = n < LEAST_WORDS
    return out


def _rows(make, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in make(*row)]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 20_000], strict=True), schema, strict=True)], schema=schema)

    return run


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row a message of ``messages`` (conv_id, turn, role, text): (conv_id, turn, role, body, n_quotes, n_linked,
    parent_turn, depth, thread_turn, position).

    ``body`` is the text without quotes (null stays null); ``parent_turn`` is null for a message that links to none,
    which then is its own thread; ``position`` numbers a conversation from 0 in reply order, null turns first. Rows
    repeated whole, or sharing a turn, share their links and follow the order of a hash of role and body. Texts may be of
    any length. No rows give no rows; other columns are ignored. The position is numbered in shares of
    ``TURNS_TOGETHER`` turns and of ``SHARES`` of each turn, so that one endless conversation, or very many rows of one
    turn or of none, are the work of many tasks.
    """
    spark = messages.sparkSession
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "text").where("conv_id is not null and turn is not null")
    key = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("level", pa.int32()), ("passage", pa.int32()), ("hash", pa.int64()), ("short", pa.bool_())])
    quoted = texts.where(F.col("text").contains(">")).mapInArrow(
        _rows(lambda c, t, x: [(c, t, level, i, h, short) for i, (level, q) in enumerate(passages(x or "")[1]) for h, short in units(q).items()], key),
        "conv_id long, turn long, level int, passage int, hash long, short boolean",
    )
    quoted = materialise(spark, quoted, "quotes")
    own = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("hash", pa.int64())])
    said = texts.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi").mapInArrow(
        _rows(lambda c, t, x: [(c, t, h) for h in units(passages(x or "")[0])], own), "conv_id long, turn long, hash long"
    )
    origins = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    found = quoted.join(materialise(spark, origins, "quote-origins"), ["conv_id", "hash"], "left").where("origin is null or origin < turn")
    each = quoted.select("conv_id", "turn", "passage").distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    hits = found.where("origin is not null").groupBy("conv_id", "turn").agg(F.countDistinct("passage").alias("n_linked"), F.min(F.struct("short", "level", (-F.col("origin")).alias("origin"))).alias("best"))
    links = each.join(hits, ["conv_id", "turn"], "left").select("conv_id", "turn", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), (-F.col("best.origin")).alias("parent_turn"))
    links = materialise(spark, links, "quote-links")
    # pointers double until each stands on a message that replies to none
    now = links.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    now = materialise(spark, now, "quote-roots")
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        joined = now.join(above, ["conv_id", "up"], "left")
        moved = joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved"))
        moved = materialise(spark, moved, "quote-roots")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    tree = materialise(spark, links.join(now, ["conv_id", "turn"], "left"), "quote-tree")
    body = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string())])
    bodies = rows.mapInArrow(_rows(lambda c, t, r, x: [(c, t, r, None if x is None else passages(x)[0])], body), "conv_id long, turn long, role string, body string")
    out = bodies.join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent_turn", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("up", "turn").alias("thread_turn"),
    )
    # shares of a thread, in groups of threads: offsets are summed over groups, then over the shares of a group
    place = lambda df, thread: df.withColumn("t", F.coalesce(thread, F.lit(-1))).withColumn("g", F.floor(F.col("t") / TURNS_TOGETHER)).withColumn("s", F.floor(F.coalesce("turn", F.lit(-1)) / TURNS_TOGETHER))
    counts = place(rows.select("conv_id", "turn").join(tree.select("conv_id", "turn", "up"), ["conv_id", "turn"], "left"), F.coalesce("up", "turn"))
    sizes = materialise(spark, counts.groupBy("conv_id", "g", "t", "s").count(), "quote-shares")
    groups = sizes.groupBy("conv_id", "g").agg(F.sum("count").alias("n"))
    groups = groups.select("conv_id", "g", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("g")) - F.col("n")).alias("ahead"))
    inside = sizes.withColumn("inside", F.sum("count").over(Window.partitionBy("conv_id", "g").orderBy("t", "s")) - F.col("count"))
    known = lambda df: df.withColumn("c", F.struct("conv_id"))  # noqa: E731  null conversations join too
    before = known(inside).join(known(groups).drop("conv_id"), ["c", "g"]).select("c", "t", "s", (F.col("ahead") + F.col("inside")).alias("before"))
    before = materialise(spark, before, "quote-positions")
    # inside a share rows follow their turns, and in a turn the shares of a hash
    share = F.pmod(F.xxhash64("role", "body"), F.lit(SHARES))
    numbered = known(place(out, F.col("thread_turn"))).withColumn("h", share)
    turns = materialise(spark, numbered.groupBy("c", "t", "s", F.coalesce("turn", F.lit(-1)).alias("at"), "h").count(), "quote-turns")
    ahead = turns.withColumn("nth", F.sum("count").over(Window.partitionBy("c", "t", "s").orderBy("at", "h")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("c", "t", "s", "at", "h").orderBy("body", "role"))
    numbered = numbered.withColumn("at", F.coalesce("turn", F.lit(-1))).withColumn("within", within)
    numbered = numbered.join(ahead, ["c", "t", "s", "at", "h"]).join(before, ["c", "t", "s"])
    return numbered.select(*out.columns, (F.col("before") + F.col("nth") + F.col("within") - 1).alias("position"))


def as_replies(messages: DataFrame) -> DataFrame:
    """``messages`` with each text below a quote of the message it answers, and that message's turn as ``answers``.

    A message answers the one before, each third one that before it, if there is such a message; the quote holds that
    one's own quote a level deeper, as mail and chat clients do it. Null texts stay null. It is a known truth to hold
    links against where a table holds no quotes.
    """
    back = lambda turn: F.col(turn) - 1 - F.when((F.col("conv_id") + F.col(turn)) % 3 == 0, 1).otherwise(0)
    quote = lambda text, mark: F.concat(F.lit(mark), F.regexp_replace(text, "\n", f"\n{mark}"), F.lit("\n"))
    said = messages.where(F.trim(F.translate("text", "\n\t\r", "   ")) != "").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    first = said.select("conv_id", F.col("turn").alias("answers"), F.col("said").alias("one"))
    second = said.select("conv_id", F.col("turn").alias("deeper"), F.col("said").alias("two"))
    rows = messages.withColumn("answers", back("turn")).join(first, ["conv_id", "answers"], "left")
    rows = rows.withColumn("deeper", F.when(F.col("one").isNotNull(), back("answers"))).join(second, ["conv_id", "deeper"], "left")
    quoted = F.concat(F.coalesce(quote(F.col("two"), "> > "), F.lit("")), quote(F.col("one"), "> "), F.lit("\n"), "text")
    return rows.select("conv_id", "turn", "role", F.coalesce(quoted, "text").alias("text"), F.when(F.col("one").isNotNull() & F.col("text").isNotNull(), F.col("answers")).alias("answers"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations``, written as a reply that quotes, linked to what it quotes and freed of it."""
    rendered = materialise(spark, as_replies(table(spark, sf_dir, "conversations")), "quote-replies")
    return link_quotes(rendered)


#: The links that ``as_replies`` put into texts, for tables where no two messages of a conversation say the same.
OP8_SQL = r"""
with recursive told as (
    select conv_id, turn, role, text, turn - 1 - case when (conv_id + turn) % 3 = 0 then 1 else 0 end as up from conversations
), answered as (
    select m.*, p.text as one, p.up as up2 from told m left join told p on p.conv_id = m.conv_id and p.turn = m.up and trim(p.text) <> '' and m.text is not null
), quoting as (
    select a.*, g.text as two from answered a left join told g on g.conv_id = a.conv_id and g.turn = a.up2 and trim(g.text) <> '' and a.one is not null
), counted as (
    select conv_id, turn, role, text as body, case when one is not null then up end as parent_turn,
        coalesce(len(list_filter(regexp_split_to_array(one, '\n\s*\n'), lambda x: trim(x) <> '')), 0)
        + coalesce(len(list_filter(regexp_split_to_array(two, '\n\s*\n'), lambda x: trim(x) <> '')), 0) as n_quotes
    from quoting
), tree as (
    select conv_id, turn, 0 as depth, turn as thread_turn from counted where parent_turn is null
    union all
    select c.conv_id, c.turn, t.depth + 1, t.thread_turn from counted c join tree t on t.conv_id = c.conv_id and t.turn = c.parent_turn
)
select conv_id, turn, role, body, n_quotes, n_quotes as n_linked, parent_turn, cast(depth as bigint) as depth, thread_turn,
    row_number() over (partition by conv_id order by thread_turn, turn) - 1 as position
from counted join tree using (conv_id, turn)
"""
