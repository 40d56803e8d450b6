"""Best-fit packing of token sequences after Martello and Toth's dominance reduction.

Lengths are integers up to the capacity, so the instance is its histogram: at most ``capacity`` counts, whatever the
corpus. The driver plans on the histogram alone. The reduction fixes, as often as counts allow, sets that dominate all
others with the same item; best fit decreasing packs the rest. A plan is a list of bin patterns with multiplicities, and
pieces find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as packed

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, materialise, table

CAPACITY, END_ID = 2048, 0
#: Pieces of text whose ids a worker keeps; pieces of one length that one task ranks.
CACHE_WORDS, RANK_ROWS = 200_000, 2_000

#: The tokenizer's own split, for lower-cased text below U+0100: there these are all letters, digits and spaces.
_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+").findall
#: What that split does not know: characters from U+0100 on, and what may begin a special token.
_odd = re.compile(r"[^\0-\xff]|<\|").finditer


def _pieces(text: str) -> list[str]:
    """What ``text`` is cut into for its ids: pieces of the tokenizer's split, and whole, between blanks, the words that
    hold something odd. The tokenizer never joins across a blank, and special tokens hold none."""
    try:
        text.encode("latin-1")
        if "<|" not in text:
            return _split(text.lower())
    except UnicodeEncodeError:
        pass
    out, done, text = [], 0, text.replace("\n", " ")
    for m in _odd(text):
        if m.start() >= done:
            first, last = text.rfind(" ", done, m.start()) + 1 or done, text.find(" ", m.end())
            out += _split(text[done:first].lower())
            done = len(text) if last < 0 else last
            out.append(text[first:done])
    return out + _split(text[done:].lower())


class _Words(dict):
    """Ids, as little-endian bytes, of pieces of text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        held = Tokenizer.from_file(path)
        self.encode, self.merge = held.encode, held.model.tokenize
        #: How byte-level models spell the letters below U+0100, which no normalisation changes but for their case.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {i: spell(chr(i))[0][0] for i in range(170, 256)}
        #: Kept pieces that were wanted again since others last went.
        self.again: set[str] = set()

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Adds what is new; of plain letters only the model's merges run.

        Where it would grow beyond ``CACHE_WORDS``, what was not wanted again goes first, or all that these do not need.
        """
        found = pieces & self.keys()
        new = pieces - found
        if len(self) + len(new) > CACHE_WORDS:
            kept = self.again | found
            needed = {w: self[w] for w in (kept if len(kept) + len(new) <= CACHE_WORDS else found)}
            self.clear()
            self.update(needed)
            self.again = found
        else:
            self.again |= found
        for w in new:
            if w.isalpha() and (w.isascii() or max(w) <= "\xff"):
                low = w.lower()
                ids = [t.id for t in self.merge(low if low.isascii() else low.translate(self.spelling))]
                self[w] = packed(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each whole text, four little-endian bytes an id."""
    held = _words(path)
    parts = [_pieces(t) for t in texts]
    held.learn(set().union(*parts))
    return [b"".join(map(held.__getitem__, p)) for p in parts]


def _all_ids(texts: pa.Array, path: str, together: int = 1 << 19) -> Iterator[bytes]:
    """The ids of each text, half a million letters at a time: all pieces of a group are held at once."""
    held, weight = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        weight += len(held[-1])
        if weight > together:
            yield from token_bytes(held, path)
            held, weight = [], 0
    yield from token_bytes(held, path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each row's ids and the end id, cut into pieces of ``capacity``; a null text is the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("words", _words.cache_clear)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out = defaultdict(list)
            for doc, ids in zip(b.column(0).to_pylist(), _all_ids(b.column(1), path), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[k].append(v)
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


Pattern = tuple[tuple[int, ...], int]


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """The sets fixed by dominance, with how often, and the counts left.

    For the largest item j not yet settled, with k the largest item that fits beside it: j alone if nothing fits; {j, k}
    if they fill the bin, since whatever else stands with j fits in k's place; {j, k} if no two items fit beside j; and
    {j, k} if at most two fit and no two that fit outweigh k.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[Pattern] = []

    def take(*items: int) -> None:
        times = min(left[w] // items.count(w) for w in set(items))
        fixed.append((items, times))
        for w in items:
            left[w] -= times
        for w in set(items):
            if not left[w]:
                del left[w]

    changed = True
    while changed and left:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                sizes = sorted(left)
                room = capacity - j
                beside = [w for w in sizes if w <= room and (w != j or left[j] > 1)]
                if not beside:
                    take(j) if left[j] == 1 or 2 * j > capacity else take(j, j)
                    changed = True
                    continue
                k = beside[-1]
                small = [w for w in sizes[:3] for _ in range(min(3, left[w] - (w == j)))][:3]
                pair_fits = len(small) > 1 and small[0] + small[1] <= room
                three_fit = len(small) > 2 and sum(small) <= room
                if k == room or not pair_fits:
                    take(j, k)
                elif not three_fit:
                    free = lambda a, b: left[a] - (a == j) - (a == b) > 0  # noqa: E731, B023
                    if any(a + b > k for i, a in enumerate(beside) for b in beside[i:] if a + b <= room and free(a, b) and left[b] - (b == j) > 0):
                        break
                    take(j, k)
                else:
                    break
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing on a histogram: bins of one content are kept as a pattern and a number."""
    open_bins: dict[int, list[Pattern]] = defaultdict(list)
    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            room = min((r for r in open_bins if r >= w), default=None)
            items, many = open_bins[room].pop() if room is not None else ((), n)
            if room is not None and not open_bins[room]:
                del open_bins[room]
            room = capacity if room is None else room
            copies = room // w
            times = min(many, n // copies)
            if not times:
                copies, times = n, 1
            if items and many > times:
                open_bins[room].append((items, many - times))
            open_bins[room - copies * w].append((items + (w,) * copies, times))
            n -= copies * times
    return [p for r in sorted(open_bins) for p in open_bins[r]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bin patterns that hold every item of the histogram."""
    if any(not 0 < w <= capacity for w in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: from which rank a pattern serves it, copies a bin, first bin, first offset."""
    out, used, first = defaultdict(list), defaultdict(int), 0
    for items, times in patterns:
        at = 0
        for w in sorted(set(items), reverse=True):
            copies = items.count(w)
            out[w].append((used[w], copies, first, at))
            used[w] += copies * times
            at += copies * w
        first += times
    return {w: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for w, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; sequences are gapless from 0.

    Pieces are ranked among those of their length in shares of ``RANK_ROWS``, so that a length that many documents have
    is ranked by many tasks. The plan sent to tasks has at most a few entries for each length.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}
    places = _places(plan(counts, capacity))
    shares = F.array(*[F.lit(-(-counts.get(w, 0) // RANK_ROWS) or 1) for w in range(capacity + 1)]) if counts else F.array(F.lit(1))
    rows = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(shares, (F.col("length") + 1).cast("int"))))
    sizes = rows.groupBy("length", "share").count()
    before = sizes.select("length", "share", (F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).alias("before"))
    before = materialise(spark, before, "packing-ranks")
    nth = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("nth", nth).join(before, ["length", "share"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(), rank.to_numpy()
        bins, offsets = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(size) else []:
            w = int(size[part[0]])
            low, copies, first, start = places[w]
            k = np.searchsorted(low, at[part], side="right") - 1
            n = at[part] - low[k]
            bins[part], offsets[part] = first[k] + n // copies[k], start[k] + n % copies[k] * w
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    found = ranked.withColumn("place", F.pandas_udf(place, "sequence_id long, offset long")("length", "rank"))
    return found.select(*pieces.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and offset.

    A null or empty text is one piece, the end id; longer ones than ``capacity`` are cut; repeated rows are packed each;
    no rows give no rows; other columns are ignored.
    """
    return pack(materialise(docs.sparkSession, tokenised(docs, path, capacity), "packing-pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
