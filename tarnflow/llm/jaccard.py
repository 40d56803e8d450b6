"""Jaccard join of word shingle sets: a size-aware light and heavy part, exact, with components of the links.

Equal sets are one class. Small sets (light) enumerate, for each size a partner can have, their subsets of just the
size that two such sets must share: sets that meet in a subset are linked, with nothing left to verify. Larger sets
(heavy) scan inverted lists of the tokens that a linked pair must meet in, the first of each set in one global order
that puts frequent tokens last. The boundary is the size with the least estimated cost.

Lists are not expanded into all pairs. In each of some rounds a set is compared by text with one partner, the nearest in
its lists by the parity of hashed bits; links found join classes into components, and lists of one component are done.
Then all pairs that still stand in different components are compared, first by those bits, which bound the overlap from
above, then by their texts. A long list is dealt to many tasks in blocks of rows: by itself in the rounds, which choose
blocks anew each time, and at last every two blocks of it together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, hold, materialise, parallelism, release, table

SHINGLE, LIKE = 4, 85
#: Documents of the sample that orders tokens; how many of them make a token frequent; rounds of nearest partners.
ORDER_DOCS, FREQUENT, ROUNDS = 4000, 8, 3
#: How far apart, by size within a list, the rounds look for a row's nearest; rows in a block of a list, about.
NEIGHBOURS, BLOCK_ROWS = 512, 2048
#: The largest light size that is considered; what comparing costs beside a row of a list; rows of ids that are broadcast at most.
MOST_LIGHT, COMPARE_COST, BROADCAST_ROWS = 40, 4, 1_000_000
#: Bits of the smallest and the largest parity map.
_BITS, _MOST_BITS = 512, 4096
#: Pairs of maps that are compared at once, of half a KB each; words whose hashes a worker keeps.
MAPS_AT_ONCE, HASHED_WORDS = 1 << 14, 50_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > HASHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; fewer words are one shingle, none are none."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(size, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = out + _mix(h[i : len(w) - k + 1 + i] + np.uint64(i)) * _FACTORS[i % 4] + np.uint64(k)
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return np.unique(_mix(out))


def _parities(s: np.ndarray) -> bytes:
    """How often each of some hashed bits is met, modulo 2; about as many bits as shingles, a power of two."""
    width = min(max(_BITS, 1 << max(len(s) - 1, 0).bit_length()), _MOST_BITS)
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _apart(maps: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits pairs of rows differ, the wider map folded to the narrower; no more than their sets differ."""

    def folded(rows: np.ndarray, to: int) -> np.ndarray:
        out = np.empty((len(rows), to // 64), np.uint64)
        for w in np.unique(width[rows]):
            own = width[rows] == w
            out[own] = np.bitwise_xor.reduce(maps[rows[own], : w // 64].reshape(-1, w // to, to // 64), axis=1)
        return out

    if len(x) > MAPS_AT_ONCE:
        return np.concatenate([_apart(maps, width, x[i : i + MAPS_AT_ONCE], y[i : i + MAPS_AT_ONCE]) for i in range(0, len(x), MAPS_AT_ONCE)])
    narrow, out = np.minimum(width[x], width[y]), np.empty(len(x), np.int64)
    for to in np.unique(narrow):
        own = narrow == to
        out[own] = np.bitwise_count(folded(x[own], int(to)) ^ folded(y[own], int(to))).sum(1, dtype=np.int64)
    return out


def least_overlap(s: int, t: int, like: int = LIKE) -> int:
    """The smallest overlap of sets of ``s`` and ``t`` that are linked."""
    return -(-like * (s + t) // (100 + like))


def prefix_length(n: int, like: int = LIKE) -> int:
    return n - -(-like * n // 100) + 1


def light_rows(n: int, boundary: int, like: int = LIKE) -> int:
    return sum(comb(n, c) for t in range(1, boundary + 1) if (c := least_overlap(n, t, like)) <= min(n, t) and n > 1)


def boundary_of(sizes: dict[int, int], like: int = LIKE) -> int:
    """The largest light size, by the estimated cost of both parts; ``sizes`` counts small sets by size."""
    heavy = {n: c * prefix_length(n, like) * (1 + COMPARE_COST) for n, c in sizes.items()}
    cost = lambda x: sum(sizes[n] * light_rows(n, x, like) for n in sizes if n <= x) + sum(v for n, v in heavy.items() if n > x or n >= -(-like * (x + 1) // 100))
    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_MADE = "kind byte, token long, key long, n long, place long, doc_id long, crc long, bits binary"
_arrow = {"byte": pa.int8(), "long": pa.int64(), "binary": pa.binary()}
_made_schema = pa.schema([(x.split()[0], _arrow[x.split()[1]]) for x in _MADE.split(", ")])
#: Kinds of rows: a token of an inverted list; a subset, of the smaller set, of the larger or of equal sizes; a document.
LIST, SMALLER, LARGER, EQUAL, DOCUMENT = 0, 1, 2, 3, 9


def _one_pass(size: int, like: int, boundary: int, frequent):
    """Each document's row, and the tokens and subsets of its set unless the task has lately seen the same set."""
    least_heavy = -(-like * (boundary + 1) // 100)

    def tokens(s: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n = len(s)
        if n >= least_heavy:
            order = s >> np.uint64(1)
            if len(common):
                order = order | ((common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s).astype(np.uint64) << np.uint64(63))
            p = prefix_length(n, like)
            first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
            yield LIST, s[first[np.argsort(order[first])]]
        if n <= boundary:
            for t in range(1, boundary + 1):
                if (c := least_overlap(n, t, like)) <= min(n, t):
                    head = bytes((min(n, t), max(n, t)))
                    yield EQUAL if n == t else SMALLER if n < t else LARGER, np.array([xxhash.xxh3_64_intdigest(head + s[list(x)].tobytes()) for x in combinations(range(n), c)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("hashes", _hashes.clear)
        common, recent = frequent.value, {}
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            sets = [shingles(t, size) for t in texts]
            keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            bits: list[bytes] = []
            rows: list[tuple[int, np.ndarray, int, int]] = []
            for i, s in enumerate(sets):
                bits.append(_parities(s))
                if len(s) < 2 or keys[i] in recent:
                    continue  # one shingle links with equal sets alone
                if len(recent) > 200_000:
                    recent.clear()
                recent[keys[i]] = None
                rows += [(kind, _signed(t), int(keys[i]), len(s)) for kind, t in tokens(s, common)]
            n = len(sets)
            crc = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, DOCUMENT, np.int8)), pa.nulls(n, pa.int64()), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int64()), b.column(0), pa.array(crc, pa.int64())]
                + [pa.array(bits, pa.binary())],
                schema=_made_schema,
            )
            if rows:
                each = [len(t) for _, t, _, _ in rows]
                m = sum(each)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([r[0] for r in rows], np.int8), each)), pa.array(np.concatenate([r[1] for r in rows]))]
                    + [pa.array(np.repeat(np.array([r[k] for r in rows], np.int64), each)) for k in (2, 3)]
                    + [pa.array(np.concatenate([np.arange(k) for k in each]))]
                    + [pa.nulls(m, pa.int64())] * 2 + [pa.nulls(m, pa.binary())],
                    schema=_made_schema,
                )

    return run


def _close_pairs(like: int, nearest: bool):
    """Pairs (a, b, far) of a list that may be linked: sizes, places and the parity of hashed bits allow the overlap and
    components differ. All of them, or for each row only the nearest by those bits among its neighbours in size.

    Rows come sorted by (token, cell): a cell is a block of a list, or two of them, of which only pairs across are looked
    at. Rows of another kind name the tokens whose lists hold such a pair, or were too long to be compared throughout: no
    other list can ever give a link.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("token", "a", "b", "far")])

    def pairs_of(rows: np.ndarray, bits: list[bytes]) -> np.ndarray:
        out = []
        order = np.argsort(rows[:, 4], kind="stable")
        rows, bits = rows[order], [bits[i] for i in order]
        key, component, n, place, block = rows[:, 2:].T
        across = len(np.unique(block)) > 1
        width = np.array([8 * len(b) for b in bits])
        most = int(width.max()) // 8
        maps = np.frombuffer(b"".join([b.ljust(most, b"\0") for b in bits]), np.uint64).reshape(len(bits), -1)
        for i in range(0, len(key), 256):
            a = slice(i, i + 256)
            if nearest:
                c = slice(max(0, i - NEIGHBOURS), i + 256 + NEIGHBOURS)
            else:  # rows are in order of size, and no set is linked with one of less than its share of the size
                c = slice(i, int(np.searchsorted(n, 100 * n[a].max() // like, side="right")))
            s, t = n[a, None], n[None, c]
            least = -(-like * (s + t) // (100 + like))
            maybe = (component[a, None] != component[None, c]) & (place[a, None] <= s - least) & (place[None, c] <= t - least)
            if not nearest:
                maybe &= np.arange(i, i + len(s))[:, None] < np.arange(c.start, c.stop)[None, :]
                if across:
                    maybe &= block[a, None] != block[None, c]
            x, y = np.nonzero(maybe)
            if not len(x):
                continue
            far = _apart(maps, width, x + i, y + c.start)
            ok = (n[x + i] + n[y + c.start] - far) >= 2 * least[x, y]
            x, y, far = x[ok] + i, y[ok] + c.start, far[ok]
            if nearest and len(x):
                first = np.lexsort((key[y], far, x))
                first = first[np.r_[True, np.diff(x[first]) > 0]]
                x, y, far = x[first], y[first], far[first]
            out.append(np.stack([key[x], key[y], far] if nearest else [np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), far], 1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def padded(before: int, values: np.ndarray, after: int) -> pa.Array:
        return pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(values, pa.int64()), pa.nulls(after, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, maps = np.zeros((0, 7), np.int64), []

        def close(rows: np.ndarray, bits: list[bytes]) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            cuts = [0, *(np.flatnonzero(np.diff(rows[:, :2], axis=0).any(1)) + 1).tolist(), len(rows)]
            found, alive = [np.zeros((0, 3), np.int64)], []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j - i > 1:
                    found.append(pairs_of(rows[i:j], bits[i:j]))
                if j - i > 1 and len(found[-1]) or j - i > NEIGHBOURS or rows[i, 1]:
                    alive.append(int(rows[i, 0]))
            pairs, alive = np.unique(np.concatenate(found), axis=0), np.unique(np.array(alive, np.int64))
            n, m = len(pairs), len(alive)
            yield pa.RecordBatch.from_arrays([padded(n, alive, 0), *(padded(0, pairs[:, k], m) for k in range(3))], schema=schema)

        for b in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns[:7]], 1)])
            maps += b.column(7).to_pylist()
            # the last cell may go on in the next batch
            last = int(np.flatnonzero((held[:, :2] != held[-1, :2]).any(1)).max(initial=-1)) + 1 if len(held) else 0
            yield from close(held[:last], maps[:last])
            held, maps = held[last:], maps[last:]
        yield from close(held, maps)

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)], pa.binary())], names=["key", "text"])


def _verified(size: int, like: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("hashes", _hashes.clear)
        kept: dict[int, np.ndarray] = {}

        expand = zstandard.ZstdDecompressor().decompress

        def of(key: int, text: pa.Scalar) -> np.ndarray:
            if key not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[key] = shingles(expand(text.as_py()).decode("utf-8", "surrogatepass"), size)
            return kept[key]

        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            on = []
            for i in range(len(a)):
                x, y = of(a[i], b.column(2)[i]), of(c[i], b.column(3)[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                on.append(100 * both >= like * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(on, pa.bool_())), b.column(1).filter(pa.array(on, pa.bool_()))], names=["a", "b"])

    return run


def _small(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def jaccard_components(docs: DataFrame, size: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id, drawn_links) for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links; ``drawn_links`` counts the links that were drawn between
    its class and others on the way, which is not all of them inside large components. A null or wordless text has an empty set, is linked with nothing and is its
    own component; a null doc_id takes part but is never a component's id; repeated rows are rows of one class; no rows
    give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a bounded sample orders the tokens, those of at least FREQUENT of its documents last, and prices the boundary
    n_docs = rows.count()
    drawn = rows if n_docs <= ORDER_DOCS else rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(ORDER_DOCS / n_docs * (1 << 30)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(s)), pa.array(np.full(len(s), len(s), np.int64))], names=["token", "n"])

    seen = materialise(spark, drawn.mapInArrow(sampled, "token long, n long"), "jaccard-sample")
    often = seen.groupBy("token").count().where(F.col("count") >= FREQUENT).select("token")
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often.toLocalIterator()], dtype=np.int64).view(np.uint64)))
    sizes = {r[0]: -(-r[1] // r[0]) for r in seen.where(F.col("n") <= MOST_LIGHT * 2).groupBy("n").count().collect()}
    boundary = boundary_of(sizes, like)
    discard(spark, seen)

    made = materialise(spark, rows.mapInArrow(_one_pass(size, like, boundary, frequent), _MADE), "jaccard-made")
    described_rows = made.where(F.col("kind") == DOCUMENT)
    signatures = materialise(spark, described_rows.select("doc_id", "key", "n"), "jaccard-signatures")
    classes = described_rows.where("n > 1").groupBy("key").agg(F.min(F.struct("doc_id", "crc", "n", "bits")).alias("one"))
    classes = materialise(spark, classes.select("key", "one.*"), "jaccard-classes")
    subsets = made.where(F.col("kind").between(SMALLER, EQUAL))
    met = subsets.groupBy("token").agg(*[F.min(F.when(F.col("kind") == k, F.col("key"))).alias(a) for k, a in ((SMALLER, "small"), (LARGER, "large"), (EQUAL, "equal"))])
    met = materialise(spark, met, "jaccard-subsets")
    light = subsets.join(met, "token").select(
        F.col("key").alias("a"), F.when(F.col("kind") == SMALLER, F.col("large")).when(F.col("kind") == LARGER, F.col("small")).otherwise(F.col("equal")).alias("b")
    ).where("b is not null and a <> b")
    links = materialise(spark, light.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-links")
    # lists with two classes, one of which may be the smaller set of a pair that meets here first
    lists = made.where(F.col("kind") == LIST).select("token", "key", "n", "place")
    least_shared = lambda s, t: F.ceil(F.lit(like) * (s + t) / F.lit(100 + like))
    heads = F.col("place") <= F.col("n") - least_shared(F.col("n"), F.col("n"))
    several = lists.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max(heads).alias("headed"))
    several = materialise(spark, several.where("low <> high and headed").select("token"), "jaccard-several")
    release(spark)
    heavy = materialise(spark, lists.join(_small(several), "token", "left_semi").distinct(), "jaccard-heavy")
    discard(spark, made, met, several)
    release(spark)

    described = classes  # all of them: the share that lists hold grows with the corpus, the classes as the rows do
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    same_text = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))

    def verify(pairs: DataFrame, links: DataFrame) -> DataFrame:
        """``links`` with the pairs that are linked, by the texts of one document of each class."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(described.select("key", "doc_id", "crc"), "key")
        ids = materialise(spark, ids, "jaccard-ids")
        named = ids.select("key", known.alias("known"), "crc")
        owned = rows.select(known.alias("known"), same_text.alias("crc"), "text").join(_small(named), ["known", "crc"])
        texts = materialise(spark, owned.select("key", "text").mapInArrow(_compressed, "key long, text binary"), "jaccard-texts")
        if texts.count() > ids.count():  # rows repeated whole
            several_texts, texts = texts, materialise(spark, texts.dropDuplicates(["key"]), "jaccard-texts")
            discard(spark, several_texts)
        both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        found = both.select("a", "b", "ta", "tb").mapInArrow(_verified(size, like), "a long, b long")
        found = materialise(spark, links.union(found).distinct(), "jaccard-links")
        discard(spark, links, ids, texts)
        release(spark)
        return found

    def grouped(links: DataFrame) -> DataFrame:
        comp = components(spark, links)
        joined = described.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        now = materialise(spark, joined, "jaccard-now")
        discard(spark, comp)
        return now

    def close_pairs(turn: int | None) -> DataFrame:
        """Pairs from the lists that still hold two components: the nearest in a round's blocks, or all."""
        of_key = heavy.join(now.select("key", "component"), "key")
        lists_now = of_key.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("rows"))
        still = materialise(spark, lists_now.where("c1 <> c2").select("token", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks")), "jaccard-open")
        rest = heavy.join(_small(still), "token").withColumn("block", F.pmod(F.xxhash64(F.lit(turn or 0), "key"), F.col("blocks")))
        if turn is None:
            rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            rest = rest.withColumn("cell", F.least("block", "with") * F.col("blocks") + F.greatest("block", "with"))
        else:
            rest = rest.withColumn("cell", F.col("block"))
        rest = rest.join(now.select("key", "component", "bits"), "key").select("token", "cell", "key", "component", "n", "place", "block", "bits")
        rest = rest.repartition(parallelism(spark), "token", "cell").sortWithinPartitions("token", "cell")
        out = materialise(spark, rest.mapInArrow(_close_pairs(like, turn is not None), "token long, a long, b long, far long"), "jaccard-close")
        discard(spark, still)
        return out

    now = grouped(links)
    for turn in range(ROUNDS):
        near = close_pairs(turn)
        # only lists that may still give a link are read again
        wider, heavy = heavy, materialise(spark, heavy.join(_small(near.select("token").where("token is not null").distinct()), "token", "left_semi"), "jaccard-heavy")
        best = near.where("a is not null").groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        pairs = materialise(spark, best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
        discard(spark, wider, near)
        links = verify(pairs, links)
        discard(spark, pairs, now)
        now = grouped(links)
        release(spark)

    # what is left: all pairs of a list in different components
    close = close_pairs(None)
    pairs = materialise(spark, close.where("a is not null").select("a", "b").distinct(), "jaccard-pairs")
    discard(spark, close, heavy)
    release(spark)
    links = verify(pairs, links)
    discard(spark, pairs, now, described)

    comp = components(spark, links)
    drawn_links = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("drawn_links"))
    placed = signatures.select("doc_id", "key", "n").join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "key")))
    least = placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    least = materialise(spark, least, "jaccard-least")
    drawn_links = materialise(spark, drawn_links, "jaccard-drawn-links")
    discard(spark, links)
    out = placed.join(least, "component", "left").join(drawn_links, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("drawn_links", F.lit(0)).alias("drawn_links"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, for tables whose doc_ids are distinct.
OP9_SQL = r"""
with recursive listed as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s from listed
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as met from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * met >= 85 * (x.n + y.n - met)),
reached as (select a as doc_id, a as other from links union select r.doc_id, l.b from reached r join links l on l.a = r.other),
least as (select doc_id, min(other) as other from reached group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(other, d.doc_id) as component_id
from documents d left join sizes using (doc_id) left join least using (doc_id)
"""
