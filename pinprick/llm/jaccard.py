"""All pairs of texts whose sets of word shingles are similar, as classes of linked texts.

Sets of a Jaccard similarity of at least s differ in at most m = (x + y) * (1 - s) / (1 + s) of their x and y members. Sizes go into bands that a
similar pair leaves by one band at most. Each band cuts the universe of shingles into more than m segments by hash, so:

* if segments of two sets get weights of 0 (left out), 1 (the same members) or 2 (at most one member more or less), and the weights
  of the larger set sum up to over m, a similar pair meets in one segment at least as its weight asks (pigeonhole);
* a set is indexed by the hash of its members in each segment of its own band, and asks in its own band and the one below;
* which segments it asks in is chosen by cost, the number of sets that answer: a segment that no other set has, or only sets that are linked to it by now,
  costs nothing and counts. Most sets end here. The others take cheap segments, then raise free segments to weight 2, looked up by all subsets with one
  member left out (of theirs and of the indexed sets'), and take dear segments only when there is nothing else. Sets whose weights cannot reach m
  (few members, all in few segments) ask by single members.

Before that, sets of one segment are held against one of them, so that large groups of near copies are linked without all their pairs.
Every link is verified on the whole sets of 64-bit hashes; equal texts are one set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, each_block, make_blocks, mix, packed, swept, unpacked
from .common import dropped, free_name, n_partitions, stored
from .components import connected_components
from .similar import FIRST, _apart, _verified, shingles

BLOCK_BYTES, ASKED, ROUNDS = 8 << 20, 1, 1
#: A segment that at most so many other sets have is taken before one is raised to weight 2; segments beyond what a band needs, one in so many; candidates of a set in a round.
CHEAP, SPARE, VOTES = 16, 6, 3
MOST_BITS = 1 << 28
_MIXES, _NONE = (0xB17, 0x2B17), bytes(8 * FIRST)


class Bands:
    """Sizes by band, the segments of each band, and the weights that a set has to reach."""

    def __init__(self, largest: int, least: Fraction) -> None:
        self.up, self.down = least.numerator, least.denominator
        self.low, self.high, self.segments = [], [], []
        lo = 1
        while lo <= max(1, largest):
            hi = lo * self.down // self.up
            need = self.need(hi, hi * self.down // self.up)
            self.low.append(lo), self.high.append(hi), self.segments.append(need + need // SPARE)
            lo = hi + 1

    def need(self, x, y):
        """The weights that two sets of x and y members need: one more than they may differ in."""
        return (x + y) * (self.down - self.up) // (self.down + self.up) + 1

    def asks(self, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(0 for the own band or 1 for the one below, which sets ask there, their bands, their weights)."""
        high = np.array(self.high)
        own = np.searchsorted(high, size)
        yield 0, np.ones(len(size), bool), own, self.need(size, size)
        below = np.maximum(own - 1, 0)
        yield 1, (own > 0) & (-(-self.up * size // self.down) <= high[below]), below, self.need(size, high[below])


class Segments:
    """The members of some sets by segments of one band for each set."""

    def __init__(self, token: np.ndarray, doc: np.ndarray, band: np.ndarray, segments: np.ndarray) -> None:
        many = segments[band]
        first = np.cumsum(many) - many
        own = ((mix(token, 0x5E6) >> np.uint64(32)) * many[doc].astype(np.uint64)) >> np.uint64(32)
        self.doc, self.first, self.many = doc, first, many
        self.at = first[doc] + own.astype(np.int64)
        self.value = mix(token, 0xFA11)
        n = int(many.sum())
        self.sum = np.zeros(n, np.uint64)
        np.add.at(self.sum, self.at, self.value)
        self.size = np.bincount(self.at, minlength=n)
        self.owner = np.repeat(np.arange(len(band)), many)
        self.salt = mix((np.arange(n) - first[self.owner]).astype(np.uint64), band[self.owner].astype(np.uint64) + np.uint64(1))
        self.key = mix(self.sum, self.salt) & ~np.uint64(1)

    def without_one(self) -> np.ndarray:
        """For each member, the key of its segment without it."""
        return mix(self.sum[self.at] - self.value, self.salt[self.at]) & ~np.uint64(1)


def _node(block: Block) -> int:
    return ((block.number >> 32) << 44) + ((block.number & 0xFFFFFFFF) << 20)


def _told(nodes: DataFrame, *more: str) -> DataFrame:
    """Messages to the nodes' blocks: places in the block and further columns of integers."""
    block = F.expr("(shiftright(node, 44) << 32) + (shiftright(node, 20) & 16777215)")
    rows = nodes.select(block.alias("block"), F.expr("cast(node & 1048575 as long)").alias("_at"), *more).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("_at", *more))).alias("_rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, told in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = packed(*(np.array([r[c] for r in told], np.int64) for c in ("_at", *more)))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ASKED], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], names=["block", "kind", "bucket", "data"])

    return rows.mapInArrow(pack, "block long, kind int, bucket int, data binary")


def _asked(block: Block, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Shingles of those texts of a block that it was told of (each once), which text they belong to, each text's number, and the further columns."""
    if ASKED not in block.told:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    at, *more = unpacked(block.told[ASKED][0][1])
    places = np.unique(at)
    wanted = set(places.tolist())
    token, doc, size = shingles((t for k, t in enumerate(block.texts()) if k in wanted), words)
    return token, doc, places, [size, at, *more]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.view(np.int64)))


def _bits(keys: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of the column ``key`` with two places for each key, and how many bits of a mix name a place.

    At most MOST_BITS, 32 MB: with more keys more others pass, which joins sort out."""
    bits = max(16, (min(MOST_BITS, 32 * keys.count()) - 1).bit_length())
    piece_bits = min(bits, 20)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            own = np.asarray(b.column(0)).view(np.uint64)
            place = np.concatenate([(mix(own, m) >> np.uint64(64 - bits)).astype(np.int64) for m in _MIXES])
            for k in np.unique(place >> piece_bits).tolist():
                own = found.setdefault(k, np.zeros(1 << piece_bits, bool))
                own[place[place >> piece_bits == k] & ((1 << piece_bits) - 1)] = True
        for k, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["piece", "data"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    step = (1 << piece_bits) // 8
    dealt = keys.select("key").repartition(min(n_partitions(keys.sparkSession), 1 << (bits - piece_bits)))
    for r in dealt.mapInArrow(collect, "piece int, data binary").toLocalIterator():
        out[r.piece * step : (r.piece + 1) * step] |= np.frombuffer(r.data, np.uint8)
    return out.tobytes(), bits


def _has(table: tuple[np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    found = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for m in _MIXES:  # the second place only where the first one is set
        place = (mix(keys[left], m) >> np.uint64(64 - table[1])).astype(np.int64)
        left = left[(table[0][place >> 3] >> (7 - (place & 7))) & 1 == 1]
    found[left] = True
    return found


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, least: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Rows are linked when their sets of distinct shingles of ``words`` words (A-Z folded; a shorter text is one shingle) have a Jaccard similarity
    of at least ``least``; the component is named by the smallest id reachable (null if no row of it has one). A text that is null or has no words has no shingles and no links:
    its component is its own id. Ids are integers that may be null or repeat; other columns are left out. ``rounds`` changes the work, not the result.
    """
    least = Fraction(str(least))
    if not 0 < least <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    spark = df.sparkSession
    blocks = make_blocks(df, id_col, text_col, BLOCK_BYTES)

    def tell(b: Block) -> Iterator[pa.RecordBatch]:
        said = [t.lower().split() for t in b.texts()]
        sha = [hashlib.sha256(b" ".join(t)).digest() if t else None for t in said]
        yield pa.RecordBatch.from_arrays([pa.array(_node(b) + np.arange(len(sha))), pa.array(b.ids, pa.int64()), pa.array(sha, pa.binary()), pa.array([max(1, len(t) - words + 1) for t in said], pa.int32())], names=["node", "id", "sha", "most"])

    texts = stored(each_block(blocks, tell, "node long, id long, sha binary, most int"), "jaccard-texts")
    classes = stored(texts.where("sha is not null").groupBy("sha").agg(F.min("node").alias("node"), F.min("id").alias("least_id"), F.max("most").alias("most")), "jaccard-classes")
    bands = Bands(classes.agg(F.max("most")).first()[0] or 1, least)
    segments = np.array(bands.segments)

    def index(b: Block) -> Iterator[pa.RecordBatch]:
        token, doc, places, more = _asked(b, words)
        if not len(places):
            return
        size, told = more[0], {}
        for part, asks, band, need in bands.asks(size):
            keep = asks[doc]
            s = Segments(token[keep], doc[keep], band, segments)
            full = (s.size > 0) & asks[s.owner]
            told[part] = _lists(s.key[full] | np.uint64(1 - part), np.bincount(s.owner[full], minlength=len(size)))
        ends = np.cumsum(size).tolist()
        own = [token[e - k : e] for e, k in zip(ends, size.tolist())]
        seen = [pa.array(list(map(_sketch, own)), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(_node(b) + places), pa.array(size.astype(np.int32)), told[0], told[1], *seen], names=["node", "n", "own", "below", "sketch"])

    whole = stored(each_block(blocks, index, "node long, n int, own array<long>, below array<long>, sketch binary", _told(classes.select("node"))), "jaccard-keys")
    keys, sketches = whole.select("node", "n", "own", "below"), stored(whole.select("node", "n", "sketch"), "jaccard-sketches")
    swept(spark)
    # segments that an indexed set shares with any other set; an indexed key has its lowest bit set
    every = keys.select(F.explode(F.concat("own", "below")).alias("key"))
    counts = every.groupBy(F.expr("shiftright(key, 1)").alias("key")).agg(F.sum(F.expr("key & 1")).alias("own"), F.count("*").alias("_all"))
    shared = stored(counts.where("own >= 1 and _all >= 2").select("key", "own"), "jaccard-shared")
    swept(spark)
    sent = spark.sparkContext.broadcast(_bits(shared))  # at most MOST_BITS bits

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
        for b in batches:
            node, n = (np.asarray(b.column(k)).astype(np.int64) for k in (0, 1))
            for part, asks, _, need in bands.asks(n):
                lists = b.column(2 + part)
                full = np.diff(np.asarray(lists.offsets))
                flat = np.asarray(lists.flatten()).astype(np.int64) >> 1
                owner = np.repeat(np.arange(len(n)), full)
                found = np.flatnonzero(_has(table, flat.view(np.uint64))) if len(flat) else np.zeros(0, np.int64)
                short = np.flatnonzero(asks & (full < need))
                at = np.concatenate([owner[found], short])
                key = pa.array(np.append(flat[found], np.zeros(len(short), np.int64)), mask=np.arange(len(at)) >= len(found))
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(n[at]), pa.array(np.full(len(at), part)), pa.array(full[at].astype(np.int64)), pa.array(need[at]), key], names=["node", "n", "part", "full", "need", "key"])

    rows = stored(keys.mapInArrow(hits, "node long, n long, part long, full long, need long, key long"), "jaccard-hits")
    short = rows.where("key is null").drop("key")
    rows = stored(rows.join(shared, "key"), "jaccard-rows")
    dropped(whole)
    swept(spark)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, n, shared): the whole sets of some texts."""

        def tell_sets(b: Block) -> Iterator[pa.RecordBatch]:
            token, _, places, more = _asked(b, words)
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array(_node(b) + places), pa.array(more[0].astype(np.int32)), _lists(token, more[0])], names=["node", "n", "shared"])

        return stored(each_block(blocks, tell_sets, "node long, n int, shared array<long>", _told(nodes.select("node").distinct())), "jaccard-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(_screened(pairs, sketches, least), "jaccard-screened")
        if pairs.isEmpty():
            return pairs
        return _verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), least)

    links = spark.createDataFrame([], "a long, b long")
    parts = spark.createDataFrame([], "node long, component long")

    def mixed() -> DataFrame:
        """Rows of the segments whose sets are in more than one component, with the first and last of these."""
        mine = stored(rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-mine")
        ends = mine.groupBy("key").agg(F.min(F.when(F.col("part") == 0, F.struct("component", "node"))).alias("_lo"), F.max(F.when(F.col("part") == 0, F.struct("component", "node"))).alias("_hi"), F.min("component").alias("_a"), F.max("component").alias("_b"))
        return stored(mine.join(ends.where("_a < _b").drop("_a", "_b"), "key"), "jaccard-mixed")

    for _ in range(rounds):
        now = mixed()
        other = F.when(F.col("_lo.component") != F.col("component"), F.col("_lo.node")).when(F.col("_hi.component") != F.col("component"), F.col("_hi.node"))
        votes = now.withColumn("_with", other).where("_with is not null").groupBy("node", "_with").agg(F.count("*").alias("_n"))
        votes = votes.withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("_n"), "_with"))).where(F.col("_k") <= VOTES)
        pairs = stored(votes.select(F.least("node", "_with").alias("a"), F.greatest("node", "_with").alias("b")).distinct(), "jaccard-pairs")
        if pairs.isEmpty():
            break
        links = stored(links.unionByName(verified(pairs)), "jaccard-links")
        parts = stored(connected_components(links), "jaccard-parts")
    now = mixed()
    # the weights: free segments count, then cheap ones, then free ones again, then dear ones
    cost = F.col("own") - F.when(F.col("part") == 0, 1).otherwise(0)
    dear = now.select("node", "n", "part", "full", "need", "key", "component", cost.alias("cost")).where("cost > 0")
    by = Window.partitionBy("node", "part")
    dear = dear.withColumn("_rank", F.row_number().over(by.orderBy("cost", "key"))).withColumn("_dear", F.count("*").over(by)).withColumn("_cheap", F.count_if(F.col("cost") <= CHEAP).over(by))
    dear = dear.unionByName(short.join(dear.select("node", "part").distinct(), ["node", "part"], "left_anti").withColumns({"_dear": F.lit(0), "_cheap": F.lit(0), "_rank": F.lit(1)}), allowMissingColumns=True)
    dear = dear.withColumn("_free", F.col("full") - F.col("_dear")).withColumn("_left", F.col("need") - F.col("_free")).where("_left > 0")
    dear = dear.withColumn("_raise", F.least("_free", F.greatest(F.lit(0), F.col("_left") - F.col("_cheap")))).withColumn("_exact", F.col("_left") - F.col("_raise"))
    dear = stored(dear.withColumn("_single", F.col("_exact") > F.col("_dear")), "jaccard-weights")
    chosen = dear.where("not _single and _rank <= _exact and key is not null").select("key", "node", "n", "part")
    answers = now.where("part = 0").select("key", "node", "n").join(chosen.select("key").distinct(), "key", "left_semi")
    final = chosen.where("part = 1").drop("part").unionByName(answers)

    raised = stored(dear.where("_raise > 0 or _single").select("node", "part", F.when(F.col("_single"), -1).otherwise(F.col("_raise")).cast("long").alias("raise"), F.coalesce("key", F.lit(-1).cast("long")).alias("key")), "jaccard-raised")
    if not raised.isEmpty():
        final = final.unionByName(_raised(spark, blocks, classes, raised, bands, words))
    final = stored(final.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-final")
    several = final.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.min("n").alias("_n")).where("_a < _b")
    # sketches of a key's sets are as long as the smallest set needs, in steps of 4
    kind = F.floor(F.greatest(F.lit(10.0), F.ceil(F.log2(2 * F.col("_n")))) / 2) * 2
    final = stored(final.join(several.select("key", kind.cast("int").alias("_bits")), "key"), "jaccard-apart")
    pairs = None
    for bits in sorted(r["_bits"] for r in final.select("_bits").distinct().collect()):  # one for each power of 4 up to the longest text
        seen = sketches.select("node", _folded(bits)("sketch").alias("parity"))
        about = final.where(F.col("_bits") == bits).join(seen, "node").select("key", "node", "n", "component", F.col("n").alias("left"), F.lit(0).alias("pos"), F.lit(_NONE).alias("first"), "parity")
        own = stored(_apart(about, least), "jaccard-pairs")
        pairs = own if pairs is None else pairs.unionByName(own)
    if pairs is not None:
        links = links.unionByName(verified(pairs.distinct()))
        parts = stored(connected_components(links), "jaccard-parts")
    # names: of texts to classes, of classes to components
    named = classes.join(parts, "node", "left").join(sketches.select("node", "n"), "node").select("sha", "least_id", "n", F.coalesce("component", "node").alias("component"))
    named = stored(named, "jaccard-named")
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component").select("sha", "n", "component_id")
    none = texts.where("sha is null").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    some = texts.where("sha is not null").join(named, "sha").select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return some.unionByName(none).withColumnRenamed("id", id_col)


def _sketch(token: np.ndarray) -> bytes:
    """For each value of the top bits, at least two values for each member, whether an odd number of members has it."""
    bits = max(10, (2 * len(token) - 1).bit_length())
    return np.packbits(np.bincount((token >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) % 2 == 1).tobytes()


def _shorter(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes: neighbouring places count as one."""
    return sketch if len(sketch) <= size else np.packbits(np.unpackbits(sketch).reshape(size * 8, -1).sum(1) % 2 == 1)


def _folded(bits: int) -> Callable[[str], Column]:
    """Sketches of 2^bits places from longer ones."""
    return F.pandas_udf(lambda s: s.map(lambda x: _shorter(np.frombuffer(x, np.uint8), (1 << bits) // 8).tobytes()), "binary")


def _screened(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) without those whose sketches differ in more places than similar sets differ in members."""
    up, down = least.numerator, least.denominator
    one, other = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
                y = _shorter(y, len(x))
                keep.append((up + down) * int(np.bitwise_count(x ^ y).sum()) <= (down - up) * (m + n))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(screen, "a long, b long")


def _raised(spark, blocks: DataFrame, classes: DataFrame, raised: DataFrame, bands: Bands, words: int) -> DataFrame:
    """(key, node, n) of sets that ask in segments of weight 2 or by single members, and of the indexed sets that answer.

    ``raised`` has (node, part, raise, key): how many free segments to raise (-1: ask by members), and a segment that is not free (-1: none)."""
    segments, singles = np.array(bands.segments), not raised.where("raise < 0").isEmpty()
    form = "key long, node long, n int"

    def batch(key: list[np.ndarray], node: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(n).astype(np.int32))], names=["key", "node", "n"])

    def member(token: np.ndarray, band: np.ndarray) -> np.ndarray:
        return mix(token, band.astype(np.uint64) + np.uint64(0x51))

    def ask(b: Block) -> Iterator[pa.RecordBatch]:
        token, doc, places, more = _asked(b, words)
        if not len(places):
            return
        size, at, which, times, used = more
        told_doc = np.searchsorted(places, at)
        out = [], [], []
        for part, _, band, _ in bands.asks(size):
            own = which == part
            wanted = np.zeros(len(size), np.int64)
            wanted[told_doc[own]] = times[own]
            keep = (wanted != 0)[doc]
            if not keep.any():
                continue
            t, d = token[keep], doc[keep]
            s = Segments(t, d, band, segments)
            # free segments: not among those named; those that leave two members or more, and of few, first
            named = set(zip(told_doc[own].tolist(), used[own].tolist()))
            free = np.array([k > 0 and (o, x) not in named for o, k, x in zip(s.owner.tolist(), s.size.tolist(), (s.key.view(np.int64) >> 1).tolist())], bool) & (wanted > 0)[s.owner]
            order = np.lexsort((s.size, s.size < 3, ~free, s.owner))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            raise_it = free & (place - s.first[s.owner] < wanted[s.owner])
            mine = _node(b) + places
            for key, o in ((s.key[raise_it], s.owner[raise_it]), (mix(s.key[raise_it], 0xDE1), s.owner[raise_it]), (s.without_one()[raise_it[s.at]], s.doc[raise_it[s.at]])):
                out[0].append(key), out[1].append(mine[o]), out[2].append(size[o])
            single = (wanted < 0)[d]
            rank = np.arange(len(d)) - np.searchsorted(d, d)
            single &= rank < (size - -(-bands.up * size // bands.down) + 1)[d]
            out[0].append(member(t[single], band[d[single]])), out[1].append(mine[d[single]]), out[2].append(size[d[single]])
        if out[0]:
            yield batch(*out)

    asked = stored(each_block(blocks, ask, form, _told(raised, "part", "raise", "key")), "jaccard-asked")
    sent = spark.sparkContext.broadcast(_bits(asked))  # at most MOST_BITS bits

    def answer(b: Block) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value[0], np.uint8), sent.value[1]
        token, doc, places, more = _asked(b, words)
        if not len(places):
            return
        size, mine = more[0], _node(b) + places
        _, _, band, _ = next(bands.asks(size))
        s = Segments(token, doc, band, segments)
        out = [], [], []
        own = [(s.key, s.owner), (mix(s.without_one(), 0xDE1), doc)]
        for key, o in [*own, (member(token, band[doc]), doc)] if singles else own:
            keep = _has(table, key)
            out[0].append(key[keep]), out[1].append(mine[o[keep]]), out[2].append(size[o[keep]])
        yield batch(*out)

    return asked.unionByName(each_block(blocks, answer, form, _told(classes.select("node"))))
