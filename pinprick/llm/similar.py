"""Near copies by SimHash, completed to all pairs of a Jaccard similarity of word shingles.

Fingerprints of similar texts are close, but at a similarity of 0.8 they differ in 10 of 64 bits on
average and sometimes in 20: no radius that segments can be searched at holds all such pairs. So
fingerprints find most links cheaply, every link is verified on the shingles, and an exact
search finds what is left:

1. Shingles say which texts can have a partner at all. If two sets have a similarity of at least s, each holds
   at least s of the other's size in common shingles. So a text with fewer than s * n of its n shingles
   in other texts is out, and two similar texts share one of their n - ceil(s * n) + 1 rarest shingles,
   their keys (prefix filter).
2. Fingerprints of these texts within a few bits are found by pigeonring chains (``simhash``), then, round by
   round, neighbours in the order of turned fingerprints among texts of one key. A pair that is
   verified joins its components; each round compares at most one new pair for each text.
3. Pairs that share a key and are in different components still are compared one by one, each at its first common key, if
   the parities of their shingles by hash, 1024 bits, differ in no more bits than the sets may in shingles (bitmap filter).

No similar pair is lost, up to 64-bit hashes of shingles. How often a shingle occurs is asked block by block (``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import MESSAGE, Block, each_block, each_bucket, make_blocks, messages, mix, n_buckets, packed, split_by, swept, unpacked, word_hashes
from .common import dropped, free_name, let_go, n_partitions, stored
from .components import connected_components
from .simhash import hamming_links

BLOCK_BYTES, SHINGLES, MOST = 8 << 20, 1, 65535
#: Radius of the pigeonring search, keys that go with each key against repeated pairs, and nodes of a key that one task compares.
NEAR, FIRST, TILE, PARITIES = 4, 8, 2048, 1024
#: The one shingle of a text without words.
EMPTY = np.uint64(1)


def shingles(texts: Iterable[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, ascending, with the text's number, and how many each text has.

    A text of fewer words is one shingle. A-Z are folded.
    """
    h, count = word_hashes(texts, lower=True)
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(h)) - first[doc]
    ahead = np.concatenate([h, np.zeros(words, np.uint64)])
    key = np.zeros(len(h), np.uint64)
    for k in range(words):
        key = mix(key, np.where(at + k < count[doc], ahead[k : k + len(h)], np.uint64(0)))
    whole = at < np.maximum(1, count - words + 1)[doc]
    none = np.flatnonzero(count == 0)
    key, doc = np.concatenate([key[whole], np.full(len(none), EMPTY)]), np.concatenate([doc[whole], none])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, doc, np.bincount(doc, minlength=len(count))


def _fingerprint(h: np.ndarray) -> int:
    """SimHash of distinct shingles, as a signed number: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(np.ascontiguousarray(h[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _parities(h: np.ndarray) -> bytes:
    """For each value of the top bits, whether an odd number of shingles has it: two sets differ in at least as many shingles as parities."""
    return np.packbits(np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=PARITIES) % 2 == 1).tobytes()


def _candidates(df: DataFrame, id_col: str, text_col: str, words: int, least: Fraction) -> DataFrame:
    """(node, id, n, fp, parity, shared, keys) of each text that enough shingles share: its number of shingles, their fingerprint
    and parities, those of them that other texts hold too, and the rarest of these, rarest first, one of which any similar text has among its own."""
    blocks = make_blocks(df, id_col, text_col, BLOCK_BYTES)
    n = n_buckets(blocks, 1_500_000)
    up, down = least.numerator, least.denominator

    def ask(b: Block) -> Iterator[pa.RecordBatch]:
        keys, times = np.unique(shingles(b.texts(), words)[0], return_counts=True)
        if len(keys):
            yield messages([(b.number, SHINGLES, k, packed(keys[i], times[i].astype(np.uint32))) for k, i in split_by((keys % np.uint64(n)).astype(np.int64), n)])

    def count(bucket: int, asked: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        got = [unpacked(d) for _, _, d in asked]
        _, which = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        texts = np.minimum(np.bincount(which, np.concatenate([g[1] for g in got])), MOST).astype(np.uint16)[which]
        rows, at = [], 0
        for (block, _, _), g in zip(asked, got):
            rows.append((block, SHINGLES, bucket, packed(texts[at : at + len(g[0])])))
            at += len(g[0])
        yield messages(rows)

    told = stored(each_bucket(each_block(blocks, ask, MESSAGE), count, MESSAGE), "similar-counts")
    swept(df.sparkSession)
    schema = T._parse_datatype_string("node long, id long, n int, fp long, parity binary, shared array<long>, keys array<long>")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def choose(b: Block) -> Iterator[pa.RecordBatch]:
        key, doc, size = shingles(b.texts(), words)
        distinct, which = np.unique(key, return_inverse=True)
        held, answers = np.zeros(len(distinct), np.uint16), dict(b.told.get(SHINGLES, []))
        for k, i in split_by((distinct % np.uint64(n)).astype(np.int64), n):
            held[i] = unpacked(answers[k])[0]
        held = held[which]
        whole, upto = key, np.cumsum(size)
        key, doc, held = key[held > 1], doc[held > 1], held[held > 1]
        many = np.bincount(doc, minlength=len(size))
        need = -(-up * size // down)
        ends = np.cumsum(many)
        node = ((b.number >> 32) << 44) + ((b.number & 0xFFFFFFFF) << 20)
        rows = []
        for d in np.flatnonzero(many >= need).tolist():
            part = slice(ends[d] - many[d], ends[d])
            k = key[part]
            rare = k[np.lexsort((k, held[part]))[: many[d] - need[d] + 1]]
            rows.append((node + d, b.ids[d], int(size[d]), _fingerprint(own := whole[upto[d] - size[d] : upto[d]]), _parities(own), k.view(np.int64), rare.view(np.int64)))
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=schema.names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=schema.names)

    out = stored(each_block(blocks, choose, schema, told), "similar-candidates")
    dropped(told)
    dropped(blocks)
    swept(df.sparkSession)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Those (a, b) whose similarity is at least ``least``."""
    one, other = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(other, "b").withColumn("_both", both).where(F.col("_both") * least.denominator >= (F.col("na") + F.col("nb") - F.col("_both")) * least.numerator).select("a", "b")


def _close(keyed: DataFrame, turn: int) -> DataFrame:
    """For each node at most one pair (a, b): of its neighbours in other components, in the order of the fingerprints turned by
    some bits among the nodes of a key, the one whose fingerprint is nearest. Ranges may cut a key's nodes, so its size doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(k)) for k in range(4)]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now)]
            key, node, fp, part = now
            held = [x[-1:] for x in now]
            at = np.flatnonzero((key[1:] == key[:-1]) & (part[1:] != part[:-1]))
            if len(at):
                far = np.bitwise_count((fp[at] ^ fp[at + 1]).view(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[at], node[at + 1]])), pa.array(np.concatenate([node[at + 1], node[at]])), pa.array(np.concatenate([far, far]))], names=["a", "b", "far"])

    order = ["key", F.expr(f"shiftleft(fp, {turn}) | shiftrightunsigned(fp, {64 - turn})") if turn else F.col("fp"), "node"]
    rows = keyed.select("key", "node", "fp", "component").repartitionByRange(n_partitions(keyed.sparkSession), *order).sortWithinPartitions(*order)
    best = rows.mapInArrow(run, "a long, b long, far int").groupBy("a").agg(F.min(F.struct("far", "b")).alias("_b"))
    return best.select(F.least("a", "_b.b").alias("a"), F.greatest("a", "_b.b").alias("b")).distinct()


def _apart(keyed: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes of one key and different components whose sizes, shingles left after the key, and parities allow the similarity.

    A pair that shares one of the first ``FIRST`` keys of both is told at its first common key only. The nodes of a key of
    more than ``TILE`` are dealt over pairs of tiles.
    """
    up, down = least.numerator, least.denominator
    spark = keyed.sparkSession
    rows = keyed.select("key", "node", "n", "component", "left", "pos", "first", "parity")
    big = stored(rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > TILE).select("key", F.ceil(F.col("_n") / TILE).cast("int").alias("_k")), "similar-big")
    rows = rows.join(big, "key", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumn("one", F.least("mine", "_with")).withColumn("two", F.greatest("mine", "_with"))
    by = ["key", "one", "two"]
    rows = rows.select(*by, "mine", "node", "n", "component", "left", "pos", "first", "parity").repartition(n_partitions(spark), *by).sortWithinPartitions(*by, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solve(cols: list[np.ndarray], first: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
            one, two, mine, node, n, part, left, pos = cols[1:]
            new = np.ones(len(node), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            bounds = [*np.flatnonzero(new).tolist(), len(node)]
            a, b, size = [], [], 0
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                for i in range(lo, hi - 1):
                    j = np.arange(i + 1, hi)
                    ok = (part[j] != part[i]) & (down * n[j] >= up * n[i]) & (down * n[i] >= up * n[j])
                    ok &= (up + down) * np.minimum(left[j], left[i]) >= up * (n[j] + n[i])
                    if one[i] != two[i]:
                        ok &= mine[j] != mine[i]
                    j = j[ok]
                    if len(j):
                        j = j[(up + down) * np.bitwise_count((parity[j] ^ parity[i]).view(np.uint64)).sum(1, dtype=np.int64) <= (down - up) * (n[j] + n[i])]
                    if len(j):  # a key before this one in both
                        early = first[i][: pos[i]]
                        again = (first[j][:, :, None] == early[None, None, :]) & (np.arange(FIRST)[None, :] < pos[j][:, None])[:, :, None]
                        j = j[~again.any((1, 2))]
                    if len(j):
                        a.append(np.full(len(j), node[i]))
                        b.append(node[j])
                        size += len(j)
                    if size > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                        a, b, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(c).astype(np.int64) for c in batch.columns[:-2]]
            now += [np.frombuffer(b"".join(c.to_pylist()), np.int64).reshape(batch.num_rows, -1) for c in batch.columns[-2:]]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut = int(np.argmax(same))  # the last tiles may go on
            if cut:
                yield from solve([c[:cut] for c in now[:-2]], now[-2][:cut], now[-1][:cut])
            held = [c[cut:] for c in now]
        if held is not None:
            yield from solve(held[:-2], held[-2], held[-1])
        held = None
        let_go()

    return rows.mapInArrow(run, "a long, b long").distinct()


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, least: float = 0.8, rounds: int = 1) -> DataFrame:
    """(id, component_id) of each row that is linked to another one.

    Rows are linked when the distinct shingles of ``words`` words of their texts have a Jaccard
    similarity of at least ``least``; the component is named by the smallest id that can be reached
    (null if no row of it has one). Texts without words are equal. Shingles are told apart by 64-bit hashes.
    ``rounds`` is how often neighbouring fingerprints are compared before the search that ends with all pairs:
    it changes the work, not the result.
    """
    least = Fraction(str(least))
    if not 0 < least <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    rows = _candidates(df, id_col, text_col, words, least)
    # fingerprints within the radius, equal ones by way of their first node
    nodes = stored(rows.select("node", "fp"), "similar-nodes")
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("a")), "similar-first")
    pairs = nodes.join(first, "fp").where("node <> a").select("a", F.col("node").alias("b")).unionByName(hamming_links(first.select("fp", F.col("a").alias("node")), NEAR))
    links = stored(_verified(pairs, rows, least), "similar-links")
    parts = stored(connected_components(links), "similar-parts")
    head = F.concat(*(F.unhex(F.lpad(F.hex(F.coalesce(F.get("keys", F.lit(k)), F.lit(0))), 16, "0")) for k in range(FIRST)))
    about = stored(rows.select("node", head.alias("first"), "parity"), "similar-about")
    keyed = rows.select("node", "n", "fp", F.size("shared").alias("_many"), F.posexplode("keys").alias("pos", "key")).withColumn("left", F.col("_many") - F.col("pos")).drop("_many")
    keyed = stored(keyed, "similar-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1").select("key")
    keyed = stored(keyed.join(shared, "key", "left_semi"), "similar-shared")

    def mixed() -> DataFrame:
        """Rows of the keys whose nodes are in different components."""
        mine = stored(keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "similar-keyed")
        keys = mine.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key")
        return stored(mine.join(keys, "key", "left_semi"), "similar-mixed")

    for k in range(rounds):
        more = stored(_verified(_close(mixed(), 64 * k // rounds), rows, least), "similar-close")
        if more.isEmpty():
            break
        links = stored(links.unionByName(more), "similar-links")
        parts = stored(connected_components(links), "similar-parts")
    more = stored(_verified(_apart(mixed().join(about, "node"), least), rows, least), "similar-more")
    parts = stored(connected_components(links.unionByName(more)), "similar-all")
    named = stored(rows.select("node", "id").join(parts, "node"), "similar-named")
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(lowest, "component").select(F.col("id").alias(id_col), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df`` without those whose component has a smaller id, with all columns.

    Ids are taken to be unique; a row without an id stays.
    """
    mine = free_name(df.columns, "_member")
    gone = similar_components(df, id_col, text_col, words=words, least=least).where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias(mine)).distinct()
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(mine), "left_anti")
