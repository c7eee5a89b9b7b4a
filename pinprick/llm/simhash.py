"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is cut into a ring of m segments. If two fingerprints differ in at most
t bits, then from at least one segment on, every chain of l consecutive segments
differs in at most l*t/m bits (the pigeonring principle). Candidates are found by the
chain of the first two segments: none of the first may differ and, with the default
5 segments and 4 bits, at most one bit of the second, so that one of its halves is equal
too. Both are the join key. The chain condition is then checked for longer and longer
chains before the full Hamming distance is taken.

The more fingerprints there are, the longer is the chain that makes the key: of each further segment, which may differ in
no more bits than the chain's budget, one of budget + 1 parts is equal. So buckets stay small at any size.

Only distinct fingerprints take part: copies are grouped first, by a partial
aggregation. In a key's bucket a spanning forest of the links is emitted, never all
pairs, and a bucket of more than ``tile`` fingerprints is dealt over pairs of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let_go, n_partitions, stored, tuned, utf8
from .components import connected_components

BITS, SEED = 64, 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the shingles of ``words`` words, repeats included; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(n)), np.uint64, n) if n == 1 else _hashes(w, words, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _hashes(w: list[bytes], words: int, n: int) -> np.ndarray:
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(x), SEED) for x in zip(*(w[i:] for i in range(words)))), np.uint64, n)


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint", words: int = 4) -> DataFrame:
    """All columns of ``df`` but the text, plus the fingerprint as a signed long."""
    tuned(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(out, T.LongType())])
    rows = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text_col}`").cast("string").alias(free_name([f.name for f in kept], "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in utf8(b.column(b.num_columns - 1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


class Ring:
    """The segments of a fingerprint and the keys by which candidates meet: of each chain of ``chain`` segments
    the first, which may not differ, and one part of every other, as many parts as bits may differ so far and one more."""

    def __init__(self, bits: int, segments: int | None = None, chain: int = 2) -> None:
        self.bits, self.chain = bits, chain
        self.m = segments or bits + 1
        if not bits < self.m <= 32:
            raise ValueError("the number of segments must be over the bits that may differ")
        cuts = [round(BITS * i / self.m) for i in range(self.m + 1)]
        self.masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])]
        self.keys = []  # (first segment, mask of what must be equal)
        for i in range(self.m):
            masks = [self.masks[i]]
            for k in range(1, min(chain, self.m)):
                lo, hi = cuts[(i + k) % self.m], cuts[(i + k) % self.m + 1]
                parts = (k + 1) * bits // self.m + 1
                ends = [lo + round((hi - lo) * p / parts) for p in range(parts + 1)]
                masks = [m | np.uint64(((1 << (b - a)) - 1) << a) for m in masks for a, b in zip(ends, ends[1:])]
            self.keys += [(i, m) for m in masks]
        #: Bits that all keys have at least.
        self.width = min(int(m).bit_count() for _, m in self.keys)

    def close(self, x: np.ndarray, start: int) -> np.ndarray:
        """Where ``x`` (an xor) passes each chain from ``start`` on, and so the whole ring."""
        left, at = x, np.arange(len(x))
        total = np.zeros(len(x), np.int64)
        for k in range(self.m):
            total = total + np.bitwise_count(left & self.masks[(start + k) % self.m])
            ok = total * self.m <= (k + 1) * self.bits
            if not ok.all():
                left, at, total = left[ok], at[ok], total[ok]
            if not len(at):
                break
        return at


def _forest(fp: np.ndarray, node: np.ndarray, ring: Ring, start: int) -> tuple[list, list]:
    """Edges of a spanning forest of the links within one bucket."""
    a, b = [], []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = ring.close(fp[rest] ^ fp[at], start)
            if len(hit):
                found = rest[hit]
                a.append(np.full(len(found), node[at]))
                b.append(node[found])
                queue += found.tolist()
                rest = np.delete(rest, hit)
    return a, b


def ring_for(n: int, bits: int, segments: int | None, tile: int) -> Ring:
    """The ring of the shortest chain by whose keys ``n`` even fingerprints make buckets of a quarter of a tile."""
    ring = Ring(bits, segments)
    while n >> ring.width > tile // 4 and ring.chain < ring.m - 1:
        ring = Ring(bits, segments, ring.chain + 1)
    return ring


def hamming_links(points: DataFrame, bits: int = 4, *, segments: int | None = None, tile: int = 4096) -> DataFrame:
    """Edges (a, b) that connect the same nodes as all pairs within ``bits`` bits do.

    ``points``: distinct ``fp`` (long) and ``node`` (long). Every pair within the distance
    is connected through the edges, though not each by an edge of its own.
    """
    spark = tuned(points.sparkSession)
    ring, n = ring_for(points.count(), bits, segments, tile), n_partitions(spark)
    schema = T.StructType([T.StructField(x, t) for x, t in (("_which", T.IntegerType()), ("_key", T.LongType()), ("fp", T.LongType()), ("node", T.LongType()))])
    masks = [int(m) for _, m in ring.keys]
    firsts = [i for i, _ in ring.keys]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for i, m in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array((fp & np.uint64(m)).view(np.int64)), b.column(0), b.column(1)], names=schema.names)

    keys = points.select("fp", "node").mapInArrow(keyed, schema)
    big = stored(keys.groupBy("_which", "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > tile), "simhash-big")
    if big.isEmpty():
        dealt = keys.withColumn("_tile", F.lit(0)).withColumn("_other", F.lit(0))
    else:
        # A row of a big bucket goes to each pair of tiles that holds its own tile.
        k = F.ceil(F.col("_n") / tile).cast("int")
        mine = F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int")
        dealt = keys.join(big.withColumn("_k", k).drop("_n"), ["_which", "_key"], "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_mine", mine)
        dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumn("_tile", F.least("_mine", "_with")).withColumn("_other", F.greatest("_mine", "_with"))
    by = ["_which", "_key", "_tile", "_other"]
    dealt = dealt.select(*by, "fp", "node").repartition(n, *by).sortWithinPartitions(*by)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            which, fp, node = cols[0], cols[4].view(np.uint64), cols[5]
            new = np.ones(len(fp), bool)
            for c in cols[:4]:
                new[1:] &= c[1:] == c[:-1]
            new[1:] = ~new[1:]
            new[0] = True
            starts = np.flatnonzero(new)
            sizes = np.diff([*starts, len(fp)])
            a, b = [], []
            run_of = np.cumsum(new) - 1
            small = sizes[run_of] <= 48
            for d in range(1, int(sizes[sizes <= 48].max(initial=0))):
                i = np.flatnonzero((run_of[:-d] == run_of[d:]) & small[:-d])
                if not len(i):
                    break
                w = which[i]
                x = fp[i] ^ fp[i + d]
                for q in np.unique(w).tolist():
                    at = np.flatnonzero(w == q)
                    hit = i[at[ring.close(x[at], firsts[q])]]
                    a.append(node[hit])
                    b.append(node[hit + d])
            for s, size in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist()):
                x, y = _forest(fp[s : s + size], node[s : s + size], ring, firsts[int(which[s])])
                a += x
                b += y
            if not sum(map(len, a)):
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not batch.num_rows:
                continue
            if held:  # the last bucket may go on
                cols = [np.concatenate([x, y]) for x, y in zip(held.pop(), cols)]
            same = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                same &= c == c[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut and (out := solve([c[:cut] for c in cols])) is not None:
                yield out
            held.append([c[cut:] for c in cols])
        if held and len(held[0][0]) and (out := solve(held[0])) is not None:
            yield out
        held.clear()
        let_go()

    return dealt.mapInArrow(link, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 4, words: int = 4, segments: int | None = None) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row.

    Rows are linked when their fingerprints differ in at most ``bits`` bits; the component
    is named by the smallest id that can be reached. Null and empty texts, and texts without words,
    have fingerprint zero and are linked like any other. Rows with a null id take part as
    texts but never name a component (null if no row of it has an id). Repeated rows are
    returned as often as they occur. Other columns are not read. Ids are integers.
    """
    fps = stored(fingerprints(df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")), "_text", "fp", words), "simhash-fp")
    component = fingerprint_components(fps, bits, segments)
    return fps.join(component, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def fingerprint_components(fps: DataFrame, bits: int, segments: int | None) -> DataFrame:
    """(fp, component) for each distinct ``fp`` of (_id, fp)."""
    # A node is the fingerprint itself; the ids come in after the components are known.
    distinct = stored(fps.groupBy("fp").agg(F.min("_id").alias("_low")), "simhash-distinct")
    links = hamming_links(distinct.select("fp", F.col("fp").alias("node")), bits, segments=segments)
    parts = stored(connected_components(links), "simhash-parts")
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "simhash-named")
    lowest = named.groupBy("component").agg(F.min("_low").alias("_least"))
    return named.join(lowest, "component").select("fp", F.col("_least").alias("component"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 4, words: int = 4) -> DataFrame:
    """The rows of ``df`` whose id names its component, with all columns.

    Rows with a null id stay only where no row of their component has an id. Of
    repeated rows with one id all stay: ids are taken to be unique here.
    """
    found = near_duplicates(df, id_col, text_col, bits=bits, words=words)
    mine = free_name(df.columns, "_member")
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(mine)).distinct()
    return df.join(keep, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(mine)), "left_semi")
