"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents into shards of bounded size. A shard holds, for each of its
terms, the ascending positions in the shard; between documents one position stays free, so
consecutive positions never cross documents. A phrase is found by intersecting its
terms' position lists, each less the term's offset, from the shard's rarest term on; what
is left after the last term are exact occurrences. Query phrases go over the index in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, let_go, n_partitions, stored, tuned, utf8

#: Words: digits, ASCII letters (lowered) and everything beyond ASCII; the rest separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHARD_WORDS = 1 << 20


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index: postings (shard, term, positions as differences) and, where
    ``term`` is null, one row per document (its id, ordinal ``ord``, first position and word count)."""
    tuned(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("gaps", T.ArrayType(T.IntegerType(), False)), T.StructField("doc_id", id_type), T.StructField("ord", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_words", T.LongType())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__
        parts, firsts, counts, ids, at = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard = (part << 24) + serial
            n = len(firsts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.concat_arrays(ids), pa.array(np.arange(n, dtype=np.int32)), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], names=schema.names)
            if not code:
                return
            codes = np.concatenate(parts)
            where = np.repeat(np.array(firsts, np.int64) - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(codes))
            order = np.argsort(codes, kind="stable")
            size = np.bincount(codes, minlength=len(code))
            ends = np.cumsum(size)
            gaps = where[order]
            gaps[1:] -= where[order][:-1]
            begin = ends - size
            gaps[begin] = where[order][begin]
            offsets, terms, gaps = np.concatenate([[0], ends]), list(code), gaps.astype(np.int32)
            for i in range(0, len(terms), 20_000):
                j = min(i + 20_000, len(terms))
                lists = pa.ListArray.from_arrays(pa.array((offsets[i : j + 1] - offsets[i]).astype(np.int32)), pa.array(gaps[offsets[i] : offsets[j]]))
                k = j - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, shard)), pa.array(terms[i:j], pa.binary()), lists, pa.nulls(k, ids[0].type), *(pa.nulls(k, t) for t in (pa.int32(), pa.int64(), pa.int64()))], names=schema.names)

        for b in batches:
            for i, text in enumerate(utf8(b.column(1))):
                w = words(text)
                parts.append(np.fromiter(map(code.__getitem__, w), np.int32, len(w)))
                firsts.append(at)
                counts.append(len(w))
                ids.append(b.column(0).slice(i, 1))
                at += len(w) + 1
                if at >= shard_words:
                    yield from flush()
                    serial += 1
                    code.clear()
                    parts, firsts, counts, ids, at = [], [], [], [], 0
        if firsts:
            yield from flush()
        code.clear()
        parts, firsts, counts, ids = [], [], [], []
        let_go()

    return stored(rows.mapInArrow(index, schema), "positional-index")


def windows(item: list[bytes], length: int) -> list[tuple[bytes, ...]]:
    """Runs of ``length`` consecutive words; a shorter item is one window; none without words."""
    return [tuple(item[i : i + length]) for i in range(len(item) - length + 1)] or [tuple(item)] * bool(item)


def _blocks(items: DataFrame, length: int, most: int) -> Iterator[list[tuple[object, list[tuple[bytes, ...]]]]]:
    """Items with their distinct windows, at most ``most`` windows at a time: those of a long item are cut."""
    block, n = [], 0
    for r in items.toLocalIterator():
        found = list(dict.fromkeys(windows(words((r["_text"] or "").encode()), length)))
        while found:
            block.append((r["_item"], found[: most - n]))
            n, found = n + len(block[-1][1]), found[most - n :]
            if n >= most:
                yield block
                block, n = [], 0
    if block:
        yield block


def find_phrases(index: DataFrame, phrases: list[tuple[tuple[bytes, ...], list[int]]], slop: int = 0) -> DataFrame:
    """Occurrences of ``phrases`` (words, numbers that name the phrase) as (shard, name, first
    and last position). With ``slop`` 0 exactly the phrase; else proximity: all its
    words, in any order, within as many positions as it has words plus ``slop``.

    One row per shard, name and stretch of touching occurrences; ``phrases`` is broadcast, so callers bound it.
    """
    spark = index.sparkSession
    vocabulary: dict[bytes, int] = {}
    coded = [(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in p], np.int32), names) for p, names in phrases]
    width = max((len(p) for p, _ in coded), default=1)
    padded = np.full((len(coded), width), -1, np.int32)
    for i, (p, _) in enumerate(coded):
        padded[i, : len(p)] = p
    shared = spark.sparkContext.broadcast((vocabulary, padded, [n for _, n in coded]))
    terms = spark.createDataFrame([(bytearray(w),) for w in vocabulary], "term binary")
    needed = index.where("term is not null").select("shard", "term", "gaps").join(F.broadcast(terms), "term", "left_semi")  # the block's words only
    needed = needed.repartition(n_partitions(spark), "shard").sortWithinPartitions("shard")

    def in_shard(lists: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int]]:
        vocabulary, padded, names = shared.value
        size = np.zeros(len(vocabulary) + 1, np.int64)  # the last stands for "no term"
        for t, x in lists.items():
            size[t] = len(x)
        size[-1] = np.iinfo(np.int64).max
        hits: dict[int, list[np.ndarray]] = defaultdict(list)
        for i in np.flatnonzero(size[padded].min(axis=1) > 0).tolist():
            p = padded[i][padded[i] >= 0]
            order = np.argsort(size[p], kind="stable")  # from the rarest term on
            if slop:
                found = _near([lists[t] for t in p[order].tolist()], p[order], len(p) + slop)
            else:
                at = lists[int(p[order[0]])] - order[0]
                for k in order[1:].tolist():
                    there = lists[int(p[k])]
                    j = np.searchsorted(there, at + k)
                    at = at[(j < len(there)) & (there[np.minimum(j, len(there) - 1)] == at + k)]
                    if not len(at):
                        break
                found = np.stack([at, at + len(p)], 1)
            if len(found):
                for name in names[i]:
                    hits[name].append(found)
        for name, found in hits.items():
            spans = np.concatenate(found)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            reach = np.maximum.accumulate(spans[:, 1])
            new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
            for a, z in zip(spans[new, 0].tolist(), reach[last].tolist()):
                yield name, a, z

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, {}
        vocabulary = shared.value[0]

        def close() -> Iterator[pa.RecordBatch]:
            rows = list(in_shard(lists))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["shard", "name", "a", "z"])

        for b in batches:
            terms, gaps = b.column(1).to_pylist(), b.column(2)
            offsets, values = np.asarray(gaps.offsets).tolist(), np.asarray(gaps.values)
            for i, shard in enumerate(b.column(0).to_pylist()):
                if shard != now:
                    if lists:
                        yield from close()
                    now, lists = shard, {}
                lists[vocabulary[terms[i]]] = np.cumsum(values[offsets[i] : offsets[i + 1]], dtype=np.int64)
        if lists:
            yield from close()
        lists = {}
        let_go()

    return needed.select("shard", "term", "gaps").mapInArrow(search, "shard long, name long, a long, z long")


def _near(lists: list[np.ndarray], terms: np.ndarray, reach: int) -> np.ndarray:
    """Stretches of at most ``reach`` positions, begun by one of the words, that hold each word as often as the phrase does."""
    need = {int(t): int((terms == t).sum()) for t in terms}
    every = {int(t): x for t, x in zip(terms, lists)}
    starts = np.unique(np.concatenate(list(every.values())))
    for t, n in need.items():  # rarest first
        x = every[t]
        starts = starts[np.searchsorted(x, starts + reach) - np.searchsorted(x, starts) >= n]
    return np.stack([starts, starts + reach], 1)


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, block_windows: int = 50_000) -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence of any item's window),
    n_items, items (ascending as text) and contaminated.

    Null texts have no words; items without words never match; items with equal text all
    match; a null item id is text 'null'. Rows with null or repeated ids are told apart by their
    place in the index. Empty tables are allowed. The benchmark goes over the index in
    blocks of some ``block_windows`` windows: all of it, however large.
    """
    index = build_index(docs, id_col, text_col)
    spark, found, items = docs.sparkSession, None, []
    for block in _blocks(benchmark.select(F.col(f"`{item_col}`").cast("string").alias("_item"), F.col(f"`{item_text_col}`").cast("string").alias("_text")), length, block_windows):
        names: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        own = []
        for item, phrases in block:
            own.append((len(items) + len(own), "null" if item is None else item))
            for p in phrases:
                names[p].append(own[-1][0])
        items += [None] * len(own)
        part = stored(find_phrases(index, list(names.items())).join(F.broadcast(spark.createDataFrame(own, "name long, item string")), "name"), "phrase-hits")
        found = part if found is None else found.unionByName(part)
    whole = index.where("term is null").select("shard", "doc_id", "ord", "first", "n_words")
    if found is None:
        return whole.select(F.col("doc_id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    # Stretches may touch but never cross documents, as one position is free between them.
    spans = found.select("shard", "item", "a", "z").repartition(n_partitions(spark), "shard")
    owner = _owners(spans, index)
    d = owner.groupBy("shard", "ord").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("s"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["z"] - F.greatest(x["a"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["z"]).alias("upto"))
    d = d.select("shard", "ord", F.aggregate("s", zero, step)["n"].alias("n_hit"), "items")
    out = whole.join(d, ["shard", "ord"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def _owners(spans: DataFrame, index: DataFrame) -> DataFrame:
    """Add the ordinal of the document that a stretch lies in: the shard's documents and
    stretches are merged in order of position, in one stream."""
    docs = index.where("term is null").select("shard", F.col("first").alias("a"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("long").alias("z"), "ord")
    rows = docs.unionByName(spans.select("shard", "a", F.lit(1).alias("kind"), "item", "z", F.lit(None).cast("int").alias("ord")))
    rows = rows.repartition(n_partitions(index.sparkSession), "shard").sortWithinPartitions("shard", "a", "kind", F.col("ord"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for b in batches:
            kind = np.asarray(b.column(2))
            if not len(kind):
                continue
            own = np.asarray(b.column(5).fill_null(-1)).astype(np.int64)
            at = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
            owner = np.where(at >= 0, own[np.maximum(at, 0)], last)
            last = int(owner[-1])
            hit = pa.array(np.flatnonzero(kind == 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), pa.array(owner).take(hit).cast(pa.int32()), b.column(3).take(hit), b.column(1).take(hit), b.column(4).take(hit)], names=["shard", "ord", "item", "a", "z"])

    return rows.mapInArrow(merge, "shard long, ord int, item string, a long, z long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns.

    Ids are taken to be unique; documents with a null id are kept or dropped together.
    """
    id_col = options.get("id_col", "doc_id")
    mine = free_name(docs.columns, "_hit")
    hit = matches(docs, benchmark, **options).where("contaminated").select(F.col(f"`{id_col}`").alias(mine)).distinct()
    return docs.join(hit, F.col(f"`{id_col}`").eqNullSafe(F.col(mine)), "left_anti")
