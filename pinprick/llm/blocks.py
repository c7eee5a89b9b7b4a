"""Blocks of whole documents, and questions that blocks ask of tables dealt by key.

A corpus statistic that every token needs (a count, a shared name) is too large to broadcast
and too fine to join token by token. Instead each block of some megabytes of text asks once for
each distinct key it holds: the keys, packed and sorted, go to the key's bucket (one shuffle of a
few bytes per distinct key and block), the bucket adds up what all blocks said and answers each
block in the order it asked. A key that stands in a third of all documents is asked for
once per block, so no bucket is larger than the number of blocks times its distinct keys.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_go, n_partitions, stored, tuned, utf8

#: What a block asks or is told: a kind, the bucket, and packed arrays.
MESSAGE = "block long, kind int, bucket int, data binary"
NAMES = ["block", "kind", "bucket", "data"]
BLOCK = "block long, kind int, bucket int, data binary, ids array<long>, sizes binary"
TEXT = 99  # kind of the row that holds a block's texts; sorts after all answers


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one or more dtypes, compressed together, like bytes of the numbers side by side."""
    head = [len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))]
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.compress(b"".join([np.array(head, np.int64).tobytes(), *planes]), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for kind, size in zip(head[::2], head[1::2]):
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += size * dtype.itemsize
    return out


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    block, kind, bucket, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=NAMES)


def make_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The stored block table: about ``block_bytes`` of text a row, compressed; a longer text
    is a block of its own. Null text is empty; ids are integers and may be null or repeat."""
    tuned(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = T._parse_datatype_string(BLOCK)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + serial]), pa.array([TEXT], pa.int32()), pa.array([0], pa.int32()), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary())], names=schema.names
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                ids.append(i)
                texts.append(t)
                held += len(t) + 16
                if held >= block_bytes:
                    yield flush()
                    serial, ids, texts, held = serial + 1, [], [], 0
        if ids:
            yield flush()

    return stored(rows.mapInArrow(gather, schema), "blocks", **{"parquet.block.size": str(8 << 20)})


class Block:
    """One block's documents and the answers to it, by kind and in order of bucket."""

    def __init__(self, number: int, data: bytes, ids: list[int | None], sizes: bytes, told: dict[int, list[tuple[int, bytes]]]) -> None:
        self.number, self.ids, self.told = number, ids, told
        self.data, self.sizes, self._sizes = data, sizes, np.frombuffer(sizes, np.int64)

    def texts(self) -> Iterator[bytes]:
        raw, at = zstandard.decompress(self.data), 0
        for n in self._sizes.tolist():
            yield raw[at : at + n]
            at += n


def each_block(blocks: DataFrame, work: Callable[[Block], Iterator[pa.RecordBatch]], schema: str | T.StructType, *told: DataFrame) -> DataFrame:
    """``work`` on every block, with what it was told (rows like MESSAGE)."""
    rows = blocks
    for t in told:
        rows = rows.unionByName(t.select(*NAMES), allowMissingColumns=True)
    if told:
        rows = rows.repartition(n_partitions(blocks.sparkSession), "block").sortWithinPartitions("block", "kind", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for i in range(b.num_rows):
                number, kind, bucket, data, ids, sizes = (c[i].as_py() for c in b.columns)
                if kind != TEXT:
                    answers.setdefault(kind, []).append((bucket, data))
                    continue
                yield from work(Block(number, data, ids, sizes, answers))
                answers = {}
        let_go()

    return rows.select("block", "kind", "bucket", "data", "ids", "sizes").mapInArrow(run, schema)


def each_bucket(asked: DataFrame, work: Callable[[int, list[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on each bucket: its number and all (block, kind, data) sent to it, in order."""
    rows = asked.select(*NAMES).repartition(n_partitions(asked.sparkSession), "bucket").sortWithinPartitions("bucket", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for block, kind, bucket, data in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and held:
                    yield from work(now, held)
                    held = []
                now = bucket
                held.append((block, kind, data))
        if held:
            yield from work(now, held)
        now, held = None, []
        let_go()

    return rows.mapInArrow(run, schema)


def n_buckets(blocks: DataFrame, keys_per_block: int, keys_per_bucket: int = 1_000_000) -> int:
    """Buckets for keys of all blocks: bounded keys in each, however many blocks there are."""
    return max(n_partitions(blocks.sparkSession), -(-blocks.count() * keys_per_block // keys_per_bucket))


def split_by(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) for each bucket that occurs; the places ascend."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    begin = np.concatenate([[0], ends[:-1]])
    for k in np.flatnonzero(ends > begin).tolist():
        yield k, order[begin[k] : ends[k]]


def swept(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are stored by now."""
    for _ in range(2):  # what Python lets go reaches the JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit name for the pairs (a, b), order counting."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 18


def _factors(n: int) -> np.ndarray:
    """A fixed 64-bit factor for each place in a word."""
    return mix(np.arange(1, n + 1, dtype=np.uint64), 0xC0FFEE) | np.uint64(1)


_FACTORS = [_factors(256)]


def word_hashes(texts: Iterable[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of anything but ASCII white space) in order, and each text's number of words.

    A word's hash is the mixed sum of its bytes times the factors of their places. Texts are gone
    through some hundred kilobytes at a time, so that the arrays stay in cache; ``lower`` folds A-Z.
    """
    hashes, counts, held, size = [], [], [], 0

    def flush() -> None:
        raw = np.frombuffer(b" ".join(held), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in held])
        raw = _LOWER[raw] if lower else raw
        space = _SPACE[raw]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        if not len(starts):
            return
        raw, space, first = raw[starts[0] :], space[starts[0] :], first[starts[0] :]
        starts = (starts - starts[0]).astype(np.int32)
        place = np.arange(len(raw), dtype=np.int32) - starts[np.cumsum(first, dtype=np.int32) - 1]
        place[space] = 0
        longest = int(place.max()) + 1
        if longest > len(_FACTORS[0]):
            _FACTORS[0] = _factors(2 * longest)
        values = (raw.astype(np.uint64) + np.uint64(1)) * _FACTORS[0][place]
        values[space] = 0
        hashes.append(mix(np.add.reduceat(values, starts), 0))

    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            flush()
            held, size = [], 0
    if held:
        flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(counts) if counts else np.zeros(0, np.int64)
