"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters.

Documents are range-partitioned by id and sorted, tokenised, and written as one row per
document (id, token count, ids as an integer list). ORC encodes the ids in run-length
stripes, keeps minimum and maximum of the ids per row group and a Bloom filter on
the document id, so a lookup skips stripes and row groups by metadata, and stripes are
read in parallel. Each reader finds any document's place in the token stream from the prefix
sums of the token counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_partitions, new_path, ranked, stored, tuned
from .tokens import encoder


def encoded(df: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) per row, in the order of ``df``; null text is empty."""
    tuned(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer, kind), np.uint32(end_id).tobytes()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 256):  # small batches: ids take more room than text
                ids = [x + end for x in own.encode(texts[i : i + 256])]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(ids)), pa.array(n), pa.ListArray.from_arrays(offsets, values)], names=schema.names)

    return rows.mapInArrow(run, schema)


def write_tokens(df: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, row_index_stride: int = 10_000, bloom_fpp: float = 0.01) -> None:
    """Write the ids of every row below ``path`` in ascending id order, file after file.

    Each document's ids end with ``end_id``; null text is empty. Null ids come first; rows with
    one id follow each other in any order. An empty table gives a folder without rows.
    """
    tuned(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartitionByRange(n_partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    encoded(rows, tokenizer, kind, end_id).write.options(
        compression="zstd", **{"orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(row_index_stride), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp)}
    ).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) from the files; ``doc_ids`` is pushed down to row indexes and Bloom filters."""
    df = tuned(spark).read.orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a token table: start counts the ids of all
    documents before it in id order, the checksum runs over the ids as little-endian
    unsigned 32-bit integers."""
    tuned(tokens.sparkSession)
    schema = T.StructType([tokens.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets)
            values = memoryview(np.ascontiguousarray(np.asarray(lists.values)).view(np.uint8))
            crc = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names)

    own = stored(tokens.select("doc_id", "ids").mapInArrow(run, schema), "token-rows")  # ranking goes over its input twice
    rows = ranked(own, [F.col("doc_id"), F.col("n_tokens"), F.col("ids_crc32")], ["n_tokens"], "token-digests")
    return rows.select("doc_id", F.col("_before_n_tokens").alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    path = new_path(df.sparkSession, "tokens-orc")
    write_tokens(df, path, tokenizer, kind, end_id)
    return digests(read_tokens(df.sparkSession, path))
