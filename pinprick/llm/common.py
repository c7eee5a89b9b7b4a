"""Shared pieces: the shared folder, written tables, global ranks and text blocks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches stay small whatever the texts' length, so that a Python worker's memory is bounded.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    ``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder
    in local mode and an error on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='pinprick-')}")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with bounds on the bytes of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def let_go() -> None:
    """Give memory that earlier tasks of this Python worker have freed back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage,
    and a lost executor costs no earlier work."""
    spark = tuned(df.sparkSession)
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pinprick_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_pinprick_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (case is ignored)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def ranked(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), name: str = "ranked") -> DataFrame:
    """Add ``_pos``, the row's global place in ``order``, and ``_before_<c>``, the sum of
    ``c`` over all rows before it, for each column c of ``sums`` (nulls count as 0).

    Rows are range-partitioned by sampled splitters; each partition adds up its own rows
    in one streaming pass, and only the per-partition totals (one small row each) meet at
    the driver, whose prefix sums are broadcast: as many rows as there are partitions,
    however large the data. Rows that tie in ``order`` keep the places the first pass gave them.
    """
    spark = tuned(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_pos", T.LongType()), *(T.StructField(f"_before_{c}", T.LongType()) for c in sums)])
    sums = list(sums)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, totals = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            n = b.num_rows
            columns = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))]
            seen += n
            for c in sums:
                own = np.asarray(b.column(b.schema.get_field_index(c)).cast(pa.int64()).fill_null(0))
                upto = np.cumsum(own) + totals[c]
                columns.append(pa.array(upto - own))
                totals[c] = int(upto[-1]) if n else totals[c]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    n = n_partitions(spark)
    local = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, schema), name)
    totals = local.groupBy("_part").agg(F.count("*").alias("_pos"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums)).collect()
    rows, acc = [], [0] * (1 + len(sums))
    for r in sorted(totals, key=lambda r: r["_part"]):
        rows.append((r["_part"], *acc))
        acc = [a + int(x) for a, x in zip(acc, r[1:], strict=True)]
    offsets = spark.createDataFrame(rows, "_part int, _o long" + "".join(f", _o{i} long" for i in range(len(sums))))
    return local.join(F.broadcast(offsets), "_part").select(
        *(local[c] for c in df.columns), (local["_pos"] + F.col("_o")).alias("_pos"), *((local[f"_before_{c}"] + F.col(f"_o{i}")).alias(f"_before_{c}") for i, c in enumerate(sums))
    )
