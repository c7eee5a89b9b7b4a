"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over the leading bytes of the
normalised text, then its SHA-256, then the identifier, and sorted externally
within each partition. Equal texts are then neighbours, the row to keep first, and one
streaming pass compares each text in full with the one before it. A group of copies may
cover many partitions (the identifier is part of the range key, so a text that a third of
all rows share is dealt over many tasks); groups that run over a partition's edge are
joined afterwards from one small row per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, n_partitions, stored, tuned, utf8

#: Bytes of the text that lead the range key: keeps the driver's sample of splitters small.
PREFIX = 32


def _starts(keys: pa.Array, last: bytes | None) -> np.ndarray:
    """True where a key differs from the one before it."""
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = ~np.asarray(pc.equal(keys[1:], keys[:-1]))
    if len(keys) and last is not None:
        new[0] = keys[0].as_py() != last
    return new


def _copied(ids: pa.Array) -> pa.Array:
    """Values of their own: a slice would keep its whole batch in memory, texts and all."""
    return ids.take(pa.array(np.arange(len(ids))))


def _sorted(df: DataFrame, id_col: str, text_col: str, keep: str, normalise: Callable[[Column], Column] | None) -> tuple[DataFrame, str, str]:
    """Rows with their key and its digest, ranged and sorted; names of both columns."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = tuned(df.sparkSession)
    key, sha = free_name(df.columns, "_key"), free_name(df.columns, "_sha")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = df.withColumn(key, (normalise(text) if normalise else text).cast("binary")).withColumn(sha, F.sha2(F.col(key), 256))
    first = F.col(f"`{id_col}`").asc_nulls_last() if keep == "smallest" else F.col(f"`{id_col}`").desc_nulls_last()
    order = [F.substring(F.col(key), 1, PREFIX), F.col(sha), first]
    return df.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(order[0], F.col(sha), F.col(key), first), key, sha


def _edges(parts: DataFrame) -> dict[int, dict]:
    """For each partition that has rows: whether its first run goes on a run of the
    partition before, found by full comparison. A few numbers per partition reach the driver."""
    spark = parts.sparkSession
    rows = {r["_part"]: r.asDict() | {"joins": False} for r in parts.drop("_first", "_last").collect()}
    order = sorted(rows)
    if len(order) > 1:
        pairs = spark.createDataFrame(list(zip(order, order[1:])), "_p int, _q int")
        a, b = parts.select(F.col("_part").alias("_p"), "_last"), parts.select(F.col("_part").alias("_q"), "_first")
        for r in pairs.join(a, "_p").join(b, "_q").where(F.col("_last") == F.col("_first")).select("_q").collect():
            rows[r["_q"]]["joins"] = True
    return rows


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their normalised UTF-8 bytes are. The row with the smallest
    (or largest) id stays. Null text counts as empty; a null id stays only in a group
    without any other; of repeated rows with one id exactly one is kept. An empty table
    gives no rows. Other columns are not read.
    """
    spark = tuned(df.sparkSession)
    id_type = df.schema[id_col].dataType
    df = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    rows, key, sha = _sorted(df, "_id", "_text", keep, normalise)
    rows = rows.select("_id", key, sha)
    schema = T.StructType(
        [T.StructField("_id", id_type), T.StructField("_keep", id_type), T.StructField("_n", T.LongType()), T.StructField("_is", T.BooleanType()), T.StructField("_sha", T.StringType()), T.StructField("_part", T.IntegerType())]
        + [T.StructField("_edge", T.IntegerType()), T.StructField("_runs", T.LongType()), T.StructField("_first", T.BinaryType()), T.StructField("_last", T.BinaryType()), T.StructField("_fn", T.LongType())]
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kind = None
        held: list[pa.Array] = []  # ids of the run that is open
        digest, last, first, n_runs, first_n = "", None, None, 0, 0

        def close(edge: int) -> list:
            nonlocal first_n
            ids = pa.concat_arrays(held)
            if n_runs == 1:
                first_n, edge = len(ids), 1
            n = len(ids)
            is_first = np.zeros(n, bool)
            is_first[0] = True
            return [ids, pa.array([ids[0].as_py()] * n, kind), pa.array(np.full(n, n)), pa.array(is_first), pa.array([digest] * n), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge, np.int32)), *(pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int64()))]

        def pack(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            ids, keys, shas = b.column(0), b.column(1), b.column(2)
            kind = ids.type
            at = np.flatnonzero(_starts(keys, last))
            if not len(ids):
                continue
            bounds = [*at.tolist(), len(ids)]
            if bounds[0] > 0:
                held.append(_copied(ids[: bounds[0]]))
            closed = []
            one = {}  # whole runs of one row, the usual case, go out together
            for i, j in zip(bounds[:-1], bounds[1:]):
                if held:
                    if n_runs > 1 and len(held) == 1 and len(held[0]) == 1:
                        one.setdefault("ids", []).append(held[0])
                        one.setdefault("sha", []).append(digest)
                    else:
                        closed.append(close(0))
                held, digest, n_runs = [_copied(ids[i:j]) if j == len(ids) else ids[i:j]], shas[i].as_py(), n_runs + 1  # only the last run stays open
            if first is None:
                first = keys[0].as_py()
            last = keys[-1].as_py()
            if one:
                own = pa.concat_arrays(one["ids"])
                n = len(own)
                closed.append([own, own, pa.array(np.ones(n, np.int64)), pa.array(np.ones(n, bool)), pa.array(one["sha"]), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), *(pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int64()))])
            for columns in closed:
                yield pack(columns)
        if held:
            out = close(2)
            yield pack(out)
            keep_last = out[1][0].as_py()
            nulls = [pa.nulls(1, kind), pa.array([keep_last], kind), pa.array([len(out[0])], pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.string()), pa.array([part], pa.int32())]
            yield pack([*nulls, pa.array([-1], pa.int32()), pa.array([n_runs], pa.int64()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([first_n], pa.int64())])

    table = stored(rows.mapInArrow(runs, schema), "exact-runs")
    parts = table.where("_edge = -1").select("_part", "_runs", "_first", "_last", F.col("_keep").alias("_last_keep"), F.col("_n").alias("_last_n"), "_fn")
    edges = _edges(parts)
    # Chains of runs over partition edges: each ends up with its first row's id and its whole size.
    runs_of: dict[tuple[int, int], list] = {}
    open_chain: list | None = None
    for p in sorted(edges):
        e = edges[p]
        if e["joins"] and open_chain is not None:
            open_chain[1] += e["_fn"]
            runs_of[p, 1] = open_chain
        else:
            runs_of[p, 1] = [None if e["_runs"] > 1 else e["_last_keep"], e["_fn"], e["_runs"] > 1]
        if e["_runs"] > 1:
            open_chain = runs_of[p, 2] = [e["_last_keep"], e["_last_n"], False]
        else:
            open_chain = runs_of[p, 1]
    fixes = [(p, edge, c[0], c[1], c[2], bool(edge == 1 and edges[p]["joins"])) for (p, edge), c in runs_of.items()]
    fix = spark.createDataFrame(fixes, T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.IntegerType()), T.StructField("_fk", id_type), T.StructField("_fs", T.LongType()), T.StructField("_own", T.BooleanType()), T.StructField("_goes_on", T.BooleanType())]))
    # Two rows per partition at most.
    out = table.where("_edge >= 0").join(F.broadcast(fix), ["_part", "_edge"], "left")
    fixed = F.col("_fs").isNotNull() & ~F.coalesce("_own", F.lit(True))
    return out.select(
        F.col("_id").alias(id_col), F.when(fixed, F.col("_fk")).otherwise(F.col("_keep")).alias("keep_id"), F.when(fixed, F.col("_fs")).otherwise(F.col("_n")).alias("group_size"),
        (F.col("_is") & ~F.coalesce("_goes_on", F.lit(False))).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that stay, with all their columns; same rules as :func:`duplicate_groups`.

    The sorted rows are streamed once and only the first of each run goes on.
    """
    spark = tuned(df.sparkSession)
    rows, key, sha = _sorted(df, id_col, text_col, keep, normalise)
    part, edge, first, last = (free_name(rows.columns, x) for x in ("_part", "_edge", "_first", "_last"))
    own = [c for c in df.columns]
    rows = rows.select(*(F.col(f"`{c}`") for c in own), key)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema.fields), T.StructField(part, T.IntegerType()), T.StructField(edge, T.IntegerType()), T.StructField(first, T.BinaryType()), T.StructField(last, T.BinaryType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        seen, begun, types = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.num_columns - 1)
            types = b.schema.types[:-1]
            new = _starts(keys, seen)
            seen = keys[-1].as_py()
            where = np.flatnonzero(new)
            kept = [c.take(pa.array(where)) for c in b.columns[:-1]]
            n = len(where)
            code = np.zeros(n, np.int32)
            if begun is None:
                begun, code[0] = keys[0].as_py(), 1
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(n, at, np.int32)), pa.array(code), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=schema.names)
        if begun is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.array([at], pa.int32()), pa.array([-1], pa.int32()), pa.array([begun], pa.binary()), pa.array([seen], pa.binary())], names=schema.names)

    table = stored(rows.mapInArrow(stream, schema), "exact-kept")
    parts = table.where(F.col(edge) == -1).select(F.col(part).alias("_part"), F.col(first).alias("_first"), F.col(last).alias("_last"))
    goes_on = [p for p, e in _edges(parts).items() if e["joins"]]  # partition numbers, no more than there are partitions
    return table.where((F.col(edge) == 0) | (F.col(edge) == 1) & ~F.col(part).isin(goes_on or [-1])).select(*(F.col(f"`{c}`") for c in own))
