"""Packing documents into fixed-length sequences: shortest-pack-first over the histogram.

Documents are tokenised and cut into full sequences and a remainder. The lengths' histogram
(at most as many counts as a sequence has tokens) is packed on the driver: lengths are
placed longest first, each on the pattern of the shortest packs so far that has
room, and the counts of patterns are updated, never single packs. The patterns then
name, for each length, which ranks go to which sequence and offset, and pieces find theirs by
their global rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, stored, tuned
from .tokens import encoder


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, how many of it)]), in order of making."""
    open_: list[tuple[int, int, list[tuple[int, int]]]] = []  # (-room, serial, pattern); widest room first
    packs: dict[int, int] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    serial = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_ and -open_[0][0] >= length:
                room, at, pattern = heappop(open_)
                room, many = -room, packs.pop(at)
                # as many of this length per pack as keep these the shortest packs
                below = -open_[0][0] if open_ else 0
                each = max(1, min(room // length, left // many, -(-(room - below) // length)))
                used = many if left >= many else left
                if used < many:
                    each = 1
                    heappush(open_, (-room, at, pattern))
                    packs[at] = many - used
                left -= used * each
                pattern, room, many = [*pattern, (length, each)], room - each * length, used
            else:
                pattern, room, many = [(length, 1)], size - length, left
                left = 0
            if room:
                heappush(open_, (-room, serial, pattern))
                packs[serial] = many
            else:
                done.append((many, pattern))
            serial += 1
    return done + [(packs[at], pattern) for _, at, pattern in sorted(open_, key=lambda x: x[1])]


def pieces(df: DataFrame, tokenizer: str, kind: str, end_id: int, size: int, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    tuned(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens"))] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer, kind), np.uint32(end_id).tobytes()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                row, start, length, crc, total, data = [], [], [], [], [], []
                for k, ids in enumerate(own.encode(texts[i : i + 256])):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, size):
                        x = ids[4 * s : 4 * (s + size)]
                        row.append(i + k)
                        start.append(s)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        total.append(n)
                        if with_ids:
                            data.append(x)
                columns = [b.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))] + [pa.array(data, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str, kind: str, end_id: int, size: int = 1024, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every row with ``sequence_id`` and ``offset``.

    Every row gives at least one piece: its ids and then ``end_id`` (null text: the end id
    alone). Null ids and repeated rows are packed like others. Sequence ids count from 0
    without gaps; offsets in a sequence have no gaps. An empty table gives no rows.
    """
    spark = tuned(df.sparkSession)
    # stored first: ranking goes over its input twice, and texts should be tokenised once
    own = stored(pieces(df, tokenizer, kind, end_id, size, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces-cut")
    cut = ranked(own, [F.col("length").desc(), F.col("_id"), F.col("start")], name="pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    first, at = {}, 0
    for length in sorted(counts, reverse=True):
        first[length], at = at, at + counts[length]
    slots, base, given = [], 0, dict.fromkeys(counts, 0)
    for many, pattern in pack_histogram(counts, size):
        offset = 0
        for length, each in pattern:
            begin = first[length] + given[length]
            slots.append((begin, begin + many * each, base, each, offset, length))
            given[length] += many * each
            offset += length * each
        base += many
    slots.sort()
    # One row for each length of each pattern: bounded by the square of the sequence's size, whatever the data.
    table = [np.array(c, np.int64) for c in zip(*slots)] or [np.zeros(0, np.int64)] * 6
    shared = spark.sparkContext.broadcast(table)
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, _, base, each, offset, length = shared.value
        for b in batches:
            pos = np.asarray(b.column(b.schema.get_field_index("_pos")))
            k = np.searchsorted(begin, pos, "right") - 1
            j = pos - begin[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base[k] + j // each[k]), pa.array(offset[k] + j % each[k] * length[k])], names=schema.names)

    return cut.mapInArrow(place, schema).withColumnRenamed("_id", id_col).drop("_pos")
