"""Contiguous shards of equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked


def shard_by_bytes(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard`` and ``slot`` to the ids, in id order.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1). The prefix sums of
    the sizes are cut at equal targets, each row going where its middle byte lies, so
    shards are contiguous in the id and their sizes differ from the target by less than
    the largest row. ``slot`` counts from 0 in each shard. Null ids come first; rows that
    tie in id are told apart by size and checksum, and repeated rows get slots of their
    own. An empty table gives no rows. Texts themselves are not shuffled.
    """
    if n_shards < 1:
        raise ValueError("n_shards is at least 1")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    sizes = df.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = ranked(sizes, [F.col("_id"), F.col("size"), F.col("text_crc32")], ["size"], "shard-sizes")
    total = rows.agg(F.max(F.col("_before_size") + F.col("size"))).first()[0] or 1
    # Twice the middle byte, in decimals: exact at any size.
    rows = rows.withColumn("shard", F.expr(f"CAST(LEAST(CAST(_before_size * 2 + size AS DECIMAL(30, 0)) * {n_shards} div CAST({2 * total} AS DECIMAL(30, 0)), {n_shards - 1}) AS INT)"))
    starts = rows.groupBy("shard").agg(F.min("_pos").alias("_from"))  # a row per shard
    return rows.join(F.broadcast(starts), "shard").select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_pos") - F.col("_from")).alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``df`` as Parquet, one folder per shard, rows in slot order.

    Rows are joined with their places by id, so ids must be unique and not null here.
    """
    places = shard_by_bytes(df, n_shards, id_col, text_col).select(id_col, "shard", "slot")
    df.join(places, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
