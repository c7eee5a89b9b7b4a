"""The event tables that the named queries run on, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hour(ts: str):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3600e6).cast("long")


def loc_ev(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("index"), F.col("value").alias("position_x"), _hour("ts").alias("frame"), F.col("event_type").alias("channel"), "user_id")


def loc_emb(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return e.select(F.col("vec_id").alias("index"), at(0).alias("position_x"), at(1).alias("position_y"), at(2).alias("position_z"), F.col("label").cast("long").alias("cluster_label"))


def loc_emb_2d(spark: SparkSession, d: str) -> DataFrame:
    return loc_emb(spark, d).drop("position_z")


def loc_li(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/lineitem.parquet")
    return e.select(F.col("l_extendedprice").alias("position_x"), F.col("l_quantity").alias("position_y"), F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long").alias("frame"), F.col("l_extendedprice").alias("intensity"), (F.col("l_discount") + 0.0).alias("local_background"), F.col("l_linenumber").cast("long").alias("channel"))


def loc_ord(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/orders.parquet")
    return e.select(F.col("o_orderkey").alias("index"), F.col("o_totalprice").alias("position_x"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long").alias("frame"))


SQL = {
    "loc_ev": "SELECT event_id AS index, value AS position_x, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, event_type AS channel, user_id FROM events",
    "loc_emb": "SELECT vec_id AS index, CAST(embedding[1] AS DOUBLE) AS position_x, CAST(embedding[2] AS DOUBLE) AS position_y, CAST(embedding[3] AS DOUBLE) AS position_z, CAST(label AS BIGINT) AS cluster_label FROM embeddings",
    "loc_li": "SELECT l_extendedprice AS position_x, l_quantity AS position_y, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS frame, l_extendedprice AS intensity, l_discount + 0.0 AS local_background, CAST(l_linenumber AS BIGINT) AS channel FROM lineitem",
    "loc_ord": "SELECT o_orderkey AS index, o_totalprice AS position_x, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS frame FROM orders",
}


def sql(text: str, *more: str) -> str:
    """``text`` after WITH clauses for the views that it names, and for more (each 'name AS (...)')."""
    parts = [f"{name} AS ({body})" for name, body in SQL.items() if name in text + " ".join(more)]
    return f"WITH {', '.join([*parts, *more])} {text}"
