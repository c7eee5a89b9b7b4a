"""Connected components: few edges in one task, many after rounds that halve the nodes, each written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset a
    temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='pinprick-')}")
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: Setting by which Spark removes the shuffle files of a query when it ends, not at some later garbage collection.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage of loops and survives lost executors. What was shuffled for it goes when it is written."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: Edges that one task joins on its own.
FIT = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task, by joining trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = list(root)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(list(map(find, part)), pa.int64())], names=["node", "component"])


def components(edges: DataFrame, few: bool = False) -> DataFrame:
    """(node, component) of the edges (a, b): the component is its smallest node.

    Up to ``FIT`` edges are joined in one task (``few``: the caller knows that there are no more). Of more, each node first goes into the least of its
    neighbours and itself, in an order that is random and another in each round, which about halves the nodes, until few edges are left."""
    now = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v")
    if not few:
        now = written(now.distinct())
        few = now.limit(FIT + 1).count() <= FIT
    one_task = lambda df: written(df.coalesce(1).mapInArrow(_joined, "node long, component long"))
    if few:
        return one_task(now)
    rounds = []
    while rounds == [] or now.limit(FIT + 1).count() > FIT:
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("p"))  # noqa: E731, B023
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        into = written(both.groupBy("u").agg(F.min(order("v")).alias("_m")).select("u", F.least(order("u"), F.col("_m"))["p"].alias("p")))
        rounds.append(into)
        side = lambda c: into.select(F.col("u").alias(c), F.col("p").alias(f"_{c}"))  # noqa: E731, B023
        both = now.join(side("u"), "u").join(side("v"), "v").where("_u <> _v")
        now = written(both.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
    names = one_task(now)
    for into in reversed(rounds):
        names = into.join(names.withColumnRenamed("node", "p"), "p", "left").select(F.col("u").alias("node"), F.coalesce("component", "p").alias("component"))
    names = written(names)
    return written(names.join(names.groupBy("component").agg(F.min("node").alias("_low")), "component").select("node", F.col("_low").alias("component")))
