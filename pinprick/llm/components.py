"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star rounds on two long columns until no edge
    changes: O(log^2) rounds, each a few shuffles of the edges. A node of very many
    edges is only ever on the probe side of a join (which adaptive execution splits)
    or under a partial ``min``. Each round is written to the shared folder.
    Self-loops and repeated edges are allowed; nulls are ignored; no edges give no rows.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    nodes = edges.select(a.alias("u"), b.alias("v")).dropna()
    now = stored(nodes.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    alone = now.where("u = v").select("u")
    first, state = now, None
    now = now.where("u > v")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        # every node points at the least of its smaller neighbours, and so do those neighbours
        small = step.select("u", F.col("m").alias("v")).unionByName(step.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        done = stored(small, "cc-edges")
        seen = done.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now is not first and hasattr(now, "_pinprick_path"):
            dropped(now)
        now = done
        if state == tuple(seen):
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    rest = alone.select(F.col("u").alias("node"), F.col("u").alias("component")).join(now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(rest)
