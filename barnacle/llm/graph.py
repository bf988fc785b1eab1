"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, heavy_keys, remove, spread_join, stored


def _star(edges: DataFrame, large: bool, total: int = 0) -> DataFrame:
    """Connect the neighbours of each node that are larger (large) or smaller (not large) than it to the least one.

    In a large star, a node with very many neighbours, such as the first of a group of copies, has them spread over several tasks. After it no
    node has many smaller ones.
    """
    both = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(both) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    found = spread_join(around, least, ["a"], heavy_keys(around, ["a"], 2 * total) if large else None, "b")
    moved = found.where("b > a" if large else "b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node that edges (a, b; any orderable type) name.

    Each step's edges are stored, and those of the step before deleted. Read again, the small files of many partitions take few tasks, while a
    checkpoint takes as many as there were partitions at every use, each with shuffle files of its own.
    """
    spark = edges.sparkSession
    path = fresh_path(spark)
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    seen, total = None, now.count()
    while True:
        before, path = path, fresh_path(spark)
        now = stored(_star(_star(now, True, total), False), path)
        remove(spark, before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen, total = state, state[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
