"""Connected components of an edge table, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of the edges (columns ``a``, ``b``); label: smallest node reachable.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Edges end as stars around the labels. Only minima are grouped,
    and hubs meet the rest in joins, which Spark splits when they are skewed. Each round is stored.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_n"), F.least("a", "_m").alias("_m"))
        large = both.join(least, F.col("a") == F.col("_n")).filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_n")
        small = large.join(least, F.col("a") == F.col("_n"))
        small = small.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").unionAll(least.select(F.col("_n").alias("a"), F.col("_m").alias("b")))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
