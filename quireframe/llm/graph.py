"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """Of each node in links(a, b): the smallest node that can be reached, as (id, root).

    Large-star and small-star steps in turn: each hangs neighbours on the smallest node around, with
    aggregates and joins on the node only; every step's links are written, so none is worked out twice. The smallest nodes
    are written too: links then meet them in a join that Spark can split where a node has very many.
    """
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.written(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m")), "lows")
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.written(large.where("u <> v").distinct(), "large")
        low = common.written(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "lows")
        small = large.join(low, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = common.written(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = tuple(now)
