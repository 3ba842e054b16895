"""Connected components of a distributed edge list (alternating stars).

Each round hooks every node to the smallest node it sees and checkpoints the
edges to the shared folder; nothing but two numbers a round reaches the
driver.  A node with many edges is one row per edge throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node reachable.

    Loops and repeated edges are allowed; nodes appear only if an edge names
    them.  Empty edges give an empty result.
    """
    pairs = (edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
             .filter("lo < hi").distinct())
    pairs = cut_lineage(pairs)
    last = None
    while True:
        # large star: the larger neighbours of u join u's smallest neighbour
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct())
        # small star: u and its smaller neighbours join the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, "hi").select(F.col("m"), F.col("lo").alias("x")).filter("m < x")
                 .unionAll(low.select("m", F.col("hi").alias("x"))))
        pairs = cut_lineage(small.select(F.col("m").alias("lo"), F.col("x").alias("hi")).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    roots = pairs.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
