"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripletspark.session import cut_lineage

#: Links that one task takes: a table of so few rows is not dealt out to many partitions again
#: and again. 16 bytes a link; more links are shuffled.
FEW = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node that has a link, the smallest node it can reach.

    Each round hangs all neighbours of a node on the smallest one in sight, so stars shrink to
    one level in a logarithmic number of rounds. A round is two aggregations and two joins over
    the links, stored in the checkpoint folder; a hub's links are spread by the joins' other
    side being one row a node. A round over at most FEW links is one task without a shuffle.
    Links to itself and nulls are ignored. No links: no rows.
    """
    start = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, before = cut_lineage(start), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                edges.select("lo", "lo").distinct())
        before, few = state, state[0] <= FEW

        def one(df: DataFrame, few: bool = few) -> DataFrame:
            return df.coalesce(1) if few else df

        def with_least(df: DataFrame, few: bool = few) -> DataFrame:
            if few:
                return one(df).withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
            return df.join(df.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        large = (with_least(edges.union(edges.select("lo", "hi"))).where(F.col("lo") > F.col("hi"))
                 .select(F.col("lo").alias("hi"), F.least("hi", "m").alias("lo")).distinct())
        small = with_least(large)
        edges = cut_lineage(one(small.select("hi", F.col("m").alias("lo")).union(
            small.where(F.col("lo") != F.col("m")).select("lo", "m"))).distinct())
