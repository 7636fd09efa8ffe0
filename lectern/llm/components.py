"""Connected components of an edge table, by alternating stars.

Large-star hangs a node's larger neighbours on its smallest; small-star does
so with its smaller ones.  Each round is a minimum by node, which is combined
before it is shuffled, and a join back; rounds go on until the edges stay the
same.  Nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut


def print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs, either way round.  Returns (node, root): root is
    the smallest node of the component; nodes without edges are not listed."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = cut(now, "stars")
    mark = print_of(now)
    while mark[0]:
        # large-star: every neighbour larger than the node moves to the node's smallest
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: the node and its smaller neighbours move to the smallest; all b are smaller than a here
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = cut(small, "stars")
        after = print_of(small)
        now = small
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
