"""Connected components by labels that sink and jump.

Every node begins with its own number; in each round it takes the smallest label
of its neighbours, and then the label of its label, which halves the way to
the smallest number each time.  A round is an equi-join and a minimum that is
combined before it is shuffled; tables cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.sinks import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one type, either way round.  node, root: root is the
    smallest node of the component; null ends and loops join nothing."""
    one = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "graph-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        sunk = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        above = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = cut(sunk.join(above, F.col("low") == F.col("up"), "left").select("node", F.least("low", F.coalesce("top", "low")).alias("root"), "was"), "graph-labels")
        labels = jumped.select("node", "root")
        if jumped.where("root <> was").isEmpty():
            return labels
