"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node), for every node of the edges.

    Each round takes the smallest label of the neighbours and then the label of that
    label, so paths halve; rounds end when no label changes. Minima are aggregated
    before the shuffle and a hot label is the many side of a join only.
    """
    both = cut(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .where("x <> y")
        .distinct()
    )
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("component"))
    labels = cut(labels)
    none = F.lit(None).cast(labels.schema["component"].dataType)
    while True:
        seen = both.join(labels, both["y"] == labels["node"]).select(F.col("x").alias("node"), "component", none.alias("old"))
        own = labels.select("node", "component", F.col("component").alias("old"))
        lowest = own.unionByName(seen).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        up = lowest.select(F.col("node").alias("via"), F.col("component").alias("up"))
        after = cut(
            lowest.join(up, lowest["component"] == up["via"]).select(
                "node", F.col("up").alias("component"), (F.col("up") != F.col("old")).alias("moved")
            )
        )
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            return labels
