"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of ``a, b`` edges.

    Each round a node takes the least label among its own and its neighbours', and then that
    label's own label, so stars and chains close in few rounds. Minima are combined before the shuffle; no
    neighbourhood is gathered, and a hub's rows go through joins that Spark can split. Every round is written
    to the shared folder.
    """
    both = materialize(edges.select("a", "b").unionAll(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, labels["node"] == offered["a"]).select(
            "node", F.least("label", "offer").alias("next"), F.col("label").alias("old"))
        heads = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
        jumped = materialize(lower.join(heads, lower["next"] == heads["head"]).select(
            "node", F.least("next", "head_label").alias("label"), (F.least("next", "head_label") != F.col("old")).alias("moved")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
