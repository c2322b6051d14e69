"""Connected components by minimum labels and pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterwise.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b); the root is the least node of its component.

    A round takes the least label among neighbours, then the label's own label, so paths
    shorten by half. Labels of neighbours are pre-aggregated before the exchange; a node with
    very many neighbours is one row per task. Nothing but two counts reaches the driver.
    """
    one_way = edges.where("a <> b").select("a", "b")
    links = materialise(one_way.union(one_way.select("b", "a")).distinct(), "links")
    labels = materialise(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "least").alias("step"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        found = materialise(
            lower.join(jump, F.col("step") == F.col("at"), "left").select(
                "node", F.least("step", F.coalesce("beyond", "step")).alias("root"), "old"
            ),
            "labels",
        )
        labels = found.select("node", "root")
        if found.where("root <> old").isEmpty():
            return labels
