"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest node reachable.

    Rounds of neighbour minima, each followed by a jump to the label of the label, so that
    the rounds follow the logarithm of a chain's length.  A hub's links meet its one label
    in a join that Spark can split, and minima combine before they move.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = materialise(both.union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("_r")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("_r").alias("_near"))
        )
        step = labels.join(near, "node").select(
            "node", F.least("root", "_near").alias("root"), F.col("root").alias("_was")
        )
        step = materialise(step, "step")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        new = step.join(jump, "root").select("node", F.col("_next").alias("root"), "_was")
        new = materialise(new, "labels")
        if new.where(F.col("root") != F.col("_was")).isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
