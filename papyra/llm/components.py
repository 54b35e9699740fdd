"""Connected components of links, by joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of links (a, b: long), written.

    Each round a node takes the least label of its neighbours and then the label of that label; rounds end when no
    label changes, which takes few rounds for stars and about the logarithm of a chain's length. A node with many
    links costs one row a task in the aggregates, and Spark can split it in the joins, whose sides are both
    read from tables. No links give no rows; self links and repeated ones do no harm.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).select(F.col("a").alias("node"), "component"), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        own = label.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = label.select(F.col("node").alias("at"), F.col("component").alias("further"))
        after = written(own.join(jump, F.col("new") == F.col("at"), "left").select("node", "old", F.least("new", F.coalesce("further", "new")).alias("component")), "labels")
        label = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return label
