"""Connected components by least labels and shortcuts, in rounds with written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import forget, narrow, stored

#: Fewer nodes than this are broadcast. A node may be a struct of texts, some 100 bytes, and a row has two.
NODES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached; edges: a, b of any orderable type, both directions meant.

    Each round gives a node the least label among its neighbours and itself, then the label of its label, so the number of rounds is
    about the logarithm of the longest way. A hub is no hot task: labels are least values, which Spark combines before it shuffles.
    Whether the labels are broadcast goes by their number, as their files are far smaller than what the driver would build of them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        told = narrow(labels, NODES)
        near = both.join(told.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hung = told.join(near, "node").select("node", "component", F.least("component", "near").alias("_to"))
        onward = told.select(F.col("node").alias("_to"), F.col("component").alias("_then"))
        moved = stored(hung.join(onward, "_to").select("node", F.least("_to", "_then").alias("component"), (F.least("_to", "_then") != F.col("component")).alias("_moved")), "labels")
        done = moved.where("_moved").isEmpty()
        forget(labels)
        labels = moved.drop("_moved")
        labels.stored_at = moved.stored_at
        if done:
            forget(both)
            return labels
