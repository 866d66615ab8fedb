"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import staged


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for the columns a and b of ``edges``, a written table.

    Every round each node takes the smallest label among its neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of the longest path. Each round is written, joins are between written tables, which
    adaptive execution splits where one node has most edges, and minima are taken before the shuffle.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).select("a", "label").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        near = staged(near, "labels")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = staged(near.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("was <> label").head(1):
            return labels
