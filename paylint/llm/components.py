"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the smallest node that links reach.

    Each round takes the least label among a node's neighbours, then the label's own
    label, so long chains shrink by doubling; every round is written to the shared
    folder.  Aggregation combines before it shuffles; a hub's rows are joined by
    shuffle, where adaptive execution splits them.
    """
    both = saved(links.union(links.select("b", "a")).where("a != b").distinct(), "both")
    state = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = saved(state.join(near, "node").select("node", F.least("label", "near").alias("new"), "label"), "lower")
        up = lower.select(F.col("node").alias("new"), F.col("new").alias("up"))
        after = saved(lower.join(up, "new").select("node", F.least("new", "up").alias("label"), (F.least("new", "up") != F.col("label")).alias("moved")), "labels")
        dropped(lower)
        dropped(state)
        state = after.select("node", "label")
        if after.where("moved").isEmpty():
            dropped(both)
            return state
