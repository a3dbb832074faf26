"""Connected components of a table of links, by labels that halve their way down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylint.sources.tables import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b); label is the smallest node reached. Every round is written to the shared folder."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(links.where("a != b").select(F.inline(ways)).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # the smaller label is told to the node that the old one names as well, so nodes of one label move together
        least, told = F.least("label", "near").alias("label"), labels.join(near, "node")
        told = told.select(F.inline(F.array(F.struct("node", least, F.col("label").alias("was")), F.struct(F.col("label").alias("node"), least, F.lit(None).cast("string").alias("was")))))
        lower = saved(told.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = saved(lower.join(up, "label").select("node", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("was")).alias("moved")))
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels
