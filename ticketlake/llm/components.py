"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label: the least node that each node of an edge can reach.

    Each round takes the least label among the neighbours and then the label of that label, so chains
    shorten by half; labels are pre-aggregated before each shuffle. Rounds are cut by written tables.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("offered"))
        offers = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("offered").alias("offered"))
        lower = labels.join(offers, "node").select("node", "label", F.least("label", "offered").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        after = saved(lower.join(jump, "lower", "left").select("node", F.col("label").alias("was"), F.least("lower", F.coalesce("further", "lower")).alias("label")))
        labels = after.select("node", "label")
        if after.where("was <> label").isEmpty():
            return labels
