"""Connected components of a link table, without gathering links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (the least node of the component) for every node of the links ``a, b`` (longs).

    Each round takes the least label among the neighbours and then that label's own label, so a chain shortens by
    half; it ends when no label moves.
    """
    both = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = kept(labels.select("node", F.least("node", "least").alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "near").alias("next"))
        target = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        moved = kept(step.join(target, "next").select("node", "comp", F.least("next", "jump").alias("next")))
        labels = moved.select("node", F.col("next").alias("comp"))
        if moved.where("next < comp").isEmpty():
            return labels
