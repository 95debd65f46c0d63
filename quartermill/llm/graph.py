"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Cut, cut


def components(links: DataFrame) -> Cut:
    """node, label: the smallest node each linked node can reach.

    Each turn hooks every node to its smallest neighbour, follows these hooks twice, and
    rewrites the links between the new labels; links inside a label vanish. A turn costs
    shuffles in proportion to the links left, whatever a node's degree: minima are
    aggregated before they are shuffled, and joins are on nodes of a side without repeats.
    """
    live = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    labels = cut(live.df.select(F.col("a").alias("node")).union(live.df.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while live.df.limit(1).count():
        both = live.df.union(live.df.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        hooks = cut(hook, "hooks")
        for _ in range(2):
            jump = hooks.df.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            after = cut(hooks.df.join(jump, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")), "hooks")
            hooks.drop()
            hooks = after
        to = hooks.df.select(F.col("node").alias("label"), "to")
        moved = cut(labels.df.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = live.df.join(hooks.df.select(F.col("node").alias("a"), F.col("to").alias("u")), "a").join(hooks.df.select(F.col("node").alias("b"), F.col("to").alias("v")), "b")
        left = cut(ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct(), "links")
        for old in (live, labels, hooks):
            old.drop()
        live, labels = left, moved
    live.drop()
    return labels
