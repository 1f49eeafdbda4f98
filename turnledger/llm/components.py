"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.frames import pin


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "node")
    return (
        both.where("b > a")
        .join(least, F.col("a") == F.col("node"))
        .select(F.col("least").alias("a"), "b")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least"))
    smaller = links.join(least, F.col("b") == F.col("node")).where("a <> least").select("least", "a")
    return smaller.union(least.select("least", "node")).toDF("a", "b").distinct()


def _unsettled(links: DataFrame) -> DataFrame:
    """Nodes that keep the links from being stars around their least nodes."""
    ends = links.select(F.col("b").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(
        links.select("a", F.lit(0), F.lit(1))
    )
    return ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where(
        "above > 1 OR (above = 1 AND below = 1)"
    )


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of the links ``a, b``; the label is the least node.

    Large and small stars alternate until every component is one star around its least node.
    Neither makes more links than it is given, and the number of rounds grows with the
    logarithm of the nodes, long chains included; so there is no limit of rounds. Links are
    written every round; no more than one row reaches the driver.
    """
    alone = links.where("a = b").select("a").distinct()
    found = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = pin(found, "stars")
    while _unsettled(found).take(1):
        found = pin(_small_star(pin(_large_star(found), "stars-large")), "stars")
    labels = found.select(F.col("b").alias("node"), F.col("a").alias("label"))
    roots = found.select("a").union(alone).distinct()
    return labels.union(
        roots.join(labels.select("node"), F.col("a") == F.col("node"), "left_anti").select("a", F.col("a").alias("label"))
    )
