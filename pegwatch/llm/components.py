"""Connected components of links, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegwatch.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, family) for the nodes of the links (a, b): components named by their smallest node.

    Each round every node takes the smallest label among its own and its neighbours', then its label's label. Rounds grow
    with the logarithm of the longest path; each is written, so a lost executor re-reads one round. Minima are combined before
    they are sent; the label side has one row for each node, so a hub's links may be split over tasks.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("family")), "component-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("family").alias("near"))
        least = labels.join(seen, "node").select("node", F.col("family").alias("before"), F.least("family", "near").alias("family"))
        further = least.select(F.col("node").alias("family"), F.col("family").alias("further"))
        moved = cut(least.join(further, "family", "left").select("node", "before", F.least("family", "further").alias("family")), "component-labels")
        labels = moved.select("node", "family")
        if moved.where("family <> before").isEmpty():
            return labels
