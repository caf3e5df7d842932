"""Connected components by joins: labels go to neighbours and labels jump to their labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of links (a, b): comp is the smallest node that can be reached.

    Links with a null end are left out; repeated links, and links of a node with itself, change nothing. Without links
    the result is empty.

    Each round takes two joins and is written out; labels that point to labels halve the way in each round.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        best = labels.join(near, labels.node == near.a).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        to = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = cut(best.join(to, "comp", "left").select("node", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "old"))
        changed = step.filter("comp != old").limit(1).count()
        drop_cut(labels)
        labels = step.select("node", "comp")
        labels._cut_path = step._cut_path
        if not changed:
            drop_cut(edges)
            return labels
