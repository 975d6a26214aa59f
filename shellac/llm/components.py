"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm.common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """Components of links (a, b longs): node, component (its smallest node), for every node that has a link.

    Each round takes the smallest label among the neighbours, then the label of that label, so a chain shortens by
    halves. Tables are written between rounds; a hub's neighbours are summed up before the shuffle. Null ends and links to
    itself are left out; repeated links do no harm; no links give no rows.
    """
    both = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")  # the links are made once
    edges = materialise(both.select(ends).select("e.a", "e.b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = lower.join(labels.select(F.col("node").alias("mid"), F.col("component").alias("far")), "mid")
        after = materialise(jump.select("node", "old", F.least("mid", "far").alias("component")), "labels")
        changed = after.where("component < old").limit(1).count()
        discard(labels)
        labels = after.select("node", "component")
        if not changed:
            discard(edges)
            return labels
