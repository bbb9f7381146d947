"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """node, root: for every node of ``links`` (src, dst: longs) the smallest node that it can reach.

    A step moves every node's neighbours to the smallest one among them. Minima are aggregates, so a hub is combined
    map-side, and they return to the links by a join that adaptive execution can split. Each round is written to the
    shared folder; only a count and a checksum come to the driver.
    """
    edges = links.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges = staged(edges, "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
        seen = now
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        lowest = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        # Large star: neighbours above a node move to its lowest neighbour.
        large = both.where(F.col("dst") > F.col("src")).join(lowest, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # Small star: neighbours below a node, and the node itself, move to its lowest neighbour.
        large = staged(large, "links")
        lowest = large.groupBy("src").agg(F.min("dst").alias("low"))
        moved = large.join(lowest, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        small = moved.unionByName(lowest.select("src", F.col("low").alias("dst"))).where(F.col("src") != F.col("dst")).distinct()
        edges = staged(small, "links")
