"""Connected components of a table of links, by label passing with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.shared import Table, hot_keys, lookup


def components(links: DataFrame) -> Table:
    """links: a, b (long) -> a table of node and label, the smallest node that is reachable. No links give no rows.

    Each round a node takes the smallest label around it and then that label's own label, so paths shrink by half or
    more. Neighbours' labels are aggregated before they are shuffled, and hubs and large components are looked up by a
    bounded broadcast, so neither gathers in one task."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = Table(both, "edges")
    hubs = hot_keys(edges.df, "b")
    now = Table(edges.df.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        told = lookup(edges.df, "b", now.df.withColumnRenamed("node", "b"), hubs)
        lowest = told.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        met = Table(now.df.join(lowest, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("was")), "labels-met")
        jump = met.df.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = Table(lookup(met.df, "label", jump).select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), "labels")
        settled = new.df.where(F.col("label") != F.col("was")).isEmpty()
        now.drop()
        met.drop()
        now = new
        now.df = new.df.select("node", "label")
        if settled:
            edges.drop()
            return now
