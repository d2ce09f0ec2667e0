"""Connected components of a link table by smallest labels and pointer jumping, on kept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop, keep


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b: long); root is the smallest node that can be reached.

    A round takes each node's smallest label among its neighbours, then that label's own label, so chains halve. Joins
    stand directly on kept tables, so that a hub's rows can be split among tasks; the minimum is combined before it is
    shuffled. An empty table gives an empty one.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select("v", "u")).union(both.select("u", "u")).union(both.select("v", "v")).distinct()
    edges = keep(both, "links")
    labels = keep(edges.groupBy("u").agg(F.min("v").alias("c")), "labels")
    total = None
    while True:
        near = keep(
            edges.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("c")), "near"
        )
        jump = near.select(F.col("u").alias("c"), F.col("c").alias("root"))
        new = keep(near.join(jump, "c").select("u", F.col("root").alias("c")), "labels")
        drop(labels, near)
        labels = new
        # Labels only fall, so an unchanged sum means unchanged labels.
        now = labels.agg(F.sum(F.col("c").cast("decimal(20,0)"))).first()[0]
        if now == total:
            drop(edges)
            return labels.select(F.col("u").alias("node"), F.col("c").alias("root"))
        total = now
