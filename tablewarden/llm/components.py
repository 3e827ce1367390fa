"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewarden.llm.durable import cut

# Edges for each task, so that rounds over few edges do not leave a file, and an event, for each of many empty partitions.
TASK_EDGES = 10_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the component's smallest node.

    Each round hangs all larger neighbours of a node on its smallest one, then does the same from
    below; the edges end as stars. A hub's edges are joined, never gathered, so that adaptive
    execution can split them. Rounds add no edges, so their tasks are counted once, by the edges.
    No edges: no rows. Nulls and loops are ignored.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    tasks = max(2, edges.count() // TASK_EDGES + 1)
    edges = edges.coalesce(tasks)
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    before = None
    while True:
        both = edges.select(F.inline(ends))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
