"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b, long): component
    is the smallest id reachable.

    Each round hooks every root to its smallest neighbouring root, shortens the
    hooks by pointer jumping and contracts the edges; at least half of the roots
    with edges vanish in a round.  Every table is written to the shared folder.
    """
    pairs = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    label = materialise(ids.withColumn("component", F.col("id")), "cc-label")
    edges = materialise(pairs(edges), "cc-edges")
    while edges.take(1):
        hooks = (edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("p"))
                 .select("a", F.least("a", "p").alias("p")))
        hooks = materialise(hooks, "cc-hooks")
        while True:  # pointer jumping: every hook ends at a root
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = materialise(hooks.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "cc-jump")
            moved = jumped.where("moved").take(1)
            hooks = jumped.drop("moved")
            if not moved:
                break
        to = hooks.select(F.col("a").alias("component"), F.col("p").alias("root"))
        label = materialise(label.join(to, "component", "left")
                            .select("id", F.coalesce("root", "component").alias("component")), "cc-label")
        ends = (edges.join(hooks.select("a", F.col("p").alias("pa")), "a")
                .join(hooks.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b"))
        edges = materialise(pairs(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "cc-edges")
    return label
