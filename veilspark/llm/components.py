"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

MAX_ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        around = both.unionByName(turned)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of a link; ``links`` has columns a and b, the component is its smallest node.

    Each round is one aggregation and one join on the nodes; its result is a
    table in the shared folder, so lineage doesn't grow and lost executors
    cost a round at most.  Rows whose ends are equal or null are left out, an
    empty table gives an empty one, chains of any length settle in a number of
    rounds that grows with their length's logarithm.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())
    edges = stored(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        now = mark(edges)
        if now == before or not now[0]:
            break
        before = now
        old, edges = edges, stored(_star(_star(edges, large=True), large=False), "stars")
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
