"""Connected components over edges of any number, in built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written

#: Into so many parts at most the rows of one node are dealt.
PARTS = 1024


def _told(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """``edges`` with the column m that ``least`` (node, m) holds for ``key``, null without one. The edges of a node are dealt
    over PARTS parts, and its one row of ``least`` goes only to the parts that there are, so no node is one key of many rows."""
    other = "b" if key == "a" else "a"
    dealt = edges.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("short"))
    asked = dealt.groupBy(F.col(key).alias("node"), "_part").agg(F.count("*").alias("_n")).select("node", "_part")
    known = asked.join(least, "node").select(F.col("node").alias(key), "_part", "m")
    return dealt.join(known, [key, "_part"], "left").drop("_part")


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), the component being its least node.

    Alternating large stars and small stars over edges that point from the larger node (a) to the smaller one (b); each
    round is written to the shared folder and the one before it removed. Nothing but one row a round comes to the driver.
    Edges with equal or null ends count for nothing; an empty table has no components.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    for _ in range(rounds):
        # of a node's neighbours the least, or itself: only its smaller neighbours matter
        least = written(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), f"{label}-least")
        # large star: every larger neighbour of a node is tied to the least of the node's surroundings
        large = written(_told(e, "b", least).select("a", F.coalesce("m", "b").alias("b")).distinct(), f"{label}-large")
        # small star: a node's smaller neighbours, and itself, are tied to the least of them
        nearest = written(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), f"{label}-nearest")
        small = _told(large, "a", nearest).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = written(small.unionByName(nearest.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), label)
        forget(e, least, large, nearest)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: the rounds did not suffice")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
