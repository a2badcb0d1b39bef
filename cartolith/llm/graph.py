"""Connected components of an undirected graph, by alternating large and small stars.

Each round is two minima (aggregated before the shuffle) and two joins; no node's neighbours are ever gathered, so a
hub of any degree is only a key of a join, whose partitions Spark can split. Rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.shared import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = edges.join(least, edges["a"] == least["u"])
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """A table of (node, label) of each node of edges (a, b), label the smallest node of its component, for all but the labels themselves."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "labels")
            discard(now)
            return out
        seen = state
        now, old = materialise(_star(_star(now, True), False), "edges"), now
        discard(old)
