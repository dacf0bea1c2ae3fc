"""Connected components of an edge table by alternating stars, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b: neighbours are tied to the smallest node that a node knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edge table (a, b): label is the smallest node of its component.

    Rounds go on until one changes nothing; alternating stars need about log n of them. Null ends are ignored.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialise(now, "edges"), None
    while (state := now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()) != before:
        if not state["n"]:
            break
        before, old = state, now
        now = materialise(_star(_star(now, large=True), large=False), "edges")
        discard(old)
    labels = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
