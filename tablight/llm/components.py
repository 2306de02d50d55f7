"""Connected components by alternating large-star and small-star.

Edges are pairs of ids.  A large-star step links every neighbour above a node
to the smallest id in the node's neighbourhood; a small-star step does the same
for the neighbours below and the node itself.  The two alternate until the
edges are stars around the smallest id of each component.  Every step is a
grouped minimum (with map-side combining) and a join on the node; both sides of
the join are plain shuffles of written tables, so that Spark can split the rows
of a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablight.llm.common import Scratch


def _star(edges: DataFrame, small: bool, scratch: Scratch, name: str) -> DataFrame:
    """edges: (a, b) with a > b, distinct."""
    if small:
        # neighbours at or below the node; the node itself goes to the minimum too
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = scratch.save(least, f"{name}-min")
    both = near.join(least, "u")
    if small:
        out = both.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return scratch.save(out.where("a > b").distinct(), name)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """links (a, b) -> (id, component): every id that occurs in a link and the
    smallest id it is connected with."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .where("a > b").distinct(), f"{tag}-0")
    before, step = None, 0
    while (now := _state(edges)) != before:
        before, step = now, step + 1
        edges = _star(edges, False, scratch, f"{tag}-{step}-large")
        edges = _star(edges, True, scratch, f"{tag}-{step}-small")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    return scratch.save(found, f"{tag}-done")
