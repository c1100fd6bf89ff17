"""Connected components of an edge table, by alternating large and small stars.

Each round hangs the neighbours of a node on the smallest node among them; the edges shrink to
stars around the smallest node of each component. Nothing is collected: a round reads the
edges of the last one from a checkpoint, and the driver only sees their number and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logsmith.llm.common import with_checkpoint_dir


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: every larger neighbour of u hangs on the smallest of u's
    neighbours and u; small: u and its smaller neighbours hang on the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v, any order); the root is the
    smallest node of the component."""
    with_checkpoint_dir(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        now = _stars(_stars(now, large=True), large=False).checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
