"""Connected components of an edge table, by alternating large and small stars.

Each round sends every node's larger neighbours, then its smaller ones, to the smallest node it
knows. Rounds are written to the shared folder; only a checksum of the edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.sources import scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): every v that is larger (or smaller) than u is tied to the smallest node around u."""
    around = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    tied = around.join(least, "u")
    if large:
        moved = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge, with the smallest node of its component; the smallest itself is left out."""
    edges = scratch.stage(edges.where("u <> v").distinct(), "edges")
    before = None
    while True:
        edges = scratch.stage(_stars(_stars(edges, True), False), "edges")
        state = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state
