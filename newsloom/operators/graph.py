"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scratch import discard_before, stored


PER_FILE = 250_000  # edges of a task that writes a round; the number of edges never grows


def _large_star(edges: DataFrame) -> DataFrame:
    """For each u, link its larger neighbours to the least of u and its neighbours; equal links may repeat."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """For each u, link u and its smaller neighbours to the least of them. Edges have u > v here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node with an edge; component is the least node that it reaches.

    Edges with a null end and loops are ignored. Each round is written to the shared folder; only a count and a
    checksum of a round's edges reach the driver, and the round before is deleted.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    table = f"components-{uuid.uuid4().hex}"
    e = stored(e, table)
    files = 1 + e.count() // PER_FILE
    last = None
    while True:
        e = discard_before(_small_star(_large_star(e)).coalesce(files), table)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
