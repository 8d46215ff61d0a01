"""Ordered operators over range partitions, for keys that hold any share of the rows.

Rows are sorted by (key, order) and dealt by ranges, so that a key may lie in many partitions. The place of a row in its key
is its place among the key's rows of its partition, and the key's rows in the partitions before, which are summed up apart:
a row for each partition and key. Windows of neighbours are made in chunks of a key's places, and the rows that a chunk's
neighbours need are handed to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored

CHUNK = 10_000  # rows of a key that one task orders


def numbered(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """df with _i (1, 2, ... in the order of each key; ties in any order) and _n (rows of the key). A null key is a key."""
    by = [key, *order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    # written, so that the ranges stay as they are; the ranges follow the order, whatever they hold
    rows = stored(dealt.withColumn("_part", F.spark_partition_id()), f"ordered-{uuid.uuid4().hex}")
    counts = rows.groupBy(key, "_part").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select(
        F.col(key).alias("_key"), "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(key)).alias("_n")
    )
    local = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)))
    both = local.join(counts, (local["_part"] == counts["_part"]) & F.col(key).eqNullSafe(F.col("_key")))
    return both.drop("_part", "_key").withColumn("_i", F.col("_i") + F.col("_before")).drop("_before")


def following(df: DataFrame, key: str, order: list[str], column: str, span: int, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """df with _next: column's values in the next span rows of the key, in order; nulls are left out.

    A key is cut into chunks of at least span rows; the first span rows of a chunk also go to the chunk before.
    """
    chunk = max(chunk, span)
    rows = numbered(df, key, order, partitions).drop("_n")
    own = rows.withColumn("_chunk", F.floor((F.col("_i") - 1) / chunk))
    halo = own.filter((F.pmod(F.col("_i") - 1, F.lit(chunk)) < span) & (F.col("_chunk") > 0)).withColumn("_chunk", F.col("_chunk") - 1)
    both = own.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    near = Window.partitionBy(key, "_chunk").orderBy("_i").rowsBetween(1, span)
    return both.withColumn("_next", F.collect_list(column).over(near)).filter("_own").drop("_own", "_chunk", "_i")
