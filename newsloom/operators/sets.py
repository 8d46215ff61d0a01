"""Sets of items as sorted numbers, rare items first, and bounds on what two sets have in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored


def signature(items: str, part: int = 0, parts: int = 1) -> Column:
    """64 bits of an array's items: each sets the bit that its hash names; with several parts, those of one of them."""
    one = F.lit(1).cast("long")

    def add(bits: Column, x: Column) -> Column:
        place = F.pmod(F.xxhash64(x), F.lit(64 * parts)).cast("int") - 64 * part
        here = place.between(0, 63) if parts > 1 else F.lit(True)
        return F.when(here, bits.bitwiseOR(F.call_function("shiftleft", one, place))).otherwise(bits)

    return F.aggregate(items, F.lit(0).cast("long"), add)


def most_common(na: str, nb: str, sa: str | list[str], sb: str | list[str]) -> Column:
    """At least as many as the items that two sets share, from their sizes and signatures: a bit that only one of them has
    stands for an item, or more, that only this one has."""
    sa, sb = ([x] if isinstance(x, str) else x for x in (sa, sb))
    alone = lambda xs, ys: reduce(lambda m, n: m + n, [
        F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) for x, y in zip(xs, ys, strict=True)
    ])
    return F.least(F.col(na) - alone(sa, sb), F.col(nb) - alone(sb, sa))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with an int column id: 0, 1, ... in the order of columns that tell all rows apart. Rows are dealt by ranges; a count
    of each range reaches the driver."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()}), "numbered")
    begins, total = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_k").alias("k")).orderBy("_p").collect():
        begins += [F.lit(r["_p"]), F.lit(total - r["k"]).cast("long")]
        total += r["n"]
    return rows.withColumn("id", (F.col("_k") + F.create_map(*begins)[F.col("_p")]).cast("int")).drop("_p", "_k")
