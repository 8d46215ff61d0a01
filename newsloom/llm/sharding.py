"""Operator 3: uniform random sharding by a two-pass external shuffle, DataFrame functions only.

Pass one scatters whole records into buckets of bounded bytes by a seeded hash of their content: one shuffle, and the
same buckets however the input is split. Of a record whose copies have more bytes together than a SHARE of a bucket, each
copy is scattered by its number, so that no repeated row fills a bucket. Pass two puts the records of a bucket in a fixed order, permutes
them with a seeded Fisher-Yates shuffle, deals the permuted sequence of all buckets to the shards in turn and writes
the bucket's part of each shard, from the task that holds the bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import shared_dir, stored

BUCKET_BYTES = 32 << 20
SHARE = 1 / 32  # of a bucket's bytes, from which the copies of a record are scattered one by one
FILL = 2 / 3  # of a bucket's bytes that it has on average
GROUP = 4096  # buckets whose offsets one task sums up


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _bucket(n_buckets: int, seed: int, copy: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("_content"), copy), F.lit(n_buckets)).cast("int")


def scatter(records: DataFrame, keys: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """(_bucket, _record): every record with its bucket; keys has _content, its copies _n and whether they are scattered, _many."""
    whole = records.select(_content(records, seed), F.struct(*_columns(records)).alias("_record"))
    hot = stored(keys.filter("_many").select("_content"), "shard-repeats")  # written, so that its size is known
    plain = whole.join(hot, "_content", "left_anti").select(_bucket(n_buckets, seed, F.lit(0)).alias("_bucket"), "_record")
    many = whole.join(hot, "_content", "left_semi").groupBy("_content", "_record").agg(F.count("*").alias("_n"))
    many = many.select("_content", "_record", F.explode(F.sequence(F.lit(1), "_n")).alias("_copy"))
    return plain.unionByName(many.select(_bucket(n_buckets, seed, F.col("_copy").cast("int")).alias("_bucket"), "_record"))


def _content(records: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *_columns(records)).alias("_content")


def _columns(records: DataFrame) -> list[Column]:
    """Also those with a dot in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in records.columns]


def offsets(keys: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """(_bucket, _offset): the records in buckets before each; groups of buckets are summed apart and then in turn."""
    one = keys.select(
        "_content",
        F.when(F.col("_many"), F.sequence(F.lit(1).cast("long"), "_n")).otherwise(F.array(F.lit(0).cast("long"))).alias("_copies"),
        F.when(F.col("_many"), 1).otherwise(F.col("_n")).alias("_n")
    )
    one = one.select("_content", F.explode("_copies").alias("_copy"), "_n")
    sizes = one.groupBy(_bucket(n_buckets, seed, F.col("_copy").cast("int")).alias("_bucket")).agg(F.sum("_n").alias("_n"))
    sizes = stored(sizes.withColumn("_group", F.floor(F.col("_bucket") / GROUP)), "shard-sizes")
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("_group", upto(Window.orderBy("_group")).alias("_before"))  # a row for GROUP buckets, some hundreds at 100 TB
    inner = sizes.select("_bucket", "_group", upto(Window.partitionBy("_group").orderBy("_bucket")).alias("_within"))
    return inner.join(groups, "_group").select("_bucket", (F.col("_within") + F.col("_before")).alias("_offset"))


def shuffle_buckets(scattered: DataFrame, at: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """Pass two: (_record, _position), the 0-based place in the permuted sequence of all buckets.

    A bucket's offset travels to it as one more row of the same shuffle.
    """
    rows = scattered.withColumn("_offset", F.lit(None).cast("long"))
    marks = at.select("_bucket", F.lit(None).cast(scattered.schema["_record"].dataType).alias("_record"), "_offset")
    sent = rows.unionByName(marks).repartitionById(n_buckets, F.col("_bucket"))
    whole = sent.groupBy("_bucket").agg(F.max("_offset").alias("_offset"), F.sort_array(F.collect_list("_record")).alias("_all"))
    dealt = whole.select("_offset", F.posexplode(F.shuffle("_all", F.lit(seed))).alias("_index", "_record"))
    return dealt.select("_record", (F.col("_index") + F.col("_offset")).alias("_position"))


def shard(records: DataFrame, n_shards: int = 16, seed: int = 20240131, size: Column | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """records with shard (0 to n_shards - 1) and slot (0, 1, ... in each shard), in uniformly random order.

    size is a record's bytes (default: those of its column text). Buckets have bucket_bytes at most, but for the chance of
    the scatter and for a record that is larger itself. Shards differ by at most one row. The same seed and
    rows give the same order, however they are split or ordered. Nulls in any column, equal rows and empty texts are
    ordinary records; every row is dealt once. An empty table gives an empty result. Columns of records named shard or
    slot are replaced. Columns of map type can't be put in order and raise an error.
    """
    records = records.drop(*[c for c in records.columns if c.lower() in ("shard", "slot")])
    keys = records.select(_content(records, seed), (text_size() if size is None else size).alias("_size"))
    keys = stored(keys.groupBy("_content").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes")), "shard-keys")
    total = keys.agg(F.sum("_bytes")).first()[0] or 0
    n_buckets = max(n_shards, int(total / (bucket_bytes * FILL)) + 1)
    keys = keys.withColumn("_many", (F.col("_n") > 1) & (F.col("_bytes") > bucket_bytes * SHARE))
    dealt = shuffle_buckets(scatter(records, keys, n_buckets, seed), offsets(keys, n_buckets, seed), n_buckets, seed)
    place = F.col("_position")
    return dealt.select("_record.*", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write shard=<n> folders: a file for each bucket, its rows in slot order. Nothing is moved between tasks."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_back(sharded: DataFrame) -> DataFrame:
    """sharded as its files in the shared folder hold it."""
    path = f"{shared_dir(sharded.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)
