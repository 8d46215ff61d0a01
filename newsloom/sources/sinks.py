"""Sinks: dated reports, state tables with a version pointer, appends, snapshots, retention."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import scalars as S


def write_dated(df: DataFrame, path: str) -> None:
    """Replace the dates that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


class StateConflict(Exception):
    """Another writer has committed the version in the meantime."""


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _contents(df: DataFrame) -> dict:
    """Rows of df and the sum of their hashes, which no order of rows changes."""
    found = df.agg(F.count("*"), F.sum(F.xxhash64(F.struct("*")).cast("decimal(38,0)"))).first()
    return {"rows": found[0], "hashes": str(found[1])}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions in the log, newest first. The log has a small file for each."""
    files, log = _files(spark, f"{path}/log")
    if not files.exists(log):
        return []
    return sorted((int(m[1]) for s in files.listStatus(log) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))), reverse=True)


def write_state(df: DataFrame, path: str, version: int) -> None:
    """Commit df as this version of the state table.

    The rows go to a folder of their own and are read back; then the log gets its entry with the folder, the rows and their
    hashes. Of several writers of a version the first to make the entry wins, the others get StateConflict; a write that
    fails before leaves no entry. An entry is made whole under another name and renamed, which on HDFS and the like never
    replaces another. Columns of map type can't be hashed and raise an error.
    """
    spark, name = df.sparkSession, f"v={version:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    entry = {"version": version, "folder": name, "schema": df.schema.json()} | _contents(spark.read.schema(df.schema).parquet(f"{path}/{name}"))
    files, log = _files(spark, f"{path}/log")
    files.mkdirs(log)
    draft, final = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log/{n}") for n in (f"{name}.draft", f"{version:012d}.json"))
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if files.exists(final):
            raise StateConflict(f"version {version} of {path} is there already")
        try:
            won = files.rename(draft, final)  # doesn't replace a file
        except Exception as lost:
            raise StateConflict(f"version {version} of {path} is there already") from lost
        if not won or _entry(spark, path, version).get("folder") != name:
            raise StateConflict(f"version {version} of {path} is there already")
    finally:
        files.delete(draft, False)


def update_state(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Commit change(last whole version; None without one) as the next version, again on the newer one where another
    writer was first; the version committed."""
    for _ in range(tries):
        base = _last_whole(spark, path)
        version = max([0, *versions(spark, path)[:1]]) + 1
        try:
            write_state(change(base), path, version)
            return version
        except StateConflict:
            continue
    raise StateConflict(f"{tries} tries at {path} were all overtaken")


def _entry(spark: SparkSession, path: str, version: int) -> dict:
    """The log's entry; empty where it can't be read."""
    try:
        files, at = _files(spark, f"{path}/log/{version:012d}.json")
        stream = files.open(at)
        found = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        return found if isinstance(found, dict) else {}
    except (Py4JJavaError, ValueError):
        return {}


def _last_whole(spark: SparkSession, path: str) -> DataFrame | None:
    for version in versions(spark, path):
        entry = _entry(spark, path, version)
        try:
            df = spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{path}/{entry['folder']}")
            if _contents(df) == {k: entry[k] for k in ("rows", "hashes")}:
                return df
        except (KeyError, ValueError, Py4JJavaError, PySparkException):
            continue  # broken or missing: the version before it
    return None


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version whose rows are those that its entry names; broken and missing ones are passed over."""
    df = _last_whole(spark, path)
    if df is None:
        raise FileNotFoundError(f"no whole version of a state table in {path}")
    return df


def write_keyed(df: DataFrame, path: str, key: str, lookups: dict[str, int], partitions: int | None = None) -> None:
    """Df in the order of key, dealt by ranges of it, with bloom filters for the columns in lookups (column: distinct
    values that a file is expected to have). A filter on key skips files and row groups by their least and greatest keys, one
    on a lookup column by its bloom filter."""
    dealt = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    writer = dealt.sortWithinPartitions(key).write.mode("overwrite")
    for column, n in lookups.items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(n))
        # a dictionary would make the filter needless to the writer
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def append_runs(df: DataFrame, path: str) -> None:
    """A16."""
    df.write.mode("append").parquet(path)


def seen_snapshot(news: DataFrame) -> DataFrame:
    """Distinct hashes of normalized URLs."""
    return news.filter("url <> ''").select(S.url_hash("url").alias("url_hash")).distinct()


def backfill_counts(events_daily: DataFrame, days: int | None = None) -> DataFrame:
    """A18, dry run: dates, events and sources that a backfill would take; with days, of the newest dates only."""
    if days:
        newest = events_daily.select("date").distinct().orderBy(F.col("date").desc()).limit(days)
        events_daily = events_daily.join(F.broadcast(newest), "date", "left_semi")  # that many dates are broadcast
    return events_daily.agg(
        F.countDistinct("date").alias("dates"), F.count("*").alias("events"),
        F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("sources")
    )


def backfill(events_daily: DataFrame, path: str, days: int | None = None) -> DataFrame:
    """Write daily events (date, ...) by date, with days the newest dates only; the counts of what was written.

    A date that is backfilled again is replaced, so that the job can be repeated.
    """
    if days:
        newest = events_daily.select("date").distinct().orderBy(F.col("date").desc()).limit(days)
        events_daily = events_daily.join(newest, "date", "left_semi")
    write_dated(events_daily, path)
    return backfill_counts(events_daily.sparkSession.read.schema(events_daily.schema).parquet(path).join(events_daily.select("date").distinct(), "date", "left_semi"))


def retention(history: DataFrame, as_of: Column, archive_after: int = 30, delete_after: int = 180) -> DataFrame:
    """History with bucket full, archive or dropped, by age in days."""
    age = F.datediff(as_of, "date")
    return history.withColumn("bucket", F.when(age > delete_after, "dropped").when(age > archive_after, "archive").otherwise("full"))


def apply_retention(history: DataFrame, as_of: Column, path: str) -> None:
    """Write the full rows and the archive, without regions and excerpt."""
    aged = retention(history, as_of)
    write_dated(aged.filter("bucket = 'full'").drop("bucket"), f"{path}/full")
    write_dated(aged.filter("bucket = 'archive'").drop("bucket", "regions", "summary_excerpt"), f"{path}/archive")


def save_snapshot(df: DataFrame, path: str, name: str) -> None:
    """A20."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot={name}")


def load_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshot={name}")


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("snapshot").count()
