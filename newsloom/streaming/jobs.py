"""Structured Streaming forms of the stateful operators. Each is event-time driven and restarts from its checkpoint."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from newsloom.functions import scalars as S
from newsloom.functions.scratch import stored
from newsloom.operators.events import build_revisions, event_heads
from newsloom.sources.sinks import write_dated

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedup(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """The first item of each normalized URL within delay of event time."""
    return stream.withColumn("url_hash", S.url_hash("url")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url_hash"])


def stream_daily(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """(date, event_type, n, total) of each day, once the watermark has passed it."""
    days = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return days.select(F.to_date("window.start").alias("date"), "event_type", "n", "total")


def upsert_batch(batch: DataFrame, path: str) -> None:
    """The last row of each event and day in batch and table; only the batch's days are rewritten. Idempotent."""
    spark = batch.sparkSession
    days = [r[0] for r in batch.select("date").distinct().collect()]
    if not days:
        return
    try:
        old = spark.read.schema(batch.schema).parquet(path).filter(F.col("date").isin(days))
    except Exception as missing:  # the first batch has no table yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        old = batch.limit(0)
    both = old.unionByName(batch)
    last = both.groupBy("event_id", "date").agg(F.max_by(
        F.struct(*[c for c in batch.columns if c not in ("event_id", "date")]), "pos"
    ).alias("_r")).select("event_id", "date", "_r.*")
    write_dated(stored(last, "upsert"), path)


def stream_upsert_events(stream: DataFrame, path: str, checkpoint: str):
    """A query that keeps path's (event_id, date) rows up to date; heads and revisions are read from it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_batch(batch, path)).trigger(availableNow=True).start()


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(n)).cast("int").alias("bucket")


def _known(spark: SparkSession, path: str, schema: StructType, buckets: list[int]) -> DataFrame:
    """Rows of the buckets of a table that may not be there yet."""
    try:
        return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path).filter(F.col("bucket").isin(buckets))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))


def _replace(df: DataFrame, path: str) -> None:
    """Rewrite the buckets that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_heads(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """Keep the rows (event_id, date, pos, ...) under path/rows and the heads of their revisions under path/heads.

    Both are dealt into buckets by event_id, a number fixed with the first batch. Of an event and day the row of the
    greatest pos counts. Only buckets that batch has events of are read and rewritten, rows before heads; in them heads are
    made anew for the batch's events from all their rows, and the others are taken over. A batch that comes again, in
    whole or after it broke off, leaves the same tables.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("bucket", _bucket(buckets))
    touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return
    names = [c for c in batch.columns if c not in ("event_id", "date", "bucket")]
    schema = StructType([f for f in batch.schema.fields if f.name != "bucket"])
    both = _known(spark, f"{path}/rows", schema, touched).unionByName(batch)
    last = both.groupBy("event_id", "date", "bucket").agg(F.max_by(F.struct(*names), "pos").alias("_r")).select("event_id", "date", "_r.*", "bucket")
    last = stored(last, "upsert-rows")
    _replace(last, f"{path}/rows")
    changed = stored(batch.select("event_id").distinct(), "upsert-events")
    new = event_heads(build_revisions(last.join(changed, "event_id", "left_semi").drop("bucket"))).withColumn("bucket", _bucket(buckets))
    old = _known(spark, f"{path}/heads", StructType([f for f in new.schema.fields if f.name != "bucket"]), touched)
    _replace(stored(old.join(changed, "event_id", "left_anti").unionByName(new), "upsert-heads"), f"{path}/heads")


def stream_heads(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """A query that keeps path's rows and heads up to date by upsert_heads()."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_heads(batch, path, buckets)).trigger(availableNow=True).start()


def current_revisions(rows: DataFrame) -> DataFrame:
    """Revisions with deltas from the kept rows."""
    return build_revisions(rows)


class _Evolution(StatefulProcessor):
    """The state of an event: what was before the last day seen, that day, and its last row."""

    def __init__(self, transitions: dict[tuple[str, str], int], half_life: float, archive_days: int):
        self.transitions, self.half_life, self.archive_days = transitions, half_life, archive_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("evolution", "phase string, risk int, seen long, moves int, day long, at long, now string")

    def moved(self, before: tuple, day: int, new: str) -> tuple:
        """State after a day with the phase new, from that before it."""
        phase, risk, seen, moves = before
        for idle in range(1, day - seen if phase is not None else 0):
            risk = int(risk * math.exp(-0.693 * idle / self.half_life))
        if phase is not None and new != phase:
            risk, moves = max(0, min(100, risk + self.transitions.get((phase, new), 0))), moves + 1
        return new, risk, day, moves

    def handleInputRows(self, key, rows, timerValues):
        *before, day, at, now = self.value.get() or (None, 0, 0, 0, -1, 0, None)
        whole = pd.concat(list(rows)).sort_values(["day", "micros"], kind="stable").drop_duplicates("day", keep="last")
        for d, t, phase in zip(whole.day, whole.micros, whole.phase, strict=True):
            if d > day:
                if now is not None:
                    before = self.moved(tuple(before), day, now)
                day, at, now = int(d), int(t), phase
            elif d == day and t >= at:
                at, now = int(t), phase
        self.value.update((*before, day, at, now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((day + self.archive_days) * 86_400_000, timerValues.getCurrentWatermarkInMs() + 1))
        phase, risk, seen, moves = self.moved(tuple(before), day, now)
        yield pd.DataFrame({"event_id": [key[0]], "phase": [phase], "risk": [risk], "last_day": [seen], "transitions": [moves], "status": ["active"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        *before, day, _, now = self.value.get()
        phase, risk, seen, moves = self.moved(tuple(before), day, now)
        self.value.clear()
        yield pd.DataFrame({"event_id": [key[0]], "phase": [phase], "risk": [risk], "last_day": [seen], "transitions": [moves], "status": ["archived"]})


def stream_evolution(
    stream: DataFrame, transitions: dict[tuple[str, str], int], half_life: float = 14, archive_days: int = 60, delay: str = "2 days"
) -> DataFrame:
    """(event_id, ts, phase) rows to the state of each event that a batch has rows of: (event_id, phase, risk, last_day,
    transitions, status).

    A new phase adds its transition's delta, idle days decay the risk as in the batch form, and days before the last one
    seen are over; rows behind the watermark are dropped. Of a day the last row by time counts, in whatever batches they
    come. When event time has passed the last day by archive_days, a timer gives the event's last state as archived and
    drops it; rows that come later begin a new one. State is kept in RocksDB, which the session is set to.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dated = stream.withWatermark("ts", delay).withColumns({"day": F.unix_date(F.to_date("ts")), "micros": F.unix_micros("ts")})
    return dated.groupBy("event_id").transformWithStateInPandas(
        _Evolution(transitions, half_life, archive_days), "event_id long, phase string, risk int, last_day long, transitions int, status string",
        "Update", "EventTime"
    )
