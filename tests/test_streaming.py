"""Streaming forms against the batch results."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.streaming import jobs

DAY = dt.date(2024, 1, 1)


def drained(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_dedup_and_daily(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + k // 4, k % 24), f"https://h.org/p{k % 5}?utm_source=s{k}", "view", 1.0) for k in range(24)]
    spark.createDataFrame(rows, "ts timestamp, url string, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, url string, event_type string, value double").parquet(str(tmp_path / "in"))
    drained(jobs.stream_dedup(stream, "30 days").writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert spark.table("dedup").count() == 5
    drained(jobs.stream_daily(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert {r.date: r.n for r in spark.table("daily").collect()} == {DAY + dt.timedelta(k): 4 for k in range(6)}


def test_upsert(spark, tmp_path):
    schema = "event_id long, date date, pos long, phase string, risk int, summary string"
    out = str(tmp_path / "out")
    for k in range(2):
        rows = [(e, DAY + dt.timedelta(d), 10 * k + d, "p", e + k, "s") for e in range(3) for d in range(k, k + 2)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_upsert_events(stream, out, str(tmp_path / "c")).awaitTermination()
    kept = spark.read.schema(schema).parquet(out)
    assert kept.count() == 9 and {r.risk - r.event_id for r in kept.filter(F.col("date") == DAY + dt.timedelta(1)).collect()} == {1}
    jobs.upsert_batch(kept.limit(100), out)  # the same rows again
    assert spark.read.parquet(out).count() == 9
    assert jobs.current_revisions(spark.read.schema(schema).parquet(out)).count() == 9


def test_evolution(spark, tmp_path):
    from newsloom.operators.risk import evolve

    rows = [(e, k, "ab"[(k // (e + 1)) % 2]) for e in range(3) for k in (0, 1, 3, 8)]
    schema = "event_id long, ts timestamp, phase string"
    stamped = [(e, dt.datetime(2024, 1, 1 + k, 5), p) for e, k, p in rows]
    spark.createDataFrame(stamped, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    states = jobs.stream_evolution(stream, {("a", "b"): 60, ("b", "a"): 7}).writeStream.format("memory").queryName("evolution").outputMode("update")
    states.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    days = spark.createDataFrame([(e, DAY + dt.timedelta(k), p) for e, k, p in rows], "event_id long, date date, phase string")
    for e in range(3):
        batch = evolve(days.filter(F.col("event_id") == e), {("a", "b"): 60, ("b", "a"): 7}, F.lit(DAY + dt.timedelta(8))).first()
        got = spark.table("evolution").filter(F.col("event_id") == e).first()
        assert (got.risk, got.phase) == (batch.risk, batch.phase)


def test_evolution_takes_the_last_row_of_a_day(spark, tmp_path):
    schema = "event_id long, ts timestamp, phase string"
    for n, phase in enumerate("aba"):  # one day in three batches
        spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5 + n), phase)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        states = jobs.stream_evolution(stream, {("a", "b"): 60, ("b", "a"): 7}).writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update")
        states.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.phase, r.risk, r.transitions) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("a", 0, 0), ("a", 0, 0), ("b", 0, 0)]


def states(spark, tmp_path, rows):
    """Adds the rows to the stream's folder, runs it to the end from its checkpoint, and gives the states of that run."""
    schema = "event_id long, ts timestamp, phase string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = str(tmp_path / f"out{len(list(tmp_path.iterdir()))}")
    out = jobs.stream_evolution(stream, {("a", "b"): 60, ("b", "a"): 7}, archive_days=10, delay="2 days")
    out.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(run)).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    return sorted((r.event_id, r.phase, r.risk, r.status) for r in spark.read.schema(out.schema).parquet(run).collect())


def test_evolution_timers_late_rows_and_restart(spark, tmp_path):
    at = lambda day, hour=5: dt.datetime(2024, 1, 1, hour) + dt.timedelta(day)
    assert states(spark, tmp_path, [(1, at(0), "a"), (2, at(0), "a")]) == [(1, "a", 0, "active"), (2, "a", 0, "active")]
    assert states(spark, tmp_path, [(1, at(4), "b")]) == [(1, "b", 60, "active")]  # restarted: the state is there
    assert states(spark, tmp_path, [(2, at(1), "b"), (1, at(4, 7), "a")]) == [(1, "a", 0, "active")]  # event 2's row is behind the watermark
    got = states(spark, tmp_path, [(3, at(40), "b")])  # event time passes the idle time of 1 and 2
    assert (3, "b", 0, "active") in got and {x for x in got if x[0] < 3} == {(1, "a", 0, "archived"), (2, "a", 0, "archived")}
    assert states(spark, tmp_path, [(1, at(41), "b")]) == [(1, "b", 0, "active")]  # begins anew
