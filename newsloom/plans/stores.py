"""Queries over what sinks and streams have written: each writes to a new folder of the shared one and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import views
from newsloom.functions import scalars as S
from newsloom.functions.scratch import shared_dir
from newsloom.operators import events as E
from newsloom.operators import search
from newsloom.plans.events import _EVOLVE, TRANSITIONS, _orders
from newsloom.plans.news import _URLS
from newsloom.plans.registry import DAILY, NEWS, RUNS, SOURCES, daily, query, runs, table
from newsloom.sources import scan, sinks
from newsloom.streaming import jobs


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """df as a stream: written as files, then read by a file source."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All rows that the stream gives until its input is used up; with mode complete, those of the last batch."""
    spark = stream.sparkSession
    out = folder(spark, name)
    kept = "overwrite" if mode == "complete" else "append"
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(kept).parquet(out))
    writer.option("checkpointLocation", folder(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# ---- sinks ----
@query("SELECT CAST(event_id AS VARCHAR) AS event_id, 'event ' || event_type AS title, CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-13' AND CAST(ts AS DATE) <= DATE '2024-01-20' AND event_id % 17 <> 0")
def a6_scan_events(spark, d):
    line = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("event "), "event_type").alias("title"),
        F.array("event_type").alias("actors")
    ))
    lines = table(spark, d, "events").select(
        F.when(F.col("event_id") % 17 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"), F.to_date("ts").alias("date")
    )
    path = folder(spark, "event-lines")
    lines.write.partitionBy("date").text(path)
    return scan.scan_events(spark, path, "2024-01-20", 7).select("event_id", "title", F.col("date").cast("date").alias("date"))


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n, round(sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 1 ELSE value END), 4) AS total FROM events GROUP BY 1")
def a14_write_dated(spark, d):
    rows, path = table(spark, d, "events").select(F.to_date("ts").alias("date"), "event_id", "value"), folder(spark, "dated")
    sinks.write_dated(rows, path)
    sinks.write_dated(rows.filter("date = '2024-01-10'").withColumn("value", F.lit(1.0)), path)
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {DAILY} SELECT event_id, risk + 1 AS risk FROM heads")
def a15_write_state(spark, d):
    heads, path = E.event_heads(E.build_revisions(daily(spark, d))).select("event_id", "risk"), folder(spark, "state")
    sinks.write_state(heads, path, 1)
    sinks.write_state(sinks.read_state(spark, path).withColumn("risk", F.col("risk") + 1), path, 2)
    return sinks.read_state(spark, path)


@query("WITH h AS (SELECT *, upper(replace(p_type, ' ', '_')) || '||' || upper(replace(p_name, ' ', '_')) || '|' AS k FROM part) SELECT p_partkey AS event_id, p_name AS canonical_title, k AS identity_key FROM h WHERE k = (SELECT k FROM h WHERE p_partkey = 7) OR p_partkey = 11")
def b13_stored_lookups(spark, d):
    key = S.identity_key(F.col("p_type"), F.array().cast("array<string>"), F.col("p_name"), F.lit(None).cast("string"))
    path = folder(spark, "keyed")
    heads = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("canonical_title"), key.alias("identity_key"))
    sinks.write_keyed(heads, path, "event_id", {"identity_key": 10_000})
    stored = spark.read.parquet(path)
    by_key = E.event_by_key(stored, E.event_by_id(stored, 7).first()["identity_key"])
    return by_key.unionByName(E.event_by_id(stored, 11).join(by_key.select("event_id"), "event_id", "left_anti"))


@query(f"WITH {RUNS} SELECT variant, count(*) AS n, round(avg(quality_score), 4) AS quality FROM rn GROUP BY variant")
def a16_append_runs(spark, d):
    r, path = runs(spark, d), folder(spark, "runs")
    for part in range(3):
        sinks.append_runs(r.filter(F.col("run_id") % 3 == part), path)
    return spark.read.parquet(path).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 4).alias("quality"))


@query("WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders), k AS (SELECT DISTINCT date FROM o ORDER BY date DESC LIMIT 30) SELECT count(DISTINCT date) AS dates, count(*) AS events, CAST(2 * count(*) AS BIGINT) AS sources FROM o WHERE date IN (SELECT date FROM k)")
def a18_backfill(spark, d):
    path = folder(spark, "backfill")
    sinks.backfill(_orders(spark, d), path, 30)
    return sinks.backfill(_orders(spark, d), path, 30)  # again: nothing is written twice


@query(f"WITH {SOURCES}, {NEWS} SELECT 'news' AS snapshot, count(*) AS \"count\" FROM news UNION ALL SELECT 'sources', count(*) FROM so")
def a20_snapshots(spark, d):
    path, views_ = folder(spark, "snapshots"), views.frames(spark, d)
    sinks.save_snapshot(views_["news_items"].select(F.col("id").cast("string").alias("name")), path, "news")
    sinks.save_snapshot(views_["news_sources"].select("name"), path, "sources")
    return sinks.list_snapshots(spark, path)


_FOUND = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
n AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda w: w = 'licensed' OR w = 'license')) AS f0, len(list_filter(ws, lambda w: starts_with(w, 'apach'))) AS f1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM n)"""


@query(f"""WITH {_FOUND} SELECT doc_id, round(ln(1 + (docs - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) + ln(1 + (docs - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)), 6) AS score
FROM n, s WHERE f0 > 0 AND f1 > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def c14_search_index(spark, d):
    path = folder(spark, "index")
    search.build_index(table(spark, d, "documents"), path)
    return search.search_index(spark, path, [["licensed", "license"], "apach*"], 20).withColumnRenamed("id", "doc_id")


@query(f"WITH {DAILY} SELECT event_id, 0.0::DOUBLE AS score, false AS ranked FROM heads WHERE contains(lower(canonical_title), 'nt pur') ORDER BY risk DESC, event_id LIMIT 50")
def c14_search_titles(spark, d):
    revs, path = E.build_revisions(daily(spark, d)), folder(spark, "event-index")
    heads = E.event_heads(revs)
    search.build_index(E.search_corpus(heads, revs), path, "event_id", ("canonical_title", "summary"))
    return search.search_events(spark, path, heads, ["Nt", "PUR"])  # no such words: titles that hold "nt pur"


@query("WITH r AS (SELECT CAST(ts AS DATE) AS date, round(avg(value) FILTER (WHERE event_type = 'view'), 4) AS u, round(avg(value) FILTER (WHERE event_type = 'click'), 4) AS g, round(avg(value) FILTER (WHERE event_type = 'error'), 4) AS j FROM events GROUP BY 1) SELECT date, round(u, 5) AS eurusd, round(u / g, 5) AS gbpusd, round(j / u, 2) AS usdjpy FROM r")
def a11_rates_from_files(spark, d):
    name = F.create_map(*[F.lit(x) for x in ("view", "USD", "click", "GBP", "error", "JPY", "signup", "", "purchase", "PUR")])
    rates = table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), name[F.col("event_type")].alias("currency")).agg(F.round(F.avg("value"), 4).alias("rate"))
    line = F.format_string('<Cube currency="%s" rate="%s"/>', "currency", F.when(F.col("currency") == "PUR", "n/a").otherwise(F.col("rate").cast("string")))
    days = rates.groupBy("date").agg(F.concat_ws("", F.collect_list(line)).alias("x"))  # a day has a handful of currencies
    page = F.format_string('<gesmes:Envelope xmlns:gesmes="http://www.gesmes.org/xml/2002-08-01"><Cube><Cube time="%s">%s</Cube></Cube></gesmes:Envelope>', F.col("date").cast("string"), "x")
    path = folder(spark, "rates")
    days.select("date", page.alias("value")).write.partitionBy("date").text(path)  # a file holds one envelope
    return scan.fx_cross_rates(scan.read_rates(spark, path))


@query(f"WITH {DAILY} SELECT event_id, first_seen, last_seen, phase, risk, peak_risk, canonical_title, revisions FROM heads")
def d9_heads_by_batches(spark, d):
    rows, path = daily(spark, d), folder(spark, "heads")
    for batch in (F.col("event_id") % 7 > 0, F.col("date") >= "2024-01-20", F.col("event_id") % 7 == 0, F.col("event_id") % 97 == 3):
        jobs.upsert_heads(rows.filter(batch), path, 16)
    return spark.read.parquet(f"{path}/heads").select("event_id", "first_seen", "last_seen", "phase", "risk", "peak_risk", "canonical_title", "revisions")


# ---- streams ----
@query(f"WITH {_URLS} SELECT DISTINCT md5(url) AS url_hash FROM nu")
def j1_stream_dedup(spark, d):
    pages = table(spark, d, "pages").select(
        "url", F.timestamp_add("HOUR", (F.col("page_id") % 40).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts")
    )
    return drained(jobs.stream_dedup(landed(pages, "pages"), "30 days"), "append", "seen").select("url_hash")


@query(f"WITH {DAILY} SELECT event_id, date, phase, risk, risk_delta FROM revs")
def j2_stream_upserts(spark, d):
    rows, out = daily(spark, d), folder(spark, "upserts")
    jobs.stream_upsert_events(landed(rows, "daily"), out, folder(spark, "upserts-checkpoint")).awaitTermination()
    kept = spark.read.schema(rows.schema).parquet(out)
    return jobs.current_revisions(kept).select("event_id", "date", "phase", "risk", "risk_delta")


@query(f"{_EVOLVE}, ends AS (SELECT event_id, max(date) AS day FROM days GROUP BY event_id) SELECT f.event_id, phase, risk, transitions, date_diff('day', DATE '1970-01-01', f.day) AS last_day FROM f JOIN ends ON f.event_id = ends.event_id AND f.day = ends.day")
def j3_stream_evolution(spark, d):
    rows = daily(spark, d).select("event_id", F.col("pos.ts").cast("timestamp").alias("ts"), "phase")
    out = drained(jobs.stream_evolution(landed(rows, "phases"), TRANSITIONS), "update", "evolution")
    last = out.groupBy("event_id").agg(F.max_by(
        F.struct("phase", "risk", "transitions", "last_day"), F.struct("last_day", "transitions")
    ).alias("s"))
    return last.select("event_id", "s.phase", "s.risk", "s.transitions", "s.last_day")


@query("SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def j4_stream_daily(spark, d):
    out = drained(
        jobs.stream_daily(landed(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "events")),
        "complete", "days"
    )
    return out.withColumn("total", F.round("total", 4))


@query(f"WITH {DAILY} SELECT event_id, date, phase, risk FROM revs")
def j5_upsert_batches(spark, d):
    rows, out = daily(spark, d), folder(spark, "batches")
    for part in (0, 1, 0):  # the first batch comes again
        jobs.upsert_batch(rows.filter(F.pmod(F.xxhash64("pos"), F.lit(2)) == part), out)
    return spark.read.schema(rows.schema).parquet(out).select("event_id", "date", "phase", "risk")


@query(f"WITH {NEWS}, {SOURCES}, {DAILY} SELECT n.region, count(*) AS items, count(credibility) AS rated, (SELECT max(peak_risk) FROM heads) AS peak FROM news AS n LEFT JOIN so ON n.source = so.name GROUP BY n.region")
def sql_views(spark, d):
    views.register(spark, d, "v_")
    return spark.sql("SELECT n.region, count(*) AS items, count(credibility) AS rated, (SELECT max(peak_risk) FROM v_event_heads) AS peak FROM v_news_items AS n LEFT JOIN v_news_sources AS s ON n.source = s.name GROUP BY n.region")
