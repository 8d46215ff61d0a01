"""Register of queries and their SQL, and the reading of tables as the operators' inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def news(spark: SparkSession, d: str) -> DataFrame:
    """Documents as news: title is the first line, summary the whole text, region the language."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.get(F.split("text", "\n"), 0).alias("title"), F.col("text").alias("summary"), F.col("lang").alias("region"), "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.timestamp_add(
            "HOUR", -(F.col("doc_id") % 200).cast("int"), F.lit("2024-01-31").cast("timestamp")
        ).alias("published_ts"),
    )


NEWS = """news AS (SELECT doc_id AS id, doc_id AS pos, string_split(text, chr(10))[1] AS title, text AS summary, lang AS region, source,
  'https://' || source || '/' || CAST(doc_id AS VARCHAR) AS url, TIMESTAMP '2024-01-31' - to_hours(CAST(doc_id % 200 AS INT)) AS published_ts FROM documents)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Events as daily events: an event is a user, its phase the type of the day's rows, its risk from the value."""
    phase = F.create_map(*[F.lit(x) for kv in {
        "view": "diplomatic", "signup": "economic", "click": "sanction", "error": "military", "purchase": "financial"
    }.items() for x in kv])
    risk = F.least(F.lit(100), F.floor(F.col("value") / 5)).cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("event_id"), F.to_date("ts").alias("date"), F.struct("ts", "event_id").alias("pos"), F.element_at(phase, F.col("event_type")).alias("phase"), risk.alias("risk"),
        F.concat(F.lit("event "), F.col("event_type")).alias("title"), F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("summary"), F.when(risk >= 80, "S").when(risk >= 60, "A").when(risk >= 35, "B").otherwise("C").alias("signal_level"),
    )


DAILY = """ev AS (SELECT user_id AS event_id, CAST(ts AS DATE) AS date, ts, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'diplomatic' WHEN 'signup' THEN 'economic' WHEN 'click' THEN 'sanction' WHEN 'error' THEN 'military' ELSE 'financial' END AS phase,
  CAST(least(100, floor(value / 5)) AS INT) AS risk, 'event ' || event_type AS title, event_type || ' ' || props AS summary FROM events),
days AS (SELECT *, CASE WHEN risk >= 80 THEN 'S' WHEN risk >= 60 THEN 'A' WHEN risk >= 35 THEN 'B' ELSE 'C' END AS signal_level
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id, date ORDER BY ts DESC, seq DESC) AS rn FROM ev) WHERE rn = 1),
revs AS (SELECT event_id, date, phase, risk, title, summary, signal_level,
  coalesce(risk - lag(risk) OVER w, 0) AS risk_delta,
  CASE WHEN lag(phase) OVER w <> phase THEN lag(phase) OVER w || '→' || phase END AS phase_transition
  FROM days WINDOW w AS (PARTITION BY event_id ORDER BY date)),
heads AS (SELECT event_id, min(date) AS first_seen, max(date) AS last_seen, arg_min(title, date) AS canonical_title, arg_max(phase, date) AS phase,
  arg_max(risk, date) AS risk, max(risk) AS peak_risk,
  arg_max(signal_level, CASE signal_level WHEN 'S' THEN 4 WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END * 1000000 - date_diff('day', DATE '1970-01-01', date)) AS peak_signal,
  count(*) AS revisions, 'active' AS status FROM revs GROUP BY event_id)"""


def themes(spark: SparkSession, d: str) -> DataFrame:
    """Event types as themes, their mean risk of a day as the score."""
    return table(spark, d, "events").groupBy(
        F.col("event_type").alias("theme"), F.to_date("ts").alias("date")
    ).agg(F.floor(F.sum(F.least(F.lit(100), F.floor(F.col("value") / 5))) / F.count("*")).cast("int").alias("score"))


THEMES = """sc AS (SELECT event_type AS theme, CAST(ts AS DATE) AS date, CAST(floor(sum(least(100, floor(value / 5))) / count(*)) AS INT) AS score FROM events GROUP BY ALL)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem prices of brands by day and provider (odd and even suppliers)."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(
        F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("key"), (F.col("l_suppkey") % 2).cast("int").alias("provider")
    ).agg((F.floor(F.sum("l_extendedprice") / F.sum("l_quantity") * 100 + 1e-6) / 100).alias("price"))


PRICES = """px AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS key, CAST(l_suppkey % 2 AS INT) AS provider, floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 1e-6) / 100 AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as run records."""
    e, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(
        e.alias("run_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("variant"), v.alias("total_seconds"), (v * 100).alias("total_tokens"), (F.col("event_type") != "error").alias("json_valid"), (F.col("event_type") != "error").alias("json_parse_success"),
        (e % 50 != 0).alias("api_ok"), (e % 40 != 0).alias("html_valid"), (60 + e % 41).cast("double").alias("quality_score"), (60 + e % 41).cast("double").alias("score"), F.when(e % 3 == 0, 0.0).otherwise(v / 1000).alias("cost"), (v * 80).alias("input_tokens"), (v * 20).alias("output_tokens"),
        ((e % 10) / 10.0).alias("source_success_rate"), (e % 13).cast("int").alias("regions_covered"), (e % 12).cast("int").alias("h2_chapters"), (e % 3).cast("int").alias("placeholder_count"), (e % 4).cast("int").alias("vague_count"), ((e % 11) / 10.0).alias("citation_density"),
        (e % 5).cast("int").alias("s_level_count"), (e % 9).cast("int").alias("a_level_count"), (e % 7 == 0).alias("had_fallback"), (e % 6 == 0).alias("had_truncation"), (F.col("event_type") == "error").alias("had_parse_error"),
    )


RUNS = """rn AS (SELECT event_id AS run_id, CAST(ts AS DATE) AS date, event_type AS variant, value AS total_seconds, value * 100 AS total_tokens, event_type <> 'error' AS json_valid, event_type <> 'error' AS json_parse_success,
  event_id % 50 <> 0 AS api_ok, event_id % 40 <> 0 AS html_valid, CAST(60 + event_id % 41 AS DOUBLE) AS quality_score, CAST(60 + event_id % 41 AS DOUBLE) AS score, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value / 1000 END AS cost, value * 80 AS input_tokens, value * 20 AS output_tokens,
  (event_id % 10) / 10.0::DOUBLE AS source_success_rate, CAST(event_id % 13 AS INT) AS regions_covered, CAST(event_id % 12 AS INT) AS h2_chapters, CAST(event_id % 3 AS INT) AS placeholder_count, CAST(event_id % 4 AS INT) AS vague_count, (event_id % 11) / 10.0::DOUBLE AS citation_density,
  CAST(event_id % 5 AS INT) AS s_level_count, CAST(event_id % 9 AS INT) AS a_level_count, event_id % 7 = 0 AS had_fallback, event_id % 6 = 0 AS had_truncation, event_type = 'error' AS had_parse_error FROM events)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as news sources."""
    s = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("pos"),
        F.col("r_name").alias("region"), (1 + F.col("s_suppkey") % 10).alias("credibility"),
        (1 + F.col("s_suppkey") % 7).alias("signal_weight"), (1 + F.col("s_suppkey") % 2).alias("tier"),
        (F.col("s_suppkey") % 9 == 0).alias("experimental")
    )


SOURCES = """so AS (SELECT 'src' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey AS pos, r_name AS region, 1 + s_suppkey % 10 AS credibility, 1 + s_suppkey % 7 AS signal_weight, 1 + s_suppkey % 2 AS tier, s_suppkey % 9 = 0 AS experimental
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
