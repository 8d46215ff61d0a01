"""Temporary views, so that the tables and what the operators make of them can be asked with spark.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators import events as E
from newsloom.plans.registry import daily, news, prices, runs, sources, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """View name -> table of the folder d, or rows that the operators make of them. Nothing runs before a view is asked."""
    revisions = E.build_revisions(daily(spark, d))
    made = {"news_items": news(spark, d), "news_sources": sources(spark, d), "event_revisions": revisions, "event_heads": E.event_heads(revisions), "run_records": runs(spark, d), "price_days": prices(spark, d)}
    return {name: table(spark, d, name) for name in TABLES} | made


def register(spark: SparkSession, d: str, prefix: str = "") -> list[str]:
    """Create or replace the views, their names after the prefix."""
    views = frames(spark, d)
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
