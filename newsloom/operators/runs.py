"""Run records: release gate, trends, costs, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import scalars as S
from newsloom.operators.ordered import numbered

#: check -> (column, kind of figure, at least or below, bound)
GATE = {
    "api": ("api_ok", "pct", ">=", 99.0), "json": ("json_valid", "pct", ">=", 100.0), "html": ("html_valid", "pct", ">=", 100.0),
    "quality": ("quality_score", "mean", ">=", 85.0), "latency_cv": ("total_seconds", "cv", "<", 30.0), "token_cv": ("total_tokens", "cv", "<", 30.0),
}


def release_gate(runs: DataFrame, as_of: Column, days: int = 14, least: int | None = None, gate: dict = GATE) -> DataFrame:
    """A row for each check over the last days and one for all: (check, value, passed)."""
    recent = runs.filter((F.col("date") > F.date_sub(as_of, days)) & (F.col("date") <= as_of))
    figure = {
        "pct": lambda c: F.avg(F.col(c).cast("double")) * 100, "mean": lambda c: F.avg(c),
        "cv": lambda c: F.try_divide(F.stddev_pop(c), F.avg(c)) * 100
    }
    one = recent.agg(F.count("*").alias("_n"), *[figure[kind](c).alias(name) for name, (c, kind, _, _) in gate.items()])
    ok = lambda name: F.coalesce(F.col(name) >= gate[name][3] if gate[name][2] == ">=" else F.col(name) < gate[name][3], F.lit(False))
    enough = F.col("_n") >= (least or days)
    whole = enough
    for name in gate:
        whole = whole & ok(name)
    rows = [F.struct(
        F.lit("records").alias("check"), F.col("_n").cast("double").alias("value"), enough.alias("passed")
    )] + [F.struct(F.lit(n).alias("check"), F.round(n, 4).alias("value"), ok(n).alias("passed")) for n in gate] + [F.struct(
        F.lit("all").alias("check"), F.lit(None).cast("double").alias("value"), whole.alias("passed")
    )]
    return one.select(F.inline(F.array(*rows)))


def ops_trend(runs: DataFrame) -> DataFrame:
    """One row of total, mean and monthly cost, mean latency, source rate and quality."""
    out = runs.agg(
        F.sum("cost").alias("total_cost"), F.avg("cost").alias("mean_cost"), F.avg("total_seconds").alias("mean_latency"),
        F.avg("source_success_rate").alias("source_rate"), F.avg("quality_score").alias("quality")
    )
    return out.select(
        F.round("total_cost", 4).alias("total_cost"), F.round("mean_cost", 4).alias("mean_cost"),
        F.round(F.col("mean_cost") * 30, 4).alias("monthly_cost"), F.round("mean_latency", 4).alias("mean_latency"),
        F.round("source_rate", 4).alias("source_rate"), F.round("quality", 4).alias("quality")
    )


def metric_trend(runs: DataFrame, metric: str, group: str, least: int = 3) -> DataFrame:
    """Of each group, ascending by date and run: mean, change of the second half against the first in %, label. A group
    may be spread over any number of tasks."""
    rows = numbered(runs.filter(F.col(metric).isNotNull()).select(group, "date", "run_id", metric), group, ["date", "run_id"])
    half = F.floor(F.col("_n") / 2)
    a, b = F.avg(F.when(F.col("_i") <= half, F.col(metric))), F.avg(F.when(F.col("_i") > half, F.col(metric)))
    out = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(metric), 4).alias("mean"),
        F.round((b - a) / F.greatest(a, F.lit(0.01)) * 100, 4).alias("change_pct")
    ).filter(F.col("n") >= least)
    return out.withColumn("trend", F.when(F.col("change_pct") > 5, "improving").when(F.col("change_pct") < -5, "degrading").otherwise("stable"))


def cost_trend(runs: DataFrame, price_in: float = 0.27, price_out: float = 1.10) -> DataFrame:
    """Mean and monthly cost; where no cost is stored, tokens times prices of a million."""
    cost = F.coalesce(F.nullif("cost", F.lit(0.0)), (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6)
    return runs.agg(F.avg(cost).alias("_m")).select(F.round("_m", 6).alias("daily_mean"), F.round(F.col("_m") * 30, 6).alias("monthly"))


def run_facts(structured: DataFrame) -> DataFrame:
    """Of each run: events, regions, S and A events, citations and citations for each event."""
    out = structured.groupBy("run_id").agg(
        F.count("*").alias("events"), F.countDistinct("region").alias("regions"),
        F.count_if(F.col("signal_level") == "S").alias("s_events"), F.count_if(F.col("signal_level") == "A").alias("a_events"),
        F.sum(F.size("citations")).alias("citations")
    )
    return out.withColumn("citation_density", F.round(F.col("citations") / F.col("events"), 4))


def quality_scores(runs: DataFrame) -> DataFrame:
    """H14."""
    return runs.withColumn("quality_score", S.run_quality())


def benchmark_scores(runs: DataFrame) -> DataFrame:
    """Part scores, their sum with one digit and the grade."""
    parts = S.benchmark_subscores()
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    return runs.withColumn("_t", total).withColumns({k: F.round(p, 1) for k, p in parts.items()} | {
        "total_score": F.round("_t", 1), "grade": S.grade(F.col("_t"))
    }).drop("_t")


def compare_variants(runs: DataFrame, a: str, b: str, drop: float = 5) -> DataFrame:
    """Of each date the last run of both variants: scores, delta, regression where b is more than drop below a."""
    last = runs.withColumn("_rn", F.row_number().over(Window.partitionBy("date", "variant").orderBy(F.col("run_id").desc()))).filter("_rn = 1")
    wide = last.groupBy("date").pivot("variant", [a, b]).agg(F.first("score")).select("date", F.col(a).alias("score_a"), F.col(b).alias("score_b"))
    wide = wide.filter("score_a is not null and score_b is not null").withColumn("delta", F.round(F.col("score_b") - F.col("score_a"), 4))
    return wide.withColumns({
        "regression": F.col("delta") < -drop, "winner": F.when(F.col("delta") > 0, b).when(F.col("delta") < 0, a).otherwise("tie")
    })


def version_regression(scores: DataFrame, threshold: float = 3) -> DataFrame:
    """(prompt, version, score): change from the version before and whether it fell by more than threshold."""
    change = F.col("score") - F.lag("score").over(Window.partitionBy("prompt").orderBy("version"))
    return scores.withColumn("change", F.round(change, 4)).withColumn("regression", F.coalesce(F.col("change") < -threshold, F.lit(False)))
