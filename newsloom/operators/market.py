"""Market operators: provider merge, cross-validation, changes, anomalies, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import scalars as S


def merge_providers(quotes: DataFrame) -> DataFrame:
    """Of each date and key the row of the provider with the least priority number."""
    return quotes.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("date", "key").orderBy("priority", "provider"))
    ).filter("_rn = 1").drop("_rn")


def cross_validate(primary: DataFrame, second: DataFrame, tolerance: DataFrame, default: float = 1.0) -> DataFrame:
    """Primary (date, key, price) against a second provider: verified with two sources, else disputed; where the
    second has nothing, single."""
    other = second.select("date", "key", F.col("price").alias("price_2"))
    out = primary.join(other, ["date", "key"], "left").join(tolerance.select("key", F.col("tolerance").alias("_t")), "key", "left")
    near = F.abs(F.col("price") - F.col("price_2")) <= F.coalesce("_t", F.lit(default))
    out = out.withColumns({
        "quality": F.when(F.col("price_2").isNull(), "single").when(near, "verified").otherwise("disputed"),
        "source_count": F.when(near, 2).otherwise(1)
    })
    return out.drop("_t")


def arbitrate(validated: DataFrame, third: DataFrame, tolerance: DataFrame, default: float = 1.0) -> DataFrame:
    """A third provider that agrees verifies (two sources, or three where already verified); one that doesn't is noted."""
    other = third.select("date", "key", F.col("price").alias("price_3"))
    out = validated.join(other, ["date", "key"], "left").join(tolerance.select("key", F.col("tolerance").alias("_t")), "key", "left")
    near = F.coalesce(F.abs(F.col("price") - F.col("price_3")) <= F.coalesce("_t", F.lit(default)), F.lit(False))
    done = F.col("quality") == "verified"
    out = out.withColumns({
        "note": F.when(F.col("price_3").isNotNull() & ~near, "third source differs"),
        "source_count": F.when(near & done, 3).when(near, 2).otherwise(F.col("source_count"))
    })
    return out.withColumn("quality", F.when(near, "verified").otherwise(F.col("quality"))).drop("_t")


def confirm(validated: DataFrame, more: DataFrame, tolerance: DataFrame, default: float = 1.0) -> DataFrame:
    """A further provider that agrees verifies with two sources, or adds one where already verified; one that doesn't is noted."""
    other = more.select("date", "key", F.col("price").alias("_p"))
    out = validated.join(other, ["date", "key"], "left").join(tolerance.select("key", F.col("tolerance").alias("_t")), "key", "left")
    near = F.coalesce(F.abs(F.col("price") - F.col("_p")) <= F.coalesce("_t", F.lit(default)), F.lit(False))
    differs = F.when(F.col("_p").isNotNull() & ~near, "further source differs")
    out = out.withColumns({
        "note": F.nullif(F.concat_ws("; ", "note", differs), F.lit("")),
        "source_count": F.when(near & (F.col("quality") == "verified"), F.col("source_count") + 1).when(near, 2).otherwise(F.col("source_count"))
    })
    return out.withColumn("quality", F.when(near, "verified").otherwise(F.col("quality"))).drop("_t", "_p")


def price_anomalies(prices: DataFrame, lookback: int = 14, least: int = 5) -> DataFrame:
    """(key, date, close) with z against the days before (sample deviation) and flag anomaly, note or normal."""
    day = F.unix_date("date")
    w = Window.partitionBy("key").orderBy(day).rangeBetween(-lookback, -1)
    out = prices.withColumns({"_n": F.count("close").over(w), "_m": F.avg("close").over(w), "_s": F.stddev_samp("close").over(w)})
    z = F.when((F.col("_n") >= least) & (F.col("_s") > 0), F.round((F.col("close") - F.col("_m")) / F.col("_s"), 4)).otherwise(0.0)
    out = out.withColumn("z", z).drop("_n", "_m", "_s")
    return out.withColumn("flag", F.when(F.abs("z") >= 3, "anomaly").when(F.abs("z") >= 2, "note").otherwise("normal"))


def quote_summary(bars: DataFrame, as_of: Column) -> DataFrame:
    """Of each key the last close, change in %, arrow, points, age in hours, and whether there are enough points."""
    ok = bars.filter(F.col("close").isNotNull() & ~F.isnan("close"))
    w = Window.partitionBy("key").orderBy("ts")
    rows = ok.withColumn("_before", F.lag("close").over(w))
    last = rows.groupBy("key").agg(
        F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"), F.max_by("_before", "ts").alias("_before"),
        F.count("*").alias("data_points")
    )
    change = F.round(F.try_divide(F.col("close") - F.col("_before"), F.col("_before")) * 100, 4)
    out = last.withColumns({"change_pct": change, "arrow": S.arrow(change), "freshness_hours": F.round(S.hours_between(F.col("ts"), as_of), 2)})
    return out.withColumn(
        "quality", F.when(F.col("data_points") <= 1, "unavailable").when(F.col("data_points") < 4, "few points").otherwise("ok")
    ).drop("_before", "ts")


def market_quality_summary(quotes: DataFrame) -> DataFrame:
    """One row: rows of each label and the verdict."""
    out = quotes.agg(F.count("*").alias("total"), *[F.count_if(F.col("quality") == q).alias(q) for q in ("verified", "single", "disputed", "stale")])
    bad = F.col("disputed") + F.col("stale")
    return out.withColumn(
        "verdict",
        F.when(F.col("total") == 0, "empty").when(bad == 0, "excellent").when(bad <= 2, "good").when(bad <= 5, "fair").otherwise("poor")
    )


def spreads(market: DataFrame) -> DataFrame:
    """Of each date: 10 less 2 years (else 5 years), whether inverted, and a credit spread."""
    p = market.groupBy("date").pivot("key", ["us10y", "us2y", "us5y", "hyg", "lqd"]).agg(F.first("price"))
    curve = F.col("us10y") - F.coalesce("us2y", "us5y")
    return p.select(
        "date", F.round(curve, 4).alias("spread"), (curve < 0).alias("inverted"),
        F.round((F.try_divide(F.lit(1), "hyg") - F.try_divide(F.lit(1), "lqd")) * 100, 6).alias("credit_spread")
    )


def with_freshness(quotes: DataFrame, limit: float = 72) -> DataFrame:
    """Unverified quotes older than limit hours are stale, and say so."""
    stale = (F.col("freshness_hours") > limit) & (F.col("quality") != "verified")
    return quotes.withColumns({
        "note": F.when(stale, F.concat(F.lit("older than "), F.lit(int(limit)), F.lit(" h"))),
        "quality": S.freshness_label(F.col("quality"), F.col("freshness_hours"), limit)
    })
