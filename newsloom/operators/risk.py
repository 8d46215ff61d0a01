"""Theme risk, transmission chains, evolution and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import scalars as S
from newsloom.functions import vocab as V
from newsloom.functions.terms import lists_found
from newsloom.operators.ordered import numbered
from newsloom.sources.scan import score_spine


def matched_themes(text: Column, themes: dict[str, list[str]]) -> Column:
    """Names of the themes with a word in the text; the text is gone through once, however many words there are."""
    names = F.array(*map(F.lit, themes)) if themes else F.array().cast("array<string>")
    return F.transform(F.coalesce(lists_found(F.lower(text), themes.values()), F.array().cast("array<int>")), lambda k: F.get(names, k))


def theme_media(news: DataFrame, themes: dict[str, list[str]]) -> DataFrame:
    """(theme, source, quality) of distinct sources that report on a theme."""
    hits = news.select("source", "quality", F.explode(matched_themes(F.concat_ws(" ", "title", "summary"), themes)).alias("theme"))
    return hits.groupBy("theme", "source").agg(F.max("quality").alias("quality"))


def theme_signal_hits(signals: DataFrame, themes: dict[str, list[str]]) -> DataFrame:
    """(theme, dimension, hits): texts of a dimension with a word of the theme."""
    hits = signals.select("dimension", F.explode(matched_themes(F.col("text"), themes)).alias("theme"))
    return hits.groupBy("theme", "dimension").agg(F.count("*").alias("hits"))


def theme_first_seen(events: DataFrame, themes: dict[str, list[str]], as_of: Column, days: int = 30) -> DataFrame:
    """(theme, first_seen): the earliest of the last days with a matching event; as_of where there is none."""
    near = events.filter((F.col("date") > F.date_sub(as_of, days)) & (F.col("date") <= as_of))
    seen = near.select("date", F.explode(matched_themes(F.col("text"), themes)).alias("theme")).groupBy("theme").agg(F.min("date").alias("first"))
    every = events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, themes))).alias("theme"))
    return every.join(seen, "theme", "left").select("theme", F.coalesce("first", as_of).alias("first_seen"))


def level(score: Column, steps: dict[str, int] = V.LEVEL_FROM) -> Column:
    return reduce(lambda rest, t: F.when(score >= t[1], t[0]).otherwise(rest), sorted(steps.items(), key=lambda t: t[1]), F.lit("C"))


def score_themes(media: DataFrame, hits: DataFrame, themes: list[str], dimensions: dict = V.DIMENSIONS) -> DataFrame:
    """(theme, parts..., score, signal_level): capped parts of each dimension, weighted, as a share of the maximum."""
    every = media.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, themes))).alias("theme"))
    m = media.groupBy("theme").agg(F.sum("quality").alias("_q"))
    wide = hits.groupBy("theme").pivot("dimension", [d for d in dimensions if d != "media"]).agg(F.sum("hits"))
    out = every.join(m, "theme", "left").join(wide, "theme", "left")
    parts = {}
    for d, (_, cap, points) in dimensions.items():
        parts[f"{d}_part"] = F.least(
            F.lit(cap), (points * F.coalesce("_q", F.lit(0.0)) / 5).cast("int")
        ) if d == "media" else F.least(F.lit(cap), (points * F.coalesce(d, F.lit(0))).cast("int"))
    out = out.withColumns(parts)
    raw = reduce(lambda a, b: a + b, [F.col(f"{d}_part") * w for d, (w, _, _) in dimensions.items()])
    most = sum(w * cap for w, cap, _ in dimensions.values())
    out = out.withColumn("score", F.floor(F.least(F.lit(100.0), raw / most * 100) + 1e-9).cast("int"))
    return out.withColumn("signal_level", level(F.col("score"))).select("theme", *parts, "score", "signal_level")


def escalate_themes(
    scores: DataFrame, signals: DataFrame, rules: list[dict], leans: DataFrame, first_seen: DataFrame, as_of: Column, divergent: float = 0.8
) -> DataFrame:
    """Bonuses of rules whose triggers all occur in the day's signals (capped at 100), then the multiplier of
    divergent leans, then decay by first sight. A level is raised by rule or score and never lowered."""
    bag = signals.sparkSession.range(1).select(F.lit(True).alias("_bag")) if not rules else signals.agg(*[
        F.max(F.lower("text").contains(t.lower())).alias(f"_{i}_{j}") for i, r in enumerate(rules) for j, t in enumerate(r["triggers"])
    ])
    fired = [
        reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_{i}_{j}"), F.lit(False)) for j in range(len(r["triggers"]))]) for i,
        r in enumerate(rules)
    ]
    rank = {"C": 1, "B": 2, "A": 3, "S": 4}
    name = F.create_map(*[F.lit(x) for k, v in rank.items() for x in (v, k)])
    out = scores.crossJoin(F.broadcast(bag))  # one row
    bonus = reduce(lambda a, b: a + b, [F.when(f, float(r["bonus"])).otherwise(0.0) for f, r in zip(fired, rules, strict=True)], F.lit(0.0))
    lift = reduce(
        F.greatest, [F.when(f, rank.get(r.get("level", "C"), 1)).otherwise(1) for f, r in zip(fired, rules, strict=True)], F.lit(1)
    ) if rules else F.lit(1)
    out = out.withColumns({"_s": F.least(F.lit(100.0), F.col("score") + bonus), "_l": F.greatest(S.mapped(F.col("signal_level"), rank, 1), lift)})
    out = out.join(leans, "theme", "left").join(first_seen, "theme", "left")
    out = out.withColumn("_l", F.greatest("_l", S.mapped(level(F.col("_s")), rank, 1)))
    out = out.withColumn("_s", F.floor(F.col("_s") * F.when(F.coalesce("divergent", F.lit(False)), divergent).otherwise(1.0) + 1e-9))
    out = out.withColumn("_l", F.greatest("_l", S.mapped(level(F.col("_s")), rank, 1)))
    out = out.withColumn("signal_level", F.element_at(name, F.col("_l")))
    return out.select(
        "theme",
        F.floor(F.col("_s") * S.signal_decay(F.coalesce("first_seen", as_of), F.col("signal_level"), as_of) + 1e-9).cast("int").alias("score"),
        "signal_level"
    )


def momentum(scores: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """(theme, momentum, trend): current score minus the oldest known of the last days, over the days between known ones."""
    spine = score_spine(scores.filter(F.col("date") < as_of), as_of, days)
    now = scores.filter(F.col("date") == as_of).select("theme", F.col("score").alias("_now"))
    ends = spine.filter("score is not null").groupBy("theme").agg(
        F.min_by("score", "date").alias("_first"), F.min("date").alias("_from"), F.max("date").alias("_to"), F.count("*").alias("_n")
    )
    out = now.join(ends, "theme", "left")
    m = F.when(F.col("_n") >= 2, F.round((F.col("_now") - F.col("_first")) / F.greatest(F.datediff("_to", "_from"), F.lit(1)), 1)).otherwise(0.0)
    return out.select("theme", m.alias("momentum"), F.when(m > 0, "rising").when(m < 0, "cooling").otherwise("stable").alias("trend"))


def acceleration(scores: DataFrame, as_of: Column, days: int = 5) -> DataFrame:
    """E5: (theme, acceleration): the last step minus the mean earlier one, of three known days or more."""
    spine = score_spine(scores.filter(F.col("date") < as_of), as_of, days).filter("score is not null")
    v = spine.groupBy("theme").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("date", "score"))), lambda x: x.score.cast("double")
    ).alias("_v"))
    now = scores.filter(F.col("date") == as_of).select("theme", F.col("score").alias("_now"))
    n = F.size("_v")
    early = F.when(n >= 4, (F.try_element_at("_v", F.lit(-2)) - F.get("_v", 0)) / (n - 2)).otherwise(0.0)
    acc = F.when(n >= 3, F.round(F.col("_now") - F.try_element_at("_v", F.lit(-1)) - early, 1)).otherwise(0.0)
    return now.join(v, "theme", "left").select("theme", F.coalesce(acc, F.lit(0.0)).alias("acceleration"))


def chain_triggers(anchors: DataFrame, market: DataFrame) -> DataFrame:
    """C11: (chain, nodes, bonus): anchors (chain, node, indicator, threshold, direction) that the market (key, price,
    change_pct) meets; the spread of 10 and 2 years is an indicator of its own."""
    spread = market.agg((F.max(F.when(F.col("key") == "us10y", F.col("price"))) - F.max(F.when(F.col("key") == "us2y", F.col("price")))).alias("price")).select(
        F.lit("spread_10y_2y").alias("key"), "price", F.lit(0.0).alias("change_pct")
    ).filter("price is not null")
    known = market.select("key", "price", "change_pct").unionByName(spread).withColumnRenamed("key", "indicator")
    t, d = F.col("threshold"), F.col("direction")
    hit = F.when(d == "above", F.col("price") > t).when((d == "below") & (t < 0), F.col("change_pct") < t).when(d == "below", F.col("price") < t).when(d == "change", F.abs("change_pct") > t).otherwise(False)
    return anchors.join(known, "indicator").filter(hit).groupBy("chain").agg(F.count("*").alias("nodes"), (5 * F.count("*")).alias("bonus"))


def global_stress(scores: DataFrame, chains: DataFrame) -> DataFrame:
    """One row: mean score plus bonuses of chains, plus 20 for three chains or 10 for two, at most 100."""
    a = scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("_m"))
    b = chains.agg(F.coalesce(F.sum("bonus"), F.lit(0)).alias("_b"), F.count("*").alias("chains"))
    extra = F.when(F.col("chains") >= 3, 20).when(F.col("chains") == 2, 10).otherwise(0)
    return a.crossJoin(b).select(F.least(F.lit(100), F.floor(F.col("_m") + F.col("_b") + extra + 1e-9).cast("int")).alias("stress"), "chains")


def theme_mentions(history: DataFrame, themes=V.THEMES) -> DataFrame:
    """(theme, date, mentions) of clusters and signals by normalized theme."""
    return history.select(
        "date", F.explode(F.concat("clusters", "signals")).alias("_x")
    ).groupBy(S.normalize_theme(F.col("_x"), themes).alias("theme"), "date").agg(F.count("*").alias("mentions"))


def trajectory(daily: DataFrame, key: str, value: str, scale: float = 10, edge: float = 1, min_days: int = 2) -> DataFrame:
    """Of keys with min_days days: days, total, first and last day, trend score (second half's mean minus the
    first's, times scale) and its label. A key may be spread over any number of tasks."""
    rows = numbered(daily.select(key, "date", value), key, ["date"])
    half = F.floor(F.col("_n") / 2)
    out = rows.groupBy(key).agg(
        F.count("*").alias("days"), F.sum(value).alias("total"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"),
        F.round(
            (F.avg(F.when(F.col("_i") > half, F.col(value))) - F.avg(F.when(F.col("_i") <= half, F.col(value)))) * scale, 4
        ).alias("trend_score"),
    ).filter(F.col("days") >= min_days)
    return out.withColumn("trend", F.when(F.col("trend_score") > edge, "rising").when(F.col("trend_score") < -edge, "falling").otherwise("stable"))


def inflections(themes: DataFrame, edge: float = 5, k: int = 5) -> DataFrame:
    """The k themes with the largest change beyond edge."""
    return themes.filter(F.abs("trend_score") > edge).orderBy(F.abs("trend_score").desc(), themes.columns[0]).limit(k)


def emerging(themes: DataFrame, max_days: int = 7, k: int = 5) -> DataFrame:
    """The k themes of few days, those with more days first."""
    return themes.filter(F.col("days") <= max_days).orderBy(F.col("days").desc(), themes.columns[0]).limit(k)


def trend_dashboard(
    themes: DataFrame, regions: DataFrame, top_themes: int = 10, top_regions: int = 8, edge: float = 5, max_days: int = 7, k: int = 5
) -> DataFrame:
    """F2: (part, rank, name, value, trend) of trajectories: themes by trend score, inflections and emerging themes, and
    regions by their daily mean."""

    def part(name: str, df: DataFrame, key: str, value: Column, order: list[Column], n: int) -> DataFrame:
        cut = df.select(
            F.col(key).cast("string").alias("name"), value.cast("double").alias("value"), "trend",
            *[o.alias(f"_o{i}") for i, o in enumerate(order)]
        ).orderBy(*[f"_o{i}" for i in range(len(order))]).limit(n)
        rank = F.row_number().over(Window.orderBy(*[f"_o{i}" for i in range(len(order))]))  # over at most n rows
        return cut.select(F.lit(name).alias("part"), rank.alias("rank"), "name", "value", "trend")

    t, score = themes.columns[0], F.col("trend_score")
    out = part("themes", themes, t, score, [-score, F.col(t)], top_themes)
    out = out.unionByName(part("inflections", themes.filter(F.abs(score) > edge), t, score, [-F.abs(score), F.col(t)], k))
    out = out.unionByName(part("emerging", themes.filter(F.col("days") <= max_days), t, F.col("days"), [-F.col("days"), F.col(t)], k))
    mean = F.col("total") / F.col("days")
    return out.unionByName(part("regions", regions, regions.columns[0], F.round(mean, 4), [-mean, F.col(regions.columns[0])], top_regions))


def region_timeline(history: DataFrame, per_day: int = 10) -> DataFrame:
    """Trajectory of items of each region; at most per_day regions of a day count."""
    rows = history.select(
        "date", F.explode(F.slice(F.array_sort(F.map_entries("regions")), 1, per_day)).alias("_e")
    ).select("date", F.col("_e.key").alias("region"), F.size("_e.value").alias("items"))
    return trajectory(rows, "region", "items", scale=1, edge=0.05)


def signal_histogram(history: DataFrame) -> DataFrame:
    """Signals of each level, named first as `S:` or `[S]`; a bare one counts as B."""
    lv = F.regexp_extract("_s", r"^\W?([SABC])(?:级|-level|[\]:：])", 1)
    return history.select(F.explode("signals").alias("_s")).groupBy(F.when(lv == "", "B").otherwise(lv).alias("signal_level")).agg(F.count("*").alias("n"))


def with_phase_delta(df: DataFrame, transitions: dict[tuple[str, str], int]) -> DataFrame:
    """risk_delta of (old_phase, phase); 0 for others."""
    return df.withColumn("risk_delta", S.mapped(F.concat_ws("→", "old_phase", "phase"), {f"{a}→{b}": d for (a, b), d in transitions.items()}, 0))


def evolve(events: DataFrame, transitions: dict[tuple[str, str], int], as_of: Column, half_life: float = 14, archive_days: int = 60) -> DataFrame:
    """State of each event (event_id, date, phase) after daily runs from its first day to as_of.

    A new event starts at risk 0. On a day with a new phase the transition's delta is added, within 0 to 100. On a day
    without the event the risk decays by the days since it was last seen, cut to whole numbers each time. Archived at
    risk 0 after archive_days idle days. Of several rows of an event and day the last by pos counts, without a column
    pos the one with the greatest phase.
    """
    delta = lambda a, b: S.mapped(F.concat_ws("→", a, b), {f"{x}→{y}": d for (x, y), d in transitions.items()}, 0)
    last = F.max_by("phase", "pos") if "pos" in events.columns else F.max("phase")
    days = events.groupBy("event_id", "date").agg(last.alias("phase")).groupBy("event_id").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "phase"))).alias("_p"), F.min("date").alias("first_seen")
    )
    days = days.withColumn("_run", F.sequence("first_seen", F.greatest(as_of, F.col("first_seen"))))
    zero = F.struct(
        F.lit(0).alias("risk"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("date").alias("seen"),
        F.lit(0).alias("transitions")
    )

    def step(s: Column, day: Column) -> Column:
        p = F.try_element_at(F.col("_p"), day)
        moved = F.coalesce(p != s.phase, F.lit(False))
        raised = F.when(moved, F.greatest(F.lit(0), F.least(F.lit(100), s.risk + delta(s.phase, p)))).otherwise(s.risk)
        idle = F.floor(s.risk * F.exp(-0.693 * F.datediff(day, s.seen) / half_life)).cast("int")
        seen = p.isNotNull()
        return F.struct(
            F.when(seen, raised).otherwise(idle).alias("risk"), F.coalesce(p, s.phase).alias("phase"),
            F.when(seen, day).otherwise(s.seen).alias("seen"), (s.transitions + moved.cast("int")).alias("transitions")
        )

    out = days.select("event_id", "first_seen", F.aggregate("_run", zero, step).alias("s"))
    idle_days = F.datediff(as_of, F.col("s.seen"))
    return out.select(
        "event_id", "first_seen", F.col("s.seen").alias("last_updated"), F.col("s.phase").alias("phase"), F.col("s.risk").alias("risk"),
        F.col("s.transitions").alias("transitions"), ((F.col("s.risk") == 0) & (idle_days >= archive_days)).alias("archived")
    )


def evolution_report(state: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: events, those active in the last days, transitions."""
    return state.agg(
        F.count("*").alias("events"), F.count_if(F.col("last_updated") >= F.date_sub(as_of, days)).alias("active"),
        F.sum("transitions").alias("transitions")
    )


def new_participants(events: DataFrame) -> DataFrame:
    """(event_id, date, new_actors, n_new): actors of an event on the first day it has them."""
    first = events.select("event_id", "date", F.explode("actors").alias("actor")).groupBy("event_id", "actor").agg(F.min("date").alias("date"))
    return first.groupBy("event_id", "date").agg(
        F.array_join(F.array_sort(F.collect_list("actor")), ",").alias("new_actors"), F.count("*").alias("n_new")
    )
