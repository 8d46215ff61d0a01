"""News operators: scoring, deduplication, coverage and balanced selection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import scalars as S
from newsloom.functions import vocab as V
from newsloom.functions.scratch import stored
from newsloom.functions.terms import with_lists
from newsloom.operators.sets import most_common, numbered, signature


def text_of() -> Column:
    return F.lower(F.concat_ws(" ", "title", "summary"))


def noise_flag(news: DataFrame, negative: list[str], category_words: list[str]) -> DataFrame:
    """B2: noise where a negative word and no category word is found."""
    return news.withColumn("noise", S.has_any(text_of(), negative) & ~S.has_any(text_of(), category_words))


def health_gate(news: DataFrame, min_sources: int = 5) -> DataFrame:
    """One row: items, sources, passed."""
    return news.agg(
        F.count("*").alias("items"), F.countDistinct("source").alias("sources")
    ).withColumn("passed", (F.col("items") > 0) & (F.col("sources") >= min_sources))


def vocab_violations(df: DataFrame, column: str, vocab: list[str]) -> DataFrame:
    """Values outside the vocabulary, null among them, and how often."""
    return df.filter(~F.coalesce(F.col(column).isin(vocab), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def category_hits(news: DataFrame, categories: dict[str, dict]) -> DataFrame:
    """(id, category, weight) at most once for an item and category.

    categories: name -> weight, terms, and context (words of which one is needed too, where given).
    """

    rows, has = with_lists(news.select("id", "title", "summary"), text_of(), _lists_of(categories))
    hits = F.array_compact(F.array(*[
        F.when(_matched(c, has), F.struct(F.lit(n).alias("category"), F.lit(float(c["weight"])).alias("weight"))) for n, c in categories.items()
    ]))
    return rows.select("id", F.explode(hits).alias("h")).select("id", "h.category", "h.weight")


def _lists_of(categories: dict[str, dict]) -> list[list[str]]:
    """Terms and contexts of the categories, and their rules' triggers one by one."""
    return [x for c in categories.values() for x in (
        c["terms"], c.get("context") or [], *([t] for rule in c.get("escalation", []) for t in rule["triggers"])
    )]


def _matched(c: dict, has: Callable[[list[str]], Column]) -> Column:
    return has(c["terms"]) & has(c["context"]) if c.get("context") else has(c["terms"])


def escalation_bonus(categories: dict[str, dict], cap: float = 30, has: Callable[[list[str]], Column] | None = None) -> Column:
    """Bonuses of matched categories' rules of which two triggers or more are in the text, capped. has: whether a row's
    text has a word of a list (default: that of title and summary)."""
    has = has or (lambda words: S.has_low(text_of(), list(words)))
    out = F.lit(0.0)
    for c in categories.values():
        for rule in c.get("escalation", []):
            n = reduce(lambda a, b: a + b, [F.when(has([t]), 1).otherwise(0) for t in rule["triggers"]])
            out = out + F.when(_matched(c, has) & (n >= 2), float(rule["bonus"])).otherwise(0.0)
    return F.least(F.lit(float(cap)), out)


def with_source_trust(df: DataFrame, tiers: list[tuple] = V.SOURCE_TRUST) -> DataFrame:
    """Tier and score of the first name that the source contains."""
    found = reduce(
        lambda rest, t: F.when(
            F.lower("source").contains(t[0].lower()), F.struct(F.lit(t[1]).alias("tier"), F.lit(t[2]).alias("score"))
        ).otherwise(rest),
        reversed(tiers), F.struct(F.lit(V.UNRATED[0]).alias("tier"), F.lit(V.UNRATED[1]).alias("score"))
    )
    return df.withColumn("_t", found).withColumns({"tier": F.col("_t.tier"), "trust": F.col("_t.score")}).drop("_t")


def with_source_quality(df: DataFrame, sources: DataFrame, default: float = 0.25) -> DataFrame:
    """C4: credibility times signal weight over 100; default for unknown sources."""
    dim = sources.select(F.col("name").alias("source"), (F.col("credibility") * F.col("signal_weight") / 100.0).alias("_q"))
    return df.join(dim, "source", "left").withColumn("quality", F.coalesce("_q", F.lit(default))).drop("_q")


def title_words() -> Column:
    """The distinct lower-case words of the title, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != "")))


PARTS = 8  # of 64 bits each, by which titles are compared before their words are


def coverage_pairs(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sa, sb) of different word sets (s, w: sorted words) that overlap by more than threshold of the larger.

    Exact prefix filter: over half of the larger set is shared, so two such sets share a word among the rarest words of
    either, the first n - floor(threshold n). Words are numbered by rising frequency, and those of one set alone are left
    out. A set comes to each of its rarest words with its numbers: sizes, places and bits drop most pairs there, the numbers
    decide, and a pair is given by the first word that it shares. So no candidate is ever shuffled: what is grows with
    the sets.
    """
    sets = stored(items.select("s", "w").dropDuplicates(["s"]).withColumn("n", F.size("w")), "title-sets")
    tokens = sets.select("s", "n", F.explode("w").alias("t"))
    ids = numbered(tokens.groupBy("t").agg(F.count("*").alias("f")).filter("f > 1"), "f", "t")
    known = tokens.join(ids.select("t", "id"), "t").groupBy("s", "n").agg(F.array_sort(F.collect_list("id")).alias("w"))
    known = known.withColumn("m", F.size("w")).filter(F.col("m") > F.col("n") * threshold)
    bits = [f"b{k}" for k in range(PARTS)]
    known = stored(known.withColumns({b: signature("w", k, PARTS) for k, b in enumerate(bits)}), "title-numbers")
    first = F.slice("w", F.lit(1), (F.col("m") - F.floor(F.col("n") * threshold)).cast("int"))
    rows = known.select("s", "n", "m", "w", *bits, F.posexplode(first).alias("r", "t"))
    rows = rows.withColumn("before", F.coalesce(F.get("w", F.col("r") - 1), F.lit(-1)))
    side = lambda x: rows.select(*[F.col(c).alias(c if c == "t" else f"{c}_{x}") for c in rows.columns])
    enough = threshold * F.greatest("n_a", "n_b")
    left_over = F.least(F.col("m_a") - F.col("r_a"), F.col("m_b") - F.col("r_b"))
    new = (F.col("before_a") != F.col("before_b")) | (F.col("before_a") < 0)  # else they share the word before as well
    both = side("a").join(side("b"), "t").filter((F.col("s_a") < F.col("s_b")) & (left_over > enough) & new)
    # one-element arrays keep the three steps apart, so that each is compiled by itself and what it makes is made once
    most = most_common("m_a", "m_b", [f"{b}_a" for b in bits], [f"{b}_b" for b in bits])
    both = both.select("t", "s_a", "s_b", "n_a", "n_b", "w_a", "w_b", F.explode(F.array(most)).alias("most")).filter(F.col("most") > enough)
    both = both.select("t", "s_a", "s_b", "n_a", "n_b", F.explode(F.array(F.array_intersect("w_a", "w_b"))).alias("common"))
    both = both.filter((F.size("common") > enough) & (F.get("common", F.lit(0)) == F.col("t")))
    return both.select(F.col("s_a").alias("sa"), F.col("s_b").alias("sb"))


def coverage_count(news: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, coverage_count): 1 plus the items of other URLs with a similar title; without a URL 1, and counted by none.

    Items are counted by word set, so that copies are never paired one by one; of those, the items of the same URL are
    taken off, which needs pairs only where a URL has several word sets. The titles' words are written down once, and so are
    the pairs; pairs are taken both ways in one pass.
    """
    items = news.select("id", "url", title_words().alias("w")).withColumn("s", F.when(F.size("w") > 0, F.xxhash64("w")))
    items = stored(items, "title-items")
    named = items.filter("s is not null and url is not null")
    pairs = stored(coverage_pairs(named, threshold), "title-pairs")
    both = F.array(F.struct(F.col("sa").alias("s"), F.col("sb").alias("o")), F.struct(F.col("sb").alias("s"), F.col("sa").alias("o")))
    near = pairs.select(F.inline(both))
    own = stored(named.groupBy("s", "url").agg(F.count("*").alias("k")), "title-counts")
    size = own.groupBy("s").agg(F.sum("k").alias("k"))
    total = near.join(size.withColumnRenamed("s", "o"), "o").select("s", "k").unionByName(size).groupBy("s").agg(F.sum("k").alias("total"))
    several = own.groupBy("url").agg(F.count("*").alias("m")).filter("m > 1").select("url")
    several = stored(own.join(several, "url", "left_semi"), "title-urls")  # written, so that Spark knows how small it is
    other = near.join(several.select(F.col("s").alias("o"), "url", F.col("k").alias("more")), "o").join(several.select("s", "url"), ["s", "url"], "left_semi")
    other = other.groupBy("s", "url").agg(F.sum("more").alias("more"))
    mine = own.join(other, ["s", "url"], "left").select("s", "url", (F.col("k") + F.coalesce("more", F.lit(0))).alias("mine"))
    out = items.drop("w").join(total, "s", "left").join(mine, ["s", "url"], "left")
    return out.select("id", (1 + F.coalesce(F.col("total") - F.col("mine"), F.lit(0))).cast("long").alias("coverage_count"))


def text_scores(news: DataFrame, categories: dict, themes: dict[str, list[str]], official: list[str]) -> DataFrame:
    """H7: news with text_score (weights of categories, escalation and themes) and official, from title and summary.

    The text is put in lower case once, and with many words gone through once. What follows needs no text, so that callers can drop it before they join.
    """
    rows, has = with_lists(news, text_of(), [*_lists_of(categories), *themes.values(), official])
    total = reduce(
        lambda a, b: a + b, [F.when(_matched(c, has), float(c["weight"])).otherwise(0.0) for c in categories.values()], F.lit(0.0)
    ) + escalation_bonus(categories, has=has)
    total = total + reduce(lambda a, b: a + b, [F.when(has(w), 2.0).otherwise(0.0) for w in themes.values()], F.lit(0.0))
    return rows.withColumns({"text_score": total, "official": has(official)}).drop("_low", "_lists")


def weighed(
    scored: DataFrame, social: list[str], media: list[str], coverage_bonus: dict[int, float], as_of: Column, half_life: float = 72
) -> DataFrame:
    """H7: text_scores() with source, credibility, coverage_count and published_ts to importance_score, one digit."""
    authority = F.least(F.coalesce("credibility", F.lit(5)), F.lit(10)) * 1.5
    loud = F.when(F.lower("source").isin([m.lower() for m in media]), 3.0).otherwise(0.0)
    step = F.lit(0.0)
    for least, bonus in sorted(coverage_bonus.items()):
        step = F.when(F.col("coverage_count") >= least, float(bonus)).otherwise(step)
    sure = S.confirmed(F.col("official"), F.col("source"), F.col("coverage_count"), social)
    total = (F.col("text_score") + authority + loud + step) * sure * S.time_decay(F.col("published_ts"), as_of, half_life)
    return scored.withColumn("importance_score", F.round(total, 1)).drop("text_score", "official")


def importance(
    news: DataFrame, categories: dict, themes: dict[str, list[str]], official: list[str], social: list[str], media: list[str],
    coverage_bonus: dict[int, float], as_of: Column, half_life: float = 72
) -> DataFrame:
    """H7: news (title, summary, source, credibility, coverage_count, published_ts) with importance_score, one digit."""
    return weighed(text_scores(news, categories, themes, official), social, media, coverage_bonus, as_of, half_life)


def score_news(
    news: DataFrame, sources: DataFrame, categories: dict, themes: dict[str, list[str]], official: list[str], social: list[str],
    media: list[str], coverage_bonus: dict[int, float], as_of: Column, half_life: float = 72
) -> DataFrame:
    """H7 and C5 together: news without summary, with coverage_count, credibility and importance_score; sources: (source,
    credibility), a source once.

    Texts are read once: what they give is written down without them, and coverage is counted and joined from there.
    """
    base = stored(text_scores(news, categories, themes, official).drop("summary"), "news-scores")
    scored = base.join(coverage_count(base), "id").join(sources, "source", "left")
    return weighed(scored, social, media, coverage_bonus, as_of, half_life)


def mark_repeats(news: DataFrame, seen: DataFrame, factor: float = 0.7) -> DataFrame:
    """C17: repeated where the normalized URL is among the seen hashes; a positive score is cut by factor."""
    known = seen.select(F.col("url_hash").alias("_h")).distinct().withColumn("_seen", F.lit(True))
    out = news.withColumn("_h", S.url_hash("url")).join(known, "_h", "left").withColumn("repeated", F.coalesce("_seen", F.lit(False)))
    return out.withColumn(
        "importance_score",
        F.when(F.col("repeated") & (F.col("importance_score") > 0), F.col("importance_score") * factor).otherwise(F.col("importance_score"))
    ).drop("_h", "_seen")


def dedup_news(news: DataFrame) -> DataFrame:
    """G1: without null or empty URLs; the first item (by pos) of each normalized URL, then of each fingerprint of what is
    left. A null title or source counts as empty, as the fingerprint says."""
    out = news.filter("url <> ''").withColumns({"url_hash": S.url_hash("url"), "fingerprint": S.fingerprint("title", "source")})
    for key in ("url_hash", "fingerprint"):
        out = out.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter("_rn = 1").drop("_rn")
    return out


def stratified_top(news: DataFrame, max_n: int, min_per_region: int = 3) -> DataFrame:
    """The best min_per_region of each region first (regions by their best item), then by score, max_n in all.

    The order over all regions is taken after each region is cut to max_n.
    """
    best = Window.partitionBy("region").orderBy(F.col("importance_score").desc(), "pos")
    cut = news.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= max_n)
    cut = cut.withColumns({"_top": F.max("importance_score").over(Window.partitionBy("region")), "_first": F.first("pos").over(best)})
    early = F.col("_r") <= min_per_region
    keys = [
        F.when(early, 0).otherwise(1), F.when(early, -F.col("_top")), F.when(early, F.col("_first")), F.when(early, F.col("_r")),
        F.col("importance_score").desc(), F.col("pos")
    ]
    picked = cut.orderBy(*keys).limit(max_n)
    return picked.drop("_r", "_top", "_first")


def round_robin(news: DataFrame, max_n: int = 500) -> DataFrame:
    """One item of each region in turn, regions by name, with turn (1, 2, ...)."""
    out = news.withColumn("turn", F.row_number().over(Window.partitionBy("region").orderBy("pos")))
    return out.filter(F.col("turn") <= max_n).orderBy("turn", "region").limit(max_n)


def links_by_region(news: DataFrame, k: int = 5) -> DataFrame:
    """The first k valid links of each region."""
    ok = news.filter(S.valid_url("url"))
    return ok.withColumn(
        "rank", F.row_number().over(Window.partitionBy("region").orderBy("pos"))
    ).filter(F.col("rank") <= k).select("region", "rank", "id", "url")


def diverse_sample(news: DataFrame, n: int = 4, penalized: tuple[str, ...] = ("中东", "Middle East")) -> DataFrame:
    """N items picked one by one for new regions, rare regions, length and new sources; all where there are n or fewer.

    A null region or source is one of its own. The fixed part of the scores is written down once, for the n best items
    of each region and source (a pick can't come from further down); each round keeps only the best candidate, and what
    was covered is a list of at most n names.
    """
    share = news.groupBy("region").agg(F.count("*").alias("_n"))
    total = share.agg(F.sum("_n").alias("_all"))
    dim = share.crossJoin(F.broadcast(total)).select(
        F.col("region").alias("_region"), (1.0 / (F.col("_n") / F.col("_all") + 0.01)).alias("_w")
    )  # one row
    long = lambda c, most: F.least(F.length(F.coalesce(c, F.lit(""))), F.lit(most)) / most
    rows = news.select(
        "id", "pos", "region", "source",
        (long("summary", 200) * 15 + long("title", 100) * 10 + F.when(F.col("region").isin(list(penalized)), -15.0).otherwise(0.0)).alias("_text")
    )
    rows = rows.join(dim, F.col("region").eqNullSafe(F.col("_region"))).select(
        "id", "pos", "region", "source", "_w", (F.col("_w") * 20 + F.col("_text")).alias("_fixed")
    )
    best = Window.partitionBy("region", "source").orderBy(F.col("_fixed").desc(), "pos")
    pool = stored(rows.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= n).drop("_k"), "diverse")
    picked: list = []
    for _ in range(n):
        known = lambda c: reduce(lambda a, b: a | b, [F.col(c).eqNullSafe(F.lit(p[c])) for p in picked], F.lit(False))  # noqa: B023, E731
        score = F.when(known("region"), 0).otherwise(1) * F.col("_w") * 30 + F.when(known("source"), 0).otherwise(1) * 15 + F.col("_fixed")
        top = pool.filter(~known("id")).withColumn("_s", score).orderBy(F.col("_s").desc(), "pos").select("id", "region", "source").limit(1).collect()
        if not top:
            break
        picked.append(top[0])
    order = {p["id"]: k for k, p in enumerate(picked)}
    if not order:
        return news.limit(0).withColumn("pick", F.lit(0))
    return news.filter(F.col("id").isin(list(order))).withColumn(
        "pick", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("id"))
    )


def source_health(news: DataFrame, low: int = 3) -> DataFrame:
    """Items and sources of each region, and whether it is low."""
    return news.groupBy("region").agg(
        F.count("*").alias("items"), F.countDistinct("source").alias("sources")
    ).withColumn("low", F.col("items") < low)


def majority(df: DataFrame, column: str, order: str) -> DataFrame:
    """D3: the most frequent value; of equal ones the one seen first."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.col("n").desc(), "first").limit(1).select(F.col(column).alias("value"), "n")


def fetch_stats(fetched: DataFrame, news: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Sources that gave rows or failed (fetched: source, ok), items, items that repeat a URL, and items whose
    fingerprint the last run has seen (seen: fingerprint; none without it)."""
    a = fetched.agg(F.count_if("ok").alias("ok_sources"), F.count_if(~F.col("ok")).alias("failed_sources"))
    b = news.agg(F.count("*").alias("items"), (F.count("*") - F.countDistinct(S.url_hash("url"))).alias("duplicates"))
    if seen is None:
        return a.crossJoin(b)  # single rows
    kept = dedup_news(news).join(seen.select("fingerprint").distinct(), "fingerprint", "left_semi").agg(F.count("*").alias("repeats"))
    return a.crossJoin(b).crossJoin(kept)


def budget_pack(sections: DataFrame, group: str, budget: int, always: int = 8) -> DataFrame:
    """of each group, sections by priority that fit the budget; those of priority `always` or more go in anyway.

    A section that doesn't fit is skipped and uses nothing, so that the rule is a fold and not a running sum.
    """
    item = F.struct((-F.col("priority")).alias("o"), "pos", "priority", "cost")
    packed = sections.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("s"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        take = (x.priority >= always) | (acc.used + x.cost <= budget)
        return F.when(
            take, F.struct((acc.used + x.cost).cast("long").alias("used"), F.concat(acc.taken, F.array(x.pos.cast("long"))).alias("taken"))
        ).otherwise(acc)

    return packed.select(group, F.aggregate("s", zero, step).alias("r")).select(
        group, F.col("r.used").alias("used"), F.size("r.taken").alias("n_taken"),
        F.array_join(F.transform("r.taken", lambda x: x.cast("string")), ",").alias("taken")
    )


def top_per_day(df: DataFrame, k: int) -> DataFrame:
    """the first k rows of each date by pos."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy("pos"))).filter(F.col("rank") <= k)


def emerging_vs_yesterday(today: DataFrame, yesterday: DataFrame, key: str = "title") -> DataFrame:
    """today's rows whose key did not occur yesterday."""
    return today.join(yesterday.select(key).distinct(), key, "left_anti")


MAX_REGIONS = 10_000


def coverage_gap(news: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """(doc_id, region) of regions in the news that the document's text does not name. names: region -> word.

    The regions are a vocabulary: they travel to the documents as one row, and more than MAX_REGIONS of them are an error.
    """
    every = news.filter("region is not null").agg(F.array_sort(F.collect_set("region")).alias("_regions"))
    every = every.select(F.when(F.size("_regions") <= MAX_REGIONS, F.col("_regions")).otherwise(F.raise_error(F.lit("too many regions"))).alias("_regions"))
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = docs.select("doc_id", F.lower("text").alias("_low")).crossJoin(F.broadcast(every))  # one row
    missing = F.filter("_regions", lambda r: ~F.col("_low").contains(F.lower(F.coalesce(F.try_element_at(named, r), r))))
    return rows.select("doc_id", F.explode(missing).alias("region"))
