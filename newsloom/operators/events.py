"""Event tables: normalizing, merging, daily revisions, heads, evidence, relations, life cycle, search."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import scalars as S
from newsloom.functions import vocab as V
from newsloom.functions.scratch import stored
from newsloom.operators.graph import connected_components
from newsloom.operators.ordered import following
from newsloom.operators.sets import numbered


def as_list(text: Column) -> Column:
    """A string "a,b、c" as a list; blank parts dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,、]"), lambda x: F.trim(x)), lambda x: x != "")


def normalize_events(raw: DataFrame) -> DataFrame:
    """Raw (pos, title, signal_level, actors and sources as strings, event_type, ...) with defaults filled."""
    out = raw.withColumn("signal_level", F.upper(F.trim(F.coalesce("signal_level", F.lit("C")))))
    return out.withColumns({
        "event_id": F.coalesce("event_id", F.format_string("evt_%03d", F.col("pos") + 1)),
        "title": F.coalesce("title", F.lit("")),
        "signal_level": F.when(F.col("signal_level").isin(list(V.SIGNAL_RANK)), F.col("signal_level")).otherwise("C"),
        "actors": as_list(F.col("actors")),
        "sources": as_list(F.col("sources")),
        "event_type": F.coalesce("event_type", F.lit("政治")),
        "source_count": F.coalesce(F.col("source_count"), F.size(as_list(F.col("sources")))),
    })


def event_quality(events: DataFrame) -> DataFrame:
    """One row: S and A events, regions, and a warning for each bound that is broken."""
    out = events.agg(
        F.count_if(F.col("signal_level") == "S").alias("s_events"), F.count_if(F.col("signal_level") == "A").alias("a_events"),
        F.countDistinct("region").alias("regions")
    )
    return out.withColumns({"many_s": F.col("s_events") > 1, "many_a": F.col("a_events") > 5, "few_regions": F.col("regions") < 3})


def normalize_clusters(raw: DataFrame) -> DataFrame:
    """Clusters (cluster_id, events array, source_count, region) with counts, consensus and regions."""
    n = F.coalesce("source_count", F.size("events"))
    return raw.withColumns({
        "event_count": F.size("events"), "source_count": n, "consensus": S.consensus(n),
        "is_emerging": F.coalesce("is_emerging", F.lit(False)), "region": F.coalesce("region", F.lit("全球"))
    }).withColumn("regions", F.array("region"))


def few_clusters(clusters: DataFrame, events: DataFrame) -> DataFrame:
    """One row: whether there are too few clusters for the events."""
    both = events.agg(F.count("*").alias("events")).crossJoin(clusters.agg(F.count("*").alias("clusters")))
    return both.withColumn("few", ((F.col("events") >= 10) & (F.col("clusters") < 5)) | ((F.col("events") >= 5) & (F.col("clusters") < 3)))


def merge_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row for each key, folded in the order of pos.

    First title; lists united in order of first sight; highest signal (of equal ones the first); longest summary (the
    first); last phase, trend and confidence; leans: neutral gives way, equal stays, else 混合; reasons joined by "; ".
    """
    rank = S.mapped(F.col("signal_level"), V.SIGNAL_RANK, 0)
    parts = [
        "pos", "title", "actors", "sources", "domains", "related_events", "signal_level", "summary", "phase", "trend", "confidence",
        "source_lean", "lean_reasoning"
    ]
    whole = events.withColumn("_rank", rank).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts, "_rank"))).alias("e"))
    united = lambda c: F.array_distinct(F.flatten(F.transform("e", lambda x: F.coalesce(x[c], F.array().cast("array<string>")))))
    best = lambda score, c: F.aggregate(
        "e", F.struct(F.lit(-1).alias("s"), F.lit(None).cast("string").alias("v")),
        lambda a, x: F.when(score(x) > a.s, F.struct(score(x).alias("s"), x[c].alias("v"))).otherwise(a)
    )["v"]
    neutral = lambda x: F.coalesce(x.isin("中立", "neutral", ""), F.lit(True))

    def lean(a: Column, x: Column) -> Column:
        new = F.when(neutral(x.source_lean), a.lean).when(neutral(a.lean), x.source_lean).when(a.lean == x.source_lean, a.lean).otherwise("混合")
        more = F.coalesce(x.lean_reasoning, F.lit(""))
        why = F.when(
            neutral(x.source_lean) | (more == "") | a.why.contains(more), a.why
        ).when(a.why == "", more).otherwise(F.concat(a.why, F.lit("; "), more))
        return F.struct(new.alias("lean"), why.alias("why"))

    folded = F.aggregate("e", F.struct(F.lit("中立").alias("lean"), F.lit("").alias("why")), lean)
    last = lambda c: F.element_at("e", -1)[c]
    return whole.select(
        key, F.get("e", 0).title.alias("title"), united("actors").alias("actors"), united("sources").alias("sources"), united("domains").alias("domains"), united("related_events").alias("related_events"),
        best(lambda x: x["_rank"], "signal_level").alias("signal_level"), best(
            lambda x: F.length(F.coalesce(x.summary, F.lit(""))), "summary"
        ).alias("summary"),
        last("phase").alias("phase"), last("trend").alias("trend"), last("confidence").alias("confidence"), folded.lean.alias("source_lean"), folded.why.alias("lean_reasoning"),
    )


def build_revisions(events: DataFrame) -> DataFrame:
    """(event_id, date, pos, risk, phase, summary, ...): one row for each event and day, the last written.

    risk_delta against the event's day before (0 for the first), phase_transition `old→new` where the phase changed.
    """
    last = Window.partitionBy("event_id", "date").orderBy(F.col("pos").desc())
    days = events.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    order = Window.partitionBy("event_id").orderBy("date")
    before, phase = F.lag("risk").over(order), F.lag("phase").over(order)
    return days.withColumns({
        "risk_delta": F.coalesce(F.col("risk") - before, F.lit(0)),
        "phase_transition": F.when(phase != F.col("phase"), F.concat(phase, F.lit("→"), F.col("phase"))),
        "summary": F.substring("summary", 1, 200)
    })


def event_heads(revisions: DataFrame) -> DataFrame:
    """One row for each event: first and last day, last title, phase and risk, peaks, first title, days."""
    rank = S.mapped(F.col("signal_level"), V.SIGNAL_RANK, 0)
    return revisions.groupBy("event_id").agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.min_by("title", "date").alias("canonical_title"), F.max_by("phase", "date").alias("phase"), F.max_by("risk", "date").alias("risk"),
        F.max("risk").alias("peak_risk"), F.max_by("signal_level", F.struct(rank, -F.unix_date("date"))).alias("peak_signal"), F.count("*").alias("revisions"), F.lit("active").alias("status"),
    )


def timeline(revisions: DataFrame, n: int = 30) -> DataFrame:
    """The newest n rows of each event."""
    return revisions.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("date").desc()))).filter(F.col("rank") <= n)


def active_events(heads: DataFrame, region: str | None = None, min_risk: float = 0) -> DataFrame:
    """Active events of a region by risk."""
    out = heads.filter((F.col("status") == "active") & (F.col("risk") >= min_risk))
    return (out if region is None else out.filter(F.col("region") == region)).orderBy(F.col("risk").desc(), "event_id")


def recent_events(heads: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """B12."""
    return heads.filter(F.col("last_seen") >= F.date_sub(as_of, days))


def event_by_id(heads: DataFrame, event_id) -> DataFrame:
    """B13."""
    return heads.filter(F.col("event_id") == event_id)


def event_by_key(heads: DataFrame, identity_key) -> DataFrame:
    """By identity key; the filter reaches the scan where heads are read from files."""
    return heads.filter(F.col("identity_key") == identity_key)


def events_by_date(heads: DataFrame, revisions: DataFrame, date: Column, limit: int = 50) -> DataFrame:
    """Events with a revision on the date, by risk."""
    return heads.join(
        revisions.filter(F.col("date") == date).select("event_id"), "event_id", "left_semi"
    ).orderBy(F.col("risk").desc(), "event_id").limit(limit)


def timeline_digest(heads: DataFrame, revisions: DataFrame, top: int = 5, min_risk: float = 20, rows: int = 7) -> DataFrame:
    """Of the top active events, phases of the last rows (equal neighbours once, at most 5), arrow and transitions."""
    events = heads.filter((F.col("status") == "active") & (F.col("risk") >= min_risk)).orderBy(F.col("risk").desc(), "event_id").limit(top)
    recent = timeline(revisions.join(F.broadcast(events.select("event_id")), "event_id", "left_semi"), rows)  # top rows are broadcast
    order = Window.partitionBy("event_id").orderBy("date")
    marked = recent.withColumn("_new", F.coalesce(F.lag("phase").over(order) != F.col("phase"), F.lit(True)))
    phases = F.transform(F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("date", "phase")))), lambda x: x.phase)
    out = marked.groupBy("event_id").agg(
        F.array_join(F.slice(phases, 1, 5), "→").alias("phases"), F.max_by("risk", "date").alias("_new_risk"),
        F.min_by("risk", "date").alias("_old_risk"), F.count_if("_new").alias("_n")
    )
    return out.select("event_id", "phases", S.arrow(F.col("_new_risk") - F.col("_old_risk")).alias("arrow"), (F.col("_n") - 1).alias("transitions"))


def append_evidence(existing: DataFrame, events: DataFrame, per_source: bool = False, limit: int = 10) -> DataFrame:
    """New evidence rows (event_id, date, content_hash, source) of events' first sources, not yet in existing.

    The hash covers the event's summary, and with per_source the source as well.
    """
    rows = events.select("event_id", "date", "summary", F.posexplode(F.slice("sources", 1, limit)).alias("n", "source"))
    content = F.concat_ws("|", "summary", "source") if per_source else F.coalesce(F.col("summary"), F.lit(""))
    rows = rows.withColumn("content_hash", F.sha2(content, 256))
    first = rows.groupBy("event_id", "date", "content_hash").agg(F.min_by("source", "n").alias("source"))
    return first.join(existing.select("event_id", "date", "content_hash"), ["event_id", "date", "content_hash"], "left_anti")


def cooccurrence_edges(events: DataFrame, span: int = 2) -> DataFrame:
    """(date, src, dst, relation, confidence) from each event to the next span events of its day by pos.

    A day may be spread over any number of tasks."""
    return following(events.select("date", "pos", "event_id"), "date", ["pos"], "event_id", span).select(
        "date", F.col("event_id").alias("src"), F.explode("_next").alias("dst"), F.lit("related_to").alias("relation"),
        F.lit(0.3).alias("confidence")
    ).filter("src <> dst")


def upsert_relations(edges: DataFrame, new: DataFrame) -> DataFrame:
    """C20: live edges found again get their history appended and last_confirmed moved; others are inserted.

    edges: src, dst, relation, first_seen, last_confirmed, expired, history array<struct<date,confidence>>. new: src, dst,
    relation, date, confidence.
    """
    key = ["src", "dst", "relation"]
    add = new.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("date", "confidence"))).alias("_add"))
    old, live = edges.filter("expired is not null"), edges.filter("expired is null")
    both = live.join(add, key, "full_outer")
    empty = F.array().cast("array<struct<date:date,confidence:double>>")
    more = both.select(
        *key, F.coalesce("first_seen", F.get("_add", 0)["date"]).alias("first_seen"), F.coalesce(
            F.try_element_at("_add", F.lit(-1))["date"], F.col("last_confirmed")
        ).alias("last_confirmed"),
        "expired", F.concat(F.coalesce("history", empty), F.coalesce("_add", empty)).alias("history"),
    )
    return more.unionByName(old.select(more.columns))


def search_corpus(heads: DataFrame, revisions: DataFrame) -> DataFrame:
    """Active events with their latest summary."""
    latest = revisions.groupBy("event_id").agg(F.max_by("summary", "date").alias("summary"))
    return heads.filter("status = 'active'").join(latest, "event_id", "left")


def tokens(text: Column) -> Column:
    """Lower-case words; runs of CJK characters as pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}&&[^一-鿿]]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(r"[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(
        runs,
        lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(
            F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))
        ))
    ))
    return F.concat(words, pairs)


def search(corpus: DataFrame, query: list[str], limit: int = 20, id_col: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """C14: documents that hold every term (a trailing * is a prefix), by BM25; where none does, those that contain the
    whole query as a substring."""
    docs = corpus.select(F.col(id_col), "text", tokens(F.col("text")).alias("_t")).withColumn("_n", F.size("_t"))
    terms = [q.lower() for q in query]

    def tf(q: str) -> Column:
        return F.size(F.filter("_t", lambda x: x.startswith(q[:-1]) if q.endswith("*") else x == q))

    counted = docs.select(
        id_col, "_n", *[tf(q).alias(f"_f{k}") for k, q in enumerate(terms)],
        F.lower("text").contains(" ".join(q.rstrip("*") for q in terms)).alias("_sub")
    )
    stats = counted.agg(
        F.count("*").alias("_docs"), F.avg("_n").alias("_avg"),
        *[F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(terms))]
    )
    rows = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("_docs") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5))
        score = score + idf * F.col(f"_f{k}") * (k1 + 1) / (F.col(f"_f{k}") + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    every = F.lit(True)
    for k in range(len(terms)):
        every = every & (F.col(f"_f{k}") > 0)
    rows = rows.withColumns({"_all": every, "score": F.round(score, 6)}).filter(F.col("_all") | F.col("_sub"))
    top = rows.orderBy(F.col("_all").desc(), F.when(F.col("_all"), F.col("score")).desc(), id_col).limit(limit)
    hit = F.max("_all").over(Window.partitionBy())  # over at most limit rows
    return top.withColumn("_hit", hit).filter(F.col("_all") == F.col("_hit")).select(
        id_col, F.when(F.col("_all"), F.col("score")).otherwise(0.0).alias("score"), F.col("_all").alias("ranked")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def rollup_clusters(events: DataFrame, assignment: DataFrame) -> DataFrame:
    """Of each cluster its events, sources, highest signal, distinct actors and regions. Nothing is gathered in lists."""
    rank = S.mapped(F.col("signal_level"), V.SIGNAL_RANK, 0)
    rows = events.join(assignment, "event_id")
    out = rows.groupBy("cluster_id").agg(
        F.count("*").alias("event_count"), F.max_by("signal_level", rank).alias("highest_signal"),
        F.countDistinct("region").alias("regions")
    )
    distinct = lambda c: rows.select("cluster_id", F.explode_outer(c).alias("_x")).groupBy("cluster_id").agg(F.countDistinct("_x").cast("int").alias("n"))
    out = out.join(
        distinct("sources").withColumnRenamed("n", "source_count"), "cluster_id"
    ).join(distinct("actors").withColumnRenamed("n", "actors"), "cluster_id")
    return out.select("cluster_id", "event_count", "source_count", "highest_signal", "actors", "regions")


LONGEST, CHOICES = 16, 64  # actors of sets that meet on several actors at once; most such choices for two sizes
PART = 1000  # events of a class, about, that are paired at once


def _choices(min_jaccard: float) -> list[tuple]:
    """(n, [(lo, hi, k, sure, pick)]): for sizes n and another up to LONGEST, lo and hi in order, the places of k actors of the
    n, so that two such sets over the threshold have the same actors at a pick of each. sure: these are enough for a link."""
    out = []
    for n in range(1, LONGEST + 1):
        own = []
        for other in range(1, LONGEST + 1):
            lo, hi = min(n, other), max(n, other)
            least = next((c for c in range(1, lo + 1) if c / (n + other - c) > min_jaccard), None)
            if least is None or lo == least == hi:  # the same set
                continue
            k = max(k for k in range(1, least + 1) if k == 1 or comb(hi - least + k, k) <= CHOICES)
            own += [(lo, hi, k, k == least, list(pick)) for pick in combinations(range(n - least + k), k)]
        out.append((n, own))
    return out


def _meeting(classes: DataFrame, min_jaccard: float) -> DataFrame:
    """The classes (first, p, n, w) at each key where they can meet others: (p, lo, hi, k, sure, items)."""
    made = classes.sparkSession.createDataFrame(_choices(min_jaccard), "n int, own array<struct<lo: int, hi: int, k: int, sure: boolean, pick: array<int>>>")
    short = classes.join(F.broadcast(made), "n").select("first", "p", "n", "w", F.inline("own"))  # LONGEST rows
    short = short.withColumn("items", F.transform("pick", lambda i: F.get("w", i))).drop("pick")
    single = F.explode(F.slice("w", F.lit(1), (F.col("n") - F.floor(F.col("n") * min_jaccard)).cast("int")))
    long = classes.filter(F.col("n") > LONGEST * min_jaccard - 1).select("first", "p", "n", "w", single.alias("item"))
    long = long.select("first", "p", "n", "w", *[F.lit(x).alias(c) for c, x in (("lo", 0), ("hi", 0), ("k", 1), ("sure", False))], F.array("item").alias("items"))
    return short.unionByName(long).withColumn("key", F.xxhash64("p", "lo", "hi", "items"))


def _alike(meeting: DataFrame, min_jaccard: float) -> DataFrame:
    """(a, b, jaccard) of the classes over the threshold, each pair by the first actors that they share."""
    side = lambda x, size: meeting.filter((F.col("n") == F.col(size)) | (F.col("hi") == 0)).select("key", *[
        F.col(c).alias(f"{c}_{x}") for c in ("first", "p", "n", "w", "lo", "hi", "k", "items")
    ])
    both = side("a", "lo").join(side("b", "hi"), "key").filter(
        (F.col("p_a") == F.col("p_b")) & (F.col("lo_a") == F.col("lo_b")) & (F.col("hi_a") == F.col("hi_b"))
        & ((F.col("lo_a") < F.col("hi_a")) | (F.col("first_a") < F.col("first_b"))) & ((F.col("hi_a") > 0) | (F.greatest("n_a", "n_b") > LONGEST))
    )
    # a one-element array: what it holds is made once
    both = both.select("first_a", "first_b", "n_a", "n_b", "k_a", "items_a", F.explode(F.array(F.array_intersect("w_a", "w_b"))).alias("common"))
    both = both.withColumn("jaccard", F.size("common") / (F.col("n_a") + F.col("n_b") - F.size("common")))
    both = both.filter((F.col("jaccard") > min_jaccard) & (F.slice("common", F.lit(1), F.col("k_a")) == F.col("items_a")))
    return both.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"), "jaccard")


def _classes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of merge_classes(); classes (first, p, n, w): place, size and numbered actors, rare ones first."""
    place = ["event_type", "location"]
    rows = events.select("event_id", *place, F.array_sort(F.array_distinct("actors")).alias("w")).filter(F.size("w") > 0)
    rows = stored(rows.select("event_id", F.xxhash64(*place, "w").alias("s"), *place, "w"), "actor-rows")
    sets = stored(rows.groupBy("s").agg(F.min("event_id").alias("first"), *[F.first(c).alias(c) for c in (*place, "w")]), "actor-sets")
    one = sets.filter(" and ".join(f"{c} is not null" for c in place)).select("first", F.xxhash64(*place).alias("p"), F.explode("w").alias("actor"))
    ids = numbered(one.groupBy("actor").agg(F.count("*").alias("f")), "f", "actor").select("actor", "id")
    classes = one.join(ids, "actor").groupBy("first", "p").agg(F.array_sort(F.collect_list("id")).alias("w"))
    classes = stored(classes.select("first", "p", F.size("w").alias("n"), "w"), "actor-numbers")
    return rows.select("event_id", "s").join(sets.select("s", "first"), "s").select("event_id", "first"), classes


def merge_classes(events: DataFrame, min_jaccard: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """K1: (members, links). members (event_id, first): events of one type, location and set of actors are a class, named
    by its least event_id. links (a, b, jaccard): classes of one type and location whose actors are alike.

    Exact: two sets of these sizes over the threshold share so many actors that the first k of them stand among the
    first n - least + k of either. Sets of up to LONGEST actors meet on k actors at once, with as large a k as CHOICES
    allows, longer ones on one. Where they meet their numbered actors decide, so that no candidate is shuffled. Events
    without actors are in no class.
    """
    members, classes = _classes(events)
    return members, _alike(_meeting(classes, min_jaccard), min_jaccard)


def merge_candidates(events: DataFrame, min_jaccard: float = 0.6) -> DataFrame:
    """K1: (a, b, jaccard) of events of one type and location whose actors are alike, by way of classes: each event of a
    class with the class's first one, and the first ones of classes that are alike. Rows grow with the events of a class."""
    members, links = merge_classes(events, min_jaccard)
    own = members.filter(F.col("event_id") != F.col("first")).select(F.col("first").alias("a"), F.col("event_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return links.unionByName(own)


def merge_pairs(events: DataFrame, min_jaccard: float = 0.6) -> DataFrame:
    """K1: (a, b, jaccard) of all pairs of events, a < b, of one type and location whose actors are alike, those with the same
    actors too. Made from classes and their links: where two classes are alike, or one has several events, all their events
    are. Rows grow with the square of a class; a task holds parts of PART events, and no pair is shuffled."""
    members, links = merge_classes(events.filter("event_type is not null and location is not null"), min_jaccard)
    sizes = members.groupBy("first").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), (F.count("*") > 1).alias("several"))
    part = F.pmod(F.xxhash64("event_id"), F.col("parts")).cast("int").alias("part")
    ids = stored(members.join(sizes, "first").groupBy("first", "parts", "several", part).agg(F.collect_list("event_id").alias("ids")), "actor-parts")
    classes = ids.select("first", "parts", "several").distinct()
    own = classes.filter("several").select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("jaccard"))
    side = lambda x: ids.select(F.col("first").alias(x), F.col("part").alias(f"part_{x}"), F.col("ids").alias(f"ids_{x}"))
    of_b = classes.select(F.col("first").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"))
    both = links.unionByName(own).join(of_b, "b").join(side("a"), "a").join(side("b"), ["b", "part_b"]).filter("a <> b or part_a <= part_b")
    one = both.select("a", "b", "part_a", "part_b", "ids_b", "jaccard", F.explode("ids_a").alias("x"))
    one = one.select("a", "b", "part_a", "part_b", "jaccard", "x", F.explode("ids_b").alias("y")).filter("x < y or x > y and (a <> b or part_a < part_b)")
    return one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def merge_groups(events: DataFrame, min_jaccard: float = 0.6) -> DataFrame:
    """K1: (event_id, into): the least event that an event with actors reaches. Of the classes' links only enough are followed:
    where sharing a key's actors is enough for a link, each class there is tied to the least one."""
    members, classes = _classes(events)
    meeting = _meeting(classes, min_jaccard)
    here = Window.partitionBy("key", "p", "lo", "hi", "items")
    sure = meeting.filter("sure").select("key", "p", "lo", "hi", "items", "n", "first").withColumns({
        "least": F.min("first").over(here), "shortest": F.min("n").over(here), "longest": F.max("n").over(here)
    })
    ties = sure.filter("shortest = lo and longest = hi and first <> least").select(F.col("first").alias("a"), F.col("least").alias("b"))
    links = ties.unionByName(_alike(meeting.filter("not sure"), min_jaccard).select("a", "b"))
    part = connected_components(links, "a", "b").toDF("first", "into")
    return members.join(part, "first", "left").select("event_id", F.coalesce("into", "first").alias("into"))


def apply_merges(heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """K2: apply_groups() along pairs (a, b) of events."""
    return apply_groups(heads, connected_components(pairs, "a", "b").toDF("event_id", "into"))


def apply_groups(heads: DataFrame, groups: DataFrame) -> DataFrame:
    """K2: heads (event_id, canonical_title, first_seen, last_seen, peak_risk, sources) merged by groups (event_id, into).

    Earliest first_seen, latest last_seen, highest peak, the title of the least id, the other titles as aliases, the
    united sources as evidence, and the count of the others. An event without a group is its own. Titles and sources are
    made distinct in each task before they are shuffled.
    """
    named = heads.join(groups, "event_id", "left").withColumn("into", F.coalesce("into", "event_id"))
    out = named.groupBy("into").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("peak_risk").alias("peak_risk"),
        (F.count("*") - 1).alias("merged"), F.min_by("canonical_title", "event_id").alias("canonical_title"),
        F.array_sort(F.collect_set("canonical_title")).alias("_titles"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("evidence")
    )
    aliases = F.filter("_titles", lambda t: ~t.eqNullSafe(F.col("canonical_title")))
    return out.select(
        F.col("into").alias("event_id"), "canonical_title", aliases.alias("aliases"), "first_seen", "last_seen", "peak_risk", "merged",
        "evidence"
    )


def lifecycle(heads: DataFrame, as_of: Column) -> DataFrame:
    """K3: status by days since last seen: 180 archived, 90 and risk under 20 resolved, 60 cooling, else active."""
    age = F.datediff(as_of, "last_seen")
    return heads.withColumn(
        "status",
        F.when(age >= 180, "archived").when((age >= 90) & (F.col("risk") < 20), "resolved").when(age >= 60, "cooling").otherwise("active")
    )


def dual_risk(assessments: DataFrame, rule_scores: DataFrame, gap: float = 3) -> DataFrame:
    """K4: model and rule score of each event, and whether they are more than gap apart."""
    return assessments.join(rule_scores, "event_id").withColumn("review", F.abs(F.col("model_score") - F.col("rule_score")) > gap)


def compare_assessments(assessments: DataFrame) -> DataFrame:
    """K5: each version of an event's assessment on a date with its change from the version before."""
    return assessments.withColumn("change", F.col("score") - F.lag("score").over(Window.partitionBy("event_id", "date").orderBy("version")))


def validate_relations(edges: DataFrame, events: DataFrame, as_of: Column, max_age: int = 90, min_confidence: float = 0.2) -> DataFrame:
    """K6: distinct live edges between known events, of enough confidence and confirmed within max_age days."""
    known = events.select("event_id").distinct()
    ok = edges.filter((F.col("confidence") >= min_confidence) & (F.col("src") != F.col("dst")) & (F.datediff(as_of, "date") <= max_age))
    ok = ok.groupBy("src", "dst", "relation").agg(F.max("date").alias("last_confirmed"), F.max("confidence").alias("confidence"))
    return ok.join(
        known.withColumnRenamed("event_id", "src"), "src", "left_semi"
    ).join(known.withColumnRenamed("event_id", "dst"), "dst", "left_semi")


def source_credibility(evidence: DataFrame) -> DataFrame:
    """K7: of each source its evidence rows, events and days."""
    return evidence.groupBy("source").agg(
        F.count("*").alias("evidence"), F.countDistinct("event_id").alias("events"), F.countDistinct("date").alias("days")
    )
