"""Queries over event tables: revisions, heads, risk, evolution, relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scalars as S
from newsloom.functions import vocab as V
from newsloom.operators import events as E
from newsloom.operators import risk as R
from newsloom.plans.registry import DAILY, NEWS, THEMES, daily, news, query, table, themes
from newsloom.sources import scan, sinks

DAY = "2024-01-31"
TRANSITIONS = {
    ("diplomatic", "sanction"): 10, ("sanction", "military"): 25, ("economic", "military"): 20, ("military", "diplomatic"): -15,
    ("financial", "economic"): 5, ("diplomatic", "military"): 30, ("military", "financial"): 8
}
_DELTA = "CASE {a} || '→' || {b} " + " ".join(f"WHEN '{x}→{y}' THEN {v}" for (x, y), v in TRANSITIONS.items()) + " ELSE 0 END"


def day(text: str = DAY):
    return F.lit(text).cast("date")


def revisions(spark, d):
    return E.build_revisions(daily(spark, d))


@query(f"WITH {DAILY} SELECT event_id, date, phase, risk, risk_delta, phase_transition FROM revs")
def e1_build_revisions(spark, d):
    return revisions(spark, d).select("event_id", "date", "phase", "risk", "risk_delta", "phase_transition")


@query(f"WITH {DAILY} SELECT * FROM heads")
def d9_event_heads(spark, d):
    return E.event_heads(revisions(spark, d))


@query(f"WITH {DAILY}, t AS (SELECT event_id, date, risk, row_number() OVER (PARTITION BY event_id ORDER BY date DESC) AS rank FROM revs) SELECT event_id, date, risk, CAST(rank AS INT) AS rank FROM t WHERE rank <= 7")
def e2_timeline(spark, d):
    return E.timeline(revisions(spark, d), 7).select("event_id", "date", "risk", "rank")


@query(f"WITH {DAILY} SELECT event_id, risk FROM heads WHERE status = 'active' AND risk >= 20 AND event_id % 3 = 0")
def b12_active_events(spark, d):
    heads = E.event_heads(revisions(spark, d)).withColumn("region", F.when(F.col("event_id") % 3 == 0, "ME").otherwise("EU"))
    return E.active_events(heads, "ME", 20).select("event_id", "risk")


@query(f"WITH {DAILY} SELECT event_id, last_seen FROM heads WHERE last_seen >= DATE '{DAY}' - 3")
def b12_recent_events(spark, d):
    return E.recent_events(E.event_heads(revisions(spark, d)), day(), 3).select("event_id", "last_seen")


@query(f"WITH {DAILY} SELECT event_id, revisions, peak_risk FROM heads WHERE event_id = 7")
def b13_event_by_id(spark, d):
    return E.event_by_id(E.event_heads(revisions(spark, d)), 7).select("event_id", "revisions", "peak_risk")


@query("SELECT p_partkey AS event_id, p_name AS canonical_title FROM part WHERE upper(replace(p_type, ' ', '_')) || '||' || upper(replace(p_brand, ' ', '_')) || '|' = (SELECT upper(replace(p_type, ' ', '_')) || '||' || upper(replace(p_brand, ' ', '_')) || '|' FROM part WHERE p_partkey = 7)")
def b13_event_by_key(spark, d):
    key = S.identity_key(F.col("p_type"), F.array().cast("array<string>"), F.col("p_brand"), F.lit(None).cast("string"))
    heads = table(spark, d, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("canonical_title"), key.alias("identity_key"))
    wanted = E.event_by_id(heads, 7).first().identity_key
    return E.event_by_key(heads, wanted).drop("identity_key")


@query(f"WITH {DAILY} SELECT event_id, risk FROM heads WHERE event_id IN (SELECT event_id FROM revs WHERE date = DATE '2024-01-15') ORDER BY risk DESC, event_id LIMIT 50")
def c12_events_by_date(spark, d):
    r = revisions(spark, d)
    return E.events_by_date(E.event_heads(r), r, day("2024-01-15"), 50).select("event_id", "risk")


@query(f"""WITH {DAILY}, top AS (SELECT event_id FROM heads WHERE risk >= 20 ORDER BY risk DESC, event_id LIMIT 5),
t AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY date DESC) AS k FROM revs WHERE event_id IN (SELECT event_id FROM top)),
m AS (SELECT *, coalesce(lag(phase) OVER (PARTITION BY event_id ORDER BY date) <> phase, true) AS new FROM t WHERE k <= 7)
SELECT event_id, array_to_string((list(phase ORDER BY date) FILTER (WHERE new))[1:5], '→') AS phases,
CASE WHEN arg_max(risk, date) > arg_min(risk, date) THEN '↑' WHEN arg_max(risk, date) < arg_min(risk, date) THEN '↓' ELSE '→' END AS arrow, CAST(count(*) FILTER (WHERE new) - 1 AS BIGINT) AS transitions FROM m GROUP BY event_id""")
def e3_timeline_digest(spark, d):
    r = revisions(spark, d)
    return E.timeline_digest(E.event_heads(r), r)


@query(f"WITH {DAILY}, t AS (SELECT * FROM revs) SELECT event_id, arg_max(summary, date) AS summary FROM t GROUP BY event_id")
def c13_search_corpus(spark, d):
    r = revisions(spark, d)
    return E.search_corpus(E.event_heads(r), r).select("event_id", "summary")


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("event_id"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus")).alias("summary"),
        F.array(F.concat(F.lit("s"), (F.col("o_orderkey") % 5).cast("string")), F.col("o_orderstatus")).alias("sources")
    )


_ORD = "o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS pos, o_custkey AS event_id, o_orderpriority || ' ' || o_orderstatus AS summary, ['s' || CAST(o_orderkey % 5 AS VARCHAR), o_orderstatus] AS sources FROM orders)"


@query(f"""WITH {_ORD}, r AS (SELECT event_id, date, sha256(summary) AS content_hash FROM o WHERE pos % 2 = 1),
x AS (SELECT event_id, date, sha256(summary) AS content_hash FROM o WHERE pos % 2 = 0)
SELECT DISTINCT event_id, date, content_hash FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.event_id = r.event_id AND x.date = r.date AND x.content_hash = r.content_hash)""")
def c18_append_evidence(spark, d):
    o = _orders(spark, d)
    old = o.filter("pos % 2 = 0").select("event_id", "date", F.sha2("summary", 256).alias("content_hash"))
    return E.append_evidence(old, o.filter("pos % 2 = 1")).select("event_id", "date", "content_hash")


_EDGES = "w AS (SELECT date, event_id AS src, unnest([lead(event_id, 1) OVER v, lead(event_id, 2) OVER v]) AS dst FROM o WINDOW v AS (PARTITION BY date ORDER BY pos)), ed AS (SELECT date, src, dst FROM w WHERE dst IS NOT NULL AND src <> dst)"


@query(f"WITH {_ORD}, {_EDGES} SELECT date, src, dst, 'related_to' AS relation, 0.3::DOUBLE AS confidence FROM ed")
def c19_cooccurrence(spark, d):
    return E.cooccurrence_edges(_orders(spark, d))


@query(f"""WITH {_ORD}, {_EDGES}, o1 AS (SELECT src, dst, min(date) AS f, max(date) AS l, count(*) AS n FROM ed WHERE date < DATE '2020-01-01' GROUP BY ALL),
n1 AS (SELECT src, dst, min(date) AS f, max(date) AS l, count(*) AS n FROM ed WHERE date >= DATE '2020-01-01' GROUP BY ALL)
SELECT coalesce(o1.src, n1.src) AS src, coalesce(o1.dst, n1.dst) AS dst, coalesce(o1.f, n1.f) AS first_seen, coalesce(n1.l, o1.l) AS last_confirmed, CAST(coalesce(o1.n, 0) + coalesce(n1.n, 0) AS INT) AS n
FROM o1 FULL JOIN n1 ON o1.src = n1.src AND o1.dst = n1.dst""")
def c20_upsert_relations(spark, d):
    e = E.cooccurrence_edges(_orders(spark, d))
    none = spark.createDataFrame(
        [],
        "src long, dst long, relation string, first_seen date, last_confirmed date, expired date, history array<struct<date:date,confidence:double>>"
    )
    one = E.upsert_relations(none, e.filter("date < '2020-01-01'"))
    return E.upsert_relations(one, e.filter("date >= '2020-01-01'")).select(
        "src", "dst", "first_seen", "last_confirmed", F.size("history").alias("n")
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'given' ELSE printf('evt_%03d', c_custkey + 1) END AS event_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS title,
CASE c_custkey % 6 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS signal_level, c_name || '|' || c_mktsegment AS actors, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'x|y' END AS sources,
CASE WHEN c_custkey % 2 = 0 THEN '军事' ELSE '政治' END AS event_type, CAST(CASE WHEN c_custkey % 7 = 0 THEN 9 WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 END AS INT) AS source_count FROM customer""")
def b5_normalize_events(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    none = F.lit(None).cast("string")
    raw = c.select(
        k.alias("pos"), F.when(k % 3 == 0, "given").alias("event_id"), F.when(k % 5 != 0, F.col("c_name")).alias("title"),
        F.element_at(
            F.array(F.lit("s"), F.lit(" A "), F.lit("b"), F.lit("c"), F.lit("urgent"), none), (k % 6 + 1).cast("int")
        ).alias("signal_level"), F.concat("c_name", F.lit(", ,"), "c_mktsegment").alias("actors"),
        F.when(k % 4 != 0, "x、 y").alias("sources"), F.when(k % 2 == 0, "军事").alias("event_type"), F.when(k % 7 == 0, 9).alias("source_count"),
    )
    joined = lambda c: F.array_join(c, "|").alias(c)
    return E.normalize_events(raw).select(
        F.col("pos").alias("c_custkey"), "event_id", "title", "signal_level", joined("actors"), joined("sources"), "event_type",
        "source_count"
    )


@query(f"WITH {DAILY} SELECT count(*) FILTER (WHERE signal_level = 'S') AS s_events, count(*) FILTER (WHERE signal_level = 'A') AS a_events, count(DISTINCT phase) AS regions, count(*) FILTER (WHERE signal_level = 'S') > 1 AS many_s, count(*) FILTER (WHERE signal_level = 'A') > 5 AS many_a, count(DISTINCT phase) < 3 AS few_regions FROM revs")
def b6_event_quality(spark, d):
    return E.event_quality(revisions(spark, d).withColumn("region", F.col("phase")))


@query("SELECT o_custkey AS cluster_id, CAST(count(*) AS INT) AS event_count, CASE WHEN count(*) > 5 THEN '高' WHEN count(*) > 1 THEN '中' ELSE '低' END AS consensus, '全球' AS region FROM orders GROUP BY o_custkey")
def b7_normalize_clusters(spark, d):
    raw = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.collect_list("o_orderkey").alias("events")).withColumns({
        "source_count": F.lit(None).cast("int"), "is_emerging": F.lit(None).cast("boolean"), "region": F.lit(None).cast("string")
    })
    return E.normalize_clusters(raw).select("cluster_id", "event_count", "consensus", "region")


def _parts(spark, d):
    n = news(spark, d)
    lean = F.when(F.col("id") % 3 == 0, "中立").otherwise(F.concat(F.lit("l"), (F.col("id") % 2).cast("string")))
    return n.select(
        F.col("source").alias("event_id"), "pos", "title", F.array("region", "source").alias("actors"),
        F.array(F.col("source")).alias("sources"), F.array(F.col("region")).alias("domains"), F.array(F.lit("")).alias("related_events"),
        F.when(F.col("id") % 7 == 0, "A").otherwise("C").alias("signal_level"), "summary", F.col("region").alias("phase"),
        F.lit("up").alias("trend"), F.lit("高").alias("confidence"), lean.alias("source_lean"), F.lit("").alias("lean_reasoning")
    )


@query(f"""WITH {NEWS}, g AS (SELECT source, region, min(pos) AS m FROM news GROUP BY ALL), l AS (SELECT source, list(region ORDER BY m) AS rs FROM g GROUP BY source)
SELECT news.source AS event_id, arg_min(title, pos) AS title, CASE WHEN bool_or(id % 7 = 0) THEN 'A' ELSE 'C' END AS signal_level, (list(summary ORDER BY length(summary) DESC, pos))[1] AS summary, arg_max(region, pos) AS phase,
CASE WHEN count(DISTINCT id % 2) FILTER (WHERE id % 3 <> 0) > 1 THEN '混合' WHEN count(*) FILTER (WHERE id % 3 <> 0) = 0 THEN '中立' ELSE 'l' || CAST(min(id % 2) FILTER (WHERE id % 3 <> 0) AS VARCHAR) END AS source_lean,
any_value(rs)[1] || ',' || news.source || CASE WHEN len(any_value(rs)) > 1 THEN ',' || array_to_string(any_value(rs)[2:], ',') ELSE '' END AS actors, news.source AS sources, array_to_string(any_value(rs), ',') AS domains FROM news JOIN l ON l.source = news.source GROUP BY news.source""")
def d1_merge_events(spark, d):
    m = E.merge_events(_parts(spark, d))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return m.select("event_id", "title", "signal_level", "summary", "phase", "source_lean", joined("actors"), joined("sources"), joined("domains"))


@query("SELECT (SELECT count(*) FROM orders) AS events, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS clusters, (SELECT count(*) FROM orders) >= 10 AND (SELECT count(DISTINCT o_orderstatus) FROM orders) < 5 AS few")
def b7_few_clusters(spark, d):
    o = table(spark, d, "orders")
    return E.few_clusters(o.select("o_orderstatus").distinct(), o)


@query(f"WITH {NEWS} SELECT source AS cluster_id, count(*) AS event_count, CAST(count(DISTINCT region) AS INT) AS source_count, CASE WHEN bool_or(id % 7 = 0) THEN 'A' ELSE 'C' END AS highest_signal, CAST(1 AS INT) AS actors, count(DISTINCT region) AS regions FROM news GROUP BY source")
def d23_rollup_clusters(spark, d):
    n = news(spark, d).select(
        F.col("id").alias("event_id"), F.array("region").alias("sources"), F.array("source").alias("actors"), "region",
        F.when(F.col("id") % 7 == 0, "A").otherwise("C").alias("signal_level")
    )
    a = news(spark, d).select(F.col("id").alias("event_id"), F.col("source").alias("cluster_id"))
    return E.rollup_clusters(n, a)


@query("SELECT p_partkey, upper(replace(p_type, ' ', '_')) || '|' || upper(p_brand) || ',' || 'X' || '|' || upper(replace(p_name, ' ', '_')) || '|' AS key, 'evt_' || substr(sha256(upper(replace(p_type, ' ', '_')) || '|' || upper(p_brand) || ',' || 'X' || '|' || upper(replace(p_name, ' ', '_')) || '|'), 1, 8) AS event_id FROM part")
def h3_identity_key(spark, d):
    key = S.identity_key(F.col("p_type"), F.array(F.col("p_brand"), F.lit(" x "), F.col("p_brand")), F.col("p_name"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", key.alias("key"), S.event_id(key).alias("event_id"))


_NAMES = [("green", "GRN"), ("blue", "BLU"), ("red", "RED"), ("widget", "WDG"), ("steel", "STL"), ("st", "ST")]


@query("""WITH n AS (SELECT p_partkey, unnest([1, 2, 3, 4, 5, 6]) AS k, unnest(['widget', 'green', 'steel', 'blue', 'red', 'st']) AS name, unnest(['WDG', 'GRN', 'STL', 'BLU', 'RED', 'ST']) AS code, p_name FROM part),
f AS (SELECT p_partkey, k, code FROM n WHERE CASE name WHEN 'st' THEN regexp_matches(p_name, '(?i)(^|[^a-z])st([^a-z]|$)') ELSE contains(lower(p_name), name) END),
r AS (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY k) AS i FROM f)
SELECT part.p_partkey, coalesce(string_agg(code, ',' ORDER BY i), '') AS codes FROM part LEFT JOIN r ON r.p_partkey = part.p_partkey AND i <= 2 GROUP BY part.p_partkey""")
def h6_extract_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(S.extract_codes(F.col("p_name"), _NAMES, 2), ",").alias("codes"))


_HAS = "CASE WHEN contains(t, '{0}') THEN '{1}' END"
_NOT_WORD = "[^\\p{L}\\p{M}\\p{N}_]+"


@query(f"""WITH {NEWS}, x AS (SELECT id, title, lower(title) AS t FROM news),
c AS (SELECT *, list_filter([{", ".join(_HAS.format(n, c) for n, c in (("keit", "KEIT"), ("aux", "AUX"), ("the", "THE")))}], lambda v: v IS NOT NULL)[1:2] AS who, list_filter([{_HAS.format("tion", "TION")}, CASE WHEN regexp_matches(title, '(?i)(^|[^\\p{{L}}])en([^\\p{{L}}]|$)') THEN 'EN' END], lambda v: v IS NOT NULL) AS rest FROM x),
k AS (SELECT *, list_concat(who, rest) AS codes FROM c)
SELECT id, CASE WHEN len(codes) >= 2 THEN lower(array_to_string(codes, '-')) WHEN contains(t, 'rights') AND NOT contains(t, 'mit') THEN 'rights' ELSE substr(trim(regexp_replace(t, '{_NOT_WORD}', '-', 'g'), '-'), 1, 30) || '-' || substr(md5(title), 1, 8) END AS event_id FROM k""")
def h5_canonical_event_id(spark, d):
    return news(spark, d).select(
        "id",
        S.canonical_event_id(
            F.col("title"), [("aux", "AUX"), ("keit", "KEIT"), ("the", "THE")], [("tion", "TION")], [("en", "EN")],
            [("rights", 9, ["rights"], ["mit"])]
        ).alias("event_id")
    )


@query(f"""WITH {NEWS}, x AS (SELECT id, title, lower(title) AS t, upper(region) AS region, upper(source) AS source FROM news),
c AS (SELECT *, list_filter([{", ".join(_HAS.format(n, c) for n, c in (("keit", "KEIT"), ("the", "THE")))}], lambda v: v IS NOT NULL) AS who FROM x)
SELECT id, region || '|' || CASE WHEN len(who) > 0 THEN array_to_string(list_sort(who), ',') ELSE source END || '|' || substr(source, 1, 30) || '|' || coalesce({_HAS.format("tion", "TION")}, upper(replace(trim(regexp_replace(substr(title, 1, 40), '{_NOT_WORD}', '_', 'g'), '_'), 'ß', 'SS'))) AS identity_key FROM c""")
def h4_derive_identity(spark, d):
    return news(spark, d).select(
        "id",
        S.derive_identity(
            F.col("title"), F.array("source"), F.lit(None).cast("string"), F.array("region", "source"), [("keit", "KEIT"), ("the", "THE")],
            [("tion", "TION")]
        ).alias("identity_key")
    )


@query(f"WITH {DAILY} SELECT event_id, date, greatest(0, least(100, CASE signal_level WHEN 'S' THEN 85 WHEN 'A' THEN 65 WHEN 'B' THEN 45 ELSE 25 END + CASE phase WHEN 'military' THEN 15 WHEN 'financial' THEN 10 WHEN 'sanction' THEN 8 WHEN 'economic' THEN 5 ELSE 0 END)) AS est FROM revs")
def h10_estimate_risk(spark, d):
    return revisions(spark, d).select("event_id", "date", S.estimate_risk(F.col("signal_level"), F.col("phase")).alias("est"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN event_id % 4 = 1 THEN '中东' WHEN event_id % 4 = 2 THEN '欧洲' ELSE '全球' END AS region,
CASE WHEN event_id % 4 = 1 THEN '军事' ELSE CASE event_type WHEN 'error' THEN '军事' WHEN 'view' THEN '外交' ELSE '政治' END END AS type FROM events""")
def h10_inferences(spark, d):
    k = F.col("event_id")
    level = F.element_at(F.array(*map(F.lit, ("HIGH", "中", "low", "unsure", "medium"))), (k % 5 + 1).cast("int"))
    domains = F.when(k % 4 == 1, F.array(F.lit("军事"), F.lit("中东"))).when(k % 4 == 2, F.array(F.lit("other"), F.lit("欧洲"))).otherwise(F.array(F.lit("other")))
    phase = F.when(F.col("event_type") == "error", "military").when(F.col("event_type") == "view", "diplomatic").otherwise("unknown")
    return table(spark, d, "events").select(
        "event_id", S.estimate_confidence(level).alias("confidence"), S.infer_region(domains).alias("region"),
        S.infer_type(domains, phase).alias("type")
    )


_RULES = [
    ("military", ["error"], ["diplomatic"]), ("sanction", ["click"], ["diplomatic"]), ("financial", ["view"], None),
    ("economic", ["signup"], ["military"])
]
_STEPS = {("diplomatic", "military"): 30, ("diplomatic", "sanction"): -5, ("diplomatic", "economic"): 7}


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'military' WHEN 'click' THEN 'sanction' WHEN 'view' THEN 'financial' ELSE 'diplomatic' END AS phase FROM events")
def h11_detect_phase(spark, d):
    return table(spark, d, "events").select("event_id", S.detect_phase(F.lit("diplomatic"), F.col("event_type"), _RULES).alias("phase"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'military' WHEN 'click' THEN 'sanction' WHEN 'view' THEN 'financial' ELSE 'diplomatic' END AS phase,
  CASE event_type WHEN 'error' THEN 30 WHEN 'click' THEN -5 ELSE 0 END AS risk_delta,
  CASE event_type WHEN 'error' THEN 'diplomatic → military (风险增量: +30)' WHEN 'click' THEN 'diplomatic → sanction (风险增量: -5)' ELSE '' END AS transition FROM events""")
def h11_phase_change(spark, d):
    return table(spark, d, "events").select("event_id", S.phase_change(F.lit("diplomatic"), F.col("event_type"), _STEPS, _RULES).alias("c")).select("event_id", "c.*")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'law' WHEN regexp_matches(text, '(?i)keit') THEN 'de' ELSE 'other' END AS theme FROM documents")
def h12_normalize_theme(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", S.normalize_theme(F.col("text"), [("license", "law"), ("keit", "de")], "other").alias("theme")
    )


@query("SELECT event_id, greatest(0.1, exp(-0.693::DOUBLE * (date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31') / 3600.0::DOUBLE) / 72)) AS decay, CASE WHEN date_diff('second', CAST(CAST(ts AS DATE) AS TIMESTAMP), TIMESTAMP '2024-01-31') <= 0 THEN 1.0 ELSE greatest(0.1, round(pow(0.9::DOUBLE, date_diff('second', CAST(CAST(ts AS DATE) AS TIMESTAMP), TIMESTAMP '2024-01-31') / 3600.0::DOUBLE / 48), 3)) END AS signal FROM events")
def h9_decay(spark, d):
    now = F.lit(DAY).cast("timestamp")
    return table(spark, d, "events").select(
        "event_id", S.time_decay(F.col("ts"), now).alias("decay"), S.signal_decay(F.to_date("ts"), F.lit("A"), now).alias("signal")
    )


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'licensed') THEN 1.5 WHEN doc_id % 5 >= 3 THEN 1.3 WHEN contains(source, 'src1') THEN 0.5 ELSE 0.8 END::DOUBLE AS multiplier FROM documents")
def h8_confirmation(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", S.confirmation(F.col("text"), F.col("source"), (F.col("doc_id") % 5), ["licensed"], ["src1"]).alias("multiplier")
    )


# ---- themes ----
TOPICS = {"rights": ["rights", "license"], "insult": ["worthless", "disgusting", "scum"], "keys": ["token", "password"]}


def _quality(spark, d):
    return news(spark, d).withColumn("quality", (F.substring("source", 4, 3).cast("int") % 4 + 1) / 8.0)


def _signals(spark, d):
    dim = F.element_at(F.array(F.lit("government"), F.lit("financial"), F.lit("energy"), F.lit("think_tank")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select(dim.alias("dimension"), "text")


_TOPIC = ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}' END" for t, ws in TOPICS.items()
)
_MEDIA = f"hit AS (SELECT doc_id, source, unnest(list_filter([{_TOPIC}], lambda x: x IS NOT NULL)) AS theme FROM documents), tm AS (SELECT DISTINCT theme, source, (CAST(substr(source, 4) AS INT) % 4 + 1) / 8.0::DOUBLE AS quality FROM hit), th AS (SELECT theme, ['government', 'financial', 'energy', 'think_tank'][CAST(doc_id % 4 + 1 AS INT)] AS dimension, count(*) AS hits FROM hit GROUP BY ALL)"


@query(f"WITH {_MEDIA} SELECT * FROM tm")
def c6_theme_media(spark, d):
    return R.theme_media(_quality(spark, d), TOPICS)


@query(f"WITH {_MEDIA} SELECT * FROM th")
def c7_theme_signal_hits(spark, d):
    return R.theme_signal_hits(_signals(spark, d), TOPICS)


def _theme_scores(spark, d):
    return R.score_themes(R.theme_media(_quality(spark, d), TOPICS), R.theme_signal_hits(_signals(spark, d), TOPICS), list(TOPICS))


_TS = f"""{_MEDIA}, p AS (SELECT t.theme, least(25, CAST(trunc(25 * coalesce((SELECT sum(quality) FROM tm WHERE tm.theme = t.theme), 0) / 5) AS INT)) AS media_part,
 {', '.join(f"least({c}, {m} * CAST(coalesce((SELECT sum(hits) FROM th WHERE th.theme = t.theme AND dimension = '{n}'), 0) AS INT)) AS {n}_part" for n, c, m in (("government", 25, 5), ("financial", 25, 5), ("energy", 25, 5), ("think_tank", 5, 2)))}
 FROM (SELECT unnest(['rights', 'insult', 'keys']) AS theme) AS t),
ts AS (SELECT *, CAST(floor(least(100, (government_part * 0.4::DOUBLE + financial_part * 0.25 + energy_part * 0.2 + media_part * 0.1 + think_tank_part * 0.05) / 24.0 * 100) + 1e-9) AS INT) AS score FROM p),
tl AS (SELECT *, CASE WHEN score >= 80 THEN 'S' WHEN score >= 60 THEN 'A' WHEN score >= 35 THEN 'B' ELSE 'C' END AS signal_level FROM ts)"""


@query(f"WITH {_TS} SELECT theme, government_part, financial_part, energy_part, media_part, think_tank_part, score, signal_level FROM tl")
def d4_score_themes(spark, d):
    return _theme_scores(spark, d)


_RANK = "CASE WHEN {0} >= 80 THEN 4 WHEN {0} >= 60 THEN 3 WHEN {0} >= 35 THEN 2 ELSE 1 END"
_RATE = "CASE l " + " ".join(f"WHEN {k} THEN {V.LEVEL_RATES.get(n, 0.80)}" for k, n in enumerate("CBAS", 1)) + " END"


@query(f"""WITH {_TS}, f AS (SELECT bool_or(contains(lower(text), 'license')) AND bool_or(contains(lower(text), 'token')) AS one, bool_or(contains(lower(text), 'nowhere to be found')) AS two FROM documents),
a AS (SELECT theme, least(100, score + CASE WHEN one THEN 10 ELSE 0 END + CASE WHEN two THEN 50 ELSE 0 END)::DOUBLE AS s1, greatest({_RANK.format("score")}, CASE WHEN one THEN 3 ELSE 1 END, CASE WHEN two THEN 4 ELSE 1 END) AS l0 FROM tl, f),
b AS (SELECT theme, floor(s1 * CASE WHEN theme = 'rights' THEN 0.8 ELSE 1.0 END::DOUBLE + 1e-9) AS s2, greatest(l0, {_RANK.format("s1")}) AS l1 FROM a),
e AS (SELECT theme, s2, greatest(l1, {_RANK.format("s2")}) AS l, date_diff('hour', coalesce((SELECT min(DATE '{DAY}' - CAST(doc_id % 40 AS INT)) FROM hit WHERE hit.theme = b.theme AND doc_id % 40 < 30), DATE '{DAY}')::TIMESTAMP, TIMESTAMP '{DAY}') AS h FROM b)
SELECT theme, CAST(floor(s2 * CASE WHEN h <= 0 THEN 1.0 ELSE greatest(0.1, round(pow(({_RATE})::DOUBLE, h / 48.0::DOUBLE), 3)) END::DOUBLE + 1e-9) AS INT) AS score, ['C', 'B', 'A', 'S'][l] AS signal_level FROM e""")
def d5_escalate_themes(spark, d):
    rules = [{"triggers": ["license", "token"], "bonus": 10, "level": "A"}, {"triggers": ["nowhere to be found"], "bonus": 50, "level": "S"}]
    leans = spark.range(1).select(F.lit("rights").alias("theme"), F.lit(True).alias("divergent"))
    first = _dated_text(spark, d)
    return R.escalate_themes(_theme_scores(spark, d), _signals(spark, d), rules, leans, R.theme_first_seen(first, TOPICS, day()), day())


def _dated_text(spark, d):
    return table(spark, d, "documents").select(F.date_sub(day(), (F.col("doc_id") % 40).cast("int")).alias("date"), "text")


@query(f"WITH {_MEDIA} SELECT t.theme, coalesce((SELECT min(DATE '{DAY}' - CAST(doc_id % 40 AS INT)) FROM hit WHERE hit.theme = t.theme AND doc_id % 40 < 30), DATE '{DAY}') AS first_seen FROM (SELECT unnest(['rights', 'insult', 'keys']) AS theme) AS t")
def c8_theme_first_seen(spark, d):
    return R.theme_first_seen(_dated_text(spark, d), TOPICS, day())


@query(f"WITH {THEMES} SELECT t.theme, CAST(x.date AS DATE) AS date, sc.score FROM (SELECT DISTINCT theme FROM sc) AS t CROSS JOIN (SELECT unnest(generate_series(DATE '{DAY}' - 10, DATE '{DAY}' - 1, INTERVAL 1 DAY)) AS date) AS x LEFT JOIN sc ON sc.theme = t.theme AND sc.date = x.date")
def a9_score_spine(spark, d):
    return scan.score_spine(themes(spark, d), day(), 10)


@query(f"""WITH {THEMES}, e AS (SELECT theme, arg_min(score, date) AS f, min(date) AS a, max(date) AS b, count(*) AS n FROM sc WHERE date >= DATE '2024-01-20' - 3 AND date < DATE '2024-01-20' GROUP BY theme),
m AS (SELECT sc.theme, CASE WHEN n >= 2 THEN round((score - f) / greatest(date_diff('day', a, b), 1)::DOUBLE, 1) ELSE 0.0 END AS momentum FROM sc LEFT JOIN e USING (theme) WHERE date = DATE '2024-01-20')
SELECT theme, momentum, CASE WHEN momentum > 0 THEN 'rising' WHEN momentum < 0 THEN 'cooling' ELSE 'stable' END AS trend FROM m""")
def e4_momentum(spark, d):
    return R.momentum(themes(spark, d), day("2024-01-20"))


@query(f"""WITH {THEMES}, v AS (SELECT theme, list(score ORDER BY date) AS v FROM sc WHERE date >= DATE '2024-01-20' - 5 AND date < DATE '2024-01-20' GROUP BY theme)
SELECT theme, CASE WHEN len(v) >= 3 THEN round(score - v[-1] - CASE WHEN len(v) >= 4 THEN (v[-2] - v[1]) / (len(v) - 2)::DOUBLE ELSE 0 END, 1) ELSE 0.0 END AS acceleration FROM sc JOIN v USING (theme) WHERE date = DATE '2024-01-20'""")
def e5_acceleration(spark, d):
    return R.acceleration(themes(spark, d), day("2024-01-20"))


def _mentions(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("theme"), F.to_date("ts").alias("date")).agg(F.count("*").alias("mentions"))


_TRAJ = """mn AS (SELECT event_type AS theme, CAST(ts AS DATE) AS date, count(*) AS mentions FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY date) AS i, count(*) OVER (PARTITION BY theme) AS n FROM mn),
tj AS (SELECT theme, count(*) AS days, CAST(sum(mentions) AS BIGINT) AS total, min(date) AS first_seen, max(date) AS last_seen, round((avg(mentions) FILTER (WHERE i > floor(n / 2)) - avg(mentions) FILTER (WHERE i <= floor(n / 2))) * 10, 4) AS trend_score FROM r GROUP BY theme HAVING count(*) >= 2)"""


@query(f"WITH {_TRAJ} SELECT *, CASE WHEN trend_score > 1 THEN 'rising' WHEN trend_score < -1 THEN 'falling' ELSE 'stable' END AS trend FROM tj")
def d8_theme_trajectory(spark, d):
    return R.trajectory(_mentions(spark, d), "theme", "mentions")


@query(f"WITH {_TRAJ} SELECT theme, trend_score FROM tj WHERE abs(trend_score) > 5 ORDER BY abs(trend_score) DESC, theme LIMIT 5")
def f2_inflections(spark, d):
    return R.inflections(R.trajectory(_mentions(spark, d), "theme", "mentions")).select("theme", "trend_score")


_TREND = "CASE WHEN trend_score > {0} THEN 'rising' WHEN trend_score < -{0} THEN 'falling' ELSE 'stable' END AS trend"


@query(f"""WITH {_TRAJ}, rg AS (SELECT user_id AS region, CAST(ts AS DATE) AS date, count(*) AS items FROM events GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date) AS i, count(*) OVER (PARTITION BY region) AS n FROM rg),
rt AS (SELECT region, count(*) AS days, sum(items) AS total, round(avg(items) FILTER (WHERE i > floor(n / 2)) - avg(items) FILTER (WHERE i <= floor(n / 2)), 4) AS trend_score FROM q GROUP BY region HAVING count(*) >= 2),
a AS (SELECT 'themes' AS part, row_number() OVER (ORDER BY -trend_score, theme) AS rank, theme AS name, trend_score::DOUBLE AS value, {_TREND.format(1)} FROM tj),
b AS (SELECT 'inflections' AS part, row_number() OVER (ORDER BY -abs(trend_score), theme) AS rank, theme AS name, trend_score::DOUBLE AS value, {_TREND.format(1)} FROM tj WHERE abs(trend_score) > 5),
c AS (SELECT 'emerging' AS part, row_number() OVER (ORDER BY -days, theme) AS rank, theme AS name, days::DOUBLE AS value, {_TREND.format(1)} FROM tj WHERE days <= 40),
e AS (SELECT 'regions' AS part, row_number() OVER (ORDER BY -(total / days::DOUBLE), region) AS rank, CAST(region AS VARCHAR) AS name, round(total / days::DOUBLE, 4) AS value, {_TREND.format(0.05)} FROM rt)
SELECT part, CAST(rank AS INT) AS rank, name, value, trend FROM (SELECT * FROM a WHERE rank <= 10 UNION ALL SELECT * FROM b WHERE rank <= 5 UNION ALL SELECT * FROM c WHERE rank <= 5 UNION ALL SELECT * FROM e WHERE rank <= 8)""")
def f2_trend_dashboard(spark, d):
    regions = table(spark, d, "events").groupBy(F.col("user_id").alias("region"), F.to_date("ts").alias("date")).agg(F.count("*").alias("items"))
    return R.trend_dashboard(
        R.trajectory(_mentions(spark, d), "theme", "mentions"), R.trajectory(regions, "region", "items", scale=1, edge=0.05), max_days=40
    )


@query(f"WITH {_TRAJ} SELECT theme, days FROM tj WHERE days <= 40 ORDER BY days DESC, theme LIMIT 5")
def d8_emerging(spark, d):
    return R.emerging(R.trajectory(_mentions(spark, d), "theme", "mentions"), 40).select("theme", "days")


def _history(spark, d):
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    items = e.groupBy("date").agg(
        F.array_sort(F.collect_list(F.concat_ws(" ", "event_type", "props"))).alias("clusters"),
        F.array_sort(F.collect_list(F.concat(F.substring(F.translate("event_type", "scvep", "SABCA"), 1, 1), F.lit(": x")))).alias("signals")
    )
    regions = e.groupBy("date", F.col("event_type").alias("r")).agg(F.collect_list("event_id").alias("v")).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("regions"))
    return items.join(regions, "date").withColumn("summary_excerpt", F.lit("x"))


@query("SELECT CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' ELSE 'other' END AS theme, CAST(ts AS DATE) AS date, count(*) AS mentions FROM events GROUP BY ALL")
def d7_theme_mentions(spark, d):
    h = _history(spark, d).withColumn("signals", F.array().cast("array<string>"))
    return R.theme_mentions(h, [("^view", "v"), ("^click", "c"), (".", "other")])


@query("SELECT CASE event_type WHEN 'signup' THEN 'S' WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'error' THEN 'C' ELSE 'A' END AS signal_level, count(*) AS n FROM events GROUP BY 1")
def d11_signal_histogram(spark, d):
    return R.signal_histogram(_history(spark, d))


@query("""WITH mn AS (SELECT event_type AS region, CAST(ts AS DATE) AS date, count(*) AS items FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date) AS i, count(*) OVER (PARTITION BY region) AS n FROM mn)
SELECT region, count(*) AS days, CAST(sum(items) AS BIGINT) AS total, round((avg(items) FILTER (WHERE i > floor(n / 2)) - avg(items) FILTER (WHERE i <= floor(n / 2))), 4) AS trend_score FROM r GROUP BY region HAVING count(*) >= 2""")
def d10_region_timeline(spark, d):
    return R.region_timeline(_history(spark, d)).select("region", "days", "total", "trend_score")


@query("SELECT CAST(ts AS DATE) AS date FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def a7_scan_history(spark, d):
    return scan.scan_history(_history(spark, d), 10).select("date")


@query("SELECT CAST(ts AS DATE) AS date, CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 25 THEN 'dropped' WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 7 THEN 'archive' ELSE 'full' END AS bucket FROM events GROUP BY ALL")
def a19_retention(spark, d):
    return sinks.retention(_history(spark, d), day(), 7, 25).select("date", "bucket")


@query(f"WITH {_ORD} SELECT count(DISTINCT date) AS dates, count(*) AS events, CAST(2 * count(*) AS BIGINT) AS sources FROM o")
def a18_backfill_counts(spark, d):
    return sinks.backfill_counts(_orders(spark, d))


@query(f"WITH {DAILY} SELECT event_id, date, phase, {_DELTA.format(a='old_phase', b='phase')} AS risk_delta FROM (SELECT *, lag(phase) OVER (PARTITION BY event_id ORDER BY date) AS old_phase FROM revs) WHERE old_phase IS NOT NULL")
def c16_phase_delta(spark, d):
    from pyspark.sql import Window

    r = revisions(spark, d).withColumn(
        "old_phase", F.lag("phase").over(Window.partitionBy("event_id").orderBy("date"))
    ).filter("old_phase is not null")
    return R.with_phase_delta(r, TRANSITIONS).select("event_id", "date", "phase", "risk_delta")


_EVOLVE = f"""WITH RECURSIVE {DAILY.replace('ev AS', 'ev AS', 1)},
st AS (SELECT event_id, min(date) AS first_seen FROM days GROUP BY event_id),
f AS (SELECT event_id, first_seen, first_seen AS day, CAST(0 AS INT) AS risk, (SELECT phase FROM days WHERE days.event_id = st.event_id AND days.date = st.first_seen) AS phase, first_seen AS seen, CAST(0 AS INT) AS transitions FROM st
  UNION ALL SELECT f.event_id, f.first_seen, CAST(f.day + 1 AS DATE), CASE WHEN x.phase IS NULL THEN CAST(trunc(f.risk * exp(-0.693::DOUBLE * date_diff('day', f.seen, CAST(f.day + 1 AS DATE)) / 14)) AS INT)
    WHEN x.phase <> f.phase THEN CAST(greatest(0, least(100, f.risk + {_DELTA.format(a='f.phase', b='x.phase')})) AS INT) ELSE f.risk END,
    coalesce(x.phase, f.phase), CASE WHEN x.phase IS NULL THEN f.seen ELSE CAST(f.day + 1 AS DATE) END, f.transitions + CAST(coalesce(x.phase <> f.phase, false) AS INT)
  FROM f LEFT JOIN days AS x ON x.event_id = f.event_id AND x.date = CAST(f.day + 1 AS DATE) WHERE f.day < DATE '{DAY}'),
state AS (SELECT event_id, first_seen, seen AS last_updated, phase, risk, transitions FROM f WHERE day = DATE '{DAY}')"""


@query(f"{_EVOLVE} SELECT *, risk = 0 AND date_diff('day', last_updated, DATE '{DAY}') >= 60 AS archived FROM state")
def e11_evolve(spark, d):
    return R.evolve(revisions(spark, d), TRANSITIONS, day())


@query(f"{_EVOLVE} SELECT count(*) AS events, count(*) FILTER (WHERE last_updated >= DATE '{DAY}' - 2) AS active, CAST(sum(transitions) AS BIGINT) AS transitions FROM state")
def d20_evolution_report(spark, d):
    return R.evolution_report(R.evolve(revisions(spark, d), TRANSITIONS, day()), day(), 2)


@query("WITH f AS (SELECT user_id AS event_id, props AS actor, min(CAST(ts AS DATE)) AS date FROM events GROUP BY ALL) SELECT event_id, date, string_agg(actor, ',' ORDER BY actor) AS new_actors, count(*) AS n_new FROM f GROUP BY ALL")
def d19_new_participants(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.to_date("ts").alias("date"), F.array("props").alias("actors"))
    return R.new_participants(e)


_ANCH = [
    ("oil", "n1", "us10y", 50.0, "above"), ("oil", "n2", "us2y", -1.0, "below"), ("gold", "n3", "spread_10y_2y", 1000.0, "below"),
    ("gold", "n4", "us2y", 5.0, "change")
]


def _market(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.when(F.col("event_type") == "view", "us10y").when(F.col("event_type") == "click", "us2y").otherwise(F.col("event_type")).alias("key")).agg(
        F.round(F.avg("value"), 4).alias("price"), (-F.round(F.avg("value") / 100, 4)).alias("change_pct")
    )


_CHAINS = """mk AS (SELECT CASE event_type WHEN 'view' THEN 'us10y' WHEN 'click' THEN 'us2y' ELSE event_type END AS key, round(avg(value), 4) AS price, -round(avg(value) / 100, 4) AS change_pct FROM events GROUP BY 1),
ch AS (SELECT 'oil' AS chain FROM mk WHERE key = 'us10y' AND price > 50 UNION ALL SELECT 'oil' FROM mk WHERE key = 'us2y' AND change_pct < -1 UNION ALL SELECT 'gold' FROM mk AS a, mk AS b WHERE a.key = 'us10y' AND b.key = 'us2y' AND a.price - b.price < 1000 UNION ALL SELECT 'gold' FROM mk WHERE key = 'us2y' AND abs(change_pct) > 5),
fired AS (SELECT chain, count(*) AS nodes, 5 * count(*) AS bonus FROM ch GROUP BY chain)"""


@query(f"WITH {_CHAINS} SELECT * FROM fired")
def c11_chain_triggers(spark, d):
    return R.chain_triggers(
        spark.createDataFrame(_ANCH, "chain string, node string, indicator string, threshold double, direction string"), _market(spark, d)
    )


@query(f"""WITH {_TS}, {_CHAINS}, b AS (SELECT coalesce(sum(bonus), 0) AS bonus, count(*) AS chains FROM fired)
SELECT CAST(least(100, floor((SELECT avg(score) FROM tl) + bonus + CASE WHEN chains >= 3 THEN 20 WHEN chains = 2 THEN 10 ELSE 0 END + 1e-9)) AS INT) AS stress, chains FROM b""")
def d6_global_stress(spark, d):
    chains = R.chain_triggers(
        spark.createDataFrame(_ANCH, "chain string, node string, indicator string, threshold double, direction string"), _market(spark, d)
    )
    return R.global_stress(_theme_scores(spark, d), chains)


# ---- search and merging ----
@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws, contains(lower(text), 'licensed apach') AS sub FROM documents),
n AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda w: w = 'licensed')) AS f0, len(list_filter(ws, lambda w: starts_with(w, 'apach'))) AS f1, sub FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM n),
r AS (SELECT doc_id, f0 > 0 AND f1 > 0 AS ranked, round(ln(1 + (docs - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) + ln(1 + (docs - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)), 6) AS score, sub FROM n, s),
o AS (SELECT * FROM r WHERE ranked OR sub ORDER BY ranked DESC, CASE WHEN ranked THEN score END DESC, doc_id LIMIT 20)
SELECT doc_id, CASE WHEN ranked THEN score ELSE 0.0 END::DOUBLE AS score, ranked FROM o WHERE ranked = (SELECT bool_or(ranked) FROM o)""")
def c14_search(spark, d):
    return E.search(table(spark, d, "documents"), ["licensed", "apach*"], 20)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in _TABLES))
def d17_table_counts(spark, d):
    return E.table_counts({n: table(spark, d, n) for n in _TABLES})


def _actors(spark, d):
    """Orders as events: their suppliers are the actors."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_set(F.concat(F.lit("a"), (F.col("l_suppkey") % 40).cast("string"))).alias("actors"))
    return a.withColumns({"event_type": F.lit("t"), "location": (F.col("event_id") % 50).cast("string")})


_ACTORS = "ac AS (SELECT l_orderkey AS e, l_orderkey % 50 AS loc, list_distinct(list('a' || CAST(l_suppkey % 40 AS VARCHAR))) AS s FROM lineitem GROUP BY ALL)"
_ALIKE = """k1 AS (SELECT x.e AS a, y.e AS b, len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE AS jaccard FROM ac AS x JOIN ac AS y ON x.loc = y.loc AND x.e < y.e
  WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE > 0.6)"""


@query(f"WITH {_ACTORS}, {_ALIKE} SELECT * FROM k1")
def k1_merge_candidates(spark, d):
    return E.merge_pairs(_actors(spark, d))


@query(f"""WITH RECURSIVE {_ACTORS}, {_ALIKE}, h AS (SELECT o_orderkey AS event_id, o_orderstatus || CAST(o_orderkey % 3 AS VARCHAR) AS title, CAST(o_orderdate AS DATE) AS d, CAST(substr(o_orderpriority, 1, 1) AS INT) AS risk, 's' || CAST(o_custkey % 5 AS VARCHAR) AS source FROM orders),
l AS (SELECT a, b FROM k1 UNION SELECT b, a FROM k1), r AS (SELECT event_id AS id, event_id AS seen FROM h UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen), c AS (SELECT id, min(seen) AS m FROM r GROUP BY id),
g AS (SELECT m, min(d) AS first_seen, max(d) AS last_seen, max(risk) AS peak_risk, count(*) - 1 AS merged, arg_min(title, event_id) AS canonical_title, list_sort(list_distinct(list(title))) AS ts, list_sort(list_distinct(list(source))) AS ss FROM h JOIN c ON c.id = event_id GROUP BY m)
SELECT m AS event_id, canonical_title, array_to_string(list_filter(ts, lambda t: t <> canonical_title), ',') AS aliases, first_seen, last_seen, peak_risk, merged, array_to_string(ss, ',') AS evidence FROM g""")
def k2_apply_merges(spark, d):
    o = table(spark, d, "orders")
    heads = o.select(
        F.col("o_orderkey").alias("event_id"), F.concat("o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("canonical_title"),
        F.to_date("o_orderdate").alias("first_seen"), F.to_date("o_orderdate").alias("last_seen"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("peak_risk"),
        F.array(F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string"))).alias("sources")
    )
    out = E.apply_groups(heads, E.merge_groups(_actors(spark, d)))
    return out.withColumns({"aliases": F.array_join("aliases", ","), "evidence": F.array_join("evidence", ",")})


@query(f"WITH {DAILY}, x AS (SELECT event_id, risk, date_diff('day', last_seen, DATE '2024-04-29') AS age FROM heads) SELECT event_id, CASE WHEN age >= 180 THEN 'archived' WHEN age >= 90 AND risk < 20 THEN 'resolved' WHEN age >= 60 THEN 'cooling' ELSE 'active' END AS status FROM x")
def k3_lifecycle(spark, d):
    return E.lifecycle(E.event_heads(revisions(spark, d)), day("2024-04-29")).select("event_id", "status")


@query("SELECT doc_id AS event_id, quality * 10 AS model_score, toxic * 8 AS rule_score, abs(quality * 10 - toxic * 8) > 3 AS review FROM labels")
def k4_dual_risk(spark, d):
    lab = table(spark, d, "labels")
    return E.dual_risk(
        lab.select(F.col("doc_id").alias("event_id"), (F.col("quality") * 10).alias("model_score")),
        lab.select(F.col("doc_id").alias("event_id"), (F.col("toxic") * 8).alias("rule_score"))
    )


@query("SELECT o_custkey AS event_id, CAST('2024-01-01' AS DATE) AS date, o_orderkey AS version, o_totalprice AS score, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS change FROM orders")
def k5_compare_assessments(spark, d):
    a = table(spark, d, "orders").select(
        F.col("o_custkey").alias("event_id"), day("2024-01-01").alias("date"), F.col("o_orderkey").alias("version"),
        F.col("o_totalprice").alias("score")
    )
    return E.compare_assessments(a).withColumn("change", F.round("change", 2))


@query(f"WITH {_ORD}, {_EDGES} SELECT src, dst, 'related_to' AS relation, max(date) AS last_confirmed, 0.3::DOUBLE AS confidence FROM ed WHERE date_diff('day', date, (SELECT max(date) FROM o)) <= 90 GROUP BY src, dst")
def k6_validate_relations(spark, d):
    o = _orders(spark, d)
    last = o.agg(F.max("date")).first()[0]
    return E.validate_relations(E.cooccurrence_edges(o), o, F.lit(last))


@query(f"WITH {_ORD}, x AS (SELECT event_id, date, unnest(sources) AS source FROM o) SELECT source, count(*) AS evidence, count(DISTINCT event_id) AS events, count(DISTINCT date) AS days FROM x GROUP BY source")
def k7_source_credibility(spark, d):
    return E.source_credibility(_orders(spark, d).select("event_id", "date", F.explode("sources").alias("source")))
