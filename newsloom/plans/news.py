"""Queries over news: documents, pages and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scalars as S
from newsloom.operators import news as N
from newsloom.operators import risk as R
from newsloom.plans.registry import NEWS, SOURCES, news, query, sources, table
from newsloom.sources import scan, sinks

NOISE, PRIORITY = ["disgusting", "trash", "***"], ["licensed", "the"]
CATEGORIES = {
    "motion": {
        "weight": 5, "terms": ["tionst", "edst"],
        "escalation": [{"triggers": ["there", "and", "of"], "bonus": 20}, {"triggers": ["aux", "que"], "bonus": 15}]
    },
    "law": {"weight": 8, "terms": ["licens", "rights"]},
    "speech": {"weight": 3, "terms": ["eaux", "keit"], "context": ["und", "les"]},
}
TOPICS = {"rights": ["rights", "license"], "insult": ["worthless", "disgusting", "scum"], "keys": ["token", "password"]}
AS_OF = "2024-01-31"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


_TEXT = "lower(title || ' ' || summary)"


def _any(words: list[str], text: str = _TEXT) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.lower()}')" for w in words) + ")"


def _cat(c: dict) -> str:
    return _any(c["terms"]) + (f" AND {_any(c['context'])}" if c.get("context") else "")


_HITS = " UNION ALL ".join(
    f"SELECT id, '{n}' AS category, CAST({c['weight']} AS DOUBLE) AS weight FROM news WHERE {_cat(c)}" for n, c in CATEGORIES.items()
)
_ESC = "least(30.0, " + " + ".join(f"CASE WHEN {_cat(c)} AND ({' + '.join(f'CAST(contains({_TEXT}, {chr(39)}{t}{chr(39)}) AS INT)' for t in r['triggers'])}) >= 2 THEN {r['bonus']}.0 ELSE 0.0 END" for c in CATEGORIES.values() for r in c.get("escalation", [])) + ")"
_COVER = """w AS (SELECT id, url, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> ''))) AS ws FROM news),
tk AS (SELECT id, url, len(ws) AS n, unnest(ws) AS t FROM w),
pr AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM tk AS a JOIN tk AS b ON a.t = b.t AND a.url <> b.url GROUP BY ALL),
cov AS (SELECT news.id, 1 + count(pr.b) AS coverage_count FROM news LEFT JOIN pr ON news.id = pr.a AND c > 0.5 * greatest(na, nb) GROUP BY news.id)"""


def _scored(spark, d):
    dim = sources(spark, d).select(F.col("name").alias("source"), "credibility")
    return N.score_news(news(spark, d), dim, CATEGORIES, TOPICS, ["licensed under"], ["src19"], ["src1", "src2"], {2: 3, 3: 6}, as_of())


_SCORED = f"""sd AS (SELECT news.*, coverage_count, credibility FROM news JOIN cov USING (id) LEFT JOIN so ON news.source = so.name),
scored AS (SELECT *, round(
  ({' + '.join(f"CASE WHEN {_cat(c)} THEN {c['weight']}.0 ELSE 0.0 END" for c in CATEGORIES.values())} + {_ESC}
   + least(coalesce(credibility, 5), 10) * 1.5 + CASE WHEN source IN ('src1', 'src2') THEN 3.0 ELSE 0.0 END
   + CASE WHEN coverage_count >= 3 THEN 6.0 WHEN coverage_count >= 2 THEN 3.0 ELSE 0.0 END
   + {' + '.join(f"CASE WHEN {_any(w)} THEN 2.0 ELSE 0.0 END" for w in TOPICS.values())})::DOUBLE
  * CASE WHEN {_any(['licensed under'])} THEN 1.5 WHEN coverage_count >= 3 THEN 1.3 WHEN contains(source, 'src19') THEN 0.5 ELSE 0.8 END::DOUBLE
  * greatest(0.1, exp(-0.693::DOUBLE * (date_diff('second', published_ts, TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE) / 72)), 1) AS importance_score FROM sd)"""


@query(f"WITH {NEWS} SELECT id FROM news WHERE NOT {_any(NOISE)} OR {_any(PRIORITY)}")
def b1_relevant(spark, d):
    return scan.relevant(news(spark, d), NOISE, PRIORITY).select("id")


@query(f"WITH {NEWS} SELECT id, {_any(NOISE)} AND NOT {_any(['license'])} AS noise FROM news")
def b2_noise_flag(spark, d):
    return N.noise_flag(news(spark, d), NOISE, ["license"]).select("id", "noise")


@query(f"WITH {NEWS} SELECT id FROM news WHERE floor(date_diff('second', published_ts, TIMESTAMP '{AS_OF}') / 86400.0) <= 3")
def b3_not_stale(spark, d):
    n = news(spark, d).withColumn("published", F.date_format("published_ts", "yyyy-MM-dd HH:mm"))
    return scan.not_stale(n, as_of(), 3).select("id")


@query(f"WITH {NEWS} SELECT count(*) AS items, count(DISTINCT source) AS sources, count(DISTINCT source) >= 5 AS passed FROM news")
def b4_health_gate(spark, d):
    return N.health_gate(news(spark, d))


@query("SELECT nullif(lang, 'de') AS value, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY 1")
def b8_vocab_violations(spark, d):
    docs = table(spark, d, "documents").withColumn("lang", F.nullif("lang", F.lit("de")))  # a null value is outside too
    return N.vocab_violations(docs, "lang", ["en", "fr"])


@query("SELECT page_id, coalesce(regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), 'xxxx|placeholder|example\\.com/test') AND NOT regexp_matches(url, '/a-[0-9]+'), false) AS valid FROM pages")
def b9_valid_url(spark, d):
    return table(spark, d, "pages").select("page_id", S.valid_url("url").alias("valid"))


@query(f"WITH {NEWS} {_HITS}")
def c1_category_hits(spark, d):
    return N.category_hits(news(spark, d), CATEGORIES)


@query(f"WITH {NEWS} SELECT id, CAST({_ESC} AS DOUBLE) AS bonus FROM news")
def c2_escalation(spark, d):
    return news(spark, d).select("id", N.escalation_bonus(CATEGORIES).alias("bonus"))


@query("SELECT c_custkey, CASE WHEN contains(lower(n_name), 'ira') THEN 'gold' WHEN contains(lower(n_name), 'united') THEN 'silver' ELSE 'unrated' END AS tier, CASE WHEN contains(lower(n_name), 'ira') THEN 90 WHEN contains(lower(n_name), 'united') THEN 60 ELSE 40 END AS trust FROM customer JOIN nation ON c_nationkey = n_nationkey")
def c3_source_trust(spark, d):
    c = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).withColumn("source", F.col("n_name"))
    return N.with_source_trust(c, [("IRA", "gold", 90), ("UNITED", "silver", 60)]).select("c_custkey", "tier", "trust")


@query(f"WITH {NEWS}, {SOURCES} SELECT id, coalesce(credibility * signal_weight / 100.0::DOUBLE, 0.25) AS quality FROM news LEFT JOIN so ON source = name")
def c4_source_quality(spark, d):
    return N.with_source_quality(news(spark, d), sources(spark, d)).select("id", "quality")


@query(f"WITH {NEWS}, {_COVER} SELECT id, coverage_count FROM cov")
def c5_coverage_count(spark, d):
    return N.coverage_count(news(spark, d))


@query(f"WITH {NEWS}, {SOURCES}, {_COVER}, {_SCORED} SELECT id, importance_score FROM scored")
def h7_importance(spark, d):
    return _scored(spark, d).select("id", "importance_score")


_SEEN = "(SELECT DISTINCT md5(url) AS h FROM news WHERE id % 2 = 0)"


@query(f"WITH {NEWS}, s AS {_SEEN} SELECT id, h IS NOT NULL AS repeated, CASE WHEN h IS NOT NULL THEN strlen(source) * 0.7::DOUBLE ELSE CAST(strlen(source) AS DOUBLE) END AS importance_score FROM news LEFT JOIN s ON md5(url) = h")
def c17_mark_repeats(spark, d):
    n = news(spark, d).withColumn("importance_score", F.length("source").cast("double"))
    return N.mark_repeats(n, sinks.seen_snapshot(n.filter("id % 2 = 0"))).select("id", "repeated", "importance_score")


_NORM = "regexp_replace(regexp_replace(trim(url), '/+$', ''), '#.*$', '')"
_URLS = f"""u AS (SELECT page_id, {_NORM} AS v FROM pages),
q AS (SELECT page_id, regexp_replace(string_split(v, '?')[1], '/+$', '') AS base, list_filter(string_split(coalesce(string_split(v, '?')[2], ''), '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '=') AND NOT regexp_matches(p, '^(utm_|ceid|hl|gl|fbclid|gclid)')) AS ps FROM u),
nu AS (SELECT page_id, base || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url FROM q)"""


@query(f"WITH {_URLS} SELECT page_id, url FROM nu")
def h1_normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", S.normalize_url("url").alias("url"))


@query(f"WITH {NEWS} SELECT id, substr(sha1(trim(lower(substr(coalesce(title, ''), 1, 80) || '|' || coalesce(source, '')))), 1, 16) AS fingerprint FROM news")
def h2_fingerprint(spark, d):
    return news(spark, d).select("id", S.fingerprint("title", "source").alias("fingerprint"))


@query(f"WITH {NEWS}, f AS (SELECT id, source, row_number() OVER (PARTITION BY substr(sha1(trim(lower(substr(coalesce(title, ''), 1, 80) || '|' || coalesce(source, '')))), 1, 16) ORDER BY pos) AS rn FROM news) SELECT id, source FROM f WHERE rn = 1")
def g1_dedup_news(spark, d):
    return N.dedup_news(news(spark, d)).select("id", "source")


@query(f"WITH {_URLS} SELECT min(page_id) AS page_id FROM nu GROUP BY url")
def g1_dedup_pages(spark, d):
    p = table(spark, d, "pages").select(
        F.col("page_id").alias("pos"), "url", F.col("page_id").cast("string").alias("title"), F.lit("page").alias("source")
    )
    return N.dedup_news(p).select(F.col("pos").alias("page_id"))


@query(f"""WITH {NEWS}, {SOURCES}, {_COVER}, {_SCORED},
f AS (SELECT *, row_number() OVER (PARTITION BY substr(sha1(trim(lower(substr(coalesce(title, ''), 1, 80) || '|' || coalesce(source, '')))), 1, 16) ORDER BY pos) AS rn FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY importance_score DESC, pos) AS k FROM f WHERE rn = 1),
o AS (SELECT *, max(importance_score) OVER (PARTITION BY region) AS top, first_value(pos) OVER (PARTITION BY region ORDER BY importance_score DESC, pos) AS fp FROM r)
SELECT id, region, importance_score FROM o ORDER BY CASE WHEN k <= 3 THEN 0 ELSE 1 END, CASE WHEN k <= 3 THEN -top END, CASE WHEN k <= 3 THEN fp END, CASE WHEN k <= 3 THEN k END, importance_score DESC, pos LIMIT 100""")
def e8_stratified_top(spark, d):
    """Scan, dedup, score and balance: the daily selection."""
    return N.stratified_top(N.dedup_news(_scored(spark, d)), 100).select("id", "region", "importance_score")


@query(f"WITH {NEWS}, r AS (SELECT id, region, row_number() OVER (PARTITION BY region ORDER BY pos) AS turn FROM news) SELECT id, region, CAST(turn AS INT) AS turn FROM r ORDER BY turn, region LIMIT 500")
def e9_round_robin(spark, d):
    return N.round_robin(news(spark, d), 500).select("id", "region", "turn")


@query(f"WITH {NEWS}, r AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY pos) AS rank, id, url FROM news) SELECT region, CAST(rank AS INT) AS rank, id, url FROM r WHERE rank <= 5")
def e10_links_by_region(spark, d):
    return N.links_by_region(news(spark, d), 5)


def _picks(n: int) -> str:
    """The best item of each round, given those picked before."""
    out = []
    for k in range(n):
        before = " UNION ALL ".join(f"SELECT * FROM pick{j}" for j in range(k)) or "SELECT * FROM base WHERE false"
        old = lambda c: f"{c} IN (SELECT {c} FROM ({before}))"  # noqa: B023, E731
        out.append(f"pick{k} AS MATERIALIZED (SELECT * FROM base WHERE NOT {old('id')} ORDER BY CASE WHEN {old('region')} THEN 0 ELSE 1 END * w * 30 + CASE WHEN {old('source')} THEN 0 ELSE 1 END * 15 + fixed DESC, pos LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT id, region, source, CAST({k} AS INT) AS pick FROM pick{k}" for k in range(n))


@query(f"""WITH {NEWS}, s AS (SELECT region, 1.0::DOUBLE / (count(*) / (SELECT count(*) FROM news)::DOUBLE + 0.01) AS w FROM news GROUP BY region),
base AS (SELECT id, pos, news.region, source, w, w * 20 + (least(length(summary), 200) / 200::DOUBLE * 15 + least(length(title), 100) / 100::DOUBLE * 10) AS fixed FROM news JOIN s ON s.region = news.region), {_picks(4)}""")
def e12_diverse_sample(spark, d):
    return N.diverse_sample(news(spark, d), 4).select("id", "region", "source", "pick")


@query(f"WITH {NEWS} SELECT region, count(*) AS items, count(DISTINCT source) AS sources, count(*) < 3 AS low FROM news GROUP BY region")
def d2_source_health(spark, d):
    return N.source_health(news(spark, d))


@query(f"WITH {NEWS} SELECT region AS value, count(*) AS n FROM news GROUP BY region ORDER BY n DESC, min(pos) LIMIT 1")
def d3_majority(spark, d):
    return N.majority(news(spark, d), "region", "pos")


@query(f"WITH {SOURCES}, {_URLS} SELECT (SELECT count(*) FROM so WHERE NOT experimental) AS ok_sources, (SELECT count(*) FROM so WHERE experimental) AS failed_sources, count(*) AS items, count(*) - count(DISTINCT url) AS duplicates, (SELECT count(*) FROM (SELECT min(page_id) AS id FROM nu GROUP BY url) WHERE id % 3 = 0) AS repeats FROM nu")
def d22_fetch_stats(spark, d):
    p = table(spark, d, "pages").select(
        F.col("page_id").alias("pos"), "url", F.col("page_id").cast("string").alias("title"), F.lit("page").alias("source")
    )
    seen = p.filter("pos % 3 = 0").select(S.fingerprint("title", "source").alias("fingerprint"))
    return N.fetch_stats(sources(spark, d).select(F.col("name").alias("source"), (~F.col("experimental")).alias("ok")), p, seen)


@query("""WITH RECURSIVE s AS (SELECT conv_id, CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 5 ELSE 3 END AS priority, CAST(turn AS INT) AS pos, CAST(length(text) // 2 AS INT) AS cost FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority DESC, pos, cost) AS k FROM s),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, '' AS taken, CAST(0 AS BIGINT) AS n FROM o GROUP BY conv_id
  UNION ALL SELECT f.conv_id, o.k, CASE WHEN priority >= 8 OR used + cost <= 500 THEN used + cost ELSE used END,
    CASE WHEN priority >= 8 OR used + cost <= 500 THEN CASE WHEN taken = '' THEN CAST(pos AS VARCHAR) ELSE taken || ',' || CAST(pos AS VARCHAR) END ELSE taken END,
    CASE WHEN priority >= 8 OR used + cost <= 500 THEN n + 1 ELSE n END FROM f JOIN o ON f.conv_id = o.conv_id AND o.k = f.k + 1)
SELECT conv_id, arg_max(used, k) AS used, CAST(arg_max(n, k) AS INT) AS n_taken, arg_max(taken, k) AS taken FROM f GROUP BY conv_id""")
def f3_budget_pack(spark, d):
    c = table(spark, d, "conversations")
    s = c.select(
        "conv_id", F.when(F.col("role") == "system", 8).when(F.col("role") == "user", 5).otherwise(3).alias("priority"),
        F.col("turn").cast("int").alias("pos"), S.est_tokens(F.col("text"), 2).cast("int").alias("cost")
    )
    return N.budget_pack(s, "conv_id", 500)


@query("WITH r AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS pos, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rank FROM orders) SELECT date, pos, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def f4_top_per_day(spark, d):
    return N.top_per_day(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("pos")), 3)


@query(f"WITH {NEWS} SELECT id, title FROM news WHERE id % 2 = 1 AND title NOT IN (SELECT title FROM news WHERE id % 2 = 0)")
def c22_emerging_vs_yesterday(spark, d):
    n = news(spark, d)
    return N.emerging_vs_yesterday(n.filter("id % 2 = 1"), n.filter("id % 2 = 0")).select("id", "title")


@query("SELECT doc_id, region FROM documents, (SELECT DISTINCT lang AS region FROM documents) WHERE NOT contains(lower(text), CASE region WHEN 'en' THEN 'and' WHEN 'fr' THEN 'les' WHEN 'de' THEN 'und' ELSE 'el' END)")
def c23_coverage_gap(spark, d):
    return N.coverage_gap(news(spark, d), table(spark, d, "documents"), {"en": "and", "fr": "les", "de": "und", "es": "el"})


@query(f"WITH {SOURCES} SELECT name, tier FROM so WHERE NOT experimental ORDER BY tier <> 1, pos LIMIT 40")
def a4_select_sources(spark, d):
    return scan.select_sources(sources(spark, d), 40).select("name", "tier")


@query("WITH e AS (SELECT c_nationkey AS source, c_custkey % 3 AS url_rank, c_custkey FROM customer), r AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY url_rank) AS k FROM e) SELECT source, url_rank, c_custkey FROM r WHERE k = 1")
def a5_failover(spark, d):
    return scan.failover(table(spark, d, "customer").select(
        F.col("c_nationkey").alias("source"), (F.col("c_custkey") % 3).alias("url_rank"), "c_custkey"
    ))


@query(f"""WITH {NEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM news)
SELECT id, trim(regexp_replace(regexp_replace(summary, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))[1:500] AS summary FROM r WHERE rn <= 30 AND trim(title) <> ''
AND floor(date_diff('second', published_ts, TIMESTAMP '{AS_OF}') / 86400.0) <= 3""")
def a1_scan_feed_entries(spark, d):
    n = news(spark, d).withColumns({
        "published": F.date_format("published_ts", "yyyy-MM-dd HH:mm"), "updated": F.lit(None).cast("string"), "link": F.col("url")
    })
    return scan.scan_feed_entries(n, as_of()).select("id", "summary")


_ANCHOR = "(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"


@query(rf"""WITH f AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS base, regexp_extract_all(html, '{_ANCHOR}', 1) AS hs, regexp_extract_all(html, '{_ANCHOR}', 2) AS ts FROM pages),
l AS (SELECT page_id, host, CASE WHEN base = '' THEN host || '/' ELSE base END AS base, i - 1 AS pos, trim(hs[i]) AS href, trim(regexp_replace(regexp_replace(ts[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT *, unnest(range(1, least(30, len(hs)) + 1)) AS i FROM f)),
u AS (SELECT page_id, pos, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN host || href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '#') OR href = '' THEN NULL ELSE base || href END AS url, title FROM l)
SELECT page_id, CAST(pos AS INT) AS pos, url, title, coalesce(nullif(replace(regexp_extract(url, '/(\d{{4}}/\d{{1,2}}/\d{{1,2}})/', 1), '/', '-'), ''), '{AS_OF}') AS published FROM u WHERE url IS NOT NULL AND length(title) >= 3 AND (NOT {_any(["au"], "lower(title)")} OR {_any(["eau"], "lower(title)")})""")
def a2_scan_page_links(spark, d):
    return scan.scan_page_links(table(spark, d, "pages"), as_of(), 30, 3, ["au"], ["eau"])


@query(f"WITH {_URLS} SELECT DISTINCT md5(url) AS url_hash FROM nu WHERE url <> ''")
def a17_seen_snapshot(spark, d):
    return sinks.seen_snapshot(table(spark, d, "pages"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\\w]+', '-', 'g'), '-') AS slug FROM part")
def h17_slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slugify("p_name").alias("slug"))


@query("SELECT conv_id, turn, CAST(length(text) // 3 AS BIGINT) AS tokens FROM conversations")
def h18_est_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.est_tokens(F.col("text"), 3).alias("tokens"))


@query("SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'one' WHEN contains(source, '5') THEN 'five' ELSE 'rest' END AS lean FROM documents")
def h13_classify_lean(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", S.classify_lean(F.col("source"), [("one", ["SRC1"]), ("five", ["5"])], "rest").alias("lean")
    )


@query("SELECT page_id, regexp_replace(url, '(?:[A-Za-z]:\\\\|/)(?:[A-Za-z0-9_.-]+[/\\\\])+[A-Za-z0-9_.-]*', '<path>', 'g')[1:300] AS text FROM pages")
def h20_redact_paths(spark, d):
    return table(spark, d, "pages").select("page_id", S.redact_paths(F.col("url")).alias("text"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("WITH t AS (SELECT lang AS dimension, lower(text) AS low FROM documents), l AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS theme) SELECT theme, dimension, count(*) AS hits FROM t, l WHERE regexp_matches(low, theme || '[a-z]') GROUP BY ALL")
def c7_many_words(spark, d):
    themes = {a: [a + b for b in _LETTERS] for a in _LETTERS}  # 676 words
    return R.theme_signal_hits(table(spark, d, "documents").select(F.col("lang").alias("dimension"), "text"), themes)
