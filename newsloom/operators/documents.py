"""Documents and pages to tables: report rules, blocks, sections, chapters, cards, links, citations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import scalars as S
from newsloom.functions import vocab as V
from newsloom.sources.scan import strip_tags

URL = r"https?://[^\s)\]]+"


def _named(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def _finding(category: str, severity: str, value: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))


def _findings(docs: DataFrame, lang: str, news_count: int, placeholders, vague, indicators, regions) -> DataFrame:
    """docs with a text, with _found: a finding for each rule that the text breaks. The counts are taken once, then judged."""
    t = F.col("text")
    need, names = indicators or V.INDICATORS[lang], regions or V.REPORT_REGIONS[lang]
    mark = "-level" if lang == "en" else "级"
    urls = F.regexp_extract_all(t, F.lit(URL), F.lit(0))
    counted = docs.filter(t.isNotNull()).select(
        "doc_id", F.regexp_count(t, F.lit(r"(?m)^##\s+")).alias("h2"), F.size(_named(t, placeholders or V.PLACEHOLDERS[lang])).alias("held"), F.size(_named(t, vague or V.VAGUE[lang])).alias("dull"),
        (len(need) - F.size(_named(t, need))).alias("missing"), F.array(*[S.occurrences(t, r) for r in names]).alias("times"),
        *[F.regexp_count(t, F.lit(rf"(?U)(?<!\w){k}{mark}(?!\w)")).alias(k) for k in "SA"], (t.rlike(r"置信度.*\d+%") | t.contains("[事实")).alias("sure"), urls.alias("urls"), F.length(t).alias("n"),
    )
    bad = F.size(F.filter("urls", lambda u: u.rlike(S.words_pattern(V.PLACEHOLDER_URLS))))
    share = F.array_max("times") * 100.0 / F.greatest(F.aggregate("times", F.lit(0), lambda a, x: a + x), F.lit(1))
    counted = counted.select(
        "*", bad.alias("bad"), F.size("urls").alias("links"), F.size(F.filter("times", lambda x: x > 0)).alias("covered"),
        share.alias("share")
    )
    c = F.col
    found = [
        _finding("A1_h2_count", "issue", c("h2"), c("h2") < 4), _finding("A1_h2_count", "warning", c("h2"), c("h2") > 12), _finding("A2_placeholders", "issue", c("held"), c("held") > 0), _finding("A3_vague", "warning", c("dull"), c("dull") > 0),
        _finding("A4_market_data", "issue", c("missing"), c("missing") > 0), _finding("B1_coverage", "issue", c("covered"), c("covered") < 6), _finding(
            "B1_coverage", "warning", c("covered"), c("covered").isin(6, 7)
        ),
        _finding("B2_dominance", "issue", F.round("share", 4), c("share") > 45), _finding(
            "B2_dominance", "warning", F.round("share", 4), (c("share") <= 45) & (c("share") > 30)
        ),
        _finding("C1_signal_S", "warning", c("S"), c("S") > 2), _finding("C1_signal_A", "warning", c("A"), c("A") > 8), _finding("C2_confidence", "warning", F.lit(0), ~c("sure")),
        _finding(
            "D1_links", "warning", c("links"), (F.lit(news_count) > 0) & (c("links") < news_count * 0.05)
        ), _finding("D2_bad_urls", "issue", c("bad"), c("bad") > 0),
        _finding("E1_length", "issue", c("n"), c("n") < 3000), _finding("E1_length", "warning", c("n"), (c("n") >= 3000) & (c("n") < 5000)),
    ]
    return counted.select("doc_id", F.array_compact(F.array(*found)).alias("_found"))


def quality_checks(
    docs: DataFrame, lang: str = "zh", news_count: int = 0, placeholders=None, vague=None, indicators=None, regions=None
) -> DataFrame:
    """(doc_id, category, severity, value): a row for each rule that a report text breaks; a null text has none.

    Rows that repeat a doc_id are judged one by one.
    """
    found = _findings(docs, lang, news_count, placeholders, vague, indicators, regions)
    # inline() would have Spark test first whether there is a finding, and judge each text once more for that
    return found.select("doc_id", F.inline_outer("_found")).filter("category is not null")


def quality_summary(
    docs: DataFrame, lang: str = "zh", news_count: int = 0, placeholders=None, vague=None, indicators=None, regions=None
) -> DataFrame:
    """(doc_id, issues, warnings, passed), a row for each row of docs with a text, judged alone."""
    found = _findings(docs, lang, news_count, placeholders, vague, indicators, regions)
    n = lambda severity: F.size(F.filter("_found", lambda x: x.severity == severity)).cast("long")
    return found.select("doc_id", n("issue").alias("issues"), n("warning").alias("warnings")).withColumn("passed", F.col("issues") == 0)


def report_language(html: Column, titles: dict[str, tuple[str, str, str]] = V.REPORT_TITLES, other: str = "zh") -> Column:
    """The first language but other whose title of the watch list is in the page, else other."""
    found = F.lit(other)
    for lang in reversed([x for x in titles if x != other]):
        found = F.when(html.rlike(titles[lang][0]), lang).otherwise(found)
    return found


def html_structure_checks(pages: DataFrame, titles: dict[str, tuple[str, str, str]] = V.REPORT_TITLES, lang: str | None = None) -> DataFrame:
    """Counts of five structure rules of a report page and whether all hold.

    titles: for each language patterns of the titles of watch list, risks and market data; lang: that of all pages, else
    each page's own. A null page has a language and no counts.
    """
    h = F.col("html")

    def after(pattern: str, n: int) -> Column:
        return F.regexp_extract(h, rf"(?s){pattern}(.{{0,{n}}})", 1)

    def of(segment: Callable[[tuple[str, str, str]], Column]) -> Column:
        found = F.lit(None).cast("string")
        for name, own in titles.items():
            found = F.when(F.col("lang") == name, segment(own)).otherwise(found)
        return found

    rows = lambda seg: F.regexp_count(seg, F.lit("<tr>"))
    watch = of(lambda t: after(rf"<h[34][^>]*>(?:{t[0]})[^<]*</h[34]>", 800))
    risk = of(lambda t: after(rf"<h[34][^>]*>(?:{t[1]})[^<]*</h[34]>", 3000))
    market = of(lambda t: after(rf"<h[1-6][^>]*>[^<]*(?:{t[2]})[^<]*</h[1-6]>", 3000))
    out = pages.withColumn("lang", F.coalesce(F.lit(lang), report_language(h, titles))).select(
        "page_id", "lang", F.regexp_count(h, F.lit(r'<h2[^>]*class="chapter-title"')).alias("chapters"), F.regexp_count(h, F.lit('<div class="watch-card">')).alias("watch_cards"),
        F.when(watch.contains("<table>"), rows(watch)).otherwise(0).alias("watch_rows"), rows(risk).alias("risk_rows"), rows(market).alias("market_rows"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit('class="sig sig-([SABC])"'), F.lit(1)))), ",").alias("levels"),
    )
    return out.withColumn(
        "passed",
        (F.col("chapters") >= 8) & ((F.col("watch_cards") >= 3) | (F.col("watch_rows") >= 3)) & (F.col("risk_rows") >= 3) & (F.col("market_rows") >= 10) & (F.col("levels") != "")
    )


@F.pandas_udf(T.StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """Texts as JSON after light repair (outer junk, trailing commas, curly quotes, open brackets); null where it fails."""

    def fix(x: str | None) -> str | None:
        if not x or not (m := re.search(r"[\[{]", x)):
            return None
        x = re.sub(r",\s*([\]}])", r"\1", x[m.start() :].translate({0x201C: '"', 0x201D: '"'}))
        end = max(x.rfind("}"), x.rfind("]")) + 1
        stack, quoted, skip = [], False, False
        for c in x:
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "[{":
                stack.append("]" if c == "[" else "}")
            elif not quoted and c in "]}" and stack:
                stack.pop()
        for tried in (x[:end], x + '"' * quoted + "".join(reversed(stack))):
            try:
                return json.dumps(json.loads(re.sub(r",\s*([\]}])", r"\1", tried)), ensure_ascii=False)
            except ValueError:
                pass
        return None

    return text.map(fix)


#: Keys by which an object in a fence is known, looked for in this order.
FENCE_KEYS = (("STRUCTURED", ("events",)), ("CITATIONS", ("citation_density", "claims")), ("METADATA", ("quality_self_assessment", "regions_covered")))


def extract_blocks(docs: DataFrame, tags: tuple[str, ...] = ("METADATA", "CITATIONS", "STRUCTURED"), fence_keys=FENCE_KEYS) -> DataFrame:
    """(doc_id, <tag> JSON text or null for each tag, body without the blocks).

    A block that isn't closed ends at the next < or with the text. Only blocks that don't parse go through repair. Where no
    block is found, the objects in ```json fences are taken, each as the first tag of fence_keys of which it has a key; of
    several the last.
    """
    body = F.col("text")
    found = []
    for tag in tags:
        closed, open_ = rf"(?s)<{tag}>(.*?)</{tag}>", rf"<{tag}>([^<]*)"
        raw = F.coalesce(F.get(F.regexp_extract_all("text", F.lit(closed), F.lit(1)), 0), F.regexp_extract("text", open_, 1))
        found.append(F.nullif(F.trim(raw), F.lit("")).alias(f"_{tag}"))
        body = F.regexp_replace(body, rf"(?s)<{tag}>(?:.*?</{tag}>|[^<]*)", "")
    found.append(F.trim(F.regexp_replace(body, r"(?s)```json.*?```", "")).alias("body"))
    # an array of one row: what it holds is worked out once, where plain columns would be repeated in every later use
    out = docs.select("doc_id", "text", F.inline(F.array(F.struct(*found))))
    fine = out.select(
        "doc_id", "text", "body", *[F.when(F.try_parse_json(f"_{t}").isNotNull(), F.col(f"_{t}")).alias(t.lower()) for t in tags],
        *[f"_{t}" for t in tags]
    )
    broken = " or ".join(f"({t.lower()} is null and _{t} is not null)" for t in tags)
    good = fine.filter(f"not ({broken})").drop(*[f"_{t}" for t in tags])
    fixed = fine.filter(broken).select(
        "doc_id", "text", "body", *[F.coalesce(F.col(t.lower()), repaired_json(f"_{t}")).alias(t.lower()) for t in tags]
    )
    found = good.unionByName(fixed)
    fences = F.filter(F.regexp_extract_all("text", F.lit(r"(?s)```json\s*(.*?)\s*```"), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())
    known = F.lit(None).cast("string")
    kind = lambda x: known
    for tag, keys in reversed(fence_keys):
        kind = lambda x, tag=tag, keys=keys, rest=kind: F.when(F.arrays_overlap(F.json_object_keys(x), F.array(*map(F.lit, keys))), tag).otherwise(rest(x))
    none = F.lit(True)
    for t in tags:
        none = none & F.col(t.lower()).isNull()
    found = found.withColumn("_fences", F.when(none & F.col("text").contains("```json"), F.transform(fences, lambda x: F.struct(kind(x).alias("k"), x.alias("v")))))
    of = lambda t: F.try_element_at(F.filter("_fences", lambda x: x.k == t), F.lit(-1))["v"]
    return found.select("doc_id", "body", *[F.coalesce(F.col(t.lower()), of(t)).alias(t.lower()) for t in tags])


def _marked_lines(docs: DataFrame, excerpt: int = 0) -> DataFrame:
    """Lines of each row of docs (_row) with their number, the last heading above them (heading) and their list item (item);
    the first line also carries the text's first excerpt characters.

    All windows over a row's lines keep to its partition, so that the texts' lines are moved once.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")  # numbered before the lines are made
    lines = rows.select(
        "_row", "doc_id", F.substring("text", 1, excerpt).alias("excerpt"), F.posexplode_outer(F.split("text", "\n")).alias("n", "line")
    )
    order = Window.partitionBy("_row").orderBy("n")
    head = F.nullif(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1), F.lit(""))
    item = F.nullif(F.trim(F.regexp_extract("line", r"^\s*(?:[-*•]|\d+[.、])\s+(.*)$", 1)), F.lit(""))
    part = lambda pattern, least: F.when(F.length(F.trim(F.regexp_extract("line", pattern, 1))) > least, F.trim(F.regexp_extract("line", pattern, 1)))
    return lines.select(
        "_row", "doc_id", "n", F.when(F.col("n") == 0, F.col("excerpt")).alias("excerpt"), head.alias("_h"), item.alias("item"),
        part(r"^\s*[-*]\s+(.*)$", 5).alias("bullet"), part(r"^\s*###\s+(.*)$", 3).alias("title")
    ).withColumn("heading", F.last("_h", ignorenulls=True).over(order)).drop("_h")


def _place(among: Column, *keys: str) -> Column:
    """The place of a line among those of its row (and keys) for which the condition holds."""
    return F.sum(among.cast("int")).over(Window.partitionBy("_row", *keys).orderBy("n"))


def _section(heading: str) -> Column:
    return F.coalesce(F.col("item").isNotNull() & F.col("heading").rlike(heading), F.lit(False))


def _taken(heading: str, k: int, other: Column | None, other_k: int) -> Column:
    """What a line gives: its item in the first k under headings that match; in a row without any, the first other_k others."""
    inside = _section(heading)
    own = F.when(inside & (_place(inside) <= k), F.col("item"))
    if other is None:
        return own
    none = F.coalesce(F.max(inside).over(Window.partitionBy("_row")), F.lit(False)) == F.lit(False)
    return F.when(none, F.when(other.isNotNull() & (_place(other.isNotNull()) <= other_k), other)).otherwise(own)


def bullets_with(word: str) -> Column:
    """List items of more than 5 letters with the word, as a fallback of sections."""
    return F.when(F.col("bullet").contains(word), F.col("bullet"))


def third_level_titles() -> Column:
    """Titles of the third level of more than 3 letters, as a fallback of sections."""
    return F.col("title")


def _with_regions(rows: DataFrame, regions: dict[str, str], per_heading: int, per_region: int) -> DataFrame:
    """rows with region and rank_region, the place among its region's items, where a line is taken as one."""
    name = F.lit(None).cast("string")
    for region, pattern in reversed(list(regions.items())):
        name = F.when(F.col("heading").rlike(pattern), region).otherwise(name)
    rows = rows.withColumn("region", F.when(F.col("item").isNotNull(), name))
    rows = rows.withColumn("_in", F.col("region").isNotNull() & (_place(F.col("region").isNotNull(), "heading") <= per_heading))
    rows = rows.withColumn("rank_region", F.when(F.col("_in"), _place(F.col("_in"), "region")))
    return rows.withColumn("rank_region", F.when(F.col("rank_region") <= per_region, F.col("rank_region").cast("int"))).drop("_in")


def extract_section_items(docs: DataFrame, heading: str = "信号|风险|观察哨", k: int = 10, other: Column | None = None, other_k: int = 5) -> DataFrame:
    """(doc_id, rank, item): the first k list items under headings that match; where there are none, the first other_k
    of other: bullets_with() a word (for signals, 5) or third_level_titles() (for clusters, 10). Rows that repeat a doc_id
    each give theirs."""
    rows = _marked_lines(docs).withColumn("_got", _taken(heading, k, other, other_k)).filter("_got is not null")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy("n"))
    return rows.select("doc_id", rank.alias("rank"), F.col("_got").alias("item"))


def extract_region_items(docs: DataFrame, regions: dict[str, str], per_heading: int = 3, per_region: int = 5) -> DataFrame:
    """(doc_id, region, rank, item): items under headings of a region (first pattern that matches); rows that repeat a
    doc_id each give theirs."""
    rows = _with_regions(_marked_lines(docs), regions, per_heading, per_region).filter("rank_region is not null")
    return rows.select("doc_id", "region", F.col("rank_region").alias("rank"), "item")


def build_history(docs: DataFrame, regions: dict[str, str], signals: str = "信号|风险|观察哨", clusters: str = "聚类", excerpt: int = 500) -> DataFrame:
    """I4: (doc_id, signals, clusters, regions map, summary_excerpt), a row for each row of docs; null where there is nothing.

    Without a section of signals, list items that name a risk are taken, and without one of clusters, third-level titles.
    """
    rows = _marked_lines(docs, excerpt)
    rows = rows.withColumns({
        "_signals": _taken(signals, 10, bullets_with("风险"), 5), "_clusters": _taken(clusters, 15, third_level_titles(), 10)
    })
    rows = _with_regions(rows, regions, 3, 5)
    some = lambda c: F.when(F.size(c) > 0, c)
    pack = lambda got: some(F.transform(F.array_sort(F.collect_list(F.when(got.isNotNull(), F.struct(F.col("n"), got.alias("got"))))), lambda x: x.got))
    placed = F.array_sort(F.collect_list(F.when(F.col("rank_region").isNotNull(), F.struct("n", "region", "item"))))
    out = rows.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.max("excerpt").alias("summary_excerpt"), pack(F.col("_signals")).alias("signals"),
        pack(F.col("_clusters")).alias("clusters"), placed.alias("_placed")
    )
    of = lambda r: F.transform(F.filter("_placed", lambda x: x.region == r), lambda x: x.item)
    names = F.array_sort(F.array_distinct(F.transform("_placed", lambda x: x.region)))
    out = out.withColumn(
        "regions",
        F.when(F.size("_placed") > 0, F.map_from_entries(F.transform(names, lambda r: F.struct(r.alias("region"), of(r).alias("items")))))
    )
    return out.select("doc_id", "signals", "clusters", "regions", "summary_excerpt")


def split_chapters(pages: DataFrame) -> DataFrame:
    """(page_id, n, title, body): sections that begin with h2; the whole page where there is none."""
    parts = F.split("html", r"(?i)(?=<h2\b)")
    some = F.filter(parts, lambda p: F.lower(p).startswith("<h2"))
    rows = pages.select("page_id", F.posexplode(F.when(F.size(some) > 0, some).otherwise(F.array("html"))).alias("n", "part"))
    title = strip_tags(F.regexp_extract("part", r"(?is)^<h2\b[^>]*>(.*?)</h2>", 1))
    return rows.select("page_id", "n", title.alias("title"), F.regexp_replace("part", r"(?is)^<h2\b[^>]*>.*?</h2>", "").alias("body"))


def extract_cards(pages: DataFrame, labels: list[str]) -> DataFrame:
    """(page_id, n, one column for each label): paragraphs in which the first label is found, split at the labels.

    A paragraph without it, but with another label and a colon, is a card in plain text: what stands before the first of the
    other labels that it has is its name, and the others' values end at the next label or colon mark ;.
    """
    stop = "|".join(re.escape(x) for x in labels)
    others = "|".join(re.escape(x) for x in labels[1:]) or "(?!)"
    colon = r"\s*[:：]\s*"
    paragraphs = F.filter(
        F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), strip_tags),
        lambda p: p.contains(labels[0]) | p.rlike(f"(?:{others}){colon}")
    )
    rows = pages.select("page_id", F.posexplode(paragraphs).alias("n", "p")).withColumn("_named", F.col("p").contains(labels[0]))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    value = lambda x: some(F.regexp_extract("p", rf"(?s){re.escape(x)}\s*[:：]?\s*(.*?)(?={stop}|$)", 1))
    name = F.coalesce(*[F.when(F.col("p").rlike(re.escape(x) + colon), F.regexp_extract("p", rf"(?s)^(.*?){re.escape(x)}{colon}", 1)) for x in labels[1:]], F.lit(""))
    name = some(F.regexp_replace(F.trim(name), "^[:：]+|[:：]+$", ""))
    plain = lambda x: some(F.regexp_replace(F.trim(F.try_element_at(
        F.regexp_extract_all("p", F.lit(rf"(?s){re.escape(x)}{colon}(.*?)(?=(?:{others})\s*[:：]|$)"), F.lit(1)), F.lit(-1)
    )), "^[；;]+|[；;]+$", ""))
    either = lambda k, x: F.when(F.col("_named"), value(x)).otherwise(name if k == 0 else plain(x))
    return rows.select("page_id", "n", *[either(k, x).alias(x) for k, x in enumerate(labels)])


def html_excerpt(pages: DataFrame) -> DataFrame:
    """(page_id, headings, paragraphs): up to ten h2 titles and five paragraphs of middle length, cut at 100."""
    h = F.slice(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h2\b[^>]*>(.*?)</h2>"), F.lit(1)), strip_tags), 1, 10)
    p = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), strip_tags)
    p = F.slice(F.filter(p, lambda x: (F.length(x) > 20) & (F.length(x) < 500)), 1, 5)
    return pages.select(
        "page_id", F.array_join(h, "\n").alias("headings"),
        F.array_join(F.transform(p, lambda x: F.substring(x, 1, 100)), "\n").alias("paragraphs")
    )


def parse_market_lines(docs: DataFrame) -> DataFrame:
    """I8: lines `- name: price unit (±chg% ...) trend [time]` to rows."""
    pattern = r"^\s*-\s*([^:：]+)[:：]\s*([\d,.]+)\s*([^\s(（]*)\s*[(（]([+-]?[\d.]+)%[^)）]*[)）]\s*([^\s\[]*)\s*(?:\[([^\]]*)\])?"
    g = lambda i: F.nullif(F.trim(F.regexp_extract("line", pattern, i)), F.lit(""))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter(F.col("line").rlike(pattern))
    return rows.select(
        "doc_id", "n", g(1).alias("name"), F.regexp_replace(g(2), ",", "").try_cast("double").alias("price"), g(3).alias("unit"),
        g(4).try_cast("double").alias("change_pct"), g(5).alias("trend"), g(6).alias("label")
    )


def extract_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", long: int = 100) -> DataFrame:
    """(id, n, url, is_long, is_placeholder) of each URL in a text."""
    rows = docs.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(r"https?://[^\s)\]\"'<>]+"), F.lit(0))).alias("n", "url"))
    return rows.withColumns({"is_long": F.length("url") > long, "is_placeholder": F.col("url").rlike(S.words_pattern(V.PLACEHOLDER_URLS))})


def signal_mentions(pages: DataFrame, excluded: str | None = None) -> DataFrame:
    """(page_id, n, s, a, b, c): mentions of levels in each chapter, without the subsection of that title."""
    rows = split_chapters(pages)
    body = F.regexp_replace("body", rf"(?is)<h3\b[^>]*>[^<]*{re.escape(excluded)}.*?(?=<h3\b|$)", "") if excluded else F.col("body")
    return rows.select(
        "page_id", "n", "title", *[F.regexp_count(body, F.lit(rf"(?U)(?<!\w){k}(?:级|-level)(?!\w)")).alias(k.lower()) for k in "SABC"]
    )


def explode_citations(structured: DataFrame, news: DataFrame) -> DataFrame:
    """(run_id, claim, ordinal, url): references of claims with the news row of that ordinal; url null for a reference
    to no row, and one row with ordinal null for a claim without references."""
    refs = structured.select("run_id", F.posexplode("claims").alias("claim", "_c")).select(
        "run_id", "claim", F.explode_outer("_c.news_refs").alias("ordinal")
    )
    return refs.join(news.select("run_id", "ordinal", "url"), ["run_id", "ordinal"], "left").select("run_id", "claim", "ordinal", "url")
