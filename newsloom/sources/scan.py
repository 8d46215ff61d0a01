"""Scans of landed feeds, pages, quotes and history."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import scalars as S
from newsloom.functions import vocab as V

EVENT_SCHEMA = "event_id string, title string, signal_level string, confidence string, actors array<string>, domains array<string>, trend string, summary string, sources array<string>, related_events array<string>, phase string, source_lean string, lean_reasoning string"


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A1 landing: items of RSS files, all columns as strings."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, published string, updated string, pubDate string, description string").load(path)


def scan_feed_entries(
    raw: DataFrame, as_of: Column, per_source: int = 30, max_days: int = 3, noise: list[str] = (), priority: list[str] = ()
) -> DataFrame:
    """A1: (source, pos, title, link, published, updated, summary) to news rows.

    The first per_source entries of a source by pos; blank titles or links, stale and irrelevant entries go.
    """
    first = Window.partitionBy("source").orderBy("pos")
    out = raw.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= per_source).drop("_rn")
    out = out.filter((F.trim("title") != "") & (F.trim("link") != ""))
    out = out.withColumns({
        "published": first_date("published", "updated"), "summary": F.substring(strip_tags(F.coalesce("summary", F.lit(""))), 1, 500),
        "url": F.trim("link")
    })
    out = not_stale(out, as_of, max_days)
    return relevant(out, list(noise), list(priority)).drop("link", "updated")


def first_date(*columns: str) -> Column:
    """The first of the columns that reads as a time; where none does, the first that is not blank."""
    text = [F.nullif(F.trim(c), F.lit("")) for c in columns]
    return F.coalesce(*[F.when(S.parsed_time(c).isNotNull(), t) for c, t in zip(columns, text, strict=True)], *text)


def not_stale(df: DataFrame, as_of: Column, max_days: int = 3) -> DataFrame:
    """No date is stale, an unreadable one is kept, else more than max_days whole days before as_of is stale."""
    blank = F.coalesce(F.trim("published") == "", F.lit(True))
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(S.parsed_time("published"))) / 86400)
    return df.filter(~blank & ~F.coalesce(days > max_days, F.lit(False)))


def relevant(df: DataFrame, noise: list[str] = V.NOISE_WORDS, priority: list[str] = V.PRIORITY_WORDS) -> DataFrame:
    """B1: rows without a noise word, or with a priority word."""
    text = F.concat_ws(" ", "title", "summary")
    return df.filter(~S.has_any(text, noise) | S.has_any(text, priority))


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DATED = re.compile("date|time|publish", re.I)
WORD = re.compile(r"\S+")
LINKS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("href", "text", "time", "dated")]))


class _Open:
    """An open element: where its text begins, and what has been found in it so far."""

    def __init__(self, tag: str, begins: int, time: str | None, is_dated: bool, link: dict | None):
        self.tag, self.begins, self.time, self.is_dated, self.link = tag, begins, time, is_dated, link
        self.stamp: str | None = None  # the datetime of the first time element inside
        self.dated: str | None = None  # the first text of 8 letters inside an element of a class for dates
        self.waiting: list[dict] = []  # links of the anchors directly in it


class _Enough(Exception):
    """Nothing that follows can change the links."""


class _Links(HTMLParser):
    """The first anchors of a page, in one pass: an element that closes hands what it has found to the one around it."""

    def __init__(self, html: str, limit: int):
        super().__init__(convert_charrefs=True)
        self.limit, self.links, self.undecided = limit, [], 0
        self.texts: list[str] = []  # without blank ones
        self.stack = [_Open("", 0, None, False, None)]
        self.open_tags: Counter[str] = Counter()
        try:
            self.feed(html if limit > 0 else "")
            self.close()
        except _Enough:
            pass
        while self.stack:
            self._close_last()

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        link = None
        if tag == "a" and len(self.links) < self.limit:
            link = {"href": (found.get("href") or "").strip(), "text": "", "time": "", "dated": ""}
            self.links.append(link)
            self.stack[-1].waiting.append(link)
            self.undecided += 1
        time = (found.get("datetime") or "").strip() if tag == "time" else None
        self.stack.append(_Open(tag, len(self.texts), time, bool(DATED.search(found.get("class") or "")), link))
        self.open_tags[tag] += 1
        if tag in VOID:
            self._close_last()

    def handle_endtag(self, tag):
        if self.open_tags[tag]:
            while self.stack[-1].tag != tag:
                self._close_last()
            self._close_last()
        if len(self.links) == self.limit and not self.undecided:
            raise _Enough

    def handle_data(self, data):
        if not data.isspace():
            self.texts.append(data)

    def _letters(self, begins: int, n: int) -> str:
        """The first n letters of the text from there on, blanks as one space each; one word may be looked at whole."""
        words, size = [], -1
        for text in self.texts[begins:]:
            for word in WORD.finditer(text):
                words.append(word[0])
                size += 1 + len(word[0])
                if size >= n:
                    return " ".join(words)[:n]
        return " ".join(words)

    def _close_last(self) -> None:
        done = self.stack.pop()
        self.open_tags[done.tag] -= 1
        if done.link is not None:
            done.link["text"] = " ".join(" ".join(self.texts[done.begins :]).split())
            done.link["time"] = done.stamp or ""
        for link in done.waiting:
            link["time"] = link["time"] or done.stamp or ""
            link["dated"] = done.dated or ""
            self.undecided -= 1
        if not self.stack:
            return
        around = self.stack[-1]
        if around.stamp is None:
            around.stamp = done.stamp if done.time is None else done.time
        if around.dated is None:
            text = self._letters(done.begins, 25) if done.is_dated else ""
            around.dated = text if len(text) >= 8 else done.dated


def page_links(limit: int):
    """The first limit anchors of pages with their texts, the time in them or else in their parent, and the parent's first
    dated text. Time and memory grow with the page, however its elements are nested or left open."""

    @F.pandas_udf(LINKS)
    def found(html: pd.Series) -> pd.Series:
        return html.map(lambda x: _Links(x or "", limit).links)

    return found


def scan_page_links(
    pages: DataFrame, as_of: Column, per_page: int = 30, min_text: int = 10, noise: list[str] = (), priority: list[str] = ()
) -> DataFrame:
    """A2 and A3: (page_id, url, html) to links (page_id, pos, url, title, published).

    The first per_page anchors; text of min_text characters or more; relative addresses completed with the page's host;
    others than http and irrelevant titles (B1) dropped. published: the time element in the anchor, else in its parent,
    else a date in the link's path, else a text of the parent's classes for dates, else as_of.
    """
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    base = F.regexp_extract("url", r"^(https?://[^?#]*/)", 1)
    rows = pages.select(
        "page_id", host.alias("_host"), F.when(base == "", F.concat(host, F.lit("/"))).otherwise(base).alias("_base"),
        F.posexplode(page_links(per_page)("html")).alias("pos", "_a")
    )
    href = F.col("_a.href")
    full = F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat("_host", href)).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(href.startswith("#") | (href == ""), None).otherwise(F.concat("_base", href))
    rows = rows.select(
        "page_id", "pos", full.alias("url"), F.col("_a.text").alias("title"), F.col("_a.time").alias("_time"),
        F.col("_a.dated").alias("_dated")
    )
    dated = F.regexp_replace(F.regexp_extract("url", r"/(\d{4}/\d{1,2}/\d{1,2})/", 1), "/", "-")
    some = lambda c: F.nullif(c, F.lit(""))
    rows = rows.withColumn("published", F.coalesce(some(F.col("_time")), some(dated), some(F.col("_dated")), F.date_format(as_of, "yyyy-MM-dd")))
    rows = rows.filter(F.col("url").isNotNull() & (F.length("title") >= min_text)).drop("_time", "_dated").withColumn("summary", F.lit(None).cast("string"))
    return relevant(rows, list(noise), list(priority)).drop("summary")


def select_sources(sources: DataFrame, limit: int | None = None) -> DataFrame:
    """A4: without experimental ones; of a limit, tier 1 first and then file order."""
    out = sources.filter(~F.coalesce("experimental", F.lit(False)))
    return out if limit is None else out.orderBy((F.col("tier") == 1).desc(), "pos").limit(limit)


def failover(entries: DataFrame) -> DataFrame:
    """A5: of each source, the rows of the first URL (least url_rank) that gave any."""
    return entries.withColumn("_r", F.dense_rank().over(Window.partitionBy("source").orderBy("url_rank"))).filter("_r = 1").drop("_r")


def scan_events(spark: SparkSession, path: str, as_of: str, days: int) -> DataFrame:
    """Events of the last days before as_of from folders date=YYYY-MM-DD of JSON lines; broken lines are left out."""
    schema = T.StructType.fromDDL(EVENT_SCHEMA + ", _corrupt_record string")
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    recent = (F.col("date").cast("date") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("date").cast("date") <= F.lit(as_of).cast("date"))
    return df.filter(recent).filter(F.col("_corrupt_record").isNull() & F.col("title").isNotNull()).drop("_corrupt_record")


def scan_history(history: DataFrame, max_days: int = 90) -> DataFrame:
    """Rows of the newest max_days dates."""
    newest = history.select("date").distinct().orderBy(F.col("date").desc()).limit(max_days)
    return history.join(F.broadcast(newest), "date", "left_semi")  # max_days dates are broadcast


def scan_price_history(df: DataFrame, as_of: Column, lookback: int = 14) -> DataFrame:
    """(date, key, value) where value is JSON, a number or an object with a price: (date, key, price)."""
    v = F.try_parse_json("value")
    price = F.coalesce(F.try_variant_get(v, "$.price", "double"), F.try_variant_get(v, "$", "double"))
    near = (F.col("date") >= F.date_sub(as_of, lookback)) & (F.col("date") < as_of)
    return df.filter(near).select("date", "key", price.alias("price")).filter(F.col("price").isNotNull() & ~F.isnan("price"))


def score_spine(scores: DataFrame, as_of: Column, days: int) -> DataFrame:
    """A row for each theme and each of the last days before as_of, score null where there is none."""
    themes = scores.select("theme").distinct()
    spine = themes.select("theme", F.explode(F.sequence(F.date_sub(as_of, days), F.date_sub(as_of, 1))).alias("date"))
    return spine.join(scores.select("theme", "date", "score"), ["theme", "date"], "left")


def in_session(at: Column) -> Column:
    """Whether a time of the exchange falls into its hours: Monday to Friday, 9:30 to 11:30 and 13:00 to 15:00, by the minute."""
    minute = F.hour(at) * 60 + F.minute(at)
    return F.weekday(at).between(0, 4) & (minute.between(9 * 60 + 30, 11 * 60 + 30) | minute.between(13 * 60, 15 * 60))


def scan_quote_lines(lines: DataFrame, symbols: DataFrame, at: Column) -> DataFrame:
    """A10: value lines `var hq_str_SYM="a,b,..."` to (key, price, change_pct, trend, label), read at the exchange's time at.

    Fields by the symbol's prefix, from 0: index lines have price 1 and previous close 2; rt_hk price 2 and previous close
    3; fx_ price 1 and the change in % in 10, else within the session against the open in 5, else 0. A change in 10 that is
    no number is 0; against a close of 0 it is 0. Lines of fewer than 4 fields, with a figure that is no number or a price of
    0 or less are dropped. label: day and time within the session, else day and 收盘; for fx_ day and the line's own time.
    symbols: (symbol, key).
    """
    found = r'hq_str_(\w+)="([^"]*)"'
    rows = lines.select(F.regexp_extract("value", found, 1).alias("symbol"), F.split(F.regexp_extract("value", found, 2), ",").alias("f"))
    rows = rows.filter((F.col("symbol") != "") & (F.size("f") >= 4))
    fx, hk, session = F.col("symbol").startswith("fx_"), F.col("symbol").startswith("rt_hk"), in_session(at)
    field = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    num = lambda i: field(i).try_cast("double")
    # one-element arrays: what they hold is worked out once, where a plain column would be repeated in every later use
    rows = rows.select("symbol", "f", F.explode(F.array(F.when(hk, num(2)).otherwise(num(1)))).alias("_p"))
    rows = rows.select("symbol", "f", "_p", F.explode(F.array(F.when(hk, num(3)).when(fx, num(5)).otherwise(num(2)))).alias("_b"))
    moved = F.when(F.col("_b") == 0, 0.0).otherwise((F.col("_p") - F.col("_b")) / F.col("_b") * 100)
    fx_change = F.when(field(10) != "", F.coalesce(num(10), F.lit(0.0))).when(session & (field(5) != ""), moved).otherwise(0.0)
    closed = F.when(session, F.date_format(at, "MM-dd HH:mm 'CST'")).otherwise(F.concat(F.date_format(at, "MM-dd"), F.lit(" 收盘")))
    label = F.when(fx & (field(0) != ""), F.concat_ws(" ", F.date_format(at, "MM-dd"), field(0), F.lit("UTC"))).otherwise(closed)
    out = rows.select("symbol", "_p", F.explode(F.array(F.when(fx, fx_change).otherwise(moved))).alias("_c"), label.alias("label"))
    out = out.filter("_p > 0 and _c is not null").withColumn("trend", F.when(F.col("_c") > 0, "↑").when(F.col("_c") < 0, "↓").otherwise("→"))
    return out.join(symbols, "symbol").select("key", F.round("_p", 4).alias("price"), F.round("_c", 2).alias("change_pct"), "trend", "label")


def scan_check_quotes(lines: DataFrame, symbols: DataFrame, usable: bool = True) -> DataFrame:
    """A10, second layout: value lines `var hq_str_SYM="a,b,..."` to (key, price) for checks against other providers.

    FX (fx_): price 1, futures: price 0, times the symbol's unit factor. symbols: (symbol, key, factor; null is 1). usable:
    only prices above 0; without it every line of a known symbol, with a null price where it is no number.
    """
    found = r'hq_str_(\w+)="([^"]*)"'
    rows = lines.select(
        F.regexp_extract("value", found, 1).alias("symbol"), F.split(F.regexp_extract("value", found, 2), ",").alias("f")
    ).filter("symbol <> ''")
    price = F.get("f", F.when(F.col("symbol").startswith("fx_"), 1).otherwise(0)).try_cast("double")
    out = rows.select("symbol", price.alias("_p")).join(symbols, "symbol")
    out = out.select("key", (F.col("_p") * F.coalesce("factor", F.lit(1.0))).alias("price"))
    return out.filter("price > 0") if usable else out


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """A11 landing: files of nested Cube elements, days (time) of currencies (currency, rate), to (date, currency, rate).

    Days without a readable date and currencies without a name or a readable rate are left out.
    """
    cube = "Cube struct<Cube: array<struct<_time: string, Cube: array<struct<_currency: string, _rate: string>>>>>"
    days = spark.read.format("xml").option("rowTag", "Envelope").option("ignoreNamespace", "true").schema(cube).load(path)
    rates = days.select(F.explode("Cube.Cube").alias("d")).select(F.col("d._time").try_cast("date").alias("date"), F.explode("d.Cube").alias("c"))
    rates = rates.select("date", F.col("c._currency").alias("currency"), F.col("c._rate").try_cast("double").alias("rate"))
    return rates.filter("date is not null and currency <> '' and rate is not null")


def fx_cross_rates(rates: DataFrame) -> DataFrame:
    """(date, currency, rate against EUR) to eurusd, gbpusd, usdjpy of each date."""
    wide = rates.groupBy("date").pivot("currency", ["USD", "GBP", "JPY"]).agg(F.first("rate"))
    return wide.select(
        "date", F.round("USD", 5).alias("eurusd"), F.round(F.try_divide("USD", "GBP"), 5).alias("gbpusd"),
        F.round(F.try_divide("JPY", "USD"), 2).alias("usdjpy")
    )


def latest_observation(obs: DataFrame) -> DataFrame:
    """Of each series the newest value that is a number ("." and blank are missing)."""
    return obs.withColumn("value", F.col("value").try_cast("double")).filter("value is not null").groupBy("series").agg(
        F.max("date").alias("date"), F.max_by("value", "date").alias("value")
    )


def scan_price_maps(df: DataFrame) -> DataFrame:
    """JSON objects key -> {close or price} to (key, price)."""
    m = F.from_json("value", "map<string, struct<close: double, price: double>>")
    return df.select(F.explode(m).alias("key", "v")).select("key", F.coalesce("v.close", "v.price").alias("price")).filter("price is not null")
