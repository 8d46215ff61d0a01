"""Hand-made rows: the documented cases and traps that the tables don't hold."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import scalars as S
from newsloom.operators import documents as D
from newsloom.operators import events as E
from newsloom.operators import news as N
from newsloom.operators import risk as R
from newsloom.operators.graph import connected_components
from newsloom.sources import scan, sinks

DAY = dt.date(2024, 1, 1)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://example.com/path/", "https://example.com/path"),
        ("https://example.com/page?utm_source=google&utm_medium=cpc&id=123", "https://example.com/page?id=123"),
        ("https://example.com/page?fbclid=abc123&id=1", "https://example.com/page?id=1"),
        ("https://example.com/search?q=test&page=2", "https://example.com/search?q=test&page=2"),
        ("https://example.com/path", "https://example.com/path"),
        ("  https://example.com  ", "https://example.com"),
        ("https://example.com/page#section1", "https://example.com/page"),
        ("https://example.com/path/?utm_source=a", "https://example.com/path"),
        ("https://example.com/p?hlabel=1&x=2", "https://example.com/p?x=2"),
        ("not a url", "not a url"),
        ("", ""),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, u=S.normalize_url(F.lit(url))).u == want


def test_identity_key(spark):
    key = lambda actors: one(spark, k=S.identity_key(F.lit("军事"), F.array(*map(F.lit, actors)), F.lit("hormuz strait"), F.lit(None))).k
    assert key(["us", "Iran "]) == key(["iran", "US", "us"]) == "MILITARY|IRAN,US|HORMUZ_STRAIT|"
    assert key(list("edcba")).split("|")[1] == "A,B,C"
    assert len(one(spark, i=S.event_id(F.lit("x"))).i) == 12


def test_codes_and_ids(spark):
    names = [("United States", "US"), ("us", "US"), ("iran", "IR"), ("伊朗", "IR"), ("china", "CN")]
    found = lambda t: one(spark, c=S.extract_codes(F.lit(t), names, 3)).c
    assert found("US strikes Iran") == ["IR", "US"] and found("focus on busy") == [] and found("美国伊朗") == ["IR"]
    ident = lambda t: one(spark, c=S.canonical_event_id(F.lit(t), names, [("strike", "STRIKE")], [("oil", "OIL")], [("Taiwan", 9, ["taiwan"], ["movie"]), ("Any", 1, ["taiwan"], [])])).c
    assert ident("Iran strikes oil") == "ir-strike-oil" and ident("Taiwan vote") == "taiwan" and ident("taiwan movie") == "any"
    assert ident("Something else").startswith("something-else-")


def test_times(spark):
    for text in ("2024-01-02 03:04:05", "2024-01-02 03:04", "Tue, 02 Jan 2024 03:04:05 GMT", "Tue, 02 Jan 2024 03:04:05 +0000", "2024-01-02T03:04:05Z"):
        assert one(spark, t=S.parsed_time(F.lit(text))).t.replace(second=0) == dt.datetime(2024, 1, 2, 3, 4), text
    assert one(spark, t=S.parsed_time(F.lit("soon"))).t is None
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "soon"), (4, "2024-01-01"), (5, "2024-01-09")], "id int, published string")
    assert {r.id for r in scan.not_stale(rows, F.lit("2024-01-10").cast("timestamp"), 3).collect()} == {3, 5}


def test_two_key_dedup(spark):
    rows = [(1, "u1", "f1"), (2, "u1", "f2"), (3, "u3", "f2"), (4, "", "f9")]
    df = spark.createDataFrame(rows, "pos int, url string, title string").withColumn("source", F.lit("s"))
    assert {r.pos for r in N.dedup_news(df).collect()} == {1, 3}
    # a row dropped by its title still holds its URL: the two passes drop the third row
    chain = spark.createDataFrame([(1, "u1", "f1"), (2, "u2", "f1"), (3, "u2", "f3")], "pos int, url string, title string").withColumn("source", F.lit("s"))
    assert {r.pos for r in N.dedup_news(chain).collect()} == {1}
    again = N.dedup_news(df).drop("url_hash", "fingerprint")
    assert N.dedup_news(again).count() == again.count()


def test_quality_checks_judge_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    out = D.quality_checks(docs, "en", 100)
    filters = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("regexp" in x or "RLIKE" in x for x in filters)
    assert {r.doc_id for r in out.collect()} == {1}


def test_coverage_counts_urls_and_common_words_exactly(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))] + [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))]
        rows.append((k, rng.choice([f"u{k}", f"u{k}", "shared", f"v{k % 9}", None]), " ".join(words)))
    word_set = {k: set(t.split()) for k, _, t in rows}
    near = lambda a, b: len(word_set[a] & word_set[b]) > 0.5 * max(len(word_set[a]), len(word_set[b]))
    want = {k: 1 + sum(u is not None and v is not None and u != v and near(k, j) for j, v, _ in rows) for k, u, _ in rows}
    df = spark.createDataFrame(rows, "id int, url string, title string")
    assert {r.id: r.coverage_count for r in N.coverage_count(df).collect()} == want
    # similar titles are decided where they meet: nothing but the pairs themselves is made for them
    plan = N.coverage_pairs(df.filter("title <> ''").select(F.xxhash64(N.title_words()).alias("s"), N.title_words().alias("w")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_coverage(spark):
    rows = [(1, "a", "x y z"), (2, "b", "z y x"), (3, "a", "x y z"), (4, "c", "x y q r"), (5, "d", "lone"), (6, "e", "lone"), (7, "f", ""), (8, "g", None)]
    got = {r.id: r.coverage_count for r in N.coverage_count(spark.createDataFrame(rows, "id int, url string, title string")).collect()}
    words = {i: set((t or "").split()) for i, _, t in rows}
    for i, u, _ in rows:
        near = [j for j, v, _ in rows if v != u and words[i] and words[j] and len(words[i] & words[j]) > 0.5 * max(len(words[i]), len(words[j]))]
        assert got[i] == 1 + len(near)


def test_stratified(spark):
    rows = [(k, "big" if k < 20 else "small", float(100 - k)) for k in range(24)]
    df = spark.createDataFrame(rows, "pos int, region string, importance_score double")
    got = N.stratified_top(df, 10).collect()
    assert len(got) == 10 and sum(r.region == "small" for r in got) == 3
    assert {r.region for r in N.stratified_top(df, 2).collect()} == {"big"}


def test_diverse_sample(spark):
    rows = [(k, k, "t", "s" * 10, ["a", "a", "b", "c"][k % 4], f"src{k % 2}") for k in range(12)]
    got = N.diverse_sample(spark.createDataFrame(rows, "id int, pos int, title string, summary string, region string, source string"), 4).collect()
    assert len(got) == 4 and {r.region for r in got} == {"a", "b", "c"}


def test_budget(spark):
    rows = [("g", 10, 0, 900), ("g", 5, 1, 60), ("g", 5, 2, 50), ("g", 1, 3, 40)]
    got = N.budget_pack(spark.createDataFrame(rows, "g string, priority int, pos int, cost int"), "g", 1000).first()
    assert (got.used, got.taken) == (1000, "0,1,3")


def ev(**k):
    return {"event_id": "e", "date": DAY, "pos": 0, "title": "t", "summary": "s", "phase": "diplomatic", "risk": 10, "signal_level": "C", "sources": ["a"]} | k


EV = "event_id string, date date, pos int, title string, summary string, phase string, risk int, signal_level string, sources array<string>"


def test_revisions(spark):
    rows = [ev(), ev(pos=1, risk=30, phase="military"), ev(date=DAY + dt.timedelta(1), risk=20, title="new")]
    df = spark.createDataFrame(rows, EV)
    got = E.build_revisions(df).orderBy("date").collect()
    assert [(r.risk, r.risk_delta, r.phase_transition) for r in got] == [(30, 0, None), (20, -10, "military→diplomatic")]
    head = E.event_heads(E.build_revisions(df)).first()
    assert (head.canonical_title, head.revisions, head.peak_risk, head.phase) == ("t", 2, 30, "diplomatic")
    assert E.events_by_date(E.event_heads(df), df, F.lit("2099-01-01").cast("date")).count() == 0


def test_evidence(spark):
    df = spark.createDataFrame([ev(sources=list("abcdefghijkl"))], EV)
    none = spark.createDataFrame([], "event_id string, date date, content_hash string")
    assert E.append_evidence(none, df).count() == 1 and E.append_evidence(none, df, per_source=True).count() == 10
    assert E.append_evidence(E.append_evidence(none, df), df).count() == 0


def test_merge_fold(spark):
    schema = "event_id string, pos int, title string, actors array<string>, sources array<string>, domains array<string>, related_events array<string>, signal_level string, summary string, phase string, trend string, confidence string, source_lean string, lean_reasoning string"
    rng = random.Random(5)
    rows = [("e", k, f"t{k}", rng.sample("abcd", 2), rng.sample("xyz", 2), None, [], rng.choice("SABC"), "s" * rng.randint(0, 5), f"p{k}", "up", "高", rng.choice(["中立", "l", "m"]), rng.choice(["", "r1", "r2"])) for k in range(9)]
    got = E.merge_events(spark.createDataFrame(rng.sample(rows, 9), schema)).first()
    uniq = lambda i: list(dict.fromkeys(x for r in rows for x in r[i] or []))
    rank = {"S": 4, "A": 3, "B": 2, "C": 1}
    lean, why = "中立", ""
    for r in rows:
        if r[12] != "中立":
            lean = r[12] if lean in ("中立", r[12]) else "混合"
            if r[13] and r[13] not in why:
                why = f"{why}; {r[13]}" if why else r[13]
    assert (got.title, got.actors, got.sources, got.phase) == ("t0", uniq(3), uniq(4), "p8")
    assert got.signal_level == max((r[7] for r in rows), key=lambda x: rank[x]) and got.summary == max((r[8] for r in rows), key=len)
    assert (got.source_lean, got.lean_reasoning) == (lean, why)


def test_relations(spark):
    edges = spark.createDataFrame([("a", "b", "r", DAY, DAY, None, [(DAY, 0.3)]), ("a", "c", "r", DAY, DAY, DAY, [(DAY, 0.3)])], "src string, dst string, relation string, first_seen date, last_confirmed date, expired date, history array<struct<date:date,confidence:double>>")
    later = DAY + dt.timedelta(3)
    new = spark.createDataFrame([("a", "b", "r", later, 0.5), ("a", "c", "r", later, 0.4)], "src string, dst string, relation string, date date, confidence double")
    got = E.upsert_relations(edges, new).collect()
    assert len(got) == 3
    live = {r.dst: r for r in got if r.expired is None}
    assert (live["b"].first_seen, live["b"].last_confirmed, len(live["b"].history)) == (DAY, later, 2) and len(live["c"].history) == 1


def test_search(spark):
    df = spark.createDataFrame([(1, "Iran talks in Oman"), (2, "talks about talks"), (3, "伊朗霍尔木兹海峡"), (4, "nothing")], "doc_id int, text string")
    ids = lambda *q: [r.doc_id for r in E.search(df, list(q)).collect()]
    assert ids("talk*") == [2, 1] and ids("iran", "oman") == [1] and ids("霍尔") == [3] and ids("尔木兹海") == [3] and ids("absent") == []


def test_merge_and_components(spark):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([(3, 2), (2, 1), (9, 8), (5, 5), (None, 1), (10, 9)], "a int, b int"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8}
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert all(got.get(a) == got.get(b) for a, b in edges) and all(c <= n for n, c in got.items())


def test_evolution(spark):
    moves = {("a", "b"): 40, ("b", "a"): -10}
    rng = random.Random(3)
    rows = [(e, DAY + dt.timedelta(d), rng.choice("ab")) for e in range(6) for d in sorted(rng.sample(range(40), 7))]
    end = DAY + dt.timedelta(120)
    got = {r.event_id: r for r in R.evolve(spark.createDataFrame(rows, "event_id int, date date, phase string"), moves, F.lit(end)).collect()}
    for e in range(6):
        by = {d: p for x, d, p in rows if x == e}
        day, risk, phase, seen = min(by), 0, None, None
        while day <= end:
            if day in by:
                if phase is not None and by[day] != phase:
                    risk = max(0, min(100, risk + moves.get((phase, by[day]), 0)))
                phase, seen = by[day], day
            else:
                risk = int(risk * math.exp(-0.693 * (day - seen).days / 14))
            day += dt.timedelta(1)
        assert (got[e].risk, got[e].phase, got[e].last_updated) == (risk, phase, seen)
        assert got[e].archived == (risk == 0 and (end - seen).days >= 60)


def test_blocks(spark):
    rows = [
        (1, '<METADATA>{"a": 1}</METADATA>body<STRUCTURED>{"x": [1, 2,]}</STRUCTURED>'), (2, 'text\n```json\n{"events": {"z": 1}}\n```\nend'), (3, "plain"),
        (4, "<STRUCTURED>hopeless</STRUCTURED>"), (5, '<CITATIONS>{"c": 1}\n<b>rest'), (6, '<METADATA>{"a": 1}</METADATA>```json\n{"events": 1}\n```'),
        (7, '```json\n{"claims": 1}\n```\n```json\n{"regions_covered": 2}```\n```json {"citation_density": 3}\n```\n```json\n{"events": [}\n```\n```json\n{"other": 1}\n```'),
        (8, '<STRUCTURED>nothing</STRUCTURED>```json\n{"claims": 1, "events": 2}\n```'), (9, None)
    ]
    got = {r.doc_id: r for r in D.extract_blocks(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].metadata == '{"a": 1}' and got[1].structured == '{"x": [1, 2]}' and got[1].body == "body"
    assert got[2].structured == '{"events": {"z": 1}}' and got[2].body == "text\n\nend" and got[3].structured is None and got[4].structured is None
    assert got[5].citations.strip() == '{"c": 1}' and got[5].body == "<b>rest"
    assert got[6].structured is None  # a block was found, so that fences are ordinary text
    assert (got[7].metadata, got[7].citations, got[7].structured) == ('{"regions_covered": 2}', '{"citation_density": 3}', None)
    assert got[8].structured == '{"claims": 1, "events": 2}' and got[8].citations is None and got[9].body is None


def test_section_fallbacks(spark):
    rows = [
        (1, "## 风险信号\n- one item\n- two\n## else\n- 风险 elsewhere here"), (2, "## else\n- 风险上升 a b\n* 风险 x\n- no such word\n1. 风险 numbered item\n" + "- 风险 again and again\n" * 9),
        (3, "### first title\n### ab\n text\n### second title"), (4, None), (5, "")
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    items = lambda **x: {d: [r.item for r in sorted(D.extract_section_items(df, **x).collect(), key=lambda r: r["rank"]) if r.doc_id == d] for d in range(1, 6)}
    got = items(other=D.bullets_with("风险"))
    assert got == {1: ["one item", "two"], 2: ["风险上升 a b"] + ["风险 again and again"] * 4, 3: [], 4: [], 5: []}
    assert items(heading="聚类", other=D.third_level_titles(), other_k=10)[3] == ["first title", "second title"]
    history = {r.doc_id: r for r in D.build_history(df, {}).collect()}
    assert history[2].signals == got[2] and history[3].clusters == ["first title", "second title"] and history[5].signals is None


def test_plain_cards(spark):
    labels = ["观察项", "当前状态", "升级触发", "缓和触发", "监控方式"]
    pages = [
        (1, "<p><strong>观察项：</strong>海峡 <strong>当前状态：</strong>紧张 <strong>升级触发</strong>：封锁</p>"),
        (2, "<p><strong>美伊谈判进展</strong>：当前状态：僵持；升级触发：<b>新制裁</b>；监控方式: 声明；</p><p>nothing here</p>"), (3, "<p>当前状态：无名；</p>"), (4, None)
    ]
    got = {r.page_id: tuple(r)[2:] for r in D.extract_cards(spark.createDataFrame(pages, "page_id int, html string"), labels).collect()}
    assert got == {
        1: ("海峡", "紧张", "封锁", None, None), 2: ("美伊谈判进展", "僵持", "新制裁", None, "声明"), 3: (None, "无名", None, None, None)
    }


def test_report_page(spark):
    def page(watch, risk, market, rows=10):
        return "".join(f'<h2 class="chapter-title">{k}</h2>' for k in range(8)) + f"<h3>{watch}（3-5个）</h3><table>" + "<tr><td>" * 3 + "</table>" + " " * 800 + f"<h3>{risk}</h3><table>" + "<tr><td>" * 3 + "</table>" + " " * 3000 + f"<h4>4.1 {market}</h4><table>" + "<tr>" * rows + '</table><span class="sig sig-A">'

    pages = [(1, page("未来48小时关键观察哨", "最高优先级风险", "核心市场数据")), (2, "<p>"), (3, page("48-Hour Key Watchpoints", "Top Priority Risks", "Market Data")), (4, page("48-Hour Key Watchpoints", "最高优先级风险", "Market Data", 9))]
    df = spark.createDataFrame([*pages, (5, None)], "page_id int, html string")
    got = {r.page_id: r for r in D.html_structure_checks(df).collect()}
    assert [(got[k].lang, got[k].passed) for k in (1, 2, 3, 4)] == [("zh", True), ("zh", False), ("en", True), ("en", False)]
    assert got[1].levels == "A" and (got[1].watch_rows, got[1].risk_rows, got[1].market_rows) == (3, 3, 10) and (got[4].risk_rows, got[4].market_rows) == (0, 9)
    assert {r.page_id: r.passed for r in D.html_structure_checks(df, lang="zh").collect()}[3] is False


def test_phase_change(spark):
    step = lambda now, text: tuple(one(spark, c=S.phase_change(F.lit(now), F.lit(text), {("diplomatic", "military"): 25, ("military", "de-escalation"): -20}, [("military", ["strike"], ["diplomatic"]), ("de-escalation", ["truce"], None)])).c)
    assert step("diplomatic", "a strike") == ("military", 25, "diplomatic → military (风险增量: +25)")
    assert step("military", "truce") == ("de-escalation", -20, "military → de-escalation (风险增量: -20)")
    assert step("economic", "a strike") == ("economic", 0, "") and step("economic", "truce") == ("de-escalation", 0, "")


def test_null_values_are_outside_a_vocabulary(spark):
    got = N.vocab_violations(spark.createDataFrame([("a",), (None,), ("z",), (None,)], "x string"), "x", ["a"]).collect()
    assert {(r.value, r.n) for r in got} == {(None, 2), ("z", 1)}


def test_links_and_dates(spark):
    html = '<time datetime="2024-01-05"></time><a href="/a/2024/02/03/x">a long enough text</a><a href="mailto:x@y">a long enough text</a><a href="p.html">another <b>long</b> text</a><a href="https://o.org/">short</a>'
    df = spark.createDataFrame([(1, "https://h.org/dir/index.html", html), (2, "https://h.org", html[34:])], "page_id int, url string, html string")
    got = {(r.page_id, r.url): r.published for r in scan.scan_page_links(df, F.lit("2024-03-01").cast("date")).collect()}
    assert got == {(1, "https://h.org/a/2024/02/03/x"): "2024-01-05", (1, "https://h.org/dir/p.html"): "2024-01-05", (2, "https://h.org/a/2024/02/03/x"): "2024-02-03", (2, "https://h.org/p.html"): "2024-03-01"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "dated")
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "x int, date string")
    sinks.write_dated(rows, path)
    sinks.write_dated(rows.filter("x = 2").withColumn("x", F.lit(3)), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 3]
    for v in (1, 2):
        sinks.write_state(rows.withColumn("v", F.lit(v)), str(tmp_path / "state"), v)
    assert {r.v for r in sinks.read_state(spark, str(tmp_path / "state")).collect()} == {2}
    history = spark.createDataFrame([(DAY + dt.timedelta(k), ["c"], ["s"], {"r": ["x"]}, "e") for k in (0, 100, 195)], "date date, clusters array<string>, signals array<string>, regions map<string,array<string>>, summary_excerpt string")
    sinks.apply_retention(history, F.lit(DAY + dt.timedelta(200)), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h/full")).count() == 1 and "regions" not in spark.read.parquet(str(tmp_path / "h/archive")).columns
    sinks.save_snapshot(rows, str(tmp_path / "snap"), "a")
    assert sinks.load_snapshot(spark, str(tmp_path / "snap"), "a").count() == 2 and sinks.list_snapshots(spark, str(tmp_path / "snap")).count() == 1


def test_feed_and_event_scans(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>https://x.org/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>B</title><link>u</link></item></channel></rss>")
    assert [r.title for r in scan.read_feed(spark, str(tmp_path / "feed.xml")).collect()] == ["A", "B"]
    for d, line in (("2024-01-01", '{"event_id": "e", "title": "t", "extra": 1}'), ("2024-01-02", '{"event_id": '), ("2023-01-01", '{"event_id": "old", "title": "t"}')):
        (tmp_path / f"ev/date={d}").mkdir(parents=True)
        (tmp_path / f"ev/date={d}/x.json").write_text(line + "\n")
    assert [r.event_id for r in scan.scan_events(spark, str(tmp_path / "ev"), "2024-01-03", 7).collect()] == ["e"]


def test_null_titles_and_sources_are_not_one_item(spark):
    rows = [(1, "u1", None, "s"), (2, "u2", "t", None), (3, "u3", None, None), (4, "u4", " T ", None), (5, "u5", "t", None), (6, None, "x", "s")]
    got = N.dedup_news(spark.createDataFrame(rows, "pos int, url string, title string, source string")).collect()
    assert {r.pos for r in got} == {1, 2, 3, 4}


def test_evolution_takes_the_last_row_of_a_day(spark):
    rows = [("e", DAY, 0, "a"), ("e", DAY + dt.timedelta(1), 1, "b"), ("e", DAY + dt.timedelta(1), 2, "a")]
    got = R.evolve(spark.createDataFrame(rows, "event_id string, date date, pos int, phase string"), {("a", "b"): 40}, F.lit(DAY + dt.timedelta(1))).first()
    assert (got.risk, got.phase, got.transitions) == (0, "a", 0)


def test_diverse_sample_keeps_null_regions(spark):
    rows = [(1, 1, "t", "s", None, "a"), (2, 2, "t", "s", "r", None), (3, 3, "t", "s", None, None)]
    df = spark.createDataFrame(rows, "id int, pos int, title string, summary string, region string, source string")
    assert {r.id for r in N.diverse_sample(df, 4).collect()} == {1, 2, 3}
    assert N.diverse_sample(df.limit(0), 4).count() == 0


def test_repeated_documents_are_judged_one_by_one(spark):
    text = "# S\n- a\n- b"
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id int, text string")
    assert [r.issues for r in D.quality_summary(df, "en").collect()] == [r.issues for r in D.quality_summary(df.limit(1), "en").collect()] * 2
    got = D.build_history(df, {"R": "S"}, "S", "none").collect()
    assert sorted((r.doc_id, r.signals, r.regions) for r in got if r.doc_id == 1) == [(1, ["a", "b"], {"R": ["a", "b"]})] * 2
    assert [(r.signals, r.clusters, r.regions, r.summary_excerpt) for r in got if r.doc_id == 2] == [(None, None, None, None)]
    assert sorted((r.rank, r.item) for r in D.extract_section_items(df, "S").collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]


def test_first_date_that_reads(spark):
    rows = [(1, "soon", "2024-01-02"), (2, " ", "later"), (3, "2024-01-03", "2024-01-01"), (4, None, None)]
    got = spark.createDataFrame(rows, "id int, published string, updated string").select("id", scan.first_date("published", "updated").alias("d")).collect()
    assert {r.id: r.d for r in got} == {1: "2024-01-02", 2: "later", 3: "2024-01-03", 4: None}


def test_backfill_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(k, DAY + dt.timedelta(k % 3), ["a", "b"]) for k in range(6)], "event_id int, date date, sources array<string>")
    path = str(tmp_path / "daily")
    assert tuple(sinks.backfill(rows, path).first()) == (3, 6, 12)
    assert tuple(sinks.backfill(rows, path, 1).first()) == (1, 2, 4) and spark.read.parquet(path).count() == 6


def test_merges_unite_titles_and_sources(spark):
    rows = [(1, "a", DAY, DAY, 3, ["x"]), (2, "b", DAY, DAY + dt.timedelta(1), 9, ["y", "x"]), (3, "c", DAY, DAY, 1, None)]
    heads = spark.createDataFrame(rows, "event_id int, canonical_title string, first_seen date, last_seen date, peak_risk int, sources array<string>")
    got = {r.event_id: r for r in E.apply_merges(heads, spark.createDataFrame([(2, 1)], "a int, b int")).collect()}
    assert (got[1].canonical_title, got[1].aliases, got[1].evidence, got[1].peak_risk, got[1].merged) == ("a", ["b"], ["x", "y"], 9, 1)
    assert (got[3].aliases, got[3].evidence, got[3].merged) == ([], [], 0)


def test_stored_tables_are_deleted(spark):
    import os
    import uuid

    from newsloom.functions import scratch

    root, own = scratch.shared_dir(spark).removeprefix("file:"), uuid.uuid4().hex
    there = lambda name: len([x for x in os.listdir(root) if x.startswith(f"{name}-{own}")])
    with scratch.temporary(spark) as kept:
        for name in ("one", "two", "two"):
            left = scratch.stored(spark.range(3), f"{name}-{own}")
        rounds = scratch.discard_before(spark.range(4), f"one-{own}")
        assert rounds.count() == 4 and there("one") == 1
        kept.append(f"two-{own}")
    assert left.count() == 3 and there("one") == 0 and there("two") == 1
