"""Term matching by one automaton, and point lookups in files laid out by key."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_stores_and_scans import scanned_rows

from newsloom.functions import terms
from newsloom.operators import events as E
from newsloom.operators import news as N
from newsloom.operators import risk as R
from newsloom.sources import sinks

ROWS = [(1, "US strikes Iran", "oil and gas"), (2, None, "制裁 warning: ΟΔΟΣ"), (3, "", ""), (4, None, None), (5, "İran WAR", "prewar warships"), (6, "a" * 5000 + "war", "x")]
LISTS = [["war"], ["warn", "oil"], ["制裁", "strikes iran"], ["absent"], [], ["OİL", "ΟΔΌΣ", "οδος"], ["i̇ran"], ["us "], [""]]


@pytest.fixture(scope="module")
def news(spark):
    return spark.createDataFrame(ROWS, "id int, title string, summary string")


def test_lists_by_scan_and_by_automaton(spark, news, monkeypatch):
    text = N.text_of()
    plain = {r.id: r.k for r in news.select("id", terms.lists_found(text, LISTS).alias("k")).collect()}
    monkeypatch.setattr(terms, "FEW", 0)
    found = {r.id: r.k for r in news.select("id", terms.lists_found(text, LISTS).alias("k")).collect()}
    assert plain == found and plain[1] == [1, 2, 7, 8] and plain[2] == [0, 1, 2, 5, 8] and plain[3] == plain[4] == [8] and plain[6] == [0, 8]
    null = spark.range(1).select(terms.lists_found(F.lit(None).cast("string"), LISTS).alias("k"))
    assert null.first().k is None
    monkeypatch.setattr(terms, "FEW", 200)
    assert spark.range(1).select(terms.lists_found(F.lit(None).cast("string"), LISTS).alias("k"), terms.lists_found(F.lit("x"), []).alias("e")).first()[:] == (None, [])


def test_operators_by_scan_and_by_automaton(spark, news, monkeypatch):
    categories = {
        "a": {"weight": 3, "terms": ["war", "oil"], "escalation": [{"triggers": ["iran", "gas", "prewar"], "bonus": 8}]},
        "b": {"weight": 2, "terms": ["us", "制裁"], "context": ["warning", "iran"]}, "c": {"weight": 1, "terms": ["absent"]}
    }
    themes = {"t1": ["WAR", "gas"], "t2": ["制裁"], "t3": ["none of it"]}
    dated = news.withColumns({"date": F.lit("2024-01-01").cast("date"), "text": F.concat_ws(" ", "title", "summary"), "dimension": F.lit("d"), "source": F.lit("s"), "quality": F.lit(0.5)})

    def all_():
        return (
            sorted(map(tuple, N.category_hits(news, categories).collect())),
            sorted(map(tuple, N.text_scores(news, categories, themes, ["strikes"]).select("id", "text_score", "official").collect())),
            sorted(map(tuple, R.theme_signal_hits(dated, themes).collect())), sorted(map(tuple, R.theme_media(dated, themes).collect())),
            sorted(map(tuple, R.theme_first_seen(dated, themes, F.lit("2024-01-05").cast("date")).collect()))
        )

    plain = all_()
    monkeypatch.setattr(terms, "FEW", 0)
    assert all_() == plain and {r[0] for r in plain[0]} == {1, 2, 5, 6} and N.text_scores(news, categories, themes, []).columns == [*news.columns, "text_score", "official"]


def test_cost_is_nearly_flat_in_the_number_of_words(spark):
    import pyarrow as pa

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(6, 9)))
    texts = pa.array([" ".join(word() for _ in range(200)) for _ in range(1500)])
    took = {}
    for n in (100, 10_000):
        lists = tuple((word(),) for _ in range(n))
        run = terms._searched(lists)
        list(run(iter([texts[:1]])))  # makes the automaton
        began = time.process_time()
        list(run(iter([texts])))
        took[n] = time.process_time() - began
    assert took[10_000] < 4 * took[100] + 0.05


def test_lookups_skip_row_groups(spark, tmp_path):
    path, rnd = str(tmp_path / "heads"), random.Random(3)
    rows = [(k, f"KEY|{rnd.random()}|{k}", k % 100) for k in range(32_000)]
    df = spark.createDataFrame(rows, "event_id long, identity_key string, risk int")
    sinks.write_keyed(df, path, "event_id", {"identity_key": 2000}, 16)
    stored = spark.read.parquet(path)
    some = rows[12_345]
    for found in (E.event_by_id(stored, some[0]), E.event_by_key(stored, some[1])):
        assert 0 < scanned_rows(found) <= 32_000 / 4 and [tuple(r) for r in found.collect()] == [some]
    assert scanned_rows(E.event_by_key(stored, "KEY|none")) <= 32_000 / 4
    assert stored.count() == 32_000
