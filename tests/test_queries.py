"""Every registered query of the library against its SQL, run by DuckDB on the same tables."""

import datetime
import math

import duckdb
import pytest

from newsloom import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = library.queries(), library.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_guards_the_optional_folder():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parents[1]
    for p in (root / "newsloom").rglob("*.py"):
        if "llm" not in p.parts:
            names = [getattr(n, "module", None) or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p
