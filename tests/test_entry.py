"""The driver contract: names, aliases, and queries against DuckDB at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


#: A sample over all kinds; the driver compares every query.
NAMES = ("flagship", "x03_safe_filename", "f03_glob_any", "j08_robots_verdict", "a06_extract_palette", "w01_evict", "w06_suppress_repeats", "g01_crawl", "s05_pieces_from_pack", "s28_parse_listing", "s29_page_links", "s44_sauce_scan", "t01_view_stream", "t05_cache_stream")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(df[c] for c in cols)).collect()), key=str)
    r = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)
