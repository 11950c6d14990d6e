"""Queries with SQL give the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from shelfmark.plans import bindings, files

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(got, want):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda v: "" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    key = lambda df: sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert key(got) == key(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", ["missing_feeds", "feed_comparison", "converted_prices", "collapsed_changes", "page_urls", "filled_values", "schedules", "brand_cards", "references", "page_batch", "structured_data", "structured_pages", "page_names", "customers_without_fifths", "removed_parts", "open_values"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    same(bindings.QUERIES[name](spark, DIR).toPandas(), con.execute(bindings.ORACLE[name]).df())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", [n for n, f in bindings.QUERIES.items() if f.__module__ == files.__name__])
def test_file_query(spark, name):
    test_query(spark, name)


def test_every_oracle_has_a_query():
    assert set(bindings.ORACLE) <= set(bindings.QUERIES)
