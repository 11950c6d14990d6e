"""Queries over whole tables give the same rows as DuckDB, and other rows than the queries that keep a part."""

import os

import duckdb
import pytest

from shelfmark.plans import bindings
from tests.test_bindings import TABLES, same

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", ["detail_pages", "resolved_values", "journal_gaps", "url_frontier", "best_matches", "feed_index"])
def test_whole(spark, con, name):
    got = bindings.QUERIES[name + "_whole"](spark, DIR).toPandas()
    same(got, con.execute(bindings.ORACLE[name + "_whole"]).df())
    cut = con.execute(bindings.ORACLE[name]).df()
    with pytest.raises(AssertionError):
        same(got[cut.columns], cut)
    if name == "best_matches":
        assert set(got["reason"]) == {"matched:original", "matched:compact"}
