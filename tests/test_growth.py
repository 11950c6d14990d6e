"""What grows with the tables: plans stay small, costly columns are spread over tasks, streams and names give what their SQL says."""

import html
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.plans import bindings, files  # noqa: F401 - files adds its queries

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


@tables
def test_the_plan_of_a_crawl_is_small(spark):
    # it was 19 MB, and a driver keeps several of each query
    assert size(bindings.listing_cards(spark, DIR)) < 1_000_000


def test_references_are_no_part_of_a_plan(spark):
    df = spark.createDataFrame([("a &lt;b&gt; &copy &nosuch;",), (None,), ("R&D",)], "t string")
    out = df.select(text.unescape(F.col("t")).alias("u"), text.unescape_each(F.array(text.text_of(F.col("t")), F.lit("&eacute;"))).alias("e"))
    assert size(out) < 5_000  # a table of names was in it, and every reference searched it from its start
    assert [(r["u"], r["e"]) for r in out.collect()] == [(html.unescape(t), [html.unescape(t), "é"]) for t in ("a &lt;b&gt; &copy &nosuch;", "", "R&D")]


@tables
def test_whole_texts_go_to_python_in_small_batches(spark):
    for query in (bindings.QUERIES["references"], bindings.QUERIES["search_texts"]):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        query(spark, DIR)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_names_and_their_sql_decode_alike(spark, tmp_path):
    heads = ["a &amp; b &amp", "cut &am", "&quot;x&quot; &amp;lt; &lt", "it&#x27;s &gt;", "plain & bare"]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(n, f"https://x.test/{n}", f"<body><h1>{h}</h1></body>") for n, h in enumerate(heads)], "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(bindings.ORACLE["page_names"]).fetchall()}
    got = {r["page_id"]: r["name"] for r in bindings.page_names(spark, str(tmp_path)).collect()}
    assert got == want and got[0].startswith("a & b & <")


@tables
def test_stream_counts_have_the_columns_of_their_sql(spark):
    out = bindings.stream_log_counts(spark, DIR)
    want = duckdb.sql(f"SELECT event_type, count(*) FROM '{DIR}/events.parquet' GROUP BY ALL").fetchall()
    assert out.columns == ["level", "n"] and sorted(map(tuple, out.collect())) == sorted(want)


@tables
@pytest.mark.parametrize("name", ["model_candidates", "unit_tokens", "converted_prices"])
def test_costly_rows_are_spread(spark, name):
    # a table of few bytes was one task
    assert "REPARTITION_BY_NUM" in bindings.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["filled_values", "mapping_report", "page_batch"])
def test_few_names_are_no_shuffle_keys(spark, name):
    plan = bindings.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@tables
def test_no_task_writes_a_whole_feed(spark):
    out = files.xml_offers(spark, DIR)
    want = duckdb.connect()
    want.execute(f"CREATE VIEW part AS SELECT * FROM '{DIR}/part.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(want.execute(bindings.ORACLE["xml_offers"]).fetchall())
    assert "SinglePartition" not in files._parts(spark.range(8).select("id"), "id")._jdf.queryExecution().executedPlan().toString()


def test_search_texts_and_their_sql_fold_alike(spark, tmp_path):
    # blanks, forms, marks and cases that the driver's small tables lack
    texts = {
        None: "", "": "abc fi 1", "\u00a0 \n": "abc fi 1", " A\u2003\u3000B\t": "a b abc fi 1", "½…Ⅳ ﬀ\u0345": "1\u20442...iv ff\u0345 abc fi 1", "E\u0301\u212b ｶ\uff9e": "éå ガ abc fi 1",
        "İ ẞ Straße": "i\u0307 ß straße abc fi 1", "ΟΔΟΣ ΣΣΣ'Α Σ ΑΣ’ς": "οδος σσσ'α σ ασ’ς abc fi 1", "\ua7dc": "\u019b abc fi 1", "A\x1cB": "a\x1cb abc fi 1",
    }
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = dict(map(tuple, files.search_texts(spark, str(tmp_path)).collect()))
    assert got == dict(con.execute(bindings.ORACLE["search_texts"]).fetchall()) == dict(enumerate(texts.values()))
