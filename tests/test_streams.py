"""Streams that go on where they ended: the same table however often they are started again."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.changes import apply_delta, collapse
from shelfmark.streaming import streams

CHANGE = "revision long, item_id string, kind string, payload map<string,string>"


def changes(rng, first, n):
    out = []
    for r in range(first, first + n):
        kind = rng.choice(["upsert", "state", "state", "state", "remove"])
        payload = {} if kind == "remove" else {rng.choice("abcd"): rng.choice(["1", "2", None]) for _ in range(rng.randint(0, 3))}
        out.append((r, f"i{rng.randrange(12)}", kind, payload))
    return out


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def table(df):
    return {r["item_id"]: r["payload"] for r in df.collect()}


def run_last_batch_again(path):
    """As if the last batch had stored its rows and broken off before it was done."""
    numbers = [int(os.path.basename(f)) for f in glob.glob(f"{path}/state/commits/[0-9]*")]
    for f in glob.glob(f"{path}/state/commits/*{max(numbers)}*") + glob.glob(f"{path}/state/commits/.{max(numbers)}*"):
        os.remove(f)
    return len(numbers)


def test_current_table_goes_on(spark, tmp_path):
    rng = random.Random(3)
    folder, path, all_rows = str(tmp_path / "in"), str(tmp_path / "kept"), []
    nothing = spark.createDataFrame([], "item_id string, payload map<string,string>")
    for step in range(4):
        rows = changes(rng, step * 40, 40)
        all_rows += rows
        put(spark, folder, rows, CHANGE)
        if step in (1, 3):  # two files a start
            got = table(streams.current_table(source(spark, folder, CHANGE), path))
            # as all changes so far, folded at once
            assert got == table(apply_delta(nothing, collapse(spark.createDataFrame(all_rows, CHANGE), -1))) and got
    assert run_last_batch_again(path) >= 4
    assert table(streams.current_table(source(spark, folder, CHANGE), path)) == got
    assert table(streams.current_table(source(spark, folder, CHANGE))) == got
    # a batch stores what it changes: no more than it has items
    counts = spark.read.parquet(f"{path}/rows").groupBy("batch").count().collect()
    assert len(counts) >= 4 and max(r["count"] for r in counts) <= 12


def test_changes_that_come_again_change_nothing(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "kept")
    put(spark, folder, [(1, "x", "upsert", {"a": "1"}), (2, "x", "state", {"a": "2"}), (3, "y", "upsert", {"b": "1"}), (4, "y", "remove", {}), (5, "z", "state", {"q": "1"})], CHANGE)
    assert table(streams.current_table(source(spark, folder, CHANGE), path)) == {"x": {"a": "2"}}
    put(spark, folder, [(1, "x", "upsert", {"a": "1"}), (3, "y", "upsert", {"b": "1"})], CHANGE)
    assert table(streams.current_table(source(spark, folder, CHANGE), path)) == {"x": {"a": "2"}}


PRODUCT = "row_id long, keys array<string>, model_key string"


def test_new_products_once_over_all_runs(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "kept")
    feeds = spark.createDataFrame([("f", "feed f", 1), ("g", "feed g", 2)], "source string, label string, position int")
    keys = spark.createDataFrame([("f", "K1"), ("g", "K1"), ("g", "K2")], "source string, key string").withColumn("item", F.lit("i"))
    batches = [[(1, ["K1"], "m1"), (2, ["K2"], "m2"), (3, ["K2"], "m2")], [(4, ["K2"], "m2"), (5, ["K3"], "m3")], [(6, ["K3"], "m3"), (7, ["K4"], "m4"), (8, ["K1"], "m1")]]
    seen = lambda df: sorted((r["model_key"], tuple(r["missing"])) for r in df.collect())
    want = [("m2", ("feed f",)), ("m3", ("feed f", "feed g")), ("m4", ("feed f", "feed g"))]
    for k, rows in enumerate(batches):
        put(spark, folder, rows, PRODUCT)
        got = seen(streams.new_products(source(spark, folder, PRODUCT), feeds, keys, path))
        assert got == want[: k + 1]
    run_last_batch_again(path)
    assert seen(streams.new_products(source(spark, folder, PRODUCT), feeds, keys, path)) == want
    assert seen(streams.new_products(source(spark, folder, PRODUCT), feeds, keys)) == want


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_stream_without_rows(spark, tmp_path, mode):
    folder = str(tmp_path / "in")
    put(spark, folder, [(1, "a")], "n long, level string")
    stream = source(spark, folder, "n long, level string").where("n < 0")
    out = streams.settled(stream if mode == "append" else streams.stream_log_counts(stream), mode)
    assert out.count() == 0 and "batch" in out.columns
