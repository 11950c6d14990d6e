"""Structured Streaming forms of the log and change feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from shelfmark.operators.match import missing_feeds
from shelfmark.storage import new_path, setting, staged


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files; the table may be one file or a folder of files."""
    table = spark.read.parquet(f"{folder}/{name}")
    one = table.inputFiles()[0].rstrip("/").endswith(f"/{name}")
    reader = spark.readStream.schema(table.schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if one else reader.parquet(f"{folder}/{name}")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(stream: DataFrame, mode: str, path: str | None = None, each: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """What a stream gives for all that is there now, with the number of the batch of each row: run to its end, what each makes of a batch stored under its number.

    path is a folder of the shared file system that keeps rows, progress and state. A later call with the same path goes on where the last one ended, also one that broke
    off: a batch that is run again replaces its own rows. Without a path the stream starts anew. State is held by RocksDB, on disk and as changes in the checkpoint.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    whole = mode == "complete"

    def write(batch: DataFrame, n: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={0 if whole else n}")

    empty = each(spark.createDataFrame([], stream.schema))
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    schema = empty.schema.add("batch", "long")
    try:
        return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    except AnalysisException:  # no batch so far
        return spark.createDataFrame([], schema)


def stream_log_counts(stream: DataFrame) -> DataFrame:
    """Running counts by level; write it in update or complete mode."""
    return stream.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def with_retention(stream: DataFrame, time: str = "created_at", days: int = 7) -> DataFrame:
    """The stream with days of retention as its watermark; a time without zone is taken as UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{days} days")


def log_counts_by_day(stream: DataFrame, time: str = "created_at", days: int = 7) -> DataFrame:
    """Counts by day and level; days older than the retention are final and leave the state."""
    return with_retention(stream, time, days).groupBy(F.window(time, "1 day"), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "level", "n")


class LastState(StatefulProcessor):
    """An item's payload, a key of the state for each of its keys, and its last revision. Of removed items the revision stays, so that changes that come again do not bring them back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "revision long, present boolean")
        self.payload = handle.getMapState("payload", "k string", "v string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, present = self.head.get() if self.head.exists() else (None, False)
        told = sorted((c for frame in rows for c in zip(frame["revision"].tolist(), frame["kind"], frame["payload"])), key=lambda c: c[0])
        told = [c for c in told if last is None or c[0] > last]
        whole = max((k for k, c in enumerate(told) if c[1] != "state"), default=None)  # what was before it does not count
        if whole is not None:
            self.payload.clear()
            present = told[whole][1] == "upsert"
            told = told[whole:]
        if not told or (whole is None and not present):
            return  # nothing new, or patches of an unknown item
        for k, v in {k: v for _, _, payload in told if present for k, v in dict(payload or {}).items()}.items():
            self.payload.updateValue((k,), (v,))
        self.head.update((told[-1][0], present))
        held = {k: v for (k,), (v,) in self.payload.iterator()} if present else {}
        yield pd.DataFrame({"item_id": [key[0]], "payload": [held], "present": [present]})

    def close(self) -> None:
        pass


def current_states(stream: DataFrame) -> DataFrame:
    """item_id, payload, present for each item that a batch of a change stream (revision, item_id, kind, payload) changes; write it in update mode."""
    kind = stream.schema["item_id"].dataType.simpleString()
    return stream.groupBy("item_id").transformWithStateInPandas(LastState(), f"item_id {kind}, payload map<string,string>, present boolean", "update", "none")


def current_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """The table (item_id, payload) after all that a change stream has now. A batch stores the items that it changes, not the table; see settled for path."""
    told = settled(current_states(stream), "update", path)
    last = told.groupBy("item_id").agg(F.max_by(F.struct("payload", "present"), "batch").alias("x"))
    return last.where("x.present").select("item_id", "x.payload")


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark; state goes with it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def new_products(stream: DataFrame, feeds: DataFrame, feed_keys: DataFrame, path: str | None = None) -> DataFrame:
    """Products of a stream (row_id, keys, model_key) that were never seen before, with the feeds in which they are missing (missing): those missing somewhere, once each, over
    all runs on one path. The state store knows every model seen; a batch reads none of what earlier ones stored."""

    def compared(fresh: DataFrame) -> DataFrame:
        fresh = staged(fresh, "fresh")  # read twice
        return fresh.join(missing_feeds(fresh, feeds, feed_keys, no_keys="none").hint("merge"), "row_id")

    return settled(stream.dropDuplicates(["model_key"]), "append", path, compared)
