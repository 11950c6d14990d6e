"""Totals and report splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_summary(news: DataFrame, feeds: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """source_label, missing and, with codes (label, codes_count), the size of each feed; feeds that miss nothing count 0."""
    counts = news.select(F.explode("missing").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("missing"))
    out = feeds.select("label").join(counts.hint("merge"), "label", "left").select("label", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))
    return out.join(codes.hint("merge"), "label", "left") if codes is not None else out


def import_totals(rows: DataFrame) -> DataFrame:
    """One row of totals over rows (status: excluded, no_model, found or missing); excluded ones are not processed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "excluded").alias("processed"), n("excluded"), n("no_model"), n("found"), n("missing"))


def comparison_totals(rows: DataFrame) -> DataFrame:
    """Totals by supplier, and over all as supplier null; here excluded rows are processed too."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.rollup("supplier").agg(F.count(F.lit(1)).alias("processed"), n("excluded"), n("found"), n("missing"))


def conversion_totals(written: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows written, sheets with the header, sheets skipped; sheets: one row a sheet."""
    rows = written.agg(F.count(F.lit(1)).alias("rows_written"), F.count_distinct("file", "sheet_index").alias("sheets_matched"))
    all_ = sheets.agg(F.count_distinct("file", "sheet_index")).scalar()
    return rows.select("rows_written", "sheets_matched", (all_ - F.col("sheets_matched")).alias("sheets_skipped"))


def codes_count(feed_keys: DataFrame) -> DataFrame:
    return feed_keys.groupBy("source").agg(F.count_distinct("key").alias("codes_count"))


ALL = "missing on all"


def split_missing(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """A row for each group a missing row belongs to, column sheet: its missing feeds, or once ALL if it is missing everywhere."""
    n = feeds.select("label").distinct().count()
    return rows.withColumn("sheet", F.explode(F.when(F.size("missing") == n, F.array(F.lit(ALL))).otherwise(F.col("missing"))))


def split_by_supplier(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sheet", F.col("supplier"))
