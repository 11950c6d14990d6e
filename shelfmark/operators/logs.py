"""Log tables and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import search_text, text_of

# Fixed values
LEVELS = ("info", "success", "warning", "error")
ACTIVE = ("running", "queued", "pausing", "stopping")
LIMITS = {"project_id": 64, "project_name": 255, "brand": 255, "group_name": 255}


def log_rows(df: DataFrame) -> DataFrame:
    """Rows fit for the log: level known or info, texts cut to their columns."""
    level = F.lower(F.trim(text_of(F.col("level"))))
    out = df.withColumn("level", F.when(level.isin(*LEVELS), level).otherwise("info"))
    return out.withColumns({c: F.left(text_of(F.col(c)), F.lit(n)) for c, n in LIMITS.items() if c in df.columns})


def append_logs(df: DataFrame, path: str) -> None:
    """Appends to the log table, a folder for each day."""
    log_rows(df).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def search_logs(df: DataFrame, level: str = "", q: str = "") -> DataFrame:
    """Rows of a level (blank: all) whose message, project, brand or group holds a text, in any case."""
    fields = [c for c in ("message", "project_name", "brand", "group_name") if c in df.columns]
    hay = F.lower(F.concat_ws("\n", *[F.col(c) for c in fields]))
    out = df.where(F.col("level") == level) if level else df
    return out.where(F.contains(hay, F.lit(q.strip().lower()))) if q.strip() else out


def search_brands(df: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Brands whose search key holds q, of two characters at least; the first by key and id."""
    wanted = " ".join(q.lower().split())
    keyed = df.withColumn("search_key", search_text(F.col("name"), False))
    return keyed.where(F.contains("search_key", F.lit(wanted)) & F.lit(len(wanted) >= 2)).orderBy("search_key", "id").limit(limit)


def prune(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return df.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))


def log_meta(df: DataFrame) -> DataFrame:
    """max_id, total and the signature max:total."""
    out = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("signature", F.concat_ws(":", "max_id", "total"))


def log_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def due(brands: DataFrame, donors: DataFrame, now: Column, grace: int = 90) -> DataFrame:
    """Brands whose schedule is due: enabled, not active, run_at reached (repeated ones at most grace seconds ago), not scanned since, with a donor."""
    waited = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("run_at").cast("timestamp"))
    on_time = F.when(F.col("schedule_type") == "once", waited >= 0).otherwise((waited >= 0) & (waited < grace * 1_000_000))
    fresh = F.col("last_scan_at").isNull() | (F.col("last_scan_at") < F.col("run_at"))
    ready = brands.where(F.col("enabled") & ~F.coalesce(F.col("status"), F.lit("")).isin(*ACTIVE) & on_time & fresh)
    return ready.join(donors.select(F.col("brand_id").alias("id")), "id", "left_semi")


def retry_plan(attempts: DataFrame, most: int = 2) -> DataFrame:
    """url and plan by its attempts (url, attempt, ok, permanent): done, retry (failed at most so often), deferred, or permanent."""
    seen = attempts.groupBy("url").agg(F.max("attempt").alias("attempts"), F.max("ok").alias("ok"), F.max("permanent").alias("permanent"))
    plan = F.when(F.col("ok"), "done").when(F.col("permanent"), "permanent").when(F.col("attempts") <= most, "retry").otherwise("deferred")
    return seen.select("url", "attempts", plan.alias("plan"))
