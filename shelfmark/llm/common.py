"""What the operators of this subpackage share: tables, staged tables and partition counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.storage import discard, gathered, listed, shared_dir, small_batches, staged

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "discard", "gathered", "listed", "partitions", "shared_dir", "small_batches", "staged", "table"]

#: Words as the contracts define them: runs of anything but blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
