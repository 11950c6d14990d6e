"""Brands, donors and sites: joins, roll-ups, upserts and merges by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import clean_text

# Which donor's status a brand shows
PRIORITY = ("running", "queued", "pausing", "stopping", "error", "partial", "completed")


def donors_with_brand(donors: DataFrame, brands: DataFrame) -> DataFrame:
    """donor columns with brand_name, ordered by brand and donor id."""
    return donors.join(brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name")), "brand_id").orderBy("brand_name", "id")


def donors_for_brand(donors: DataFrame, name: str) -> DataFrame:
    """Donors whose brand name holds the given one or is held by it; all, if there is none."""
    wanted, own = F.lower(F.lit(name)), F.lower(clean_text(F.col("brand_name")))
    fits = donors.where(F.contains(own, wanted) | F.contains(wanted, own))
    return donors if fits.isEmpty() else fits


def orphans(a: DataFrame, b: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(F.col(other).alias(key)), key, "left_anti")


def primary_donor(brands: DataFrame, donors: DataFrame) -> DataFrame:
    """brand_id, donor_id: the stated primary donor if it belongs to the brand, else the first; null without donors."""
    own = donors.groupBy("brand_id").agg(F.min("id").alias("first"))
    valid = donors.select(F.col("id").alias("primary_id"), F.col("brand_id").alias("_brand"))
    out = brands.select(F.col("id").alias("brand_id"), "primary_id").join(own, "brand_id", "left").join(valid, "primary_id", "left")
    return out.select("brand_id", F.when(F.col("_brand") == F.col("brand_id"), F.col("primary_id")).otherwise(F.col("first")).alias("donor_id"))


def brand_state(donors: DataFrame) -> DataFrame:
    """brand_id, status of the donor that comes first by priority (by id among equals or others), latest scan."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("status")), F.lit(0)), F.lit(len(PRIORITY) + 1))
    return donors.groupBy("brand_id").agg(F.min_by("status", F.struct(rank, "id")).alias("status"), F.max("last_scan_at").alias("last_scan_at"))


def brand_cards(donors: DataFrame) -> DataFrame:
    """By group and brand: whether a donor is active, most new, most found, failures in all."""
    active = F.max(F.col("status").isin(*PRIORITY[:4])).alias("active")
    return donors.groupBy("group_name", "brand").agg(F.count(F.lit(1)).alias("donors"), active, F.max("new_count").alias("new_count"), F.max("found_count").alias("found_count"), F.sum("failed_count").alias("failed_count"))


def workspace_totals(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count(F.lit(1)).alias("brands"), F.sum("donors").alias("donors"), F.count_if("active").alias("active"), F.sum("new_count").alias("new_count"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of source put in or, by key, in the place of old ones; null fields of source keep what was there."""
    rest = [c for c in target.columns if c not in keys]
    new = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest if c in source.columns])
    joined = target.join(new, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) if c in source.columns else F.col(c) for c in rest])


def merge_membership(current: DataFrame, saved: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Ids after a merge of an edited list with a changed remote one: what was removed on either side stays removed, what was added on either stays."""
    marked = [df.select(key).distinct().withColumn(f"_{name}", F.lit(True)) for name, df in (("current", current), ("saved", saved), ("remote", remote))]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), marked)
    at = {n: F.coalesce(F.col(f"_{n}"), F.lit(False)) for n in ("current", "saved", "remote")}
    keep = F.when(at["saved"], at["current"] & at["remote"]).otherwise(at["current"] | at["remote"])
    return joined.where(keep).select(key)


def merge_known(known: DataFrame, news: DataFrame, key: str = "model_key") -> DataFrame:
    """Products known so far with those of newer runs in place of older ones (column run)."""
    both = known.unionByName(news)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), "run").alias("r")).select(key, "r.*")
