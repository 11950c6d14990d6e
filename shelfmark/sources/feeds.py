"""Offer feeds in XML, feed snapshots, stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import clean_text
from shelfmark.storage import staged


def read_offer_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Every element named row_tag as an item map<string, string>: lower-cased tag, without prefix, to its text."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").load(path)
    leaves = [(f.name, c) for f in df.schema.fields if (c := _last_text(F.col(f"`{f.name}`"), f.dataType)) is not None]
    entries = [F.struct(F.lit(n.rpartition(":")[2].lower()).alias("key"), clean_text(c).alias("value")) for n, c in leaves if not n.startswith("_")]
    return df.select(F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] != "")).alias("item"))


def _last_text(c: Column, kind: T.DataType) -> Column | None:
    """The text of a child, of a repeated one the last, whatever its attributes; None if it holds elements only."""
    if isinstance(kind, T.ArrayType):
        c, kind = F.try_element_at(c, F.lit(-1)), kind.elementType
    if isinstance(kind, T.StructType):
        return c["_VALUE"] if "_VALUE" in kind.names else None
    return c


def _text(df: DataFrame, name: str) -> Column | None:
    """A child's text, whatever its case; of a child with attributes its value."""
    for f in df.schema.fields:
        if f.name.rpartition(":")[2].lower() == name.lower():
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.ArrayType):
                c, kind = F.get(c, F.lit(0)), f.dataType.elementType
            else:
                kind = f.dataType
            return c["_VALUE"] if isinstance(kind, T.StructType) and "_VALUE" in kind.names else c if not isinstance(kind, T.StructType) else None
    return None


def selected(df: DataFrame, selector: str) -> Column:
    """A field by selector: a tag (<tag> too), '@attribute', 'param:Name'; '' where it is absent."""
    s = selector.strip().strip("<>/").strip()
    if s.lower().startswith("param:"):
        wanted = s[6:].strip().lower()
        for f in df.schema.fields:
            if f.name.lower() == "param":
                many = F.col(f"`{f.name}`") if isinstance(f.dataType, T.ArrayType) else F.array(F.col(f"`{f.name}`"))
                return F.coalesce(clean_text(F.get(F.filter(many, lambda p: F.lower(p["_name"]) == wanted), F.lit(0))["_VALUE"]), F.lit(""))
        return F.lit("")
    found = _text(df, "_" + s[1:]) if s.startswith("@") else _text(df, s)
    return clean_text(found) if found is not None else F.lit("")


def read_supplier_xml(spark: SparkSession, path: str, row_tag: str, fields: dict[str, str]) -> DataFrame:
    """Offers of a supplier's XML feed: row_number (position in the feed, from 1), source_model, name, price, brand, url. A folder's files, put together by name, are the feed; it is read once and stored.

    fields maps model, name, price, brand and url to selectors. Blank models are dropped, without a name the model is it.
    Dedupe and number afterwards (dedupe_offers, number_offers).
    """
    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").option("multiLine", True).load(path)
    get = {k: selected(df, fields[k]) if fields.get(k) else F.lit("") for k in ("model", "name", "price", "brand", "url")}
    name = F.when(get["name"] != "", get["name"]).otherwise(get["model"])
    # a file is one task with multiLine: its rows come in order
    read = df.select(F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_n"), get["model"].alias("source_model"), name.alias("name"), get["price"].alias("price"), get["brand"].alias("brand"), get["url"].alias("url"))
    rows = staged(read, "supplier-feed")
    files = rows.groupBy("_file").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("_file", (before - F.col("_first") + 1).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").select((F.col("_n") + F.col("_start")).alias("row_number"), "source_model", "name", "price", "brand", "url").where("source_model <> ''")


def available_xml_fields(df: DataFrame, limit: int = 20) -> list[str]:
    """The first leaf fields of a feed, from its schema."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.StructType)][:limit]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "html")


def latest_snapshots(df: DataFrame, keep: int = 3) -> DataFrame:
    """Rows of the newest snapshots (column snapshot) of each source."""
    ids = df.groupBy("source", "snapshot").agg(F.max("created_at").alias("_at"))
    kept = ids.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("_at"), F.desc("snapshot")))).where(F.col("_n") <= keep)
    return df.join(kept.select("source", "snapshot"), ["source", "snapshot"], "left_semi")


def reusable(snapshots: DataFrame, now: Column, ttl: int, signature: str) -> DataFrame:
    """source, snapshot: the newest of each source, if its signature is the given one and it is at most ttl seconds old."""
    newest = snapshots.groupBy("source").agg(F.max_by(F.struct("snapshot", "created_at", "signature"), F.struct("created_at", "snapshot")).alias("s")).select("source", "s.*")
    return newest.where((F.col("signature") == signature) & (F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl)))).select("source", "snapshot")
