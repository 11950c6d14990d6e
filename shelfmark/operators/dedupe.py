"""First of equal rows, row numbers, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.keys import compare_key
from shelfmark.functions.urls import host_of
from shelfmark.functions.text import search_text, text_of
from shelfmark.operators.match import small

#: Row numbers that are counted together when rows are numbered.
STEP = 10_000


def first_by(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. An aggregate, not a window: rows are combined before they move."""
    names = [f"_k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.select(*[k.alias(n) for k, n in zip(keys, names)], row.alias("_row"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_order"))
    return picked.groupBy(*names).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def dedupe_offers(offers: DataFrame) -> DataFrame:
    """Offers that differ in compare key or url, the first by row_number kept."""
    return first_by(offers, [compare_key(F.col("source_model")), F.lower(text_of(F.col("url")))], [F.col("row_number")])


def number_offers(offers: DataFrame, source: str = "source") -> DataFrame:
    """row_number anew from 1 within each source, in the order of the old one, as offers of an XML feed are numbered after dedupe. Rows of a grid keep
    their number. Numbers are taken within steps of the old number, so no source is one task; row numbers of a source are distinct."""
    step = F.floor(F.col("row_number") / STEP).alias("_step")
    counts = offers.groupBy(source, step).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(source).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(source).alias("_source"), F.col("_step").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = offers.withColumn("_step", step)
    joined = own.join(small(starts, 100_000), own[source].eqNullSafe(starts["_source"]) & (F.col("_step") == F.col("_at")))
    number = F.row_number().over(Window.partitionBy(source, "_step").orderBy("row_number")) + F.col("_start")
    return joined.withColumn("row_number", number.cast("int")).select(offers.columns)


def dedupe_products(products: DataFrame) -> DataFrame:
    """Products (pos, url, model, price): by url where there is one, by model otherwise.

    A row is dropped too if its model stood url-less before it.
    """
    model = F.lower(text_of(F.col("model")))
    with_url = F.nullif(text_of(F.col("url")), F.lit("")).isNotNull()
    bare_first = products.where(~with_url).groupBy(model.alias("_m")).agg(F.min("pos").alias("_first"))
    joined = products.withColumn("_m", model).join(bare_first.hint("merge"), "_m", "left").where(F.col("_first").isNull() | (F.col("pos") <= F.col("_first")))
    kept = first_by(joined.where(with_url), [F.col("url")], [F.col("pos")]).unionByName(joined.where(~with_url & (F.col("pos") == F.col("_first"))))
    return kept.drop("_m", "_first")


def dedupe_news(news: DataFrame) -> DataFrame:
    """The first row of each model, or url where the model is blank."""
    return first_by(news, [F.coalesce(F.nullif(F.lower(text_of(F.col("model"))), F.lit("")), F.col("url"))], [F.col("pos")])


def distinct_first(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The first row of each key by position."""
    return first_by(df, [F.col(k) for k in keys], [F.col(pos)])


def log_page(logs: DataFrame, page: int = 1, limit: int = 200) -> DataFrame:
    """A page of the newest rows, shown in ascending order."""
    size = max(1, min(limit, 1000))
    return logs.orderBy(F.desc("id")).offset((max(page, 1) - 1) * size).limit(size).orderBy("id")


def log_delta(logs: DataFrame, after_id: int, limit: int = 200) -> DataFrame:
    """The rows after an id; a page of the newest if the id lies outside of what there is."""
    low, high = logs.agg(F.min("id"), F.max("id")).first()
    if low is None or not low <= after_id <= high:
        return log_page(logs, 1, limit)
    return logs.where(F.col("id") > after_id).orderBy("id").limit(max(1, min(limit, 1000)))


def top_brands(brands: DataFrame, limit: int = 20) -> DataFrame:
    return brands.withColumn("search_key", search_text(F.col("name"), False)).orderBy("search_key", "id").limit(limit)


def latest(df: DataFrame, n: int = 30, by: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by)).limit(n)


def top_k_per(df: DataFrame, keys: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k best rows of each key, ties by another column."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def margin(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each key and how far it is ahead of the second (of 0, if there is none)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    ahead = df.withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0))).withColumn("_n", F.row_number().over(w))
    return ahead.where("_n = 1").drop("_n")


def longest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(F.length(value), value)).alias(value))


def longest_prefix(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """url and the rule (column prefix) that is its longest prefix; null if none is. With a column host in the rules (null: none), a rule of the url's
    host where no prefix fits (of several the first by prefix), its host in the column host.

    A url is met with rules of the lengths that occur, on equal text: a hash join instead of comparing all with all.
    """
    if "host" in rules.columns:
        found = longest_prefix(urls, rules.where("prefix <> ''").select("prefix"), url)
        hosts = rules.where("host <> ''").groupBy(F.lower("host").alias("_host")).agg(F.min("prefix").alias("_prefix"))
        joined = found.withColumn("_h", host_of(F.col(url))).join(hosts.hint("merge"), F.col("_h") == F.col("_host"), "left")
        fallback = F.col("prefix").isNull() & F.col("_host").isNotNull()
        return joined.withColumns({"prefix": F.coalesce("prefix", "_prefix"), "host": F.when(fallback, F.col("_host"))}).drop("_h", "_host", "_prefix")
    lengths = [r[0] for r in rules.select(F.length("prefix")).distinct().collect()]  # a row for each length
    probes = urls.select(url).distinct().select(url, F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("_n")).where(F.length(url) >= F.col("_n"))
    hit = probes.withColumn("prefix", F.left(F.col(url), F.col("_n"))).join(rules.select("prefix").distinct().hint("merge"), "prefix")
    best = hit.groupBy(url).agg(F.max_by("prefix", "_n").alias("prefix"))
    return urls.join(best.hint("merge"), url, "left")
