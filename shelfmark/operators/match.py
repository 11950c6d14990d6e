"""Offers against feeds: key indexes, best matches, and what is missing where.

All matching is by equal keys, so every step is a hash join or an aggregate; feeds are few and
only their list is broadcast, after a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.candidates import model_candidates
from shelfmark.functions.keys import compare_keys, product_keys
from shelfmark.functions.text import clean_text, let, model_key

#: Most feeds that are broadcast; beyond it they are joined as any table.
MAX_FEEDS = 10_000


def small(df: DataFrame, rows: int = MAX_FEEDS) -> DataFrame:
    """Broadcast if it has at most so many rows, else to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def feed_index(items: DataFrame, values: Column) -> DataFrame:
    """source, key, item, reason: for every key of a feed the first item (by position) that has it.

    items: source, item, position; values: the array of texts that an item is known by, most telling first.
    """
    keyed = items.select("source", "item", "position", F.posexplode(values).alias("value_pos", "value"))
    keys = keyed.select("source", "item", "position", "value_pos", F.posexplode(compare_keys(F.col("value"))).alias("reason_pos", "k"))
    first = F.min_by(F.struct("item", "k.reason"), F.struct("position", "value_pos", "reason_pos"))
    return keys.groupBy("source", F.col("k.key").alias("key")).agg(first.alias("f")).select("source", "key", "f.item", "f.reason")


# Fields that name an item, most telling first
CODE_FIELDS = ("vendorcode", "vendor_code", "model", "sku", "article", "articul")


def item_values(item: Column, brand: Column | None = None) -> Column:
    """The texts that an item of an own feed (map of lower-case tags to texts) is known by: its code fields, and without any of them the candidates of its name or title."""
    field = lambda k: clean_text(F.try_element_at(item, F.lit(k)))
    codes = F.filter(F.array(*[field(k) for k in CODE_FIELDS]), lambda v: v != "")
    name = F.coalesce(F.nullif(field("name"), F.lit("")), field("title"))
    return let(codes, lambda c: F.when(F.size(c) > 0, c).when(name == "", F.array().cast("array<string>")).otherwise(model_candidates(name, brand if brand is not None else F.lit(""))))


def feed_codes(items: DataFrame) -> DataFrame:
    """source, key: the vendor code, and the model, or else the name, the title, or the code, of every item (columns vendorcode, model, name, title)."""
    filled = lambda c: F.nullif(clean_text(F.col(c)), F.lit(""))
    second = F.coalesce(filled("model"), filled("name"), filled("title"), filled("vendorcode"))
    keys = items.select("source", F.explode(F.array(model_key(F.col("vendorcode")), model_key(second))).alias("key"))
    return keys.where("key <> ''").distinct()


def best_match(rows: DataFrame, feed_keys: DataFrame, feeds: DataFrame) -> DataFrame:
    """The match of each row: row_id, candidate, reason, source, item. Candidate order counts first, then reason, then feed.

    rows: row_id, candidates (array); feed_keys: source, key, item; feeds: source, position. Rows without a match are left out.
    """
    tried = rows.select("row_id", F.posexplode("candidates").alias("cand_pos", "candidate"))
    tried = tried.select("row_id", "cand_pos", "candidate", F.posexplode(compare_keys(F.col("candidate"))).alias("reason_pos", "k")).select("*", "k.key", "k.reason").drop("k")
    hits = tried.join(feed_keys.select("source", "key", "item").hint("merge"), "key").join(small(feeds.select("source", F.col("position").alias("feed_pos"))), "source")
    best = F.min_by(F.struct("candidate", "reason", "source", "item"), F.struct("cand_pos", "reason_pos", "feed_pos"))
    out = hits.groupBy("row_id").agg(best.alias("b"))
    return out.select("row_id", "b.candidate", F.concat(F.lit("matched:"), "b.reason").alias("reason"), "b.source", "b.item")


def missing_feeds(rows: DataFrame, feeds: DataFrame, feed_keys: DataFrame, no_keys: str = "all") -> DataFrame:
    """row_id, missing (array of feed labels in feed order) for rows (row_id, keys) that are missing somewhere.

    A row is present in a feed if any of its keys is. no_keys: a row without keys misses 'all' feeds, or 'none'.
    feeds: source, label, position; feed_keys: source, key.
    """
    # explode_outer: a plain explode would compute the keys a second time to filter by them
    asked = rows.select("row_id", F.explode_outer("keys").alias("key")).where("key is not null").distinct()
    hits = asked.join(feed_keys.select("source", "key").distinct().hint("merge"), "key")
    present = hits.groupBy("row_id").agg(F.collect_set("source").alias("present"))  # at most one entry for each feed
    listed = feeds.agg(F.array_sort(F.collect_list(F.struct("position", "label", "source")))).scalar()
    own = rows.select("row_id", F.size("keys").alias("n")).join(present.hint("merge"), "row_id", "left")
    missing = F.transform(F.filter("_feeds", lambda f: ~F.array_contains(F.coalesce("present", F.array().cast("array<string>")), f["source"].cast("string"))), lambda f: f["label"])
    out = own.withColumn("_feeds", listed).select("row_id", F.when((F.col("n") == 0) & F.lit(no_keys == "none"), F.array().cast("array<string>")).otherwise(missing).alias("missing"))
    return out.where(F.size("missing") > 0)


def missing_everywhere(rows: DataFrame, feed_keys: DataFrame) -> DataFrame:
    """Rows of which no key is in any feed."""
    keys = rows.select("row_id", F.explode("keys").alias("key")).join(all_keys(feed_keys).hint("merge"), "key", "left_semi")
    return rows.join(keys.select("row_id").distinct().hint("merge"), "row_id", "left_anti")


def present_everywhere(rows: DataFrame, feeds: DataFrame, feed_keys: DataFrame) -> DataFrame:
    """row_id of rows with a key in every feed."""
    n = feeds.select("source").distinct().count()
    hits = rows.select("row_id", F.explode("keys").alias("key")).join(feed_keys.select("source", "key").hint("merge"), "key").groupBy("row_id").agg(F.count_distinct("source").alias("n"))
    return hits.where(F.col("n") == n).select("row_id")


def all_keys(feed_keys: DataFrame) -> DataFrame:
    return feed_keys.select("key").distinct()


def keys_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def union_keys(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def new_products(products: DataFrame, details: DataFrame, feeds: DataFrame, feed_keys: DataFrame, available: Column | None = None) -> DataFrame:
    """Donor products that are missing in some feed: products joined with their details by url, unavailable ones left out.

    products: url, model, price; details: url, name, vendor_code, availability. Keys of the listing and the detail page both count.
    """
    joined = products.join(details, "url")
    kept = joined.where(available) if available is not None else joined
    keyed = kept.withColumn("keys", union_keys(product_keys(F.col("name"), F.col("vendor_code")), product_keys(F.col("model"), F.lit(""))))
    missing = missing_feeds(keyed.select(F.col("url").alias("row_id"), "keys"), feeds, feed_keys, no_keys="none")
    return keyed.join(missing.withColumnRenamed("row_id", "url").hint("merge"), "url")


def brand_pattern(brand: Column) -> Column:
    """A regular expression for a brand: its words, joined by an ampersand where it has one, else by blanks."""
    parts = F.filter(F.split(clean_text(brand), r"\s*&\s*|\s+"), lambda p: p != "")
    words = F.transform(parts, lambda p: F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.call_function("array_join", words, F.when(F.contains(brand, F.lit("&")), r"\s*&\s*").otherwise(r"\s+"))


def detect_brand(rows: DataFrame, brands: DataFrame, name: str = "name", explicit: str | None = None) -> DataFrame:
    """rows with detected_brand: the stated one, else the longest known brand that stands in the name as whole words, else ''.

    Names are cut into runs of as many words as brands have and met with them on an equal key; the text decides: blanks of a brand
    are any blanks, and around an ampersand there may be some or none.
    Brands without a letter or digit of these words are met by runs of characters, of the lengths that such brands have.
    """
    words = lambda c: F.regexp_extract_all(F.upper(c), F.lit("([A-ZА-ЯЁ0-9]+)"), 1)
    known = brands.select(clean_text(F.col("brand")).alias("brand")).where("brand <> ''").distinct()
    parts = words(F.col("brand"))
    known = known.select("brand", F.size(parts).alias("_n"), F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.upper("brand")).alias("_key"))
    # the distinct lengths of brands are few
    lengths = known.select((F.col("_n") > 0).alias("worded"), F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.length("_key")).alias("n")).distinct().collect()
    run = {kind: F.array(*[F.lit(n) for n in sorted(r["n"] for r in lengths if r["worded"] is kind)]).cast("array<int>") for kind in (True, False)}
    ids = rows.withColumn("_id", F.xxhash64(F.col(name))).select("_id", F.col(name).alias("_name")).distinct()
    w = words(F.col("_name"))
    cut = lambda size, lengths, piece: F.flatten(F.transform(F.filter(lengths, lambda n: n <= size), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: piece(i, n))))
    grams = cut(F.size(w), run[True], lambda i, n: F.array_join(F.slice(w, i, n), " "))
    if any(not r["worded"] for r in lengths):
        t = F.upper(clean_text(F.col("_name")))
        grams = F.concat(grams, cut(F.length(t), run[False], lambda i, n: F.substring(t, i, n)))
    probes = ids.select("_id", "_name", F.explode(F.array_distinct(grams)).alias("_key"))
    hit = probes.join(known.hint("merge"), "_key").where(F.regexp_like("_name", F.concat(F.lit(r"(?iuU)(?<![A-Za-zА-Яа-яЁё0-9])"), brand_pattern(F.col("brand")), F.lit(r"(?![A-Za-zА-Яа-яЁё0-9])"))))
    # of brands of one length the first by name
    best = hit.groupBy("_name").agg(F.min_by("brand", F.struct(-F.length("brand"), "brand")).alias("_brand"))
    out = rows.join(best.hint("merge"), F.col(name) == F.col("_name"), "left")
    stated = F.nullif(clean_text(F.col(explicit)), F.lit("")) if explicit else F.lit(None).cast("string")
    return out.withColumn("detected_brand", F.coalesce(stated, "_brand", F.lit(""))).drop("_name", "_brand")
