"""Queries on sources, sinks and streams: files written from the driver's tables into the shared folder are read back, and
operators with cases that the views of bindings do not have. They register beside those of bindings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import candidates as cand
from shelfmark.functions import keys, text, values
from shelfmark.operators import attributes, changes, dedupe, logs, match
from shelfmark.plans.bindings import CHANGES, MISSING, OFFERS, change_view, feed_keys, feeds, field_view, flat, log_view, offers, query, table
from shelfmark.sources import feeds as feed_sources
from shelfmark.sources import grid as grids
from shelfmark.sources import sinks
from shelfmark.storage import new_path, setting, small_batches, spread, staged
from shelfmark.streaming import streams

# --- feeds in XML


def _one_file(df: DataFrame, by: str) -> DataFrame:
    return df.repartition(1).sortWithinPartitions(by).drop(by)


def _parts(df: DataFrame, by: str) -> DataFrame:
    """In files that, put together by name, are in order."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by).drop(by)


def _xml(df: DataFrame) -> str:
    path = new_path(df.sparkSession, "feed")
    df.write.format("xml").option("rowTag", "offer").option("rootTag", "offers").save(path)
    return path


ITEMS = (
    OFFERS
    + """,
known AS (
  SELECT row_id, source_model AS v, 0 AS nth FROM offers WHERE row_id % 3 = 0
  UNION ALL SELECT row_id, source_model, 1 FROM offers WHERE row_id % 3 = 1
  UNION ALL SELECT row_id, 'S-' || (row_id % 500), 2 FROM offers WHERE row_id % 3 = 1
  UNION ALL SELECT row_id, source_model, 0 FROM offers WHERE row_id % 3 = 2
), item_keys AS (
  SELECT row_id, (row_id * 10 + nth) * 10 AS place, 'original' AS reason, v AS key FROM known
  UNION ALL SELECT row_id, (row_id * 10 + nth) * 10 + 1, 'compact', regexp_replace(v, '[-/]', '', 'g') FROM known
)"""
)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """An own feed: a third of the items with a vendor code, a third with model and sku, a third with a name alone."""
    # a file is read by one task
    o, third = spread(offers(spark, d), "row_id"), F.col("row_id") % 3
    feed = o.select(
        F.col("row_id").alias("id"),
        F.when(third == 0, F.col("source_model")).alias("vendorCode"),
        F.when(third == 1, F.col("source_model")).alias("model"),
        F.when(third == 1, F.concat(F.lit("S-"), F.col("row_id") % 500)).alias("sku"),
        F.concat(F.lit("Чайник "), "source_model", F.lit(" электрический")).alias("name"),
    )
    return feed_sources.read_offer_xml(spark, _xml(feed), "offer")


@query("WITH" + ITEMS + " SELECT 'shop' AS source, key, arg_min(row_id, place) AS item, arg_min(reason, place) AS reason FROM item_keys GROUP BY key")
def xml_feed_index(spark, d):
    """The keys of a feed's items, by their code fields or else the candidates of their name"""
    number = F.col("fields")["id"].cast("long")
    read = _items(spark, d).withColumnRenamed("item", "fields")
    items = read.select(F.lit("shop").alias("source"), number.alias("item"), number.alias("position"), match.item_values(F.col("fields")).alias("values"))
    return match.feed_index(items, F.col("values"))


@query("WITH" + OFFERS + """
, firsts AS (SELECT min(row_id) AS row_id FROM offers GROUP BY source_model, url)
SELECT CAST(row_number() OVER (ORDER BY row_id) AS INTEGER) AS row_number, source_model,
  CASE WHEN row_id % 2 = 0 THEN name ELSE source_model END AS name, price, brand, url
FROM offers JOIN firsts USING (row_id)""")
def xml_offers(spark, d):
    """A supplier's feed by selectors, deduped, numbered from 1"""
    o = offers(spark, d)
    param = lambda name, c: F.struct(F.lit(name).alias("_name"), c.alias("_VALUE"))
    feed = o.select(
        "row_id",
        F.col("url").alias("_href"),
        F.col("source_model").alias("SKU"),
        F.when(F.col("row_id") % 2 == 0, F.col("name")).alias("display"),
        F.array(param("Цвет", F.lit("x")), param("Бренд", F.col("brand"))).alias("param"),
        "price",
    )
    fields = {"model": "sku", "name": "<display>", "price": "price", "brand": "param:бренд", "url": "@href"}
    read = feed_sources.read_supplier_xml(spark, _xml(_parts(feed, "row_id")), "offer", fields)
    numbered = dedupe.number_offers(dedupe.dedupe_offers(read).withColumn("source", F.lit("one")))
    return numbered.select("row_number", "source_model", "name", "price", "brand", "url")


# --- tables in CSV


@query("WITH" + OFFERS + """ SELECT CAST(row_number() OVER (ORDER BY row_id) + 2 AS INTEGER) AS row_number, source_model, 'Чайник ' || name AS name, price, brand FROM offers""")
def price_file(spark, d):
    """A windows-1251 file under a blank row; name and brand are found by their usual headers"""
    path = new_path(spark, "prices")
    rows = offers(spark, d).select("row_id", F.col("source_model").alias("a"), F.concat(F.lit("Чайник "), "name").alias("b"), F.lit("no name").alias("c"), F.col("price").alias("d"), F.col("brand").alias("e"))
    head = spark.createDataFrame([(-2, "", "", "", "", ""), (-1, "Модель", "Наименование товара", "Name", "Цена", "Производитель")], rows.schema)
    with setting(spark, "spark.sql.legacy.javaCharsets", "true"):
        _one_file(head.unionAll(rows), "row_id").write.csv(path, sep="|", encoding="windows-1251", emptyValue="")
        files = spark.read.format("binaryFile").load(path)
        encoding = grids.detect_encoding(files).first()["encoding"]
        grid = staged(grids.csv_grid(spark, path, encoding=encoding), "price-grid")
    return grids.read_price_file(grid, "модель", "цена").drop("file")


@query("SELECT p_partkey AS id, p_name || chr(10) || p_type AS value, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS row_number FROM part")
def attribute_file(spark, d):
    """Line breaks inside quoted cells stay, blanks in each line go"""
    path = new_path(spark, "attributes")
    p = table(spark, d, "part")
    cell = F.concat(F.lit("  "), F.col("p_name"), F.lit("   \n  "), F.col("p_type"), F.lit(" \n"))
    _one_file(p.select("p_partkey", F.col("p_partkey").cast("string").alias("a"), cell.alias("b")), "p_partkey").write.csv(path, sep=";", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = grids.attr_csv(grids.csv_grid(spark, path, sep=";"))
    return rows.select(F.col("cells")[0].cast("long").alias("id"), F.col("cells")[1].alias("value"), "row_number")


@query("""WITH n AS (SELECT DISTINCT p_brand AS brand, CAST(regexp_extract(p_brand, '[0-9]+', 0) AS INTEGER) AS n FROM part)
SELECT brand, CASE WHEN n % 3 = 0 THEN 'csv' ELSE 'xml' END AS format, CASE WHEN n % 2 = 0 THEN 'kept' ELSE 'too large' END AS size FROM n""")
def file_formats(spark, d):
    """Formats by content, in UTF-8 and UTF-16, and files that are too large"""
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    line = F.when(number % 3 == 0, "model;price").otherwise(F.lit("  <offers><offer/></offers>"))
    # files of odd numbers are larger
    long = F.when(number % 2 == 1, F.repeat(F.lit("x"), 3000)).otherwise("")
    rows = table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.concat(line, long).alias("line"), (number % 4 < 2).alias("wide"))
    found = []
    for wide in (False, True):
        path = new_path(spark, "formats")
        own = rows.where("wide" if wide else "not wide").drop("wide")
        own.write.partitionBy("p_brand").csv(path, encoding="UTF-16" if wide else "UTF-8", quote="", ignoreLeadingWhiteSpace=False)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
        kept, large = grids.drop_oversize(files, 4000 if wide else 2000)
        sizes = kept.select("path", F.lit("kept").alias("size")).unionAll(large.select("path", F.lit("too large").alias("size")))
        found.append(grids.detect_format(files).join(sizes, "path"))
    brand = F.replace(F.regexp_extract("path", "p_brand=([^/]*)", 1), F.lit("%23"), F.lit("#"))
    return found[0].unionAll(found[1]).select(F.replace(brand, F.lit("%2523"), F.lit("#")).alias("brand"), "format", "size")


@query("""WITH h AS (SELECT DISTINCT p_type, p_brand FROM part), placed AS (SELECT lower(p_brand) AS header, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS pos FROM h)
SELECT header, CAST(min(pos) AS INTEGER) AS pos FROM placed GROUP BY header ORDER BY pos, header LIMIT 20""")
def grid_fields(spark, d):
    """The first headers of sheets whose header row holds their brands"""
    p = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("cells"))
    sheet = p.select(F.lit("f").alias("file"), F.col("p_type").alias("sheet_index"), F.lit("").alias("sheet_name"), F.lit(1).alias("row_number"), "cells")
    return grids.available_fields(sheet, 20)


@query("SELECT url, length(html) AS n FROM pages")
def stored_pages(spark, d):
    """S10"""
    return feed_sources.read_pages(spark, f"{d}/pages.parquet").select("url", F.length("html").cast("long").alias("n"))


@query("""WITH n AS (SELECT user_id AS source, event_id // 500 AS snapshot, max(event_id) AS last FROM events GROUP BY ALL), newest AS (SELECT source, max(snapshot) AS snapshot, arg_max(last, snapshot) AS last FROM n GROUP BY source)
SELECT source, snapshot FROM newest WHERE last >= (SELECT max(event_id) FROM events) - 1200 AND snapshot % 2 = 0""")
def reused_snapshots(spark, d):
    """The newest snapshot of a source is used again if it is young and of the same feeds"""
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), F.floor(F.col("event_id") / 500).alias("snapshot"), "event_id")
    at = F.timestamp_seconds(F.max("event_id"))
    s = e.groupBy("source", "snapshot").agg(at.alias("created_at")).withColumn("signature", F.when(F.col("snapshot") % 2 == 0, "even").otherwise("odd"))
    now = table(spark, d, "events").agg(F.timestamp_seconds(F.max("event_id"))).scalar()
    return feed_sources.reusable(s, now, 1200, "even")


# --- exports


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("WITH" + OFFERS + """ SELECT 'URL товара;_MODEL_;_PRICE_' AS line UNION ALL SELECT url || ';' || source_model || ';"' || replace(price, ' ', ';') || '""x""' || '"' FROM offers""")
def exported_products(spark, d):
    """K1"""
    path = new_path(spark, "export")
    price = F.concat(F.replace("price", F.lit(" "), F.lit(";")), F.lit('"x"'))
    sinks.write_products(offers(spark, d).select("url", F.col("source_model").alias("model"), price.alias("price")), path)
    return _lines(spark, path)


@query("WITH" + MISSING + """, m AS (SELECT row_id, string_agg(label, ', ' ORDER BY position) AS missing FROM missing GROUP BY row_id)
SELECT 'Дата появления;Группа;Сайт/бренд;Наименование;Модель;Цена;Наличие;Нет на сайтах;URL товара' AS line
UNION ALL SELECT '2026-08-05;' || supplier || ';' || brand || ';' || name || ';' || source_model || ';' || price || ';;' || missing || ';' || url FROM m JOIN offers USING (row_id)""")
def exported_news(spark, d):
    """K2"""
    path = new_path(spark, "export")
    o = offers(spark, d)
    rows = match.missing_feeds(o.select("row_id", keys.key_texts(F.col("source_model")).alias("keys")), feeds(spark, d), feed_keys(spark, d)).join(o, "row_id")
    news = rows.select(F.lit("2026-08-05").alias("date_found"), F.col("supplier").alias("group"), "brand", "name", F.col("source_model").alias("model"), "price", F.lit("").alias("availability"), F.col("missing").alias("missing_on"), "url")
    sinks.write_news(news, path)
    return _lines(spark, path)


@query("WITH" + OFFERS + """ SELECT '_MODEL_;_PRICE_;_SPECIAL_' AS line UNION ALL SELECT source_model || ';' || price || ';' || CASE WHEN row_id % 2 = 0 THEN '1,1,' || row_id || ',2026-08-05,2026-09-01' ELSE '' END FROM offers""")
def exported_prices(spark, d):
    """K3, F27"""
    path = new_path(spark, "export")
    promo = F.when(F.col("row_id") % 2 == 0, F.col("row_id").cast("string")).otherwise("")
    rows = offers(spark, d).select(F.col("source_model").alias("model"), "price", grids.promo_special(promo, "2026-08-05", "2026-09-01").alias("special"))
    sinks.write_prices(rows, path)
    return _lines(spark, path)


@query("""SELECT '_MODEL_' AS model, '_ATTRIBUTES_' AS stack UNION ALL SELECT 'MX-' || p_partkey, 'Основные|Марка|' || p_brand || chr(10) || 'Размеры|Size|' || p_size || chr(10) || 'прочее|тип|' || p_type || ' ?' FROM part""")
def exported_attributes(spark, d):
    """K6: windows-1251, with a question mark for what it lacks"""
    path = new_path(spark, "export")
    p = table(spark, d, "part")
    value = lambda g, n, v, own, order: F.struct(F.lit(g).alias("group_name"), F.lit(n).alias("name"), v.alias("final_value"), F.lit(own).alias("is_in_template"), F.lit(order).alias("sort_order"))
    made = F.array(value("прочее", "тип", F.concat("p_type", F.lit(" 冰")), False, 0), value("Размеры", "Size", F.col("p_size").cast("string"), True, 2), value("Основные", "Марка", F.col("p_brand"), True, 1))
    rows = p.select(F.col("p_partkey").alias("product_id"), F.posexplode(made).alias("id", "v")).select("product_id", "id", "v.*").withColumns({"status": F.lit("approved"), "current_value": F.lit("old")})
    stacks = attributes.export_attributes(rows)
    sinks.write_attributes(stacks.select(F.concat(F.lit("MX-"), "product_id").alias("model"), "stack"), path)
    with setting(spark, "spark.sql.legacy.javaCharsets", "true"):
        read = spark.read.schema("model string, stack string").csv(path, sep=";", multiLine=True, encoding="windows-1251", quote='"', escape='"')
        return staged(read, "export-read")


# --- texts and keys


#: What NFKC makes of each letter that it changes; composing what follows them is left to nfc_normalize.
FORMS = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xA0, 0x20000)) if not unicodedata.is_normalized("NFKC", c)}
_FORMED = "".join(FORMS)
_CASED, _SKIPPED = r"\p{Lu}\p{Ll}\p{Lt}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}", r"\p{Mn}\p{Me}\p{Cf}\p{Lm}\p{Sk}''.:·՟״‧‘’"
#: Capitals of Unicode 16, which lower of DuckDB leaves.
_NEW, _NEW_LOWER = ("".join(map(chr, c)) for c in ([0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, *range(0x10D50, 0x10D66)], [0x1C8A, 0x264, 0xA7CD, 0xA7DB, 0x19B, *range(0x10D70, 0x10D86)]))


@query("WITH forms(letter, form) AS (VALUES " + ", ".join("('{}', '{}')".format(c, f.replace("'", "''")) for c, f in FORMS.items()) + rf"""),
pieces AS (SELECT doc_id, n, unnest(p) AS piece, generate_subscripts(p, 1) AS place
  FROM (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(coalesce(text || '  ＡＢＣ ﬁ ①', ' '), '[{_FORMED}]|[^{_FORMED}]+') AS p FROM documents)),
folded AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(form, piece), '' ORDER BY place)) AS t FROM pieces LEFT JOIN forms ON piece = letter GROUP BY doc_id, n),
inner_sigmas AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'Σ([{_SKIPPED}]*[{_CASED}])', 'σ\1', 'g'), 'Σ([{_SKIPPED}]*[{_CASED}])', 'σ\1', 'g') AS t FROM folded),
sigmas AS (SELECT doc_id, regexp_replace(t, '([{_CASED}][{_SKIPPED}]*)Σ', '\1ς', 'g') AS t FROM inner_sigmas)
SELECT doc_id, trim(regexp_replace(lower(translate(replace(t, 'İ', 'i' || chr(775)), '{_NEW}', '{_NEW_LOWER}')), '[\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS search FROM sigmas""")
def search_texts(spark, d):
    """full-width letters, a ligature and a circled number become what they stand for"""
    small_batches(spark)
    return table(spark, d, "documents").select("doc_id", text.search_text(F.concat("text", F.lit("  ＡＢＣ ﬁ ①"))).alias("search"))


@query("SELECT p_partkey, p_name || ' Привет' AS repaired, p_name || ' Привет' AS kept FROM part")
def repaired_texts(spark, d):
    """F29"""
    p = table(spark, d, "part")
    wrong, right = F.concat("p_name", F.lit(" РџСЂРёРІРµС‚")), F.concat("p_name", F.lit(" Привет"))
    return p.select("p_partkey", text.repair_text(wrong).alias("repaired"), text.repair_text(right).alias("kept"))


@query("WITH" + OFFERS + " SELECT row_id, row_id % 3 <> 0 AS overlap FROM offers")
def overlapping_keys(spark, d):
    """E2"""
    other = F.concat(F.replace("source_model", F.lit("/"), F.lit("")), F.when(F.col("row_id") % 3 == 0, "Z").otherwise(""))
    return offers(spark, d).select("row_id", match.keys_overlap(keys.key_texts(F.col("source_model")), keys.key_texts(other)).alias("overlap"))


@query("SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def removed_items(spark, d):
    """E4"""
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type")
    return changes.removed(e, e.where("event_type = 'error'"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Alfa & Beta Gamma Delta Epsilon' WHEN 1 THEN 'B&W' WHEN 2 THEN 'Mega Mix' ELSE '' END AS detected_brand FROM part""")
def brands_with_ampersands(spark, d):
    """Long brands, blanks around an ampersand, blanks of any kind"""
    n = F.col("p_partkey") % 4
    said = F.when(n == 0, "плита ALFA&beta & gamma&Delta &Epsilon").when(n == 1, "tv b & W").when(n == 2, "mega \t mix").otherwise("B W Mega-Mix alfa beta")
    rows = table(spark, d, "part").select("p_partkey", F.concat(said, F.lit(" "), F.col("p_partkey")).alias("name"))
    brands = spark.createDataFrame([("Alfa & Beta Gamma Delta Epsilon",), ("B&W",), ("Mega Mix",)], "brand string")
    return match.detect_brand(rows, brands).select("p_partkey", "detected_brand")


@query("WITH" + OFFERS + " SELECT row_id, (row_id % 90 + 10) || 'W' AS first, (row_id % 90 + 10) || 'L MX-' || row_id AS second FROM offers")
def unit_tokens(spark, d):
    """amounts in W and L are model words where they stand among others, but no model on their own"""
    n = (F.col("row_id") % 90 + 10).cast("string")
    return spread(offers(spark, d), "row_id").select(
        "row_id",
        F.when(cand.is_model_token(F.concat(n, F.lit("W"))) & (F.size(cand.model_candidates(F.concat(n, F.lit("W")), F.lit(""))) == 0), F.concat(n, F.lit("W"))).alias("first"),
        F.get(cand.model_candidates(F.concat(F.lit("Чайник "), n, F.lit("L MX-"), "row_id"), F.lit("")), F.lit(0)).alias("second"),
    )


@query("""WITH r AS (SELECT unnest(['https://example.com/en/', 'https://www.example.com/en/1', 'https://m.']) AS prefix, unnest(['example.net', '', 'blog.example.org']) AS host),
u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h FROM pages),
p AS (SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM u JOIN r ON starts_with(url, prefix) GROUP BY page_id),
f AS (SELECT page_id, r.prefix, r.host FROM u JOIN r ON u.h = r.host AND r.host <> '')
SELECT u.page_id, coalesce(p.prefix, f.prefix) AS prefix, CASE WHEN p.prefix IS NULL THEN f.host END AS host FROM u LEFT JOIN p USING (page_id) LEFT JOIN f USING (page_id)""")
def host_rules(spark, d):
    """A rule of the host where no prefix fits"""
    rules = spark.createDataFrame([("https://example.com/en/", "example.net"), ("https://www.example.com/en/1", ""), ("https://m.", "blog.example.org")], "prefix string, host string")
    return dedupe.longest_prefix(table(spark, d, "pages").select("page_id", "url"), rules).select("page_id", "prefix", "host")


# --- attributes


@query("""WITH vals AS (SELECT p_partkey AS product_id, CASE p_size % 5 WHEN 0 THEN 'filled' WHEN 1 THEN 'missing' WHEN 2 THEN 'suggested' WHEN 3 THEN 'ambiguous' ELSE 'conflict' END AS status, p_partkey % 6 <> 0 AS t,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE p_type END AS final FROM part),
s AS (SELECT product_id, bool_or(t AND (status <> 'filled' OR final = '')) AS r FROM vals GROUP BY product_id)
SELECT (SELECT count(*) FROM s) AS products, (SELECT count(*) FROM s WHERE NOT r) AS ready, (SELECT count(*) FROM s WHERE r) AS needs_review,
  count(*) FILTER (t AND final NOT IN ('', '-')) AS filled, count(*) FILTER (t AND final = '') AS missing, count(*) FILTER (status = 'conflict') AS conflicts, count(*) FILTER (status = 'suggested') AS suggestions FROM vals""")
def batch_totals(spark, d):
    """Ambiguous values and blank final values are open"""
    status = F.element_at(F.array(*map(F.lit, ("filled", "missing", "suggested", "ambiguous", "conflict"))), (F.col("p_size") % 5 + 1).cast("int"))
    final = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "-").otherwise(F.col("p_type"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.lit(1).alias("field_id"), status.alias("status"), (F.col("p_partkey") % 6 != 0).alias("is_in_template"), final.alias("final_value"))
    return attributes.batch_totals(p)


#: Names of source attributes and fields whose likeness decides, and what difflib gives for them: (name, rank, field, score in hundredths).
FUZZY_FIELDS = [(1, "Скорость отжима барабана"), (2, "Скорость вращения"), (3, "Цвет корпуса")]
FUZZY_NAMES = ["скорость отжима барабна", "скорость", "цвет корпса", "глубина", "корпуса цвет и скорость"]
SCORES = """
scores AS (SELECT * FROM (VALUES
  ('скорость отжима барабна', 1, 1, 79),
  ('скорость отжима барабна', 2, 2, 51),
  ('скорость отжима барабна', 3, 3, 14),
  ('скорость', 1, 1, 96),
  ('скорость', 2, 2, 96),
  ('скорость', 3, 3, 19),
  ('цвет корпса', 1, 3, 69),
  ('цвет корпса', 2, 2, 17),
  ('цвет корпса', 3, 1, 14),
  ('глубина', 1, 3, 10),
  ('глубина', 2, 1, 9),
  ('глубина', 3, 2, 4),
  ('корпуса цвет и скорость', 1, 3, 96),
  ('корпуса цвет и скорость', 2, 2, 41),
  ('корпуса цвет и скорость', 3, 1, 32)
) AS t(name, rank, field_id, score)),
named AS (SELECT p_partkey, list_extract(['скорость отжима барабна', 'скорость', 'цвет корпса', 'глубина', 'корпуса цвет и скорость'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS name FROM part)"""


def _fuzzy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = F.array(*map(F.lit, FUZZY_NAMES))
    attrs = table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"))
    return attrs, spark.createDataFrame(FUZZY_FIELDS, "field_id int, name string")


@query("WITH" + SCORES + """ SELECT p_partkey, name, CASE WHEN score >= 74 THEN field_id END AS field_id, score AS confidence, CASE WHEN score >= 74 THEN 'mapped' ELSE 'unknown' END AS status FROM named JOIN scores USING (name) WHERE rank = 1""")
def fuzzy_fields(spark, d):
    """Names that are only like a field's"""
    attrs, fields = _fuzzy(spark, d)
    return attrs.join(attributes.map_attributes(attrs, fields).hint("merge"), "name").select("p_partkey", "name", "field_id", "confidence", "status")


@query("WITH" + SCORES + " SELECT p_partkey, name, rank, field_id, score FROM named JOIN scores USING (name)")
def field_alternatives(spark, d):
    """The best fields of every name"""
    attrs, fields = _fuzzy(spark, d)
    return attrs.join(attributes.alternatives(attrs, fields).hint("merge"), "name").select("p_partkey", "name", "rank", "field_id", "score")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS mapped, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 100 WHEN length(p_brand) = 7 THEN 93 ELSE 94 END AS confidence FROM part""")
def fuzzy_values(spark, d):
    """Values that are only like one of a dictionary"""
    p = table(spark, d, "part")
    said = F.when(F.col("p_partkey") % 3 == 0, "Brand of nobody").when(F.col("p_partkey") % 3 == 1, F.upper("p_brand")).otherwise(F.replace("p_brand", F.lit("n"), F.lit("nn")))
    rows = p.select("p_partkey", F.lit(1).alias("field_id"), said.alias("value"))
    allowed = p.select(F.lit(1).alias("field_id"), F.col("p_brand").alias("value")).distinct().withColumn("normalized_value", values.attr_key(F.col("value")))
    nothing = spark.createDataFrame([], "field_id int, value string, normalized_synonym string")
    mapped = attributes.map_values(rows, field_view(spark), allowed, nothing)
    return rows.join(mapped.hint("merge"), ["field_id", "value"]).select("p_partkey", "mapped", "confidence")


@query("""SELECT p_type AS category, CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'MEDIUM' THEN 3 END AS INTEGER) AS template_id, CASE p_type WHEN 'ECONOMY' THEN 86 WHEN 'STANDARD' THEN 88 WHEN 'MEDIUM' THEN 100 END AS score FROM part GROUP BY p_type""")
def fuzzy_templates(spark, d):
    """Categories that are only like a template's name"""
    t = spark.createDataFrame([(1, "Economi"), (2, "Standart"), (3, "medium"), (4, "Prom0tion")], "template_id int, name string")
    found = attributes.match_template(table(spark, d, "part").select(F.col("p_type").alias("category")), t)
    return found.select("category", "template_id", F.bround(F.col("score") * 100).cast("int").alias("score"))


# --- the log


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, left(CAST(user_id AS VARCHAR), 255) AS project_name, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS day FROM events""")
def stored_logs(spark, d):
    """K8: the log appended in two steps, a folder for each day, and read again"""
    path = new_path(spark, "log")
    rows = log_view(spark, d).withColumn("level", F.upper("level"))
    for part in (0, 1):
        logs.append_logs(rows.where(F.col("id") % 2 == part), path)
    return spark.read.parquet(path).select("id", "level", "project_name", F.date_format("day", "yyyy-MM-dd").alias("day"))


# --- streams


@query("WITH" + CHANGES + """, base AS (SELECT item_id, max(revision) AS r, arg_max(kind, revision) AS bk, arg_max(k, revision) AS k, arg_max(v, revision) AS v FROM changes WHERE kind <> 'state' GROUP BY item_id),
st AS (SELECT c.item_id, c.k, arg_max(c.v, c.revision) AS v FROM changes c JOIN base b ON b.item_id = c.item_id AND b.bk = 'upsert' AND c.revision > b.r WHERE c.kind = 'state' GROUP BY c.item_id, c.k),
pay AS (SELECT item_id, k, v FROM base WHERE bk = 'upsert' UNION ALL SELECT item_id, k, v FROM st)
SELECT item_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS payload FROM pay GROUP BY item_id""")
def stream_current(spark, d):
    """The last state of every item, laid down batch by batch of a change stream"""
    stream = change_view(spark, d, streams.file_stream(spark, d, "events.parquet"))
    return streams.current_table(stream).select("item_id", flat(F.col("payload")).alias("payload"))


@query("WITH" + MISSING + ", firsts AS (SELECT min(row_id) AS row_id FROM offers GROUP BY source_model) SELECT source_model AS model_key, string_agg(label, ',' ORDER BY position) AS missing FROM missing JOIN offers USING (row_id) WHERE row_id IN (SELECT row_id FROM firsts) GROUP BY source_model")
def stream_new(spark, d):
    """Products of a stream that were never seen before and are missing in some feed, once each"""
    model = offers(spark, d, streams.file_stream(spark, d, "part.parquet")).select("row_id", keys.key_texts(F.col("source_model")).alias("keys"), F.col("source_model").alias("model_key"))
    f, k = feeds(spark, d), staged(feed_keys(spark, d), "feed-keys")
    return streams.new_products(model, f, k).select("model_key", F.array_join("missing", ",").alias("missing"))
