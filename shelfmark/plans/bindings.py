"""Queries over the driver's tables, with the same in DuckDB SQL.

The tables hold no shops or feeds, so each query takes a view of them: parts are offers, lineitems
with a large quantity say which feed (return flag) lists a part, suppliers are donors, nations brands,
events logs and changes, documents free text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import candidates as cand
from shelfmark.functions import keys, text, times, urls, values
from shelfmark.operators import attributes, changes, dedupe, entities, logs, match, pages, report
from shelfmark.plans import jobs
from shelfmark.sources import feeds as feed_sources
from shelfmark.sources import grid as grids
from shelfmark.storage import small_batches, spread, staged
from shelfmark.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- views

OFFERS = """
offers AS (SELECT p_partkey AS row_id, p_partkey + 1 AS row_number, 'MX-' || (p_partkey % 700) || '/' || p_size AS source_model,
  p_name || ' ' || p_brand || ' MX-' || (p_partkey % 700) || '/' || p_size AS name, CAST(floor(p_retailprice) AS BIGINT) || ' руб.' AS price,
  p_brand AS brand, 'https://shop.example.test/goods_' || (p_partkey % 900) AS url, p_type AS supplier FROM part)"""
FEEDS = OFFERS + """,
feeds AS (SELECT l_returnflag AS source, 'feed ' || l_returnflag AS label, row_number() OVER (ORDER BY l_returnflag) AS position FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
listed AS (SELECT DISTINCT l_returnflag AS source, source_model AS item FROM lineitem JOIN offers ON l_partkey = row_id WHERE l_quantity >= 48),
feed_keys AS (SELECT DISTINCT source, k AS key FROM (SELECT source, item AS k FROM listed UNION ALL SELECT source, regexp_replace(item, '[-/]', '', 'g') FROM listed))"""


def offers(spark, d, parts=None):
    p = parts if parts is not None else table(spark, d, "part")
    model = F.concat(F.lit("MX-"), (F.col("p_partkey") % 700).cast("string"), F.lit("/"), F.col("p_size").cast("string"))
    return p.select(
        F.col("p_partkey").alias("row_id"), (F.col("p_partkey") + 1).alias("row_number"), model.alias("source_model"), F.concat_ws(" ", "p_name", "p_brand", model).alias("name"),
        F.concat(F.floor("p_retailprice").cast("long").cast("string"), F.lit(" руб.")).alias("price"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("https://shop.example.test/goods_"), (F.col("p_partkey") % 900).cast("string")).alias("url"), F.col("p_type").alias("supplier"),
    )


def feeds(spark, d):
    flags = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source")).distinct()
    return flags.select("source", F.concat(F.lit("feed "), "source").alias("label"), (F.ascii("source") - 64).cast("int").alias("position"))


def feed_items(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 48").select(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("row_id")).distinct()
    return big.join(offers(spark, d), "row_id").select("source", F.col("source_model").alias("item"), F.col("row_id").alias("position"))


def feed_keys(spark, d):
    return match.feed_index(feed_items(spark, d), F.array("item"))


def keyed_offers(spark, d):
    return offers(spark, d).select("row_id", keys.key_texts(F.col("source_model")).alias("keys"))


def log_view(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("level"), F.col("props").alias("message"), F.col("user_id").cast("string").alias("project_name"))


CHANGES = """
changes AS (SELECT event_id AS revision, user_id AS item_id, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'upsert' ELSE 'state' END AS kind,
  event_type AS k, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS v FROM events)"""


def change_view(spark, d, events=None):
    e = events if events is not None else table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "upsert").otherwise("state")
    payload = F.create_map(F.col("event_type"), F.round(F.col("value") * 100).cast("long").cast("string"))
    return e.select(F.col("event_id").alias("revision"), F.col("user_id").alias("item_id"), kind.alias("kind"), F.when(kind == "remove", F.create_map().cast("map<string,string>")).otherwise(payload).alias("payload"))


def flat(m):
    """A map as sorted text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


# --- keys and text


@query("WITH" + OFFERS + " SELECT row_id, upper(source_model) AS original, regexp_replace(upper(source_model), '[-/]', '', 'g') AS compact, regexp_replace(upper(source_model), '[-/]', '', 'g') AS visual, upper(name) AS name_key, 'MX' AS prefix FROM offers")
def compare_keys(spark, d):
    """F8, F12-F16"""
    m = F.col("source_model")
    folded = F.replace(m, F.lit("MX"), F.lit("МХ"))  # Cyrillic look-alikes
    return offers(spark, d).select("row_id", keys.compare_key(m).alias("original"), keys.compact_key(m).alias("compact"), keys.visual_key(folded).alias("visual"), F.get(keys.product_keys(F.lit(""), F.col("name")), F.lit(0)).alias("name_key"), F.left(keys.visual_key(folded), F.lit(2)).alias("prefix"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS clean, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS header,
  regexp_replace(text, '[^0-9]+', '', 'g') AS digits FROM documents""")
def clean_documents(spark, d):
    """F1, F2, F3, F5"""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.clean_text(t).alias("clean"), text.norm_header(t).alias("header"), text.price_digits(t).alias("digits"))


@query("WITH" + OFFERS + """ SELECT row_id, price AS found, price AS display, CASE WHEN p >= 1000 THEN (p // 1000) || ' ' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0') ELSE CAST(p AS VARCHAR) END || ' ₽' AS bare, CAST(p AS VARCHAR) AS digits
 FROM (SELECT *, CAST(split_part(price, ' ', 1) AS BIGINT) AS p FROM offers)""")
def prices(spark, d):
    """F5, F6, F7"""
    p = F.col("price")
    bare = F.split(p, " ")[0]
    return offers(spark, d).select("row_id", F.get(text.extract_prices(F.concat(F.lit("от "), p, F.lit(" за шт"))), F.lit(0)).alias("found"), text.price_display(p).alias("display"), text.price_display(bare).alias("bare"), text.price_digits(p).alias("digits"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(round(p_retailprice, 2) AS VARCHAR) END AS price, CASE WHEN p_size > 25 THEN '1' ELSE '0' END AS flag FROM part""")
def cell_texts(spark, d):
    """F4"""
    return table(spark, d, "part").select("p_partkey", text.cell_text(F.col("p_retailprice"), "double").alias("price"), text.cell_text(F.col("p_size") > 25, "boolean").alias("flag"))


RULES = "Brand#|\n{reg[#m(x)-#i]}|\\1\n{skip}zzz|\n12{.}|!\nbroken"


@query("WITH" + OFFERS + r""" SELECT row_id, regexp_replace(regexp_replace(replace(name, 'Brand#', ''), '(?i)m(x)-', '\1', 'g'), '12.', '!', 'g') AS replaced, p AS plain, trim(regexp_replace(name, '[^0-9A-Za-z\s\-./\\|@+]+', ' ', 'g')) AS stripped
 FROM (SELECT *, trim(regexp_replace(name, '#', ' ')) AS p FROM offers)""")
def replace_rules(spark, d):
    """F17, F18, F19, F10"""
    tagged = F.concat(F.lit("<b>"), F.replace("name", F.lit("#"), F.lit("<i>")), F.lit("</b>"))
    return offers(spark, d).select("row_id", text.apply_rules(F.col("name"), RULES).alias("replaced"), text.strip_tags(tagged).alias("plain"), text.strip_model_chars(F.col("name")).alias("stripped"))


@query("WITH" + OFFERS + " SELECT row_id, brand AS between_, source_model AS after_, '' AS none, 'cost' AS field, CAST(2 AS INTEGER) AS items, 'a side b' AS phrase FROM offers")
def markers_and_lists(spark, d):
    """F11, F22, F28, F30"""
    n = F.col("name")
    listed = text.split_list(F.concat_ws("\n", "brand", "source_model", "brand", F.lit(" ")))
    src = F.concat(F.lit("[b]"), "brand", F.lit("[/b]=>"), "source_model")
    return offers(spark, d).select("row_id", text.between_markers(src, "[b]", "[/b]").alias("between_"), text.between_markers(src, "=>").alias("after_"), text.between_markers(n, "nowhere", "x").alias("none"), text.norm_field(F.lit("<ns:cost>")).alias("field"), F.size(listed).alias("items"), text.strip_phrases(F.lit("a side b side-by-side ")).alias("phrase"))


@query("SELECT doc_id, coalesce(text, '') AS decoded, coalesce(text, '') || '&nosuch; &lt;' AS once FROM documents")
def references(spark, d):
    """every kind of character reference in whole texts"""
    coded = F.coalesce("text", F.lit(""))
    for char, ref in (("&", "&amp;"), (",", "&comma;"), ("t", "&#x74;"), (".", "&#46;"), ("é", "&eacute;"), ("ó", "&#243"), ("\n", "&NewLine;")):
        coded = F.replace(coded, F.lit(char), F.lit(ref)) if not ref.startswith("&#243") else F.regexp_replace(coded, "ó(?![0-9])", ref)
    small_batches(spark)
    rows = table(spark, d, "documents").select("doc_id", coded.alias("coded"))
    return rows.select("doc_id", text.unescape(F.col("coded")).alias("decoded"), text.unescape(F.concat("coded", F.lit("&nosuch; &amp;lt;"))).alias("once"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_defaults(spark, d):
    """F31"""
    return table(spark, d, "events").select("event_id", text.json_or(F.col("props"), "k int", F.struct(F.lit(0).alias("k")))["k"].alias("k"))


@query("WITH" + OFFERS + " SELECT row_id, source_model AS first, source_model AS converter, 'MX-' || (row_id % 700) || '/' || p_size || 'A' AS scraped FROM offers JOIN part ON row_id = p_partkey")
def model_candidates(spark, d):
    """F20-F26"""
    o = spread(offers(spark, d), "row_id")
    described = F.concat(F.lit("Чайник электрический "), "brand", F.lit(" "), "source_model", F.lit(" чёрный, 1,7 Л"))
    return o.select("row_id", F.get(cand.model_candidates(described, F.col("brand")), F.lit(0)).alias("first"), cand.converter_model(F.concat(F.col("source_model"), F.lit(" белый")), F.col("brand")).alias("converter"), cand.finalize_model(F.concat(F.lit("Духовой шкаф "), "source_model", F.lit("a"))).alias("scraped"))


@query("SELECT part.p_partkey AS row_id, p_brand AS detected_brand FROM part")
def brand_in_name(spark, d):
    """J9"""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    o = offers(spark, d).select("row_id", "name")
    return match.detect_brand(o, brands).select("row_id", "detected_brand")


# --- urls and pages

PARTS = r"""
parts AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages)"""


@query("WITH" + PARTS + r""" SELECT page_id, scheme || '://' || host || path || CASE WHEN query LIKE 'page=%' THEN '?' || split_part(query, '&', 1) ELSE '' END AS canonical,
  scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS feed_url, regexp_replace(host, '^www\.', '') AS source,
  (host = 'example.com' OR host LIKE '%.example.com') AS same_site, ends_with(path, '.css') AS static, path LIKE '/en/%' AS follow, (path LIKE '/fr/%' OR host LIKE 'm.%') AS excluded FROM parts""")
def page_urls(spark, d):
    """U1-U8, P2"""
    u = F.col("url")
    p = table(spark, d, "pages")
    starts = [f"https://example.{t}/en/" for t in ("com", "net", "org")]
    return p.select(
        "page_id", urls.normalize_url(u, u).alias("canonical"), urls.normalize_feed_url(u).alias("feed_url"), urls.feed_source(u).alias("source"), urls.same_site(u, F.lit("example.com")).alias("same_site"),
        urls.is_static(u).alias("static"), urls.should_follow(u, starts).alias("follow"), urls.url_excluded(u, ["/fr/", "http*://m.*"]).alias("excluded"),
    )


@query("WITH" + PARTS + " SELECT page_id, (path LIKE '/en/%' OR path LIKE '/de/%') AND NOT contains(url, '.html') AS ok, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS product FROM parts")
def product_urls(spark, d):
    """U7, P3"""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.product_url_ok(u, ["/en/", "*/de/*"], [".HTML"]).alias("ok"), urls.canonical_product_url(F.regexp_replace(u, "^([a-z]+://[^/]+)/", "$1/")).alias("product"))


@query("WITH" + PARTS + r""" SELECT url, scheme || '://' || host || h AS link FROM (SELECT DISTINCT url, scheme, host, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM parts)""")
def page_links(spark, d):
    """U10"""
    return pages.extract_links(table(spark, d, "pages").select("url", "html")).distinct()


@query(r"""WITH headed AS (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h FROM pages),
unquoted AS (SELECT page_id, regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&#(39|[xX]27);', '''', 'g') AS h FROM headed),
decoded AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS h FROM unquoted)
SELECT page_id, trim(regexp_replace(h, '[ \t\n\r]+', ' ', 'g')) || ' <X5> ®' AS name,
  CASE page_id % 3 WHEN 0 THEN 'в наличии' WHEN 1 THEN 'под заказ' ELSE '' END AS availability, page_id % 4 = 0 AS blocked FROM decoded""")
def page_names(spark, d):
    """U9, U13, U14"""
    h, n = F.col("html"), F.col("page_id")
    p = table(spark, d, "pages")
    said = F.when(n % 3 == 0, "<i>Нет</i> в наличии, Ожидается").when(n % 3 == 1, "Ожидался, под заказ").otherwise("")
    shell = F.when(n % 4 == 0, "<html><body><p>One more step: CAPTCHA</p></body></html>").otherwise(h)
    enough = (n % 4 == 0) | (F.length(pages.visible_text(h)) >= 250)
    named = F.regexp_replace(h, "</h1>", " &lt;X5&gt; &reg;</h1>")
    return p.select("page_id", pages.extract_name(named).alias("name"), pages.extract_availability(F.concat(F.regexp_replace(h, "(?i)available|stock", ""), said)).alias("availability"), (pages.is_blocked(shell) & enough).alias("blocked"))


CARD = pages.PageRules(card_open='<div class="card">', url='href="([^"]*)"', model='<b class="model">(.*?)</b>', price='<i class="price">(.*?)</i>')


def card_pages(spark, d):
    o = offers(spark, d)
    card = F.concat(F.lit('<div class="card"><a href="'), F.concat(F.lit("/goods_"), "row_id"), F.lit('">x</a><b class="model">'), "source_model", F.lit('</b><i class="price">'), "price", F.lit("</i></div>"))
    # one page for each brand and thousand of parts
    made = o.withColumn("card", card).groupBy("brand", F.floor(F.col("row_id") / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("row_id", "card"))).alias("cards"))
    return made.select(F.concat(F.lit("https://shop.example.test/c/"), F.replace("brand", F.lit("#"), F.lit("-")), F.lit("/"), "part").alias("url"), F.concat(F.lit("<body>"), F.array_join(F.col("cards.card"), ""), F.lit("</body>")).alias("html"))


@query("WITH" + OFFERS + " SELECT 'https://shop.example.test/goods_' || row_id AS url, source_model AS model, price FROM offers")
def listing_cards(spark, d):
    """U11, U18, D2, W10"""
    return jobs.crawl_result(card_pages(spark, d), CARD, pages.PageRules(model="<h1>(.*?)</h1>", price="<em>(.*?)</em>"))


@query("WITH" + OFFERS + " SELECT 'https://shop.example.test/goods_' || row_id AS url, upper(source_model) AS model, price FROM offers WHERE row_id % 2 = 0")
def detail_pages(spark, d):
    """U12, J7, P5"""
    return detail_view(offers(spark, d).where("row_id % 2 = 0"))


@query("WITH" + OFFERS + " SELECT 'https://shop.example.test/goods_' || row_id AS url, upper(source_model) AS model, price FROM offers")
def detail_pages_whole(spark, d):
    """Every part"""
    return detail_view(offers(spark, d))


def detail_view(o):
    url = F.concat(F.lit("https://shop.example.test/goods_"), "row_id")
    html = F.concat(F.lit("<h1>["), "source_model", F.lit("]</h1>"))
    listing = o.select(F.lit("p").alias("page_url"), F.col("row_id").alias("pos"), url.alias("url"), "price")
    stored = pages.with_listing_price(o.select(url.alias("url"), html.alias("html")), listing)
    return pages.extract_detail(stored, pages.PageRules(model_start="[", model_end="]", price="<em>(.*?)</em>"))


@query("""SELECT p_partkey AS id, p_name AS name, 'M' || p_partkey AS model, p_brand AS brand, p_type AS category, 'size' AS attr, CAST(p_size AS VARCHAR) AS value FROM part""")
def structured_data(spark, d):
    """U15, U16, U17"""
    p = spread(table(spark, d, "part"), "p_partkey")
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.concat(F.lit("M"), "p_partkey").alias("sku"), F.struct(F.col("p_brand").alias("name")).alias("brand")))
    table_ = F.concat(F.lit("<table><tr><th>Size</th><td>"), F.col("p_size").cast("string"), F.lit("</td></tr><tr><td>size</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    crumbs = F.concat(F.lit('<div class="breadcrumbs"><a>'), "p_type", F.lit("</a><a>"), "p_type", F.lit("</a></div>"))
    made = p.select(F.col("p_partkey").alias("url"), F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"), crumbs, table_).alias("html"))
    made = staged(pages.with_facts(made).drop("html"), "facts")  # read three times
    pairs = pages.extract_pairs(made).select("url", F.lower("name").alias("attr"), "value")
    found = pages.extract_jsonld(made).select("url", "name", "model", "brand")
    back = pages.page_fallbacks(made).select("url", "category")
    return found.join(pairs.hint("merge"), "url").join(back.hint("merge"), "url").withColumnRenamed("url", "id")


@query("""WITH pairs AS (
  SELECT p_partkey AS id, 0 AS pos, 'Цвет & размер' AS attr, p_type || ' <' || p_size || '>' AS value FROM part
  UNION ALL SELECT p_partkey, 1, 'outer', p_size || ' inner ' || p_brand FROM part UNION ALL SELECT p_partkey, 2, 'inner', p_brand FROM part UNION ALL SELECT p_partkey, 3, 'Артикул', 'M' || p_partkey FROM part)
SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 2 THEN 'M' || p_partkey ELSE 'S' || p_partkey END AS model, p_brand AS brand,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Home > ' || p_type END AS category, attr, value FROM part JOIN pairs ON p_partkey = id""")
def structured_pages(spark, d):
    """Products in graphs and lists, of several types, fields from several products, tables within cells, references in cells"""
    p = spread(table(spark, d, "part"), "p_partkey")
    n = F.col("p_partkey")
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    quoted = lambda c: F.regexp_extract(text(c), r"^\{\"x\":(.*)\}$", 1)
    first = F.concat(F.lit('{"@type":["Thing","Product"],"name":"old","category":"'), F.when(n % 2 == 0, F.col("p_type")).otherwise(""), F.lit('","brand":{"name":'), quoted("p_brand"), F.lit("}}"))
    sku = F.when(n % 3 == 2, "").otherwise(F.concat(F.lit("S"), n))
    second = F.concat(F.lit('{"@type":"Product","name":'), quoted("p_name"), F.lit(',"brand":"","sku":"'), sku, F.lit('"}'))
    ld = F.when(n % 3 == 0, F.concat(F.lit('{"@context":"x","@graph":[{"@type":"Other"},'), first, F.lit(",["), second, F.lit("]]}"))).when(n % 3 == 1, F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))).otherwise(
        F.concat(first, F.lit('</script><script type="application/ld+json">not json</script><script type="application/ld+json">'), second)
    )
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    cells = F.concat(
        F.lit("<table><tr><td>Цвет &amp; размер<td></td></td><td>"), F.col("p_type"), F.lit(" &lt;"), size, F.lit("&gt;</td></tr><tr><th>outer</th><td>"), size, F.lit("<table><tr><td>inner</td><td>"), brand,
        F.lit("</td></tr></table></td></tr><tr><td>INNER</td><td>"), F.lower(brand), F.lit("</td></tr><tr><td>same</td><td>same</td></tr></table><dl><dt>Артикул</dt><p>x</p><dd>M"), n, F.lit("</dd></dl>"),
    )
    crumbs = F.concat(F.lit('<ul class="top breadcrumb"><li><a>Home</a></li><li><a>'), F.col("p_type"), F.lit("</a></li><li><a> home</a></li></ul>"))
    html = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"), F.regexp_replace(crumbs, "<li><a> home</a></li>", ""), F.lit("<h1>heading</h1>"), cells)
    made = staged(pages.with_facts(p.select(F.col("p_partkey").alias("url"), html.alias("html"))).drop("html"), "facts")
    found = pages.page_product(made).select("url", "name", "model", "brand", "category", F.explode("attributes").alias("a"))
    return found.select(F.col("url").alias("id"), "name", "model", "brand", "category", F.col("a.name").alias("attr"), F.col("a.value").alias("value"))



@query("WITH" + PARTS + r""", links AS (SELECT DISTINCT scheme || '://' || host || h AS link, h FROM (SELECT scheme, host, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM parts WHERE host LIKE '%.example.com'))
 SELECT link FROM links WHERE NOT starts_with(lower(h), '/the') AND link NOT IN (SELECT url FROM pages)""")
def url_frontier(spark, d):
    """J8"""
    return frontier_view(spark, d).where(~F.lower(urls.path_of(F.col("link"))).startswith("/the"))


@query("WITH" + PARTS + r""", links AS (SELECT DISTINCT scheme || '://' || host || h AS link, h FROM (SELECT scheme, host, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM parts WHERE host LIKE '%.example.com'))
 SELECT link FROM links WHERE link NOT IN (SELECT url FROM pages)""")
def url_frontier_whole(spark, d):
    """Every path"""
    return frontier_view(spark, d)


def frontier_view(spark, d):
    p = table(spark, d, "pages").select("url", "html")
    links = pages.extract_links(p)
    nothing = p.limit(0)
    return pages.next_frontier(links, p, nothing, ["https://example.com/"])


# --- values and times


@query("""SELECT p_partkey, lower(p_name) AS key, upper(replace(replace('MX-' || p_partkey, '-', ''), ' ', '')) AS model, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END AS number,
  p_size || 'x' || (p_size + 1) || '.5' AS dims, CASE WHEN p_size > 25 THEN 'Да' ELSE 'Нет' END AS yes, CASE WHEN p_brand < p_type THEN p_brand || '/' || p_type ELSE p_brand || '/' || p_type END AS parts FROM part""")
def typed_values(spark, d):
    """A1, A2, A4-A6"""
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    return p.select(
        "p_partkey", values.attr_key(F.concat(F.lit(" "), "p_name", F.lit("! "))).alias("key"), values.attr_model(F.concat(F.lit("mx-"), "p_partkey")).alias("model"),
        values.norm_number(F.concat(size, F.when(F.col("p_partkey") % 2 == 0, ",50").otherwise(",00"))).alias("number"), values.norm_value(F.concat(size, F.lit(" х "), (F.col("p_size") + 1).cast("string"), F.lit(",5")), "dimensions").alias("dims"),
        values.norm_value(F.when(F.col("p_size") > 25, "Есть").otherwise("no"), "boolean").alias("yes"), values.norm_value(F.concat_ws(" / ", "p_type", "p_brand", "p_type"), "select", True).alias("parts"),
    )


@query("""SELECT p_partkey AS id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'g' ELSE 'h' END AS group_name, CASE pos WHEN 0 THEN 'brand' ELSE 'size' END AS name, CASE pos WHEN 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS value, p_type AS head, 'grp' AS head_group
 FROM part, (SELECT unnest([0, 2]) AS pos)""")
def attribute_stacks(spark, d):
    """A7, A8"""
    p = table(spark, d, "part")
    stack = F.concat(F.lit("g|brand|"), "p_brand", F.lit("\r\nno parts\nh|size|"), F.col("p_size").cast("string"))
    h = values.split_header(F.concat("p_type", F.lit(" ( grp )")))
    return p.select(F.col("p_partkey").alias("id"), F.explode(values.parse_stack(stack)).alias("s"), h["name"].alias("head"), h["group"].alias("head_group")).select("id", "s.*", "head", "head_group")


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT a, 1.0::DOUBLE AS same, 0.96::DOUBLE AS inside FROM n""")
def mapping_scores(spark, d):
    """A3, A9"""
    n = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    return n.select("a", values.mapping_score(F.col("a"), F.upper("a")).alias("same"), values.mapping_score(F.col("a"), F.concat(F.col("a"), F.lit(" макс extra"))).alias("inside"))


@query("""SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '+03:00' AS local, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def local_times(spark, d):
    """A10, A11"""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "events").select("event_id", times.to_local_iso(F.col("ts")).alias("local"), F.date_format(times.parse_dt(F.concat(iso, F.lit("+03:00"))), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


SCHEDULE = """
schedule AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'once' WHEN 1 THEN 'daily' ELSE 'weekly' END AS kind, o_orderdate + INTERVAL 5 HOUR AS now, CAST(o_orderkey % 24 AS INTEGER) AS hour, CAST(o_orderkey % 9 AS INTEGER) AS weekday, o_orderdate AS once_at FROM orders),
planned AS (SELECT *, CASE kind WHEN 'once' THEN once_at WHEN 'daily' THEN date_trunc('day', now) + to_hours(hour) ELSE date_trunc('day', now) + to_hours(hour) + to_days(CAST(least(weekday, 6) - (isodow(now) - 1) AS INTEGER)) END AS run_at FROM schedule)"""


def schedule_view(spark, d):
    o = table(spark, d, "orders")
    now = F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(5))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "once").when(F.col("o_orderkey") % 3 == 1, "daily").otherwise("weekly")
    time = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00"))
    s = o.select(F.col("o_orderkey").alias("id"), kind.alias("schedule_type"), now.alias("now"), time.alias("time"), (F.col("o_orderkey") % 9).cast("int").alias("weekday"), F.col("o_orderdate").alias("once_at"), "o_orderstatus")
    args = (F.col("schedule_type"), F.col("time"), F.col("weekday"), F.col("once_at"), F.col("now"))
    return s.withColumn("run_at", times.run_at(*args)).withColumn("next", times.next_run_at(*args))


@query("WITH" + SCHEDULE + """ SELECT id, strftime(run_at, '%Y-%m-%d %H:%M') AS run_at, strftime(CASE WHEN kind = 'once' OR run_at > now THEN run_at WHEN kind = 'daily' THEN run_at + INTERVAL 1 DAY ELSE run_at + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M') AS next FROM planned""")
def schedules(spark, d):
    """A12, A13"""
    fmt = "yyyy-MM-dd HH:mm"
    return schedule_view(spark, d).select("id", F.date_format("run_at", fmt).alias("run_at"), F.date_format("next", fmt).alias("next"))


@query("WITH" + SCHEDULE + """ SELECT p.id FROM planned p JOIN orders ON o_orderkey = p.id WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AND CASE kind WHEN 'once' THEN now >= run_at ELSE now >= run_at AND now < run_at + INTERVAL 90 SECOND END""")
def due_schedules(spark, d):
    """P8"""
    s = schedule_view(spark, d)
    brands = s.withColumns({"enabled": F.col("id") % 5 != 0, "status": F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed"), "last_scan_at": F.lit(None).cast("timestamp_ntz")})
    return logs.due(brands, s.select(F.col("id").alias("brand_id")), F.col("now")).select("id")


# --- matching


@query("WITH" + FEEDS + " SELECT source, key, min(item) AS item FROM (SELECT source, item, item AS key FROM listed UNION ALL SELECT source, item, regexp_replace(item, '[-/]', '', 'g') FROM listed) GROUP BY source, key HAVING count(DISTINCT item) = 1")
def feed_index(spark, d):
    """J1"""
    # texts of two items may fall together without their separators: those are left out on both sides
    all_ = feed_items(spark, d).select("source", "item", F.explode(F.array("item", F.regexp_replace("item", "[-/]", ""))).alias("key")).groupBy("source", "key").agg(F.count_distinct("item").alias("n"))
    return feed_keys(spark, d).select("source", "key", "item").join(all_.where("n = 1").select("source", "key").hint("merge"), ["source", "key"], "left_semi")


KEYED = """,
placed AS (SELECT l_returnflag AS source, row_id, min(source_model) AS item FROM lineitem JOIN offers ON l_partkey = row_id WHERE l_quantity >= 48 GROUP BY ALL),
reasons AS (SELECT source, item, row_id * 2 AS place, 'original' AS reason, item AS key FROM placed UNION ALL SELECT source, item, row_id * 2 + 1, 'compact', regexp_replace(item, '[-/]', '', 'g') FROM placed),
indexed AS (SELECT source, key, arg_min(item, place) AS item, arg_min(reason, place) AS reason FROM reasons GROUP BY source, key)"""


@query("WITH" + FEEDS + KEYED + " SELECT * FROM indexed")
def feed_index_whole(spark, d):
    """Keys that items share too; the first item by position has them"""
    return feed_keys(spark, d)


@query("WITH" + FEEDS + ", codes AS (SELECT source, item AS key FROM listed UNION SELECT source, item || ' NAME' FROM listed) SELECT source, count(*) AS codes_count FROM codes GROUP BY source")
def feed_codes(spark, d):
    """J2, G5"""
    items = feed_items(spark, d).select("source", F.col("item").alias("vendorcode"), F.lit(" ").alias("model"), F.concat("item", F.lit(" name")).alias("name"), F.lit("t").alias("title"))
    return report.codes_count(match.feed_codes(items))


@query("WITH" + FEEDS + ", hits AS (SELECT o.row_id, f.source, f.position FROM offers o JOIN listed l ON l.item = o.source_model JOIN feeds f ON f.source = l.source) SELECT row_id, arg_min(source, position) AS source, 'matched:original' AS reason, source_model AS candidate FROM hits JOIN offers USING (row_id) GROUP BY row_id, source_model")
def best_matches(spark, d):
    """J3"""
    # a row that is listed only by its compact form is another matter
    return match_view(spark, d).where("reason = 'matched:original'").select("row_id", "source", "reason", "candidate")


@query("WITH" + FEEDS + KEYED + """,
asked AS (SELECT row_id, source_model AS candidate, 0 AS r, 'original' AS reason, source_model AS key FROM offers UNION ALL SELECT row_id, source_model, 1, 'compact', regexp_replace(source_model, '[-/]', '', 'g') FROM offers),
hits AS (SELECT a.row_id, a.candidate, 'matched:' || a.reason AS reason, i.source, i.item, a.r * 1000000 + f.position AS place FROM asked a JOIN indexed i ON i.key = a.key JOIN feeds f ON f.source = i.source)
 SELECT row_id, arg_min(source, place) AS source, arg_min(reason, place) AS reason, arg_min(candidate, place) AS candidate, arg_min(item, place) AS item FROM hits GROUP BY row_id""")
def best_matches_whole(spark, d):
    """Every reason"""
    return match_view(spark, d)


def match_view(spark, d):
    rows = offers(spark, d).select("row_id", F.array(F.lit("none"), F.col("source_model")).alias("candidates"))
    return match.best_match(rows, feed_keys(spark, d), feeds(spark, d))


MISSING = FEEDS + """,
hits AS (SELECT DISTINCT o.row_id, k.source FROM offers o JOIN feed_keys k ON k.key = o.source_model OR k.key = regexp_replace(o.source_model, '[-/]', '', 'g')),
missing AS (SELECT o.row_id, f.label, f.position FROM offers o CROSS JOIN feeds f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.row_id = o.row_id AND h.source = f.source))"""


@query("WITH" + MISSING + " SELECT row_id, string_agg(label, ',' ORDER BY position) AS missing FROM missing GROUP BY row_id")
def missing_feeds(spark, d):
    """J4, E2"""
    out = match.missing_feeds(keyed_offers(spark, d), feeds(spark, d), feed_keys(spark, d))
    return out.select("row_id", F.array_join("missing", ",").alias("missing"))


@query("WITH" + MISSING + " SELECT label, count(*) AS missing FROM missing GROUP BY label")
def missing_summary(spark, d):
    """G1"""
    return report.missing_summary(match.missing_feeds(keyed_offers(spark, d), feeds(spark, d), feed_keys(spark, d)), feeds(spark, d))


@query("WITH" + MISSING + " SELECT row_id, CASE WHEN n = 0 THEN 'nowhere' ELSE 'everywhere' END AS present FROM (SELECT o.row_id, count(h.source) AS n FROM offers o LEFT JOIN hits h USING (row_id) GROUP BY o.row_id) WHERE n = 0 OR n = (SELECT count(*) FROM feeds)")
def present_ends(spark, d):
    """J5, E1"""
    rows, k = keyed_offers(spark, d), feed_keys(spark, d)
    none = match.missing_everywhere(rows, k).select("row_id", F.lit("nowhere").alias("present"))
    return none.unionByName(match.present_everywhere(rows, feeds(spark, d), k).select("row_id", F.lit("everywhere").alias("present")))


@query("WITH" + MISSING + ", per AS (SELECT row_id, count(*) AS n FROM missing GROUP BY row_id) SELECT sheet, count(*) AS n FROM (SELECT DISTINCT m.row_id, CASE WHEN p.n = (SELECT count(*) FROM feeds) THEN 'missing on all' ELSE label END AS sheet FROM missing m JOIN per p USING (row_id)) GROUP BY sheet")
def missing_sheets(spark, d):
    """K4"""
    rows = match.missing_feeds(keyed_offers(spark, d), feeds(spark, d), feed_keys(spark, d))
    return report.split_missing(rows, feeds(spark, d)).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))


@query("WITH" + MISSING + " SELECT source_model AS model, row_id, string_agg(label, ',' ORDER BY position) AS missing, price FROM missing JOIN offers USING (row_id) WHERE row_id % 3 <> 0 GROUP BY ALL")
def new_products(spark, d):
    """J6, P4, E3, W2"""
    o = offers(spark, d).withColumn("url", F.concat(F.lit("u"), "row_id"))
    products = o.select("url", F.col("source_model").alias("model"), "price", "row_id")
    details = o.select("url", F.regexp_replace("source_model", "[-/]", "").alias("name"), F.lit("").alias("vendor_code"), F.when(F.col("row_id") % 3 == 0, "Нет в наличии").otherwise("В наличии").alias("availability"))
    out = jobs.scan_new_products(products, details, feeds(spark, d), feed_keys(spark, d), ["нет в"]).rows
    return out.select("model", "row_id", F.array_join("missing", ",").alias("missing"), "price")


@query("WITH" + FEEDS + ", gone AS (SELECT o.row_id, o.source_model, f.label, f.position FROM offers o CROSS JOIN feeds f WHERE NOT EXISTS (SELECT 1 FROM feed_keys k WHERE k.key = o.source_model AND k.source = f.source)), firsts AS (SELECT min(row_id) AS row_id FROM gone GROUP BY source_model) SELECT row_id AS pos, string_agg(label, ',' ORDER BY position) AS missing FROM gone WHERE row_id IN (SELECT row_id FROM firsts) GROUP BY row_id")
def partial_news(spark, d):
    """F16, D3, W2p"""
    products = offers(spark, d).select(F.col("row_id").alias("pos"), "url", F.col("source_model").alias("model"), "price")
    return jobs.scan_partial(products, feeds(spark, d), feed_keys(spark, d)).select("pos", F.array_join("missing", ",").alias("missing"))


COMPARED = MISSING + """,
marked AS (SELECT o.row_id, supplier, source_model, price, CASE WHEN contains(lower(o.name), 'brand#1 ') THEN 'excluded' WHEN m.row_id IS NOT NULL THEN 'missing' ELSE 'found' END AS status, m.missing FROM offers o LEFT JOIN (SELECT row_id, string_agg(label, ',' ORDER BY position) AS missing FROM missing GROUP BY row_id) m USING (row_id))"""


@query("WITH" + COMPARED + " SELECT row_id, supplier, source_model AS selected_model, missing FROM marked WHERE status = 'missing'")
def feed_comparison(spark, d):
    """W1, P1, F24, K5"""
    out = jobs.compare_feeds(offers(spark, d), feeds(spark, d), feed_keys(spark, d), ["BRAND#1 MX"]).rows
    return report.split_by_supplier(out).select("row_id", F.col("sheet").alias("supplier"), "selected_model", F.array_join("missing", ",").alias("missing"))


@query("WITH" + COMPARED + " SELECT supplier, count(*) AS processed, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'missing') AS missing FROM marked GROUP BY ROLLUP (supplier)")
def comparison_totals(spark, d):
    """G3"""
    return jobs.compare_feeds(offers(spark, d), feeds(spark, d), feed_keys(spark, d), ["brand#1 mx"]).totals


@query("WITH" + COMPARED + " SELECT count(*) AS total, count(*) FILTER (status <> 'excluded') AS processed, count(*) FILTER (status = 'excluded') AS excluded, 0::BIGINT AS no_model, count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'missing') AS missing FROM marked")
def import_totals(spark, d):
    """G2, W3"""
    return jobs.import_file(offers(spark, d), feeds(spark, d), feed_keys(spark, d), ["brand#1 mx"]).totals


@query("WITH" + COMPARED + " SELECT row_id, source_model AS selected_model, missing FROM marked WHERE status = 'missing'")
def file_import(spark, d):
    """W3"""
    out = jobs.import_file(offers(spark, d), feeds(spark, d), feed_keys(spark, d), ["brand#1 mx"]).rows
    return out.select("row_id", "selected_model", F.array_join("missing", ",").alias("missing"))


# --- dedupe, order, limits


@query("WITH" + OFFERS + ", d AS (SELECT min(row_number) AS row_number, supplier FROM offers GROUP BY source_model, url, supplier) SELECT supplier, d.row_number AS was, CAST(row_number() OVER (PARTITION BY supplier ORDER BY d.row_number) + 1 AS INTEGER) AS row_number FROM d")
def deduped_offers(spark, d):
    """D1, D5"""
    o = dedupe.first_by(offers(spark, d), [keys.compare_key(F.col("source_model")), F.lower("url"), F.col("supplier")], [F.col("row_number")])
    # a sheet with a header: its rows begin with the second
    return dedupe.number_offers(o.withColumn("was", F.col("row_number")), "supplier").select("supplier", "was", (F.col("row_number") + 1).alias("row_number"))


@query("WITH" + OFFERS + ", r AS (SELECT row_id AS pos, CASE WHEN row_id % 4 = 0 THEN '' ELSE url END AS url, source_model AS model FROM offers), bare AS (SELECT model, min(pos) AS first FROM r WHERE url = '' GROUP BY model), ok AS (SELECT r.* FROM r LEFT JOIN bare b USING (model) WHERE b.first IS NULL OR r.pos <= b.first) SELECT min(pos) AS pos FROM ok WHERE url <> '' GROUP BY url UNION ALL SELECT first FROM bare")
def deduped_products(spark, d):
    """D2"""
    o = offers(spark, d).select(F.col("row_id").alias("pos"), F.when(F.col("row_id") % 4 == 0, "").otherwise(F.col("url")).alias("url"), F.col("source_model").alias("model"), "price")
    return dedupe.dedupe_products(o).select("pos")


@query("SELECT p_brand AS name, p_type AS value, min(p_partkey) AS pos FROM part GROUP BY ALL")
def distinct_pairs(spark, d):
    """D4"""
    return dedupe.distinct_first(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("value"), F.col("p_partkey").alias("pos")), ["name", "value"])


@query("SELECT * FROM (SELECT event_id AS id, event_type AS level FROM events ORDER BY event_id DESC LIMIT 100 OFFSET 100) ORDER BY id")
def log_page(spark, d):
    """T1"""
    return dedupe.log_page(log_view(spark, d), 2, 100).select("id", "level")


@query("SELECT event_id AS id FROM events WHERE event_id > 40 ORDER BY event_id LIMIT 200")
def log_delta(spark, d):
    """T2"""
    return dedupe.log_delta(log_view(spark, d), 40, 200).select("id")


@query("SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), 'omer#0000000') ORDER BY lower(c_name), c_custkey LIMIT 20")
def brand_search(spark, d):
    """P7, T3"""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return dedupe.top_brands(logs.search_brands(c, " oMer#0000000 ")).select("id")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey DESC LIMIT 30")
def latest_batches(spark, d):
    """T4"""
    return dedupe.latest(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("SELECT p_brand, p_partkey, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 4")
def top_alternatives(spark, d):
    """T5"""
    return dedupe.top_k_per(table(spark, d, "part"), ["p_brand"], "p_retailprice", 4, "p_partkey").select("p_brand", "p_partkey", "rank")


@query("WITH r AS (SELECT p_brand, p_partkey, p_size, p_size - coalesce(lead(p_size) OVER w, 0) AS margin, row_number() OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)), l AS (SELECT p_brand, max(p_name) AS longest FROM part p WHERE length(p_name) = (SELECT max(length(p_name)) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand) SELECT r.p_brand, p_partkey, CAST(margin AS DOUBLE) AS margin, longest FROM r JOIN l USING (p_brand) WHERE n = 1")
def best_margins(spark, d):
    """T6, T7"""
    p = table(spark, d, "part")
    best = dedupe.margin(p, ["p_brand"], "p_size", "p_partkey").select("p_brand", "p_partkey", F.col("margin").cast("double").alias("margin"))
    return best.join(dedupe.longest(p, ["p_brand"], "p_name").withColumnRenamed("p_name", "longest"), "p_brand")


@query("SELECT u.url, page_id, (SELECT arg_max(p, length(p)) FROM (SELECT unnest(['http://', 'https://', 'https://m.', 'https://blog.', 'https://www.']) AS p) WHERE starts_with(u.url, p)) AS prefix FROM pages u")
def prefix_rules(spark, d):
    """T8"""
    rules = spark.createDataFrame([(p,) for p in ("http://", "https://", "https://m.", "https://blog.", "https://www.")], "prefix string")
    return dedupe.longest_prefix(table(spark, d, "pages").select("page_id", "url"), rules)


# --- logs and changes


@query("SELECT event_type AS level, count(*) AS n FROM events GROUP BY event_type")
def log_counts(spark, d):
    """G7"""
    return logs.log_counts(log_view(spark, d))


@query("SELECT max(event_id) AS max_id, count(*) AS total, max(event_id) || ':' || count(*) AS signature FROM events")
def log_meta(spark, d):
    """G6"""
    return logs.log_meta(log_view(spark, d))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND contains(props, '\"k\": 8') AND ts >= TIMESTAMP '2024-01-05 00:00:00'")
def log_search(spark, d):
    """P6, P9"""
    now = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return logs.search_logs(logs.prune(log_view(spark, d), now), "click", '"K": 8').select("id")


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM events")
def log_rows(spark, d):
    """K8"""
    return logs.log_rows(log_view(spark, d).withColumn("level", F.upper("level"))).select("id", "level")


@query("WITH" + CHANGES + """, c AS (SELECT * FROM changes WHERE revision > 50), base AS (SELECT item_id, max(revision) AS r, arg_max(kind, revision) AS bk, arg_max(k, revision) AS k, arg_max(v, revision) AS v FROM c WHERE kind <> 'state' GROUP BY item_id),
 st AS (SELECT item_id, k, arg_max(v, revision) AS v, max(revision) AS r FROM c LEFT JOIN (SELECT item_id, r FROM base) b USING (item_id) WHERE kind = 'state' AND (b.r IS NULL OR revision > b.r) GROUP BY item_id, k),
 pay AS (SELECT item_id, k, v FROM base WHERE bk = 'upsert' UNION ALL SELECT item_id, k, v FROM st), s AS (SELECT item_id, max(r) AS r FROM st GROUP BY item_id), p AS (SELECT item_id, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS payload FROM pay GROUP BY item_id)
 SELECT item_id, greatest(coalesce(b.r, 0), coalesce(s.r, 0)) AS revision, CASE WHEN b.bk IS NULL OR (b.bk = 'remove' AND s.r IS NOT NULL) THEN 'state' ELSE b.bk END AS kind, coalesce(payload, '') AS payload FROM base b FULL JOIN s USING (item_id) LEFT JOIN p USING (item_id)""")
def collapsed_changes(spark, d):
    """C2"""
    out = changes.collapse(change_view(spark, d), 50)
    return out.select("item_id", "revision", "kind", flat(F.col("payload")).alias("payload"))


@query("""WITH p AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 <> 0), c AS (SELECT p_partkey AS id, p_partkey % 3 AS m FROM part WHERE p_partkey % 7 <> 0)
 SELECT coalesce(p.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'remove' WHEN p.id IS NULL OR m = 1 THEN 'upsert' ELSE 'state' END AS kind FROM p FULL JOIN c USING (id) WHERE c.id IS NULL OR p.id IS NULL OR m > 0""")
def snapshot_diff(spark, d):
    """C1, E4"""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name")).alias("fields"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("state"))
    now = p.where("id % 7 <> 0")
    now = now.withColumn("fields", F.when(F.col("id") % 3 == 1, F.create_map(F.lit("name"), F.lit("new"))).otherwise(F.col("fields"))).withColumn("state", F.when(F.col("id") % 3 == 2, F.create_map(F.lit("size"), F.lit("0"))).otherwise(F.col("state")))
    return changes.diff(p.where("id % 5 <> 0"), now).select("id", "kind")


@query("WITH" + CHANGES + """, cur AS (SELECT DISTINCT user_id AS item_id FROM events WHERE user_id % 2 = 0), b AS (SELECT item_id, arg_max(kind, revision) AS bk, max(revision) AS r FROM changes WHERE kind <> 'state' GROUP BY item_id), s AS (SELECT DISTINCT c.item_id FROM changes c LEFT JOIN b USING (item_id) WHERE c.kind = 'state' AND (b.r IS NULL OR c.revision > b.r)),
 kinds AS (SELECT item_id, CASE WHEN bk IS NULL OR (bk = 'remove' AND s.item_id IS NOT NULL) THEN 'state' ELSE bk END AS kind FROM (SELECT DISTINCT item_id FROM changes) LEFT JOIN b USING (item_id) LEFT JOIN s USING (item_id)) SELECT item_id FROM kinds LEFT JOIN cur USING (item_id) WHERE kind = 'upsert' OR (kind = 'state' AND cur.item_id IS NOT NULL) UNION SELECT item_id FROM cur WHERE item_id NOT IN (SELECT item_id FROM kinds)""")
def applied_delta(spark, d):
    """C3, R3"""
    cur = table(spark, d, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("item_id")).distinct().withColumn("payload", F.create_map(F.lit("a"), F.lit("b")))
    return changes.apply_delta(cur, changes.collapse(change_view(spark, d), -1)).select("item_id")


@query("SELECT event_id AS revision, coalesce(last_value(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS found FROM events")
def stable_counters(spark, d):
    """C4"""
    e = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("run"), F.col("event_id").alias("revision"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("event_id")).alias("found"))
    return changes.stable_merge(e, ["found"]).select("revision", "found")


@query("SELECT event_id AS cursor, event_id < 99 AS needs_full FROM events WHERE event_id % 10 = 0")
def journal_gaps(spark, d):
    """C5"""
    e = table(spark, d, "events")
    return gap_view(e.where("event_id % 10 = 0"), e)


@query("SELECT event_id AS cursor, event_id < 99 AS needs_full FROM events")
def journal_gaps_whole(spark, d):
    """Every cursor"""
    e = table(spark, d, "events")
    return gap_view(e, e)


def gap_view(cursors, e):
    return changes.needs_full(cursors.select(F.col("event_id").alias("cursor")), e.where("event_id >= 100").select(F.col("event_id").alias("revision")))


@query("SELECT l_partkey AS url, max(l_linenumber) AS attempts, CASE WHEN bool_or(l_quantity > 45) THEN 'done' WHEN max(l_linenumber) <= 2 THEN 'retry' ELSE 'deferred' END AS plan FROM lineitem GROUP BY l_partkey")
def retry_plans(spark, d):
    """R5"""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("url"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity") > 45).alias("ok"), F.lit(False).alias("permanent"))
    return logs.retry_plan(li)


# --- entities


def donor_view(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    status = F.when(F.col("s_suppkey") % 11 == 0, "error").when(F.col("s_suppkey") % 13 == 0, "running").otherwise("completed")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("id"), F.col("n_nationkey").alias("brand_id"), F.col("n_name").alias("brand"), F.col("r_name").alias("group_name"), status.alias("status"), F.col("s_suppkey").alias("last_scan_at"), (F.col("s_suppkey") % 7).alias("new_count"), (F.col("s_suppkey") % 5).alias("found_count"), (F.col("s_suppkey") % 3).alias("failed_count"))


DONORS = """donors AS (SELECT s_suppkey AS id, n_nationkey AS brand_id, n_name AS brand, r_name AS group_name, CASE WHEN s_suppkey % 11 = 0 THEN 'error' WHEN s_suppkey % 13 = 0 THEN 'running' ELSE 'completed' END AS status,
 s_suppkey % 7 AS new_count, s_suppkey % 5 AS found_count, s_suppkey % 3 AS failed_count FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("SELECT s_suppkey AS id, n_name AS brand_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name, s_suppkey")
def donors_with_brand(spark, d):
    """J10"""
    brands = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return entities.donors_with_brand(donor_view(spark, d).select("id", "brand_id"), brands).select("id", "brand_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_customers(spark, d):
    """J11"""
    return entities.orphans(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def customers_without_fifths(spark, d):
    """Customers none of whose orders has a number divisible by five"""
    return entities.orphans(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderkey % 5 = 0"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT p_partkey AS id FROM part WHERE p_size > 25")
def removed_parts(spark, d):
    """Parts that a later snapshot, of the small ones, does not have"""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return changes.removed(p, p.where("p_size <= 25"))


@query("WITH " + DONORS + " SELECT n_nationkey AS brand_id, CASE WHEN EXISTS (SELECT 1 FROM donors d WHERE d.id = n_nationkey AND d.brand_id = n_nationkey) THEN n_nationkey ELSE (SELECT min(id) FROM donors d WHERE d.brand_id = n_nationkey) END AS donor_id FROM nation")
def primary_donors(spark, d):
    """J17"""
    brands = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("primary_id"))
    return entities.primary_donor(brands, donor_view(spark, d))


@query("WITH " + DONORS + " SELECT brand_id, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'error') THEN 'error' ELSE 'completed' END AS status, max(id) AS last_scan_at FROM donors GROUP BY brand_id")
def brand_states(spark, d):
    """G14"""
    return entities.brand_state(donor_view(spark, d))


@query("WITH " + DONORS + " SELECT group_name, brand, count(*) AS donors, bool_or(status = 'running') AS active, max(new_count) AS new_count, max(found_count) AS found_count, sum(failed_count)::BIGINT AS failed_count FROM donors GROUP BY group_name, brand")
def brand_cards(spark, d):
    """G15"""
    return entities.brand_cards(donor_view(spark, d))


@query("WITH " + DONORS + ", cards AS (SELECT brand, count(*) AS donors, bool_or(status = 'running') AS active, max(new_count) AS new_count FROM donors GROUP BY group_name, brand) SELECT count(*) AS brands, sum(donors)::BIGINT AS donors, count(*) FILTER (active) AS active, sum(new_count)::BIGINT AS new_count FROM cards")
def workspace_totals(spark, d):
    """G16"""
    return entities.workspace_totals(entities.brand_cards(donor_view(spark, d)))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def upserted(spark, d):
    """K7"""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return entities.upsert(c.where("id % 3 <> 0"), c.where("id % 2 = 0").withColumn("name", F.lit("new")), ["id"])


@query("SELECT o_orderkey AS id FROM (SELECT *, o_orderkey % 2 = 0 AS c, o_orderkey % 3 = 0 AS s, o_orderkey % 5 = 0 AS r FROM orders) WHERE CASE WHEN s THEN c AND r ELSE c OR r END")
def merged_membership(spark, d):
    """J18"""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return entities.merge_membership(o.where("id % 2 = 0"), o.where("id % 3 = 0"), o.where("id % 5 = 0"))


@query("WITH" + OFFERS + " SELECT source_model AS model_key, arg_max(price, row_id) AS price FROM offers GROUP BY source_model")
def known_products(spark, d):
    """E5"""
    o = offers(spark, d).select(F.col("source_model").alias("model_key"), "price", F.col("row_id").alias("run"))
    return entities.merge_known(o.where("run % 2 = 0"), o.where("run % 2 = 1")).select("model_key", "price")


@query("SELECT user_id AS source, event_id AS row FROM (SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id // 500 DESC) AS n FROM events) WHERE n <= 3")
def kept_snapshots(spark, d):
    """S13"""
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), F.floor(F.col("event_id") / 500).alias("snapshot"), F.floor(F.col("event_id") / 500).alias("created_at"), F.col("event_id").alias("row"))
    return feed_sources.latest_snapshots(e, 3).select("source", "row")


@query("SELECT count(*) FILTER (p_size % 5 IN (0, 1)) AS visited, count(*) FILTER (p_size % 5 = 1) AS results, count(*) FILTER (p_size % 5 = 2) AS skipped, count(*) FILTER (p_size % 5 = 3) AS failed, CAST(floor(count(*) FILTER (p_size % 5 < 4) * 100 / count(*)) AS INTEGER) AS percent FROM part")
def crawl_totals(spark, d):
    """G17"""
    s = F.element_at(F.array(*map(F.lit, ("visited", "result", "skipped", "failed", "queued"))), (F.col("p_size") % 5 + 1).cast("int"))
    return pages.crawl_totals(table(spark, d, "part").select(s.alias("status")))


# --- grids


def grid_view(spark, d):
    """A sheet for each type: a title row, a header whose columns change places, the parts."""
    p = table(spark, d, "part")
    sheet = F.ascii("p_type").cast("int")
    model = F.concat(F.lit("MX-"), "p_partkey", F.lit("/7 белый"))
    price = F.concat(F.floor("p_retailprice").cast("long"), F.lit(" руб"))
    turned = sheet % 2 == 0
    rows = p.select(F.lit("f").alias("file"), sheet.alias("sheet_index"), F.col("p_type").alias("sheet_name"), (F.col("p_partkey") + 3).cast("int").alias("row_number"), F.when(turned, F.array(price, model)).otherwise(F.array(model, price)).alias("cells"))
    sheets = rows.select("file", "sheet_index", "sheet_name").distinct()
    title = sheets.withColumn("row_number", F.lit(1)).withColumn("cells", F.array(F.lit("Прайс")))
    head = sheets.withColumn("row_number", F.lit(2)).withColumn("cells", F.when(F.col("sheet_index") % 2 == 0, F.array(F.lit(" ЦЕНА "), F.lit("Модель"))).otherwise(F.array(F.lit("Модель"), F.lit("Цена"))))
    return rows.unionByName(title).unionByName(head)


@query("SELECT ascii(p_type) AS sheet_index, CAST(p_partkey + 3 AS INTEGER) AS row_number, 'MX-' || p_partkey || '/7' AS model, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price, '1,1,' || CAST(floor(p_retailprice) AS BIGINT) || ',2026-08-05,2026-09-01' AS special FROM part")
def converted_prices(spark, d):
    """S6, F5, F26, F27, W4"""
    return jobs.convert_prices(grid_view(spark, d), "модель", "цена", "Цена", "2026-08-05", "2026-09-01").rows.drop("file")


@query("SELECT count(*) AS rows_written, count(DISTINCT ascii(p_type)) AS sheets_matched, 0::BIGINT AS sheets_skipped FROM part")
def conversion_totals(spark, d):
    """G4"""
    return jobs.convert_prices(grid_view(spark, d), "модель", "цена").totals


@query("SELECT CAST(p_partkey + 3 AS INTEGER) AS row_number, CASE WHEN ascii(p_type) % 2 = 0 THEN CAST(floor(p_retailprice) AS BIGINT) || ' руб' ELSE 'MX-' || p_partkey || '/7 белый' END AS source_model FROM part UNION ALL SELECT 2, CASE WHEN s % 2 = 0 THEN 'ЦЕНА' ELSE 'Модель' END FROM (SELECT DISTINCT p_type, ascii(p_type) AS s FROM part)")
def supplier_grid(spark, d):
    """S3, S7"""
    return grids.read_supplier_grid(grid_view(spark, d), {"model": "прайс"}).select("row_number", "source_model")


# --- attributes


def field_view(spark):
    return spark.createDataFrame([(1, "Основные", "Brand", "select", False), (2, "Основные", "Type", "select", True), (3, "Размеры", "Size", "number", False)], "field_id int, group_name string, name string, value_type string, is_composite boolean")


@query("""SELECT p_partkey AS product_id, f AS field_id, CASE f WHEN 1 THEN p_brand WHEN 2 THEN '' WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE 'x' END AS value, CASE WHEN f IS NULL THEN 'extra' WHEN f = 2 THEN 'missing' ELSE 'filled' END AS status FROM part, (SELECT unnest([1, 2, 3, NULL]) AS f)""")
def attribute_batch(spark, d):
    """J12, W5"""
    stack = F.concat(F.lit("Основные|BRAND|"), "p_brand", F.lit("\nРазмеры|size:|"), F.col("p_size").cast("string"), F.lit("\nа|other|x"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), stack.alias("stack"))
    return jobs.batch_from_csv(p, field_view(spark)).select("product_id", "field_id", F.col("current_value").alias("value"), "status")


RESOLVED = """cands AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey % 3 AS priority, 'v' || (l_suppkey % 2) AS value, CAST(80 + l_suppkey % 3 * 10 AS INTEGER) AS confidence FROM lineitem WHERE l_suppkey % 10 < 3)"""


@query("WITH " + RESOLVED + " SELECT product_id, CASE WHEN count(DISTINCT value) > 1 THEN 'conflict' WHEN arg_min(confidence, priority) >= 90 THEN 'approved' ELSE 'suggested' END AS status, CASE WHEN count(DISTINCT value) > 1 THEN '' ELSE min(value) END AS value, CASE WHEN count(DISTINCT value) > 1 THEN max(confidence) ELSE arg_min(confidence, priority) END AS confidence FROM cands GROUP BY product_id")
def resolved_values(spark, d):
    """G10"""
    return resolved_view(table(spark, d, "lineitem").where("l_suppkey % 10 < 3"))


RESOLVED_WHOLE = """cands AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey % 3 AS priority, 'v' || (l_suppkey % 2) AS value, CAST(80 + l_suppkey % 3 * 10 AS INTEGER) AS confidence FROM lineitem)"""


@query("WITH " + RESOLVED_WHOLE + " SELECT product_id, CASE WHEN count(DISTINCT value) > 1 THEN 'conflict' WHEN arg_min(confidence, priority) >= 90 THEN 'approved' ELSE 'suggested' END AS status, CASE WHEN count(DISTINCT value) > 1 THEN '' ELSE min(value) END AS value, CASE WHEN count(DISTINCT value) > 1 THEN max(confidence) ELSE arg_min(confidence, priority) END AS confidence FROM cands GROUP BY product_id")
def resolved_values_whole(spark, d):
    """Every lineitem"""
    return resolved_view(table(spark, d, "lineitem"))


def resolved_view(lines):
    li = lines.select(F.col("l_partkey").alias("product_id"), F.lit(1).alias("field_id"), (F.col("l_suppkey") % 3).alias("priority"), F.concat(F.lit("v"), F.col("l_suppkey") % 2).alias("value"), (F.lit(80) + F.col("l_suppkey") % 3 * 10).cast("int").alias("confidence"), F.lit(0).alias("pos"), F.lit("s").alias("source")).distinct()
    return attributes.resolve_candidates(li, True).select("product_id", "status", "value", "confidence")


@query("""SELECT p_partkey AS product_id, 1 AS field_id, 'approved' AS status, p_brand AS value, 98 AS confidence FROM part WHERE p_size <= 40 UNION ALL SELECT p_partkey, 3, 'approved', CAST(p_size AS VARCHAR), 96 FROM part""")
def filled_values(spark, d):
    """J13, J14, W7"""
    p = table(spark, d, "part")
    attrs = p.select(F.col("p_partkey").alias("product_id"), F.explode(F.array(F.struct(F.lit("Brand").alias("name"), F.when(F.col("p_size") > 40, "unheard of").otherwise(F.concat(F.lit("the "), "p_brand")).alias("value")), F.struct(F.lit("size макс").alias("name"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("zzz").alias("name"), F.lit("1").alias("value")))).alias("a")).select("product_id", "a.*", F.lit("site").alias("source"), F.lit(0).alias("priority"), F.lit(0).alias("pos"))
    brands = p.select(F.col("p_brand").alias("value")).distinct().withColumn("field_id", F.lit(1))
    allowed = brands.withColumn("normalized_value", values.attr_key(F.col("value")))
    synonyms = brands.withColumn("normalized_synonym", values.attr_key(F.concat(F.lit("the "), "value")))
    out = jobs.fill_from_sources(attrs, field_view(spark), allowed, synonyms, None, True, fuzzy=False).rows
    return out.select("product_id", "field_id", "status", "value", "confidence")


@query("SELECT 'site' AS source, (2 * count(*))::BIGINT AS mapped, count(*) AS unknown, 0::BIGINT AS ambiguous FROM part")
def mapping_report(spark, d):
    """G18"""
    p = table(spark, d, "part").select(F.explode(F.array(F.lit("Brand"), F.lit("Size"), F.lit("zzz"))).alias("name"), F.lit("site").alias("source"))
    mapped = staged(attributes.map_attributes(p, field_view(spark), fuzzy=False), "mapped-names")
    return attributes.mapping_report(p.join(match.small(mapped, attributes.MAX_DIMENSION), "name"))


VALUES = """vals AS (SELECT p_partkey AS product_id, CASE p_size % 4 WHEN 0 THEN 'filled' WHEN 1 THEN 'missing' WHEN 2 THEN 'suggested' ELSE 'extra' END AS status, p_partkey % 6 <> 0 AS t FROM part UNION ALL SELECT p_partkey, 'filled', true FROM part)"""


def value_view(spark, d):
    p = table(spark, d, "part")
    status = F.when(F.col("p_size") % 4 == 0, "filled").when(F.col("p_size") % 4 == 1, "missing").when(F.col("p_size") % 4 == 2, "suggested").otherwise("extra")
    one = p.select(F.col("p_partkey").alias("product_id"), F.lit(1).alias("field_id"), status.alias("status"), (F.col("p_partkey") % 6 != 0).alias("is_in_template"), F.col("p_type").alias("final_value"))
    two = p.select(F.col("p_partkey").alias("product_id"), F.lit(2).alias("field_id"), F.lit("filled").alias("status"), F.lit(True).alias("is_in_template"), F.lit("MX").alias("final_value"))
    return one.unionByName(two)


@query("WITH " + VALUES + ", s AS (SELECT product_id, bool_or(t AND status IN ('missing', 'suggested')) AS r FROM vals GROUP BY product_id) SELECT count(*) FILTER (t AND status = 'filled') AS values_filled, count(*) FILTER (t AND status = 'missing') AS values_missing, 0::BIGINT AS values_conflict, count(*) FILTER (t AND status = 'suggested') AS values_suggested, (SELECT count(*) FROM s WHERE NOT r) AS products_ready, (SELECT count(*) FROM s WHERE r) AS products_review FROM vals")
def batch_summary(spark, d):
    """G8"""
    return attributes.batch_summary(value_view(spark, d))


@query("WITH " + VALUES + " SELECT product_id, CASE WHEN bool_or(t AND status IN ('missing', 'suggested')) THEN 'review' ELSE 'ready' END AS status, count(*) FILTER (t AND status IN ('missing', 'suggested')) AS open_values FROM vals GROUP BY product_id")
def product_status(spark, d):
    """G9"""
    return attributes.product_status(value_view(spark, d))


@query("WITH " + VALUES + " SELECT product_id, CASE WHEN t AND status = 'suggested' THEN 'approved' WHEN t AND status = 'missing' THEN 'approved' ELSE status END AS status, CASE WHEN t AND status = 'suggested' THEN 'p' WHEN t AND status = 'missing' THEN '-' ELSE '' END AS final_value FROM vals")
def accepted_values(spark, d):
    """P10, W8"""
    v = value_view(spark, d).withColumns({"current_value": F.when(F.col("status") == "filled", "x").otherwise(""), "proposed_value": F.lit("p"), "final_value": F.lit("")})
    return attributes.accept_suggested(v, True).select("product_id", "status", "final_value")


@query("WITH " + VALUES + " SELECT product_id FROM vals WHERE t AND status <> 'filled'")
def open_values(spark, d):
    """P10: the template's values that the source file left blank"""
    v = value_view(spark, d).withColumn("current_value", F.when(F.col("status") == "filled", "x").otherwise(" ").cast("string"))
    return attributes.open_values(v.withColumn("current_value", F.trim("current_value"))).select("product_id")


@query("SELECT p_partkey AS product_id, '1|brand|' || p_brand || chr(10) || '1|size|' || p_size || chr(10) || 'z|extra|' || p_type AS stack FROM part")
def exported_stacks(spark, d):
    """K6"""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("product_id"), F.explode(F.array(F.struct(F.lit("z").alias("group_name"), F.lit("extra").alias("name"), F.col("p_type").alias("final_value"), F.lit(False).alias("is_in_template"), F.lit(0).alias("sort_order")), F.struct(F.lit("1").alias("group_name"), F.lit("size").alias("name"), F.col("p_size").cast("string").alias("final_value"), F.lit(True).alias("is_in_template"), F.lit(2).alias("sort_order")), F.struct(F.lit("1").alias("group_name"), F.lit("brand").alias("name"), F.col("p_brand").alias("final_value"), F.lit(True).alias("is_in_template"), F.lit(1).alias("sort_order")))).alias("v")).select("product_id", "v.*", F.lit(0).alias("id"), F.lit("filled").alias("status"), F.lit(None).cast("string").alias("current_value"))
    return attributes.export_attributes(rows)


@query("SELECT CAST(pos AS INTEGER) AS column_pos, CASE pos WHEN 0 THEN 'select' WHEN 1 THEN 'number' WHEN 2 THEN 'dimensions' ELSE 'select' END AS value_type, pos = 3 AS is_composite, CASE pos WHEN 0 THEN 'Brand' WHEN 1 THEN 'Size' WHEN 2 THEN 'Box' ELSE 'Mix' END AS name FROM (SELECT unnest([0, 1, 2, 3]) AS pos)")
def inferred_types(spark, d):
    """G12, A7, W9"""
    size = F.col("p_size").cast("string")
    cells = F.array(*[F.struct(F.lit(k).alias("column_pos"), F.lit(h).alias("header"), v.alias("value")) for k, (h, v) in enumerate((("Brand (a)", F.col("p_brand")), ("Size (a)", size), ("Box (b)", F.concat(size, F.lit(" x 3"))), ("Mix", F.concat_ws("/", "p_brand", "p_type"))))])
    rows = table(spark, d, "part").select(F.explode(cells).alias("c")).select("c.*")
    return attributes.import_template(rows).select(F.col("field_id").alias("column_pos"), "value_type", "is_composite", "name")


@query("WITH f AS (SELECT p_brand AS value, min(p_partkey) AS n FROM part GROUP BY p_brand) SELECT 1 AS field_id, value, CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS sort_order FROM f")
def dictionaries(spark, d):
    """G13"""
    cells = table(spark, d, "part").select(F.lit(1).alias("field_id"), F.col("p_partkey").alias("row_number"), F.col("p_brand").alias("value"))
    return attributes.build_dictionary(cells, field_view(spark)).select("field_id", "value", "sort_order")


@query("SELECT p_partkey AS product_id, 2 AS field_id, 'MX' AS value, 80 AS confidence FROM part")
def similar_values(spark, d):
    """G11"""
    v = value_view(spark, d)
    return attributes.similar_fill(v, v.where("field_id = 2"), field_view(spark))


@query("SELECT p_type AS category, CAST(CASE WHEN p_type = 'ECONOMY' THEN 7 END AS INTEGER) AS template_id FROM part GROUP BY p_type")
def matched_templates(spark, d):
    """J15"""
    t = spark.createDataFrame([(7, "Economy!"), (8, "none such")], "template_id int, name string")
    return attributes.match_template(table(spark, d, "part").select(F.col("p_type").alias("category")), t).select("category", "template_id")


@query("WITH" + OFFERS + " SELECT row_id AS product_id, (SELECT min(row_id) FROM offers q WHERE regexp_replace(q.source_model, '[-/]', '', 'g') = regexp_replace(o.source_model, '[-/]', '', 'g')) AS url FROM offers o")
def cached_urls(spark, d):
    """J16"""
    o = offers(spark, d)
    known = o.select(F.col("row_id").alias("url"), F.col("row_id").alias("pos"), F.lower("source_model").alias("model"), F.lit("").alias("sku"))
    return attributes.cached_url(o.select(F.col("row_id").alias("product_id"), F.regexp_replace("source_model", "-", " ").alias("model")), known)


@query("""SELECT p_partkey AS url, p_name AS name, 'M' || p_partkey AS model, p_brand AS brand, p_type AS category, CAST(CASE WHEN p_type = 'ECONOMY' THEN 7 END AS INTEGER) AS template_id FROM part""")
def page_batch(spark, d):
    """W6"""
    p = spread(table(spark, d, "part"), "p_partkey")
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category")))
    html = F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script><h1>"), "p_name", F.lit("</h1><dl><dt>Артикул</dt><dd>M"), "p_partkey", F.lit("</dd></dl>"))
    t = spark.createDataFrame([(7, "Economy!"), (8, "none such")], "template_id int, name string")
    return jobs.batch_from_pages(p.select(F.col("p_partkey").alias("url"), html.alias("html")), t, fuzzy=False).select("url", "name", "model", "brand", "category", "template_id")


@query("WITH" + OFFERS + " SELECT row_id AS url FROM offers WHERE row_id % 3 = 0")
def usable_pages(spark, d):
    """U18"""
    o = offers(spark, d)
    return pages.usable_pages(o.select(F.col("row_id").alias("url")), o.where("row_id % 3 = 0").select(F.col("row_id").alias("page_url"))).select("url")


# --- streams


@query("SELECT event_type AS level, count(*) AS n FROM events GROUP BY event_type")
def stream_log_counts(spark, d):
    """R1"""
    e = streams.file_stream(spark, d, "events.parquet")
    return streams.settled(streams.stream_log_counts(e.select(F.col("event_type").alias("level"))), "complete").select("level", "n")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS level, count(*) AS n FROM events GROUP BY ALL")
def stream_days(spark, d):
    """R2"""
    e = streams.file_stream(spark, d, "events.parquet").select(F.col("event_type").alias("level"), F.col("ts").alias("created_at"))
    return streams.settled(streams.log_counts_by_day(e), "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "level", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    """R4"""
    e = streams.file_stream(spark, d, "events.parquet").select("user_id", "event_type", "ts")
    return streams.settled(streams.first_seen(e, ["user_id", "event_type"], "ts", "3650 days"), "append").select("user_id", "event_type")
