"""Stored web pages: links, products, names, attributes, and what to read next.

Rules are patterns, not selectors: a card begins where card_open matches and runs to the next card.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.candidates import finalize_model
from shelfmark.functions.text import PRICE, between_markers, clean_text, extract_prices, let, price_display, strip_tags, text_of, unescape, unescape_each
from shelfmark.functions.urls import canonical_product_url, normalize_url, product_url_ok, should_follow, url_excluded
from shelfmark.functions.values import attr_key
from shelfmark.operators.dedupe import first_by
from shelfmark.operators.structured import page_facts

# Fixed values
BLOCK_WORDS = ("cloudflare", "captcha", "access denied", "http 403", "__qrator", "qauth.js", "qrator", "доступ ограничен", "проверяем ваш браузер", "enable javascript")
STATUSES = ("В наличии", "Нет в наличии", "Под заказ", "Ожидается", "Сообщить о поступлении", "available", "out of stock", "in stock")


@dataclass(frozen=True)
class PageRules:
    """Patterns have one group for the value; blank ones are not used."""

    card_open: str = ""
    url: str = ""
    model: str = ""
    price: str = ""
    model_start: str = ""
    model_end: str = ""
    model_replace: str = ""
    name: str = ""
    availability: str = ""
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())


def plain_text(c: Column) -> Column:
    """The text of a piece of HTML: tags off first, so that a reference to '<' makes no tag."""
    return clean_text(unescape(strip_tags(c)))


def _value(html: Column, pattern: str) -> Column:
    return plain_text(F.regexp_extract(html, pattern, 1)) if pattern else F.lit("")


def visible_text(html: Column) -> Column:
    return strip_tags(F.regexp_replace(text_of(html), r"(?is)<(script|style)\b.*?</\1\s*>", " "))


def link_count(html: Column) -> Column:
    return F.regexp_count(text_of(html), F.lit(r"(?i)<a\s[^>]*href\s*="))


def is_blocked(html: Column) -> Column:
    """A block page or a nearly empty shell: a price in it clears it; block words with little text or few links; else very little of both."""
    words = F.lower(text_of(html)).rlike("|".join(BLOCK_WORDS))
    judged = let(F.struct(F.length(visible_text(html)).alias("text"), link_count(html).alias("links")), lambda n: F.when(words, (n["text"] < 1200) | (n["links"] < 10)).otherwise((n["text"] < 250) & (n["links"] < 5)))
    return ~text_of(html).rlike(PRICE) & judged


def extract_links(pages: DataFrame) -> DataFrame:
    """url, link: the distinct normalised links of each page."""
    hrefs = F.regexp_extract_all("html", F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"']"), 1)
    links = F.transform(unescape_each(hrefs), lambda h: normalize_url(h, F.col("url")))
    return pages.select("url", F.explode(F.array_distinct(F.filter(links, lambda x: x.isNotNull()))).alias("link"))


def _model(html: Column, rules: PageRules, preserve: bool = True) -> Column:
    raw = _value(html, rules.model)
    if rules.model_start or rules.model_end:
        raw = F.coalesce(F.nullif(between_markers(html, rules.model_start, rules.model_end), F.lit("")), raw)
    return finalize_model(raw, rules.model_replace, preserve)


def extract_listing(pages: DataFrame, rules: PageRules) -> DataFrame:
    """page_url, pos, url, model, price of the cards of each page; cards without model or price are left out.

    Within a page the first card of each url counts, or of each model for cards without one.
    """
    if not rules.card_open:
        return pages.sparkSession.createDataFrame([], "page_url string, pos int, url string, model string, price string")
    parts = F.split(F.col("html"), f"(?={rules.card_open})")
    cards = pages.select(F.col("url").alias("page_url"), F.posexplode(F.filter(parts, lambda p: p.rlike(f"^(?:{rules.card_open})"))).alias("pos", "card"))
    card = F.col("card")
    link = F.coalesce(canonical_product_url(normalize_url(unescape(F.regexp_extract(card, rules.url, 1)), F.col("page_url"))), F.lit("")) if rules.url else F.lit("")
    found = let(_value(card, rules.price), lambda price: F.coalesce(F.get(extract_prices(price), F.lit(0)), price_display(price)))
    # one struct, exploded, so that the filter below does not take the expressions apart again
    made = F.struct(link.alias("url"), _model(card, rules).alias("model"), found.alias("price"))
    rows = cards.select("page_url", "pos", F.explode_outer(F.array(made)).alias("c")).select("page_url", "pos", "c.*")
    rows = rows.where((F.col("model") != "") & (F.col("price") != "") & ((F.col("url") == "") | product_url_ok(F.col("url"), rules.include, rules.exclude)))
    key = F.when(F.col("url") != "", F.concat(F.lit("u"), "url")).otherwise(F.concat(F.lit("m"), F.lower("model")))
    return first_by(rows, [F.col("page_url"), key], [F.col("pos")])


def extract_detail(pages: DataFrame, rules: PageRules, allow_empty_price: bool = False) -> DataFrame:
    """url, model, price of product pages (url, html, fallback_price): the last price in the price field, else the field as a price, else the fallback."""
    html = F.col("html")
    fallback = F.col("fallback_price") if "fallback_price" in pages.columns else F.lit("")
    last = lambda price: let(extract_prices(price), lambda p: F.when(F.size(p) > 0, F.element_at(p, -1)))
    found = let(_value(html, rules.price), lambda price: F.coalesce(last(price), price_display(F.when(price != "", price).otherwise(text_of(fallback)))))
    made = F.struct("url", _model(html, rules).alias("model"), found.alias("price"))
    rows = pages.select(F.explode_outer(F.array(made)).alias("p")).select("p.*")
    return has_model_price(rows, allow_empty_price)


def has_model_price(rows: DataFrame, allow_empty_price: bool = False) -> DataFrame:
    return rows.where((text_of(F.col("model")) != "") & ((text_of(F.col("price")) != "") | F.lit(allow_empty_price)))


def with_listing_price(details: DataFrame, listing: DataFrame) -> DataFrame:
    """details with fallback_price: the last listing price (by page and position) of their canonical url."""
    last = listing.where("url <> ''").groupBy(canonical_product_url(F.col("url")).alias("_c")).agg(F.max_by("price", F.struct("page_url", "pos")).alias("fallback_price"))
    return details.withColumn("_c", canonical_product_url(F.col("url"))).join(last.hint("merge"), "_c", "left").drop("_c")


def extract_name(html: Column, rules: PageRules = PageRules()) -> Column:
    """By pattern, social title, first heading."""
    # the attributes may come in any order
    social = r"""(?:property|name)\s*=\s*["'](?:og|twitter):title["']"""
    content = r"""content\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    tag = F.regexp_extract(text_of(html), rf"(?is)(<meta(?=[^>]*{social})(?=[^>]*{content})[^>]*>)", 1)
    meta = clean_text(unescape(let(tag, lambda t: F.concat(F.regexp_extract(t, f"(?is){content}", 1), F.regexp_extract(t, f"(?is){content}", 2)))))
    tries = [_value(html, rules.name), meta, _value(html, r"(?is)<h1[^>]*>(.*?)</h1>")]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit(""))


def extract_availability(html: Column, rules: PageRules = PageRules()) -> Column:
    """By pattern, else the first known phrase, in the order of the list, that the page shows."""
    text = visible_text(html)
    tries = [_value(html, rules.availability)] + [F.regexp_extract(text, f"(?iu)({p})", 1) for p in STATUSES]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit(""))


def availability_ok(status: Column, rules: list[str]) -> Column:
    """Not excluded: no rule is part of the status; a blank status is fine."""
    own, bad = F.lower(clean_text(status)), F.lit(False)
    for r in rules:
        if r.strip():
            bad = bad | F.contains(own, F.lower(clean_text(F.lit(r))))
    return ~bad


# Fixed values
MODEL_NAMES = ("модель", "код модели", "артикул", "sku")


def with_facts(pages: DataFrame) -> DataFrame:
    """pages with facts, what their structured data says; where a caller has asked for it already, as it is."""
    return pages if "facts" in pages.columns else pages.withColumn("facts", page_facts(F.col("html")))


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """url, pos, name, model, brand, category, properties of the JSON-LD products of each page."""
    return with_facts(pages).select("url", F.posexplode("facts.products").alias("pos", "p")).select("url", "pos", "p.*")


def extract_pairs(pages: DataFrame) -> DataFrame:
    """url, pos, name, value: first and last cell of table rows of two cells or more, and dt with dd, unless a product or an earlier pair of the page has the same."""
    return with_facts(pages).select("url", F.posexplode("facts.pairs").alias("pos", "p")).select("url", "pos", "p.*")


def page_product(pages: DataFrame) -> DataFrame:
    """url, name, model, brand, category, attributes of each page: of its products the last field that says anything, else the heading, the first pair whose
    name says model, and the breadcrumbs; attributes are the products' properties, then the pairs."""
    p = F.col("facts.products")
    last = lambda name: F.coalesce(F.get(F.reverse(F.filter(F.transform(p, lambda x: x[name]), lambda v: v != "")), F.lit(0)), F.lit(""))
    attributes = F.concat(F.flatten(F.transform(p, lambda x: x["properties"])), F.col("facts.pairs"))
    model = F.get(F.filter(attributes, lambda x: attr_key(x["name"]).isin(*MODEL_NAMES)), F.lit(0))["value"]
    or_else = lambda name, other: F.coalesce(F.nullif(last(name), F.lit("")), other, F.lit("")).alias(name)
    fields = or_else("name", F.col("facts.heading")), or_else("model", model), last("brand").alias("brand"), or_else("category", F.array_join("facts.crumbs", " > "))
    return with_facts(pages).select("url", *fields, attributes.alias("attributes"))


def page_fallbacks(pages: DataFrame) -> DataFrame:
    """url, model (of the first pair whose name says so) and category (breadcrumb texts, distinct, joined by ' > ')."""
    model = F.get(F.filter("facts.pairs", lambda x: attr_key(x["name"]).isin(*MODEL_NAMES)), F.lit(0))["value"]
    return with_facts(pages).select("url", F.array_join("facts.crumbs", " > ").alias("category"), model.alias("model"))


def usable_pages(pages: DataFrame, products: DataFrame, url: str = "page_url") -> DataFrame:
    """Pages from which at least one product came."""
    return pages.join(products.select(F.col(url).alias("url")).hint("merge"), "url", "left_semi")


def next_frontier(links: DataFrame, visited: DataFrame, results: DataFrame, starts: list[str], excluded: list[str] = ()) -> DataFrame:
    """link: distinct links that may be followed and were neither visited nor are results already."""
    allowed = links.select("link").where(should_follow(F.col("link"), starts) & ~url_excluded(F.col("link"), list(excluded))).distinct()
    return allowed.join(visited.select(F.col("url").alias("link")).hint("merge"), "link", "left_anti").join(results.select(F.col("url").alias("link")).hint("merge"), "link", "left_anti")


def crawl_totals(urls: DataFrame) -> DataFrame:
    """Counts over urls (status: visited, result, skipped, failed, queued) and the percentage that is done."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    done = n("visited", "result", "skipped", "failed")
    return urls.agg(n("visited", "result").alias("visited"), n("result").alias("results"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.coalesce(F.floor(done * 100 / F.nullif(F.count(F.lit(1)), F.lit(0))), F.lit(0)).cast("int").alias("percent"))
