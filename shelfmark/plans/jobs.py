"""The jobs: operators put together. They give tables, and writing them is up to the caller; W1 and W3 store the offers with their candidates in the shared folder, W10 the cards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.candidates import model_candidates
from shelfmark.functions.keys import fold_lookalikes, key_texts, product_keys
from shelfmark.functions.text import clean_text, let, prepare_model, text_of
from shelfmark.functions.values import parse_stack
from shelfmark.operators import attributes, dedupe, match, pages, report
from shelfmark.sources import grid as grids
from shelfmark.storage import spread, staged


@dataclass
class Result:
    rows: DataFrame
    totals: DataFrame


def not_excluded(model: Column, name: Column, brand: Column, patterns: list[str]) -> Column:
    """No pattern is part of 'model name brand', as it stands or with look-alike letters folded."""
    plain = F.concat_ws(" ", text_of(model), text_of(name), text_of(brand))
    low, folded = F.lower(plain), F.lower(fold_lookalikes(plain))
    bad: Column = F.lit(False)
    for p in (" ".join(p.split()) for p in patterns):
        if p:
            bad = bad | F.contains(low, F.lower(F.lit(p))) | F.contains(folded, F.lower(fold_lookalikes(F.lit(p))))
    return ~bad


def with_candidates(offers: DataFrame, rules: str = "", brands: DataFrame | None = None, from_name: bool = False) -> DataFrame:
    """offers with candidates: of the prepared model, or where it has none of the prepared name (from_name: of that only)."""
    if brands is not None:
        offers = match.detect_brand(offers.drop("detected_brand"), brands, "name", "brand")
    brand = F.col("detected_brand") if brands is not None else F.coalesce(F.nullif(clean_text(F.col("brand")), F.lit("")), F.lit(""))
    of_model = model_candidates(prepare_model(F.col("source_model"), rules, True), brand)
    of_name = model_candidates(prepare_model(F.col("name"), rules, True), brand)
    return offers.withColumn("candidates", of_name if from_name else let(of_model, lambda found: F.when(F.size(found) > 0, found).otherwise(of_name)))


def prepared(offers: DataFrame, rules: str, exclusions: list[str]) -> DataFrame:
    """offers with candidates, keys and kept, stored: the costly columns are computed once, by all cores, however many joins read them."""
    kept = not_excluded(F.col("source_model"), F.col("name"), F.col("brand"), exclusions)
    return staged(with_candidates(spread(offers, "row_id").withColumn("kept", kept), rules).withColumn("keys", _keys(F.col("candidates"))), "prepared-offers")


def _keys(candidates: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(candidates, key_texts)))


def compare_feeds(offers: DataFrame, feeds: DataFrame, feed_keys: DataFrame, exclusions: list[str] = (), rules: str = "") -> Result:
    """Supplier offers that are missing on own feeds. offers: row_id, supplier, row_number, source_model, name, price, brand, url; deduped and numbered before.

    rows: offers with candidates, selected_model and missing; totals by supplier and over all.
    """
    rows = prepared(offers, rules, list(exclusions))
    asked = rows.where(F.col("kept") & (F.size("candidates") > 0))
    missing = match.missing_feeds(asked, feeds, feed_keys)
    joined = rows.join(missing.hint("merge"), "row_id", "left")
    status = F.when(~F.col("kept"), "excluded").when(F.size("candidates") == 0, "no_model").when(F.col("missing").isNotNull(), "missing").otherwise("found")
    marked = joined.withColumn("status", status)
    out = marked.where("status = 'missing'").withColumn("selected_model", F.col("candidates")[0]).drop("keys", "kept", "status")
    return Result(out, report.comparison_totals(marked))


def import_file(rows: DataFrame, feeds: DataFrame, feed_keys: DataFrame, exclusions: list[str] = (), rules: str = "") -> Result:
    """Rows of a price file that are missing on own feeds, and totals. rows: row_id, source_model, name, price, brand; feed_keys: source, key, item.

    selected_model is the candidate that matched best somewhere, else the first one.
    """
    own = prepared(rows, rules, list(exclusions))
    asked = own.where(F.col("kept") & (F.size("candidates") > 0))
    best = match.best_match(asked, feed_keys, feeds).select("row_id", F.col("candidate").alias("_best"), "reason")
    joined = own.join(match.missing_feeds(asked, feeds, feed_keys).hint("merge"), "row_id", "left").join(best.hint("merge"), "row_id", "left")
    status = F.when(~F.col("kept"), "excluded").when(F.size("candidates") == 0, "no_model").when(F.col("missing").isNotNull(), "missing").otherwise("found")
    marked = joined.withColumn("status", status)
    out = marked.where("status = 'missing'").withColumn("selected_model", F.coalesce("_best", F.col("candidates")[0])).drop("keys", "kept", "status", "_best")
    return Result(out, report.import_totals(marked))


def convert_prices(grid: DataFrame, model_field: str, price_field: str, promo_field: str = "", promo_start: str = "", promo_end: str = "", sheet: int | None = None) -> Result:
    rows = grids.convert_prices(grid, model_field, price_field, promo_field, promo_start, promo_end, sheet)
    return Result(rows, report.conversion_totals(rows, grid if sheet is None else grid.where(F.col("sheet_index") == sheet)))


def scan_new_products(products: DataFrame, details: DataFrame, feeds: DataFrame, feed_keys: DataFrame, availability_rules: list[str] = ()) -> Result:
    """Donor products new to us with what they miss, and counts by feed."""
    ok = pages.availability_ok(F.col("availability"), list(availability_rules))
    rows = match.new_products(products, details, feeds, feed_keys, ok)
    return Result(rows, report.missing_summary(rows, feeds))


def scan_partial(products: DataFrame, feeds: DataFrame, feed_keys: DataFrame) -> DataFrame:
    """The same from the listing alone: pos, url, model, price, missing, deduped."""
    keyed = products.withColumn("keys", product_keys(F.col("model"), F.lit(""))).withColumn("row_id", F.col("pos"))
    missing = match.missing_feeds(keyed, feeds, feed_keys, no_keys="none")
    return dedupe.dedupe_news(keyed.join(missing.hint("merge"), "row_id").drop("row_id", "keys"))


def crawl_result(stored: DataFrame, listing: pages.PageRules, detail: pages.PageRules) -> DataFrame:
    """url, model, price of the products of stored pages (url, html): cards of listings, and pages of their own, the listing's price carried over. The cards are stored once."""
    usable = stored.where(~pages.is_blocked(F.col("html")))
    cards = staged(pages.extract_listing(usable, listing), "cards")  # read three times
    # a page that lists products is no product page
    rest = usable.join(cards.select(F.col("page_url").alias("url")).hint("merge"), "url", "left_anti")
    single = pages.extract_detail(pages.with_listing_price(rest, cards), detail)
    both = cards.select("page_url", "pos", "url", "model", "price").unionByName(single.select(F.col("url").alias("page_url"), F.lit(0).alias("pos"), "url", "model", "price"))
    ordered = both.withColumn("pos", F.struct("page_url", "pos"))
    return dedupe.dedupe_products(ordered).select("url", "model", "price")


def batch_from_csv(products: DataFrame, fields: DataFrame) -> DataFrame:
    """Attribute values of products (product_id, stack): stack rows met with the template's fields; status filled, missing or extra."""
    stack = products.select("product_id", F.explode(parse_stack(F.col("stack"))).alias("s")).select("product_id", "s.*")
    rows = attributes.match_fields(stack, fields)
    status = F.when(~F.col("in_template"), "extra").when(F.col("value") != "", "filled").otherwise("missing")
    return rows.select("product_id", "field_id", "group_name", "name", F.col("value").alias("current_value"), F.col("in_template").alias("is_in_template"), status.alias("status"))


def batch_from_pages(stored: DataFrame, templates: DataFrame, fuzzy: bool = True) -> DataFrame:
    """url, name, model, brand, category, template_id of stored product pages: structured data, the last of its products that says a field, then the page's own heading, pairs and breadcrumbs."""
    out = staged(pages.page_product(stored).drop("attributes"), "page-products")
    # categories may be few: by a shuffle all pages of one would be a task
    found = staged(attributes.match_template(out, templates, fuzzy), "templates")
    return out.join(match.small(found, attributes.MAX_DIMENSION), "category", "left").drop("score")


def fill_from_sources(attrs: DataFrame, fields: DataFrame, allowed: DataFrame, synonyms: DataFrame, rules: DataFrame | None = None, auto: bool = False, fuzzy: bool = True) -> Result:
    """Proposed values from source attributes (product_id, name, value, source, priority, pos), and the mapping report by source.

    Confidence is the lesser of the field's and the value's.
    """
    # names, and values of a field, may be few: by a shuffle all rows of one would be a task
    mapped = staged(attributes.map_attributes(attrs, fields, rules, fuzzy), "mapped-names")
    named = attrs.join(match.small(mapped, attributes.MAX_DIMENSION), "name")
    values = attributes.map_values(named.where("field_id is not null"), fields, allowed, synonyms, fuzzy).select("field_id", "value", "mapped", F.col("confidence").alias("_c"))
    values = staged(values, "mapped-values")
    good = named.join(match.small(values, attributes.MAX_DIMENSION), ["field_id", "value"]).where("mapped is not null")
    cands = good.select("product_id", "field_id", F.col("mapped").alias("value"), "source", "priority", F.least("confidence", "_c").alias("confidence"), "pos")
    return Result(attributes.resolve_candidates(cands, auto), attributes.mapping_report(named))
