"""Attribute templates, mapping of names and values, and the choice between sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import clean_text, text_of
from shelfmark.functions.values import DIMENSIONS, NUMBER, attr_key, attr_model, name_tokens, norm_value, split_header
from shelfmark.operators import fuzzy as fuzzy_ops
from shelfmark.operators.dedupe import first_by, top_k_per
from shelfmark.operators.match import small
from shelfmark.storage import staged

# Fixed thresholds
FIELD, MARGIN, SURE, VALUE, TEMPLATE = 0.74, 0.06, 0.94, 0.88, 0.82
#: Most fields of a template that are broadcast.
MAX_DIMENSION = 50_000


def open_values(values: DataFrame) -> DataFrame:
    """Values that may be changed: in the template and not filled in the source file."""
    return values.where((text_of(F.col("current_value")) == "") & F.col("is_in_template"))


def beside(reference: DataFrame, entry: Column, key: str) -> list[Column]:
    """A reference table as scalar values, arrays of at most MAX_DIMENSION entries: one, or several by hash of key."""
    blocks = -(-reference.count() // MAX_DIMENSION) or 1
    block = F.pmod(F.xxhash64(key), F.lit(2 * blocks))  # half full on average
    parts = [reference] if blocks == 1 else [reference.where(block == b) for b in range(2 * blocks)]
    return [part.agg(F.array_sort(F.collect_list(entry))).scalar() for part in parts]


def against(rows: DataFrame, reference: DataFrame, entry: Column, key: str) -> DataFrame:
    """Every row with every entry of a reference table (column e): the fields of a template, the templates. The table is laid beside the rows as a
    value of at most MAX_DIMENSION entries; a larger one in several such values, by hash of key."""
    return reduce(DataFrame.unionAll, [rows.select("*", F.explode(value).alias("e")) for value in beside(reference, entry, key)])


def match_fields(stack: DataFrame, fields: DataFrame) -> DataFrame:
    """product_id, field_id, group_name, name, value, in_template: stack rows (product_id, pos, group_name, name, value) met with fields by name,
    and by group too where several fields have the name. The first row takes a field; others are extras; fields without a row come with a blank value."""
    many = F.count(F.lit(1)).over(Window.partitionBy("_n"))
    known = fields.select("field_id", F.col("group_name").alias("_group"), F.col("name").alias("_name"), attr_key(F.col("name")).alias("_n"), attr_key(F.col("group_name")).alias("_g")).withColumn("_many", many)
    rows = stack.withColumn("_n", attr_key(F.col("name"))).withColumn("_rg", attr_key(F.col("group_name")))
    hit = rows.join(small(known, MAX_DIMENSION), "_n").where((F.col("_many") == 1) | (F.col("_rg") == F.col("_g")))
    taken = first_by(hit.select("product_id", "pos", "field_id", "_group", "_name", "value"), [F.col("product_id"), F.col("field_id")], [F.col("pos")])
    used = taken.select("product_id", "pos")
    extras = stack.join(used.hint("merge"), ["product_id", "pos"], "left_anti").select("product_id", F.lit(None).cast("int").alias("field_id"), "group_name", "name", "value", F.lit(False).alias("in_template"))
    per_product = against(stack.select("product_id").distinct(), fields, F.struct("field_id", "group_name", "name"), "field_id").select("product_id", "e.*")
    filled = per_product.join(taken.select("product_id", "field_id", "value").hint("merge"), ["product_id", "field_id"], "left")
    return filled.select("product_id", "field_id", "group_name", "name", F.coalesce("value", F.lit("")).alias("value"), F.lit(True).alias("in_template")).unionByName(extras)


def best_fields(attrs: DataFrame, fields: DataFrame, k: int, fuzzy: bool = True) -> DataFrame:
    """name, rank (from 1), field_id, score of the k best fields of every distinct source name; ties by field_id. fuzzy off: only equal names and contained words score.

    The fields are those of one template, laid beside the names as a value of at most MAX_DIMENSION; a larger reference table in several such values.
    """
    # stored: else the test that a name has best fields goes below the distinct, and they are looked for in every row
    names = staged(attrs.select("name").where("name is not null").distinct(), "names")
    entries = fields.select(F.col("field_id").alias("id"), attr_key(F.col("name")).alias("key"), name_tokens(F.col("name")).alias("tokens"))
    found = [fuzzy_ops.best_entries(names, value, k, fuzzy) for value in beside(entries, F.struct("id", "key", "tokens"), "id")]
    rows = reduce(DataFrame.unionAll, [f.select("name", F.posexplode("best").alias("at", "b")) for f in found]).select("name", "at", F.col("b.id").cast(fields.schema["field_id"].dataType).alias("field_id"), "b.score")
    if len(found) == 1:
        return rows.select("name", (F.col("at") + 1).alias("rank"), "field_id", "score")
    return top_k_per(rows.drop("at"), ["name"], "score", k, "field_id").select("name", "rank", "field_id", "score")


def map_attributes(attrs: DataFrame, fields: DataFrame, rules: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """name, field_id (null if none), confidence, status (rule, mapped, ambiguous, unknown) for every distinct source name.

    A saved rule (normalized_name, field_id) wins; else the best field, if its score is high enough and clear of the second.
    Only the reference table of fields of one template stands on the right of the comparison, never data with data.
    """
    two = best_fields(attrs, fields, 2, fuzzy).groupBy("name").agg(F.min_by("field_id", "rank").alias("field_id"), F.max("score").alias("score"), F.min(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    status = F.when(F.col("score") < FIELD, "unknown").when(F.col("second").isNotNull() & (F.col("score") - F.col("second") < MARGIN) & (F.col("score") < SURE), "ambiguous").otherwise("mapped")
    best = two.select("name", "field_id", F.bround(F.col("score") * 100).cast("int").alias("confidence"), status.alias("status"))
    names = attrs.select("name").distinct().join(best.hint("merge"), "name", "left")
    if rules is not None:
        names = names.withColumn("_k", attr_key(F.col("name"))).join(rules.select(F.col("normalized_name").alias("_k"), F.col("field_id").alias("_rule")), "_k", "left").drop("_k")
    else:
        names = names.withColumn("_rule", F.lit(None).cast("int"))
    ruled = F.col("_rule").isNotNull()
    status = F.when(ruled, "rule").otherwise(F.coalesce("status", F.lit("unknown")))
    return names.select("name", F.when(ruled, F.col("_rule")).when(F.col("status") == "mapped", F.col("field_id")).alias("field_id"), F.when(ruled, 100).otherwise(F.coalesce("confidence", F.lit(0))).alias("confidence"), status.alias("status"))


def map_values(values: DataFrame, fields: DataFrame, allowed: DataFrame, synonyms: DataFrame, fuzzy: bool = True) -> DataFrame:
    """field_id, value, mapped (null if none), confidence for distinct (field_id, value).

    By dictionary: equal 100, synonym 98, alike from 0.88; numbers and dimensions of a field without a dictionary 96 for their
    form. A composite value maps if all of its parts do, with their least confidence.
    """
    has = allowed.select("field_id").distinct().withColumn("_has", F.lit(True))
    own = staged(values.select("field_id", "value").distinct(), "values").join(fields.select("field_id", "value_type", "is_composite"), "field_id").join(has, "field_id", "left")
    normal = norm_value(F.col("value"), F.col("value_type"))
    single = F.array(normal)
    many = F.filter(F.transform(F.split("value", "/"), clean_text), lambda p: p != "")
    parts = own.withColumn("part", F.explode(F.when(F.col("is_composite"), many).otherwise(single))).withColumn("_k", attr_key(F.col("part")))
    words = allowed.select("field_id", F.col("normalized_value").alias("_k"), F.col("value").alias("_exact"))
    other = synonyms.select("field_id", F.col("normalized_synonym").alias("_k"), F.col("value").alias("_synonym"))
    joined = parts.join(first_by(words, [F.col("field_id"), F.col("_k")], [F.col("_exact")]).hint("merge"), ["field_id", "_k"], "left").join(first_by(other, [F.col("field_id"), F.col("_k")], [F.col("_synonym")]).hint("merge"), ["field_id", "_k"], "left")
    form = F.col("value_type").isin("number", "dimensions") & F.col("_has").isNull()
    known = F.when(form, F.col("part")).otherwise(F.coalesce("_exact", "_synonym"))
    score = F.when(form & F.col("part").isNotNull(), 96).when(F.col("_exact").isNotNull(), 100).when(F.col("_synonym").isNotNull(), 98)
    joined = joined.withColumn("_value", known).withColumn("_score", score)
    if fuzzy:
        rest = joined.where("_score is null and part is not null").select("field_id", F.col("_k").alias("text"))
        near = fuzzy_ops.alike(rest, words.withColumnRenamed("_k", "text"), ["field_id"], VALUE).select("field_id", F.col("a").alias("_k"), F.col("b").alias("_w"), F.col("ratio").alias("_ratio"))
        near = near.join(words.withColumnRenamed("_k", "_w").hint("shuffle_hash"), ["field_id", "_w"])
        near = near.groupBy("field_id", "_k").agg(F.max(F.struct("_ratio", "_exact")).alias("b")).select("field_id", "_k", F.col("b._exact").alias("_near"), F.bround(F.col("b._ratio") * 100).cast("int").alias("_near_score"))
        joined = joined.join(near.hint("merge"), ["field_id", "_k"], "left").withColumn("_value", F.coalesce("_value", "_near")).withColumn("_score", F.coalesce("_score", "_near_score"))
    grouped = joined.groupBy("field_id", "value").agg(F.bool_and(F.col("_score").isNotNull()).alias("ok"), F.min("_score").alias("s"), F.collect_set("_value").alias("parts"))
    text = F.array_join(F.transform(F.array_sort(F.transform("parts", lambda p: F.struct(F.lower(p).alias("k"), p.alias("p")))), lambda x: x["p"]), "/")
    return grouped.select("field_id", "value", F.when(F.col("ok"), text).alias("mapped"), F.when(F.col("ok"), F.col("s")).otherwise(0).cast("int").alias("confidence"))


def match_template(pages: DataFrame, templates: DataFrame, fuzzy: bool = True) -> DataFrame:
    """category, template_id, score for distinct categories: equal keys, else the likest name from 0.82; null if none is."""
    cats = pages.select("category").distinct().withColumn("_k", attr_key(F.col("category")))
    names = templates.select("template_id", attr_key(F.col("name")).alias("_t"))
    exact = cats.join(names.groupBy(F.col("_t").alias("_k")).agg(F.min("template_id").alias("_exact")), "_k", "left")
    out = exact.withColumn("template_id", F.col("_exact")).withColumn("score", F.when(F.col("_exact").isNotNull(), 1.0))
    if fuzzy:
        rest, own = exact.where("_exact is null").select(F.col("_k").alias("text")), names.select(F.col("_t").alias("text"))
        pairs = fuzzy_ops.alike(rest, own, [], TEMPLATE).select(F.col("a").alias("_k"), F.col("b").alias("_t"), F.col("ratio").alias("r"))
        pairs = pairs.join(names.hint("shuffle_hash"), "_t")
        near = pairs.groupBy("_k").agg(F.max_by("template_id", F.struct("r", -F.col("template_id"))).alias("_near"), F.max("r").alias("_r"))
        out = out.join(near.hint("merge"), "_k", "left").withColumn("template_id", F.coalesce("template_id", "_near")).withColumn("score", F.coalesce("score", "_r"))
    return out.select("category", "template_id", "score")


def cached_url(products: DataFrame, known: DataFrame, fields: tuple[str, ...] = ("model", "vendor_code", "sku", "name")) -> DataFrame:
    """product_id, url of the first known page (by pos) one of whose candidate fields is the product's model."""
    keys = known.select("url", "pos", F.explode(F.array_distinct(F.array(*[attr_model(F.col(f)) for f in fields if f in known.columns]))).alias("_m")).where("_m <> ''")
    first = keys.groupBy("_m").agg(F.min_by("url", "pos").alias("url"))
    return products.select("product_id", attr_model(F.col("model")).alias("_m")).join(first.hint("merge"), "_m").select("product_id", "url")


def resolve_candidates(cands: DataFrame, auto: bool = False) -> DataFrame:
    """product_id, field_id, status, value, source, confidence from candidates (value, source, priority, confidence, pos).

    Different values are a conflict, without a value and with the greatest confidence; else the lowest priority, then the
    highest confidence, decides. With auto, 90 and more is approved at once. Status: conflict, approved or suggested.
    """
    best = F.min_by(F.struct("value", "source", "confidence"), F.struct("priority", -F.col("confidence"), "pos"))
    g = cands.groupBy("product_id", "field_id").agg(F.count_distinct(F.nullif(attr_key(F.col("value")), F.lit(""))).alias("n"), F.max("confidence").alias("top"), best.alias("b"))
    clash = F.col("n") > 1
    status = F.when(clash, "conflict").when(F.lit(auto) & (F.col("b.confidence") >= 90), "approved").otherwise("suggested")
    return g.select("product_id", "field_id", status.alias("status"), F.when(clash, "").otherwise(F.col("b.value")).alias("value"), F.when(clash, "").otherwise(F.col("b.source")).alias("source"), F.when(clash, F.col("top")).otherwise(F.col("b.confidence")).alias("confidence"))


def batch_summary(values: DataFrame) -> DataFrame:
    """Products ready and to review, and values filled, missing, in conflict, suggested; only values of the template count."""
    own = values.where("is_in_template")
    per = product_status(values).agg(F.count_if(F.col("status") == "ready").alias("products_ready"), F.count_if(F.col("status") == "review").alias("products_review"))
    n = lambda s: F.count_if(F.col("status") == s).alias(f"values_{s}")
    counts = own.agg(n("filled"), n("missing"), n("conflict"), n("suggested"))
    return counts.select("*", *[per.select(c).scalar().alias(c) for c in per.columns])


def product_status(values: DataFrame) -> DataFrame:
    """product_id, status (review while a value of the template is open), open_values. Open: missing, in conflict, suggested, unknown, ambiguous, or without a final value."""
    is_open = F.col("is_in_template") & (F.col("status").isin("missing", "suggested", "conflict", "unknown", "ambiguous") | (text_of(F.col("final_value")) == ""))
    return values.groupBy("product_id").agg(F.when(F.bool_or(is_open), "review").otherwise("ready").alias("status"), F.count_if(is_open).alias("open_values"))


def batch_totals(values: DataFrame) -> DataFrame:
    """products, ready, needs_review; of the template's values those filled (a final value other than a dash) and missing (none); conflicts and suggestions of all values."""
    final, own = text_of(F.col("final_value")), F.col("is_in_template")
    per = product_status(values).agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") != "ready").alias("needs_review"))
    counts = values.agg(
        F.count_if(own & (final != "") & (final != "-")).alias("filled"), F.count_if(own & (final == "")).alias("missing"),
        F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(F.col("status") == "suggested").alias("suggestions"),
    )
    return counts.select(*[per.select(c).scalar().alias(c) for c in per.columns], "*")


def alternatives(attrs: DataFrame, fields: DataFrame, fuzzy: bool = True, k: int = 4) -> DataFrame:
    """name, rank (from 1), field_id, score (0 to 100): the k best fields of every distinct source name."""
    return best_fields(attrs, fields, k, fuzzy).select("name", "rank", "field_id", F.bround(F.col("score") * 100).cast("int").alias("score"))


def similar_fill(values: DataFrame, targets: DataFrame, fields: DataFrame, peers: int = 100) -> DataFrame:
    """product_id, field_id, value, confidence: what most of the first peers (by product_id) have as their final value.

    Two values at least, a share of 75 % or more, the smallest of equals; never for numbers and dimensions. A product is no peer
    of itself, so the peers + 1 first products are counted and its own vote is taken off.
    """
    first = [r[0] for r in values.select("product_id").distinct().orderBy("product_id").limit(peers + 1).collect()]
    votes = values.where(F.col("product_id").isin(first) & (text_of(F.col("final_value")) != "") & (F.col("final_value") != "-")).select("product_id", "field_id", F.col("final_value").alias("value"))
    last = first[-1] if len(first) > peers else None
    kinds = fields.where(~F.col("value_type").isin("number", "dimensions")).select("field_id")
    wanted = targets.select("product_id", "field_id").join(kinds, "field_id", "left_semi")
    # each target meets the votes of its field: 101 at most
    pairs = wanted.join(votes.withColumnRenamed("product_id", "peer"), "field_id").where(F.col("peer") != F.col("product_id"))
    if last is not None:
        pairs = pairs.where(F.col("product_id").isin(first) | (F.col("peer") != last))
    counts = pairs.groupBy("product_id", "field_id", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("product_id", "field_id").agg(F.sum("n").alias("all"), F.max("n").alias("n"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    share = F.bround(F.col("n") / F.col("all") * 80).cast("int")
    return best.where((F.col("all") >= 2) & (share >= 60)).select("product_id", "field_id", "value", share.alias("confidence"))


def infer_types(cells: DataFrame) -> DataFrame:
    """column_pos, value_type, is_composite from cells (column_pos, header, value); blanks and dashes say nothing."""
    v = clean_text(F.col("value"))
    says = (v != "") & (v != "-")
    key = attr_key(F.first("header"))
    named = key.rlike("габарит|размеры|высота x|ширина x")
    listed = key.rlike("список программ|дополнительные программы|индикация")
    g = cells.groupBy("column_pos").agg(
        named.alias("named"), listed.alias("listed"), F.count_if(says).alias("n"), F.bool_and(F.when(says, v.rlike(DIMENSIONS))).alias("dims"), F.bool_and(F.when(says, v.rlike(NUMBER))).alias("nums"), F.coalesce(F.bool_or(F.when(says, F.contains(v, F.lit("/")))), F.lit(False)).alias("slash")
    )
    some = F.col("n") > 0
    dims, nums = F.col("named") | (some & F.col("dims")), some & F.col("nums")
    kind = F.when(dims, "dimensions").when(nums, "number").otherwise("select")
    return g.select("column_pos", kind.alias("value_type"), (~dims & ~nums & (F.col("listed") | F.col("slash"))).alias("is_composite"))


def build_dictionary(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """field_id, value, normalized_value, sort_order: the distinct values of each select field, in order of first sight."""
    own = cells.join(fields.where("value_type = 'select'").select("field_id", "is_composite"), "field_id")
    one = F.array(clean_text(F.col("value")))
    parts = F.when(F.col("is_composite"), F.transform(F.split("value", "/"), clean_text)).otherwise(one)
    rows = own.select("field_id", "row_number", F.posexplode(parts).alias("part_pos", "value")).where("value <> '' and value <> '-'").withColumn("normalized_value", attr_key(F.col("value")))
    first = rows.groupBy("field_id", "normalized_value").agg(F.min(F.struct("row_number", "part_pos", "value")).alias("f"))
    order = F.row_number().over(Window.partitionBy("field_id").orderBy("f.row_number", "f.part_pos"))
    return first.select("field_id", F.col("f.value").alias("value"), "normalized_value", (order - 1).alias("sort_order"))


def import_template(cells: DataFrame) -> DataFrame:
    """field_id, group_name, name, value_type, is_composite, sort_order from header cells 'name (group)' and the values below."""
    heads = cells.groupBy("column_pos").agg(F.first("header").alias("header"))
    h = split_header(F.col("header"))
    return heads.join(infer_types(cells), "column_pos").select(F.col("column_pos").alias("field_id"), h["group"].alias("group_name"), h["name"].alias("name"), "value_type", "is_composite", F.col("column_pos").alias("sort_order"))


def mapping_report(attrs: DataFrame) -> DataFrame:
    """By source: attributes mapped (also by rule), unknown, ambiguous."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return attrs.groupBy("source").agg(n("mapped", "rule").alias("mapped"), n("unknown").alias("unknown"), n("ambiguous").alias("ambiguous"))


def accept_suggested(values: DataFrame, dash_missing: bool = False) -> DataFrame:
    """Suggested values approved; with dash_missing, missing ones of the template filled with '-'. Filled ones stay as they are."""
    free = (text_of(F.col("current_value")) == "") & F.col("is_in_template")
    take, dash = free & (F.col("status") == "suggested"), free & (F.col("status") == "missing") & F.lit(dash_missing)
    final = F.when(take, F.col("proposed_value")).when(dash, "-").otherwise(F.col("final_value"))
    return values.withColumn("final_value", final).withColumn("status", F.when(take | dash, "approved").otherwise(F.col("status")))


def export_attributes(values: DataFrame) -> DataFrame:
    """product_id, stack: lines 'group|name|final value', the template's fields in their order, then extras. Refuses values of the template that are in conflict or have no final value."""
    unresolved = values.where(F.col("is_in_template") & ((text_of(F.col("final_value")) == "") | (F.col("status") == "conflict"))).count()
    if unresolved:
        raise ValueError(f"{unresolved} values are unresolved")
    line = F.concat_ws("|", "group_name", "name", text_of(F.col("final_value")))
    entry = F.struct((~F.col("is_in_template")).alias("extra"), "sort_order", "id", line.alias("line"))
    return values.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]), "\n").alias("stack"))
