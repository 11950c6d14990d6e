"""Comparison keys of product models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import let, model_key, technical_clean, text_of

# Cyrillic letters that look like Latin ones
LOOKALIKE_FROM = "АВЕКМНОРСТХавекмнорстх"
LOOKALIKE_TO = "ABEKMHOPCTXABEKMHOPCTX"


def fold_lookalikes(c: Column) -> Column:
    return F.translate(text_of(c), LOOKALIKE_FROM, LOOKALIKE_TO)


def trim_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .,/\\_\-+]+|[ .,/\\_\-+]+$", "")


def compare_key(c: Column) -> Column:
    """Clean, quotes off, edge punctuation off, upper case."""
    bare = F.regexp_replace(technical_clean(c, drop_brackets=False), "[\"'`«»]", "")
    return model_key(trim_edges(F.regexp_replace(bare, " +", " ")))


def compact(key: Column) -> Column:
    return F.regexp_replace(key, r"[\s./_+\-]+", "")


def compact_key(c: Column) -> Column:
    """The compare key without blanks and . / _ + -"""
    return compact(compare_key(c))


def visual_key(c: Column) -> Column:
    """The compact key with look-alike letters folded."""
    return compact_key(fold_lookalikes(c))


def compare_keys(c: Column) -> Column:
    """array<struct<reason, key>> in the order in which reasons are tried, blank keys dropped."""
    named = lambda reason, key: F.struct(F.lit(reason).alias("reason"), key.alias("key"))
    keys = let(compare_key(c), lambda own: F.array(named("original", own), named("compact", compact(own)), named("visual", visual_key(c))))
    return F.filter(keys, lambda k: k["key"] != "")


def product_keys(model: Column, vendor_code: Column) -> Column:
    """Model and vendor code keys, distinct, blank ones dropped."""
    return F.array_distinct(F.filter(F.array(model_key(model), model_key(vendor_code)), lambda k: k != ""))


def key_texts(c: Column) -> Column:
    """The distinct keys of a value, whatever the reason."""
    return let(compare_keys(c), lambda k: F.array_distinct(k["key"]))
