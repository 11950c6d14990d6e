"""Attribute keys and typed attribute values."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import clean_text, let, text_of

# Fixed values
STOP_WORDS = ("максимальная", "максимальный", "макс", "мин", "об", "минуту", "ед", "значение", "характеристика", "параметр", "тип")
YES, NO = ("да", "есть", "yes", "true", "1", "имеется"), ("нет", "no", "false", "0", "отсутствует")
DEFAULT_GROUP = "Основные характеристики"
NUMBER = r"^[+-]?\d+(?:[.,]\d+)?$"
DIMENSIONS = r"^[+-]?\d+(?:[.,]\d+)?(?:\s*[xXхХ×]\s*[+-]?\d+(?:[.,]\d+)?){1,3}$"


def attr_key(c: Column) -> Column:
    """Lower case, ё as е, words of letters and digits joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(clean_text(c)), F.lit("ё"), F.lit("е")), F.lit("([a-zа-я0-9]+)"), 1), " ")


def attr_model(c: Column) -> Column:
    return F.regexp_replace(F.upper(clean_text(c)), "[^A-ZА-ЯЁ0-9]", "")


def name_tokens(c: Column) -> Column:
    """The distinct words of a name, without stop words and single letters."""
    return F.filter(F.array_distinct(F.split(attr_key(c), " ")), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def norm_number(c: Column) -> Column:
    """Comma as dot, trailing zeros off; null if it is no number."""
    text = F.replace(clean_text(c), F.lit(","), F.lit("."))
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(clean_text(c).rlike(NUMBER), short)


def norm_dimensions(c: Column) -> Column:
    """Two to four numbers joined by x; null if it is nothing like that."""
    text = F.replace(F.regexp_replace(clean_text(c), r"\s*[xXхХ×]\s*", "x"), F.lit(","), F.lit("."))
    return F.when(clean_text(c).rlike(DIMENSIONS), text)


def composite(c: Column, sep: str = "/") -> Column:
    """Distinct parts in order of their lower-case form."""
    parts = F.array_distinct(F.filter(F.transform(F.split(clean_text(c), sep), clean_text), lambda p: p != ""))
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(F.lower(p).alias("k"), p.alias("p"))))
    return F.array_join(F.transform(ordered, lambda s: s["p"]), sep)


def norm_value(c: Column, kind: Column | str, is_composite: Column | bool = False) -> Column:
    """By type: number, dimensions, boolean, select. '' stays ''; null for a number or dimensions that are none."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    many = F.lit(is_composite) if isinstance(is_composite, bool) else is_composite
    text, key = clean_text(c), attr_key(c)
    plain = F.when(many, composite(c)).otherwise(text)
    return (
        F.when(text == "", "")
        .when(kind == "number", norm_number(c))
        .when(kind == "dimensions", norm_dimensions(c))
        .when((kind == "boolean") & key.isin(*YES), "Да")
        .when((kind == "boolean") & key.isin(*NO), "Нет")
        .otherwise(plain)
    )


def split_header(c: Column) -> Column:
    """'name (group)' as struct<name, group>."""
    text = clean_text(c)
    name, group = F.regexp_extract(text, r"^(.*?)\s*\(([^()]*)\)\s*$", 1), F.regexp_extract(text, r"^(.*?)\s*\(([^()]*)\)\s*$", 2)
    has = text.rlike(r"^(.*?)\s*\(([^()]*)\)\s*$")
    return F.struct(F.when(has, clean_text(name)).otherwise(text).alias("name"), F.when(has & (clean_text(group) != ""), clean_text(group)).otherwise(DEFAULT_GROUP).alias("group"))


def parse_stack(c: Column) -> Column:
    """Lines 'group|name|value' as array<struct<pos, group_name, name, value>>; lines without three parts are left out."""
    lines = F.transform(F.split(text_of(c), r"\r\n|\r|\n"), lambda x, i: F.struct(i.alias("pos"), F.split(x, r"\|", 3).alias("p"), x.alias("line")))
    good = F.filter(lines, lambda x: (F.size(x["p"]) == 3) & (clean_text(x["line"]) != ""))
    return F.transform(good, lambda x: F.struct(x["pos"].alias("pos"), clean_text(x["p"][0]).alias("group_name"), clean_text(x["p"][1]).alias("name"), clean_text(x["p"][2]).alias("value")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two texts are as sequences, 0 to 1; a null side gives 0 at once. Call it on distinct pairs that ratio_bound leaves."""
    return pd.Series([0.0 if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b)])


def ratio_bound(a: Column, b: Column) -> Column:
    """What sequence_ratio is at most: only characters that both texts have can match."""
    shared = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(shared(a, b), shared(b, a)) / total)


def ratio_of(a: str, b: str) -> float:
    """How alike two texts are as sequences, 0 to 1."""
    return SequenceMatcher(None, a, b).ratio()


def name_score_parts(x: Column, y: Column, p: Column, q: Column) -> Column:
    """What name tokens x and y and attribute keys p and q say of a mapping score without comparing sequences, as struct<known, low, high>: low is the score if it is known, else what
    words in common give; high is what it is at most. Equal keys have 1, names whose words are among the other's 0.96."""
    return let(F.size(F.array_intersect(x, y)), lambda both: _score_parts(both, x, y, p, q))


def _score_parts(both: Column, x: Column, y: Column, p: Column, q: Column) -> Column:
    filled = (F.size(x) > 0) & (F.size(y) > 0)
    inside = filled & ((both == F.size(x)) | (both == F.size(y)))
    words = F.when(filled, 0.37 * (both / F.least(F.size(x), F.size(y))) + 0.15 * (both / (F.size(x) + F.size(y) - both))).otherwise(0.0)
    sure = F.when(p == q, 1.0).when(inside, 0.96)
    most = F.least(F.lit(0.99), 0.48 * ratio_bound(p, q) + words + 1e-9)
    return F.struct(sure.isNotNull().alias("known"), F.coalesce(sure, words).alias("low"), F.coalesce(sure, most).alias("high"))


def mapping_score(a: Column, b: Column) -> Column:
    """How well a source attribute's name fits a field's, 0 to 1. For the best of many fields ask operators.fuzzy.best_entries."""
    p = let(name_tokens(a), lambda x: let(name_tokens(b), lambda y: name_score_parts(x, y, attr_key(a), attr_key(b))))
    ratio = sequence_ratio(F.when(attr_key(a) != attr_key(b), attr_key(a)), attr_key(b))
    return F.when(p["known"], p["low"]).otherwise(F.least(F.lit(0.99), 0.48 * ratio + p["low"]))
