"""Product model candidates from offer names, and the model of a crawled product."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.keys import compare_key, fold_lookalikes, trim_edges
from shelfmark.functions.text import cell_text, clean_text, let, prepare_model, strip_phrases, technical_clean, text_of

# Units that are no models, and those of them that the test of single words knows
UNITS = "ВТ|W|BT|В|V|B|Л|L|МЛ|ML|КГ|KG|Г|G|СМ|CM|ММ|MM"
WORD_UNITS = "ВТ|BT|В|V|B|Л|МЛ|ML|КГ|KG|Г|G|СМ|CM|ММ|MM"


def _amounts(units: str) -> str:
    return rf"^\d+(?:[.,]\d+)?(?:{units})(?:/\d+(?:[.,]\d+)?(?:{units}))*$"


UNIT_ONLY, WORD_UNIT_ONLY = _amounts(UNITS), _amounts(WORD_UNITS)
LETTERS = "A-Za-zА-Яа-яЁё"
TOKEN = rf"[{LETTERS}0-9]+(?:[./_+\-][{LETTERS}0-9]+)*"
MOST = 8


def is_model_token(c: Column) -> Column:
    """Not an amount with a unit (W and L are none here), and with a Latin letter, or a digit beside Cyrillic letters."""
    latin, digit, cyrillic = c.rlike("[A-Za-z]"), c.rlike(r"\d"), c.rlike("[А-Яа-яЁё]")
    return (c != "") & ~F.upper(c).rlike(WORD_UNIT_ONLY) & (latin | (digit & cyrillic))


def _short_lookalike(c: Column) -> Column:
    return c.rlike(f"^[{LETTERS}]{{1,3}}$") & (fold_lookalikes(c) != c)


def until_description(c: Column) -> Column:
    """Words up to the first unit or Cyrillic word that follows a model token; short look-alike suffixes stay."""

    def step(acc: Column, word: Column) -> Column:
        model = is_model_token(word)
        ends = acc["seen"] & (F.upper(word).rlike(UNIT_ONLY) | (~model & ~_short_lookalike(word) & word.rlike(r"^[А-Яа-яЁё][А-Яа-яЁё/\-]*$")))
        over = acc["over"] | ends
        return F.struct(F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(word))).alias("kept"), (acc["seen"] | (~over & model)).alias("seen"), over.alias("over"))

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("seen"), F.lit(False).alias("over"))
    return F.aggregate(F.split(c, " "), start, step, lambda acc: clean_text(F.array_join(acc["kept"], " ")))


def longest_block(c: Column) -> Column:
    """The longest run of consecutive model tokens, the first of equals."""

    def step(acc: Column, word: Column) -> Column:
        run = F.when(is_model_token(word), F.trim(F.concat_ws(" ", acc["run"], word))).otherwise("")
        return let(run, lambda r: F.struct(F.when(F.length(r) > F.length(acc["best"]), r).otherwise(acc["best"]).alias("best"), r.alias("run")))

    start = F.struct(F.lit("").alias("best"), F.lit("").alias("run"))
    return F.aggregate(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1), start, step, lambda acc: acc["best"])


def display(c: Column) -> Column:
    """As shown: words with a digit, and short words beside one, with look-alikes folded and in upper case."""

    def words(text: Column) -> Column:
        return F.transform(F.split(text, " "), lambda w: F.when(w.rlike(r"\d") | (text.rlike(r"\d") & w.rlike(f"^[{LETTERS}]{{1,3}}$")), F.upper(fold_lookalikes(w))).otherwise(w))

    # parts of a clean text are clean, unless they hold a tag or a reference
    clean = F.when(c.rlike("[<&]"), technical_clean(c)).otherwise(clean_text(c))
    return let(trim_edges(clean), lambda text: F.array_join(words(text), " "))


def tail_after_brand(name: Column, brand: Column) -> Column:
    """What follows the brand in the cleaned name, or what stands before it if that holds a model token; the whole name without a brand.

    The brand is looked for as it is, then with look-alike letters folded on both sides.
    """
    text = technical_clean(name)

    def at(haystack: Column, needle: Column) -> Column:
        return F.instr(F.lower(haystack), F.lower(needle))

    def cut(t: Column) -> Column:
        place = F.when(at(t, brand) > 0, at(t, brand)).otherwise(at(fold_lookalikes(t), fold_lookalikes(brand)))

        def parts(p: Column) -> Column:
            before = clean_text(F.substring(t, F.lit(1), p - 1))
            after = clean_text(F.substring(t, p + F.length(brand), F.length(t)))
            return F.when(p < 1, t).when(F.exists(F.split(before, " "), is_model_token), before).otherwise(after)

        return F.when(text_of(brand) == "", t).otherwise(let(place, parts))

    return let(text, cut)


def model_candidates(name: Column, brand: Column) -> Column:
    """At most eight models that the name may stand for, the likeliest first; one for each compare key.

    brand: as stated or detected; null or '' if unknown.
    """
    cleaned = strip_phrases(technical_clean(name))
    return let(tail_after_brand(cleaned, text_of(brand)), _of_tail)


def _of_tail(tail: Column) -> Column:
    return let(F.regexp_extract(tail, r"^([^,;|]*)", 1), lambda main: let(F.struct(until_description(main).alias("before"), longest_block(main).alias("block")), lambda p: _ordered(tail, main, p["before"], p["block"])))


def _ordered(tail: Column, main: Column, before: Column, block: Column) -> Column:
    codes = F.filter(F.regexp_extract_all(main, F.lit(f"({TOKEN})"), 1), lambda w: is_model_token(w) & display(w).rlike(r"\d"))
    base = F.when(before != "", before).when(main != "", main).otherwise(block)

    def runs(words: Column) -> Column:
        n = F.size(words)
        suffixes = F.transform(F.filter(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: k < n), lambda k: F.array_join(F.slice(words, k + 1, n), " "))
        prefixes = F.transform(F.filter(F.array(*[F.lit(k) for k in (4, 3, 2, 1)]), lambda k: k <= n), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
        return F.filter(F.concat(suffixes, prefixes), lambda v: v.rlike(r"\d"))

    tried = F.concat(F.array(before, block, main, tail), codes, let(F.split(clean_text(base), " "), runs))
    shown = F.filter(F.transform(tried, display), lambda v: (v != "") & ~v.rlike("[А-Яа-яЁё]") & ~F.upper(v).rlike(UNIT_ONLY))
    keyed = F.filter(F.transform(shown, lambda v: F.struct(v.alias("value"), compare_key(v).alias("key"))), lambda s: F.length(s["key"]) >= 2)
    first = F.aggregate(keyed, F.array().cast("array<struct<value:string,key:string>>"), lambda acc, s: F.when(F.exists(acc, lambda a: a["key"] == s["key"]), acc).otherwise(F.concat(acc, F.array(s))))
    return F.slice(F.transform(first, lambda s: s["value"]), 1, MOST)


def converter_model(c: Column, brand: Column | None = None) -> Column:
    """The first candidate of a cell, else the cell's text."""
    text = cell_text(c)
    found = model_candidates(text, brand if brand is not None else F.lit(""))
    return F.when(text == "", "").otherwise(F.coalesce(F.get(found, F.lit(0)), text))


def normalize_model(c: Column, brands: list[str] = ()) -> Column:
    """The model without the full product name; rules are tried in turn, the first that fits decides.

    A mixed-case Latin code as it is; the code after a known brand; up to six Latin words that are the
    whole text; the last run of two to six upper-case words with a digit; the last code of letters and digits; else the text.
    """
    known = sorted({b.upper() for b in brands if b}, key=lambda b: (-len(b), b))
    bare = [*known, "SERIE", "SERIES"]
    text = F.regexp_replace(F.replace(clean_text(c), F.lit("\\"), F.lit("/")), "[–—]", "-")
    text = F.regexp_replace(F.regexp_replace(text, r"\s*([/_.+])\s*", "$1"), r"\s+-\s+", " - ")
    text = F.regexp_replace(text, r"\.+$", "")
    edges = lambda x: F.regexp_replace(x, r"^[ .,/\\_\-]+|[ .,/\\_\-]+$", "")

    def choose(t: Column) -> Column:
        mixed = t.rlike(r"^[A-Za-z0-9./_@-]+(?:\s+-\s+|\s+[A-Za-z0-9./_@-]+){0,8}$") & t.rlike(r"\d") & t.rlike("[a-z]")
        branded = F.regexp_extract(t, rf"(?i)\b(?:{'|'.join(re.escape(b) for b in known)})\b\s+([A-Z0-9][A-Z0-9./_@\\-]{{2,}})", 1) if known else F.lit("")
        words = F.regexp_extract_all(t, F.lit("([A-Za-z0-9./_@-]+)"), 1)
        first = F.upper(F.coalesce(F.get(words, F.lit(0)), F.lit("")))
        whole = (F.array_join(words, " ") == t) & F.size(words).between(1, 6) & t.rlike(r"\d") & t.rlike("[A-Za-z]") & ~first.isin(bare)
        latin = F.array_join(F.filter(F.transform(words, lambda w: F.upper(edges(w))), lambda w: w != ""), " ")
        tokens = F.regexp_extract_all(t, F.lit("([A-Za-z0-9]+(?:[./_@-][A-Za-z0-9]+)*)"), 1)

        def last_run(ts: Column) -> Column:
            n = F.size(ts)
            tails = F.transform(F.sequence(F.lit(6), F.lit(2), F.lit(-1)), lambda k: F.when(k <= n, F.slice(ts, n - k + 1, k)))
            fits = F.filter(tails, lambda r: r.isNotNull() & F.exists(r, lambda w: w.rlike(r"\d")) & F.forall(r, lambda w: w.rlike("^[A-Z0-9./_@-]+$")) & ~F.upper(r[0]).isin(bare))
            return F.coalesce(F.array_join(F.get(fits, F.lit(0)), " "), F.lit(""))

        codes = F.filter(F.transform(F.regexp_extract_all(t, F.lit("(?i)([A-Z\u0400-\u04ff0-9][A-Z\u0400-\u04ff0-9./_@\\\\-]{2,})"), 1), edges), lambda w: w.rlike(r"\d") & w.rlike("[A-Za-z\u0400-\u04ff]") & ~F.upper(w).isin(bare[:-2] or [""]))
        return (
            F.when(mixed, t)
            .when(branded != "", F.upper(F.replace(edges(branded), F.lit("\\"), F.lit("/"))))
            .when(whole, latin)
            .otherwise(let(let(tokens, last_run), lambda r: F.when(r != "", r).when(F.size(codes) > 0, F.upper(F.element_at(codes, -1))).otherwise(t)))
        )

    return F.when(clean_text(c) == "", "").otherwise(let(text, choose))


def finalize_model(c: Column, rules: str = "", preserve: bool = False, brands: list[str] = ()) -> Column:
    """Rules applied; kept as that where rules or a configured source are given, else normalised."""
    prepared = prepare_model(c, rules)
    return prepared if preserve or (rules or "").strip() else normalize_model(prepared, brands)
