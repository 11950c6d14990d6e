"""Column expressions that clean text, cells and prices. Null counts as an empty text unless said otherwise."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A price with its currency, as crawled pages show it
PRICE = "(?iU)\\d[\\d\\s]{1,}(?:\u20bd|руб\\.?)"
# Character references that occur in feeds
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&laquo;": "«", "&raquo;": "»", "&ndash;": "–", "&mdash;": "—", "&times;": "×", "&amp;": "&"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """Runs of blanks of any kind as one blank, trimmed."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def search_text(c: Column, compatible: bool = True) -> Column:
    """Lower case, blanks collapsed, compatibility forms folded (an Arrow function, only for texts beyond Latin-1 and Cyrillic)."""
    text = text_of(c)
    if compatible:
        odd = text.rlike("[^\\x00-\\x7F\u00c0-\u00ff\u0400-\u04ff]")
        text = F.when(odd, _nfkc(F.when(odd, text))).otherwise(text)
    return clean_text(F.lower(text))


def norm_header(c: Column) -> Column:
    return F.lower(clean_text(c))


def cell_text(c: Column, kind: str = "string", blank_words: bool = False) -> Column:
    """A cell of the given type as text: booleans 1 or 0, whole floats without a fraction, others with 15 digits, no number ''.

    blank_words: none, null and nan in any case are '' too.
    """
    if kind == "boolean":
        out = F.when(c, "1").when(~c, "0").otherwise("")
    elif kind in ("float", "double"):
        whole = (c == F.floor(c)) & (F.abs(c) < 9e18)
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        exact = F.format_string("%.15g", c)
        short = F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        out = F.when(~finite | c.isNull(), "").when(whole, c.cast("bigint").cast("string")).otherwise(F.coalesce(F.rtrim(short), F.lit("")))
    else:
        out = clean_text(c)
    return F.when(F.lower(out).isin("none", "null", "nan"), "").otherwise(out) if blank_words else out


def price_digits(c: Column) -> Column:
    """Only the digits: 11674.16 becomes 1167416."""
    return F.regexp_replace(clean_text(c), r"\D+", "")


def extract_prices(c: Column) -> Column:
    """All prices with a currency, in order."""
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(f"({PRICE})"), 1), clean_text)


def price_display(c: Column) -> Column:
    """The first price with a currency; else a bare number of two digits or more with blanks between thousands and the rouble sign; else ''."""

    def show(text: Column) -> Column:
        found = F.regexp_extract(text, f"({PRICE})", 1)
        digits = F.regexp_replace(text, r"\D", "")
        bare = text.rlike(r"^(?U)[^\w]*\d[\d\s.,]*[^\w]*$") & (F.length(digits) >= 2)
        shown = F.concat(F.replace(F.format_number(digits.cast("decimal(38,0)"), 0), F.lit(","), F.lit(" ")), F.lit(" \u20bd"))
        return F.when(found != "", clean_text(found)).when(bare, shown).otherwise("")

    return let(clean_text(c), show)


def model_key(c: Column) -> Column:
    return F.upper(clean_text(c))


@F.pandas_udf(T.StringType())
def _unescape(c: pd.Series) -> pd.Series:
    return c.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_each(c: pd.Series) -> pd.Series:
    return c.map(lambda texts: [html.unescape(t) for t in texts], na_action="ignore")


# What may be a reference; nothing else goes to Python
REFERENCE = "&[#A-Za-z]"


def unescape(c: Column) -> Column:
    """Character references as their characters, by name or number, once: &amp;lt; becomes &lt;. What is no reference stays. An Arrow function, so not for use within let or transform."""
    text = text_of(c)
    odd = text.rlike(REFERENCE)
    return F.when(odd, _unescape(F.when(odd, text))).otherwise(text)


def unescape_each(c: Column) -> Column:
    """unescape of each text of an array that holds no null."""
    odd = F.exists(c, lambda t: t.rlike(REFERENCE))
    return F.when(odd, _unescape_each(F.when(odd, c))).otherwise(c)


def unescape_common(c: Column) -> Column:
    """The references of ENTITIES only, the ampersand last, natively: for keys and candidates, which nest it within lambdas. Where texts hold others, unescape a column first."""
    out = text_of(c)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def strip_tags(c: Column) -> Column:
    return clean_text(F.regexp_replace(text_of(c), r"(?s)<[^>]*>", " "))


def technical_clean(c: Column, drop_brackets: bool = True) -> Column:
    """Without tags; common references decoded; dashes alike; no blanks around / _ . + -; bracketed parts off if wanted."""
    text = F.regexp_replace(unescape_common(strip_tags(c)), "[–—−]", "-")
    text = F.regexp_replace(text, r"(?U)\s*([/_.+\-])\s*", "$1")
    if drop_brackets:
        text = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    return clean_text(text)


def strip_model_chars(c: Column) -> Column:
    text = F.regexp_replace(text_of(c), r"[^0-9A-Za-zА-Яа-яЁё\s\-./\\|@+]+", " ")
    return clean_text(F.regexp_replace(clean_text(text), r"\s*([\-./\\|])\s*", "$1"))


def strip_phrases(c: Column) -> Column:
    """Without "side by side", which is no model."""
    return clean_text(F.regexp_replace(clean_text(c), r"(?i)(?<![a-z0-9])side\s*[- ]\s*by\s*[- ]\s*side(?![a-z0-9])", " "))


def between_markers(c: Column, start: str = "", end: str = "") -> Column:
    """What stands between two literal markers; one may be ''; '' if a marker that is given is absent."""
    text = text_of(c)
    if not start and not end:
        return F.lit("")
    rest = F.when(F.instr(text, start) > 0, F.substring(text, F.instr(text, start) + len(start), F.length(text))) if start else text
    if not end:
        return F.coalesce(rest, F.lit(""))
    return F.coalesce(F.when(F.instr(rest, end) > 0, F.substring(rest, F.lit(1), F.instr(rest, end) - 1)), F.lit(""))


def norm_field(c: Column) -> Column:
    """A field selector: <tag> and a/b/tag as tag, a namespace prefix off; '@attribute' and 'param:Name' as they are."""
    text = F.regexp_replace(clean_text(c), r"^<\s*/?|\s*/?>$", "")
    last = F.element_at(F.split(text, "/"), -1)
    plain = F.when(F.instr(last, ":") > 0, F.element_at(F.split(last, ":"), -1)).otherwise(last)
    return F.when(text.startswith("@") | F.lower(text).startswith("param:"), text).otherwise(plain)


def split_list(c: Column, sep: str = r"[\n,]+") -> Column:
    """Trimmed, non-empty, distinct items in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text_of(c), sep), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != ""))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """The JSON value, or the default where the text is null or no such JSON."""
    return F.coalesce(F.from_json(c, schema), default)


# Letters that show up when UTF-8 was read as windows-1251
_MOJIBAKE = "ЂЅІЎёђѕџ€СПОМНДГЦР"


@F.pandas_udf(T.StringType())
def _repair(c: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        for _ in range(3):
            try:
                better = text.encode("cp1251").decode("utf-8") if any(m in text for m in _MOJIBAKE) else text
            except UnicodeError:
                return text
            if better == text:
                return text
            text = better
        return text

    return c.map(one, na_action="ignore")


def repair_text(c: Column) -> Column:
    """UTF-8 that was decoded as windows-1251, up to three times over, put right; other texts as they are."""
    odd = c.rlike(f"[{_MOJIBAKE}]")
    return F.when(odd, _repair(F.when(odd, c))).otherwise(c)


# --- replace rules


def _java_replacement(text: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def apply_rules(c: Column, rules: str) -> Column:
    """A program of replacements, one 'pattern|replacement' a line, applied in order to the unescaped text.

    {br} is any line break; {reg[#regex#flags]} a regular expression with flags i, m, s; {skip} the shortest
    run and {.} one character in a pattern; anything else is literal. Lines without '|' and bad regexes are skipped.
    """
    out = unescape_common(c)
    for line in (rules or "").splitlines():
        pattern, bar, new = line.strip().partition("|")
        pattern, new = pattern.strip(), new.strip()
        if not bar or not pattern:
            continue
        if pattern == "{br}":
            out = F.regexp_replace(out, r"\r\n|\r|\n", _java_replacement(new))
        elif m := re.fullmatch(r"\{reg\[#(.*)#([a-zA-Z]*)\]\}", pattern):
            try:
                re.compile(m[1])
            except re.error:
                continue
            flags = "".join(f for f in "ims" if f in m[2].lower())
            out = F.regexp_replace(out, (f"(?{flags})" if flags else "") + m[1], _java_replacement(new))
        elif "{skip}" in pattern or "{.}" in pattern:
            parts = re.split(r"(\{skip\}|\{\.\})", pattern)
            regex = "".join({"{skip}": ".*?", "{.}": "."}.get(p, re.escape(p)) for p in parts)
            out = F.regexp_replace(out, "(?s)" + regex, _java_replacement(new))
        else:
            out = F.replace(out, F.lit(pattern), F.lit(new))
    return out


def prepare_model(c: Column, rules: str = "", from_file: bool = False) -> Column:
    """Rules, then tags off, then clean; for values from files also without special characters."""
    out = strip_tags(apply_rules(c, rules))
    return strip_model_chars(out) if from_file else out
