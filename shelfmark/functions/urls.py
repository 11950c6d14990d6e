"""URL expressions. Parts are taken by patterns: parse_url raises or gives null on odd input."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import let, text_of

# Fixed values
STATIC = "jpg|jpeg|png|gif|svg|webp|pdf|doc|docx|xls|xlsx|zip|rar|mp4|avi|css|js"
SERVICE = ("articles", "reviews", "delivery-and-payment", "services", "credit", "guarantee", "contacts", "favorites", "compare", "cart", "login", "personal", "search", "upload", "bitrix", "ajax")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), _SCHEME, 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"^[^?#]*\?([^#]*)", 1)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(text_of(url), "#.*$", "")


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL from a reference and the page that it stands on, dot segments removed."""
    origin = F.concat(scheme_of(base), F.lit("://"), F.regexp_extract(text_of(base), r"^[^:]+://([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    path, query = path_of(href), F.when(query_of(href) != "", F.concat(F.lit("?"), query_of(href))).otherwise("")
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    relative = F.when(
        path == "", F.concat(origin, path_of(base), F.when(query != "", query).when(query_of(base) != "", F.concat(F.lit("?"), query_of(base))).otherwise(""))
    ).otherwise(F.concat(origin, _no_dots(joined), query))
    return F.when(scheme_of(href) != "", text_of(href)).when(text_of(href).startswith("//"), F.concat(scheme_of(base), F.lit(":"), text_of(href))).otherwise(relative)


def _no_dots(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != ".")
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")
    return F.when(path.rlike(r"/\.\.?$"), F.concat(out, F.lit("/"))).otherwise(out)


def normalize_url(href: Column, base: Column) -> Column:
    """The canonical form of a link within a site, null for what is no http link.

    Resolved, without fragment, single slashes, scheme and host in lower case; of the query only
    page and pagen_* stay, and route, path and product_id of a product route.
    """
    trimmed = F.trim(text_of(href))

    def build(url: Column) -> Column:
        pairs = F.filter(
            F.transform(F.split(query_of(url), "&"), lambda p: F.struct(F.lower(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.regexp_extract(p, "^([^=]*)", 1).alias("key"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("value"))),
            lambda p: p["value"] != "",
        )

        def kept(all_: Column) -> Column:
            route = F.coalesce(F.get(F.filter(all_, lambda p: p["k"] == "route"), F.lit(0))["value"], F.lit(""))
            product = (F.lower(F.regexp_replace(F.replace(route, F.lit("%2F"), F.lit("/")), "^/+|/+$", "")) == "product/product") & F.exists(all_, lambda p: p["k"] == "product_id")
            stay = F.filter(all_, lambda p: (p["k"] == "page") | p["k"].startswith("pagen_") | (product & p["k"].isin("route", "path", "product_id")))
            text = F.array_join(F.transform(stay, lambda p: F.concat_ws("=", p["key"], p["value"])), "&")
            return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")

        path = F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), "/{2,}", "/")
        good = scheme_of(url).isin("http", "https") & (host_of(url) != "")
        return F.when(good, F.concat(scheme_of(url), F.lit("://"), host_of(url), path, let(pairs, kept)))

    other = trimmed.rlike("^(mailto|tel|javascript):") | (trimmed == "")
    return F.when(~other, let(drop_fragment(resolve(trimmed, base)), build))


def normalize_feed_url(c: Column) -> Column:
    """https by default, no fragment, single slashes, lower-case host; the query stays; '' where there is no host."""
    text = F.trim(text_of(c))

    def build(full: Column) -> Column:
        path = F.regexp_replace(F.when(path_of(full) == "", "/").otherwise(path_of(full)), "/{2,}", "/")
        query = F.when(query_of(full) != "", F.concat(F.lit("?"), query_of(full))).otherwise("")
        return F.when((text == "") | (host_of(full) == ""), "").otherwise(F.concat(scheme_of(full), F.lit("://"), host_of(full), path, query))

    return let(drop_fragment(F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))), build)


def same_site(url: Column, host: Column) -> Column:
    return (host_of(url) == F.lower(host)) | host_of(url).endswith(F.concat(F.lit("."), F.lower(host)))


def is_static(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(rf"\.({STATIC})$")


def is_service_path(url: Column) -> Column:
    return F.lower(F.regexp_extract(path_of(url), "^/*([^/]*)", 1)).isin(*SERVICE)


def should_follow(url: Column, starts: list[str]) -> Column:
    """No static file, no service page, on the site and under the path of one of the start pages ('/' and '/catalog' admit all)."""
    under: Column = F.lit(False)
    for start in starts:
        m = re.match(r"^[a-z]+://([^/?#]*)([^?#]*)", start, re.I)
        host, path = (m[1], m[2].rstrip("/") or "/") if m else ("", "/")
        below = F.lit(True) if path in ("/", "/catalog") else (path_of(url) == path) | path_of(url).startswith(path + "/")
        under = under | (same_site(url, F.lit(host)) & below)
    return ~is_static(url) & ~is_service_path(url) & under


def canonical_product_url(url: Column) -> Column:
    """The path from its /good(s)_N part on, fragment off."""

    def build(u: Column) -> Column:
        cut = F.regexp_extract(path_of(u), r"(?i)(/goods?_\d+.*)$", 1)
        path = F.when(cut != "", cut).when(path_of(u) == "", "/").otherwise(path_of(u))
        origin = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        query = F.when(query_of(u) != "", F.concat(F.lit("?"), query_of(u))).otherwise("")
        return F.when(u == "", "").otherwise(F.concat(origin, path, query))

    return let(text_of(url), build)


def feed_source(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def glob(pattern: str) -> str:
    """A regular expression for a shell pattern with *, ? and sets: [abc], [a-c], [!abc]"""
    parts = re.split(r"(\[!?\]?[^\]]*\]|.)", pattern, flags=re.S)

    def one(p: str) -> str:
        if len(p) < 3:
            return {"*": ".*", "?": "."}.get(p, re.escape(p))
        inner = re.sub(r"[\\\[\]^&~|]", r"\\\g<0>", p[1:-1].removeprefix("!"))
        return f"[{'^' if p[1] == '!' else ''}{inner}]"

    return "(?s)^" + "".join(map(one, parts)) + "$"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def url_excluded(url: Column, patterns: list[str]) -> Column:
    """A pattern with * or ? is a glob on the url or path with one trailing slash; one with a scheme a prefix of the url; else a prefix of the path, or part of it."""
    full = F.concat(F.regexp_replace(text_of(url), "/+$", ""), F.lit("/"))
    path = F.concat(F.regexp_replace(path_of(url), "/+$", ""), F.lit("/"))
    tests = []
    for p in (p.strip() for p in patterns):
        ended = p.rstrip("/") + "/"
        if not p:
            continue
        if "*" in p or "?" in p:  # sets alone make no glob
            tests.append(full.rlike(glob(p)) | path.rlike(glob(p)))
        elif p.startswith(("http://", "https://")):
            tests.append(full.startswith(ended))
        else:
            tests.append(path.startswith(ended) | path_of(url).contains(p))
    return _any(tests)


def url_matches(url: Column, patterns: list[str]) -> Column:
    """Any pattern is part of, or as a glob matches, the lower-cased 'url path'."""
    hay = F.lower(F.concat(text_of(url), F.lit(" "), path_of(url)))
    own = [p.strip().lower() for p in patterns if p.strip()]
    return _any([hay.contains(p) | hay.rlike(glob(p)) for p in own])


def product_url_ok(url: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Include filters admit all if there are none, exclude filters none."""
    wanted = url_matches(url, include) if any(p.strip() for p in include) else F.lit(True)
    return wanted & ~url_matches(url, exclude)
