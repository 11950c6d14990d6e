"""What a product page says of itself: JSON-LD products, attribute pairs of tables and definition lists, the heading and the breadcrumbs.

One pass over the tags of a page with a stack of the elements that are open. A tag opens an element within the one on top of the stack; an end tag closes
the nearest element of its name and all in it. Text goes to every element around it that asked for its text.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FACTS = "products: array<struct<name: string, model: string, brand: string, category: string, properties: array<struct<name: string, value: string>>>>, pairs: array<struct<name: string, value: string>>, heading: string, crumbs: array<string>"
# Fixed values
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
ROWS = ("table", ".characteristics", ".specifications", ".properties")
CRUMBS = (".breadcrumb", ".breadcrumbs")
CLASSES = {x[1:] for x in ROWS + CRUMBS if x.startswith(".")}
SILENT = ("script", "style", "template")
#: What a page has to hold to say anything.
TELLING = r"(?i)<h1|<tr|<dt|ld\+json|breadcrumb|itemlistelement"

_WORD = re.compile(r"[a-zа-я0-9]+")


def clean(value: object) -> str:
    return re.sub(r"\s+", " ", "" if value is None else str(value)).strip()


def key(text: str) -> str:
    return " ".join(_WORD.findall(text.casefold().replace("ё", "е")))


def jsonld_items(value: object) -> Iterator[dict]:
    """Objects at any depth of lists and @graph, those of a graph before the object that holds it."""
    stack = [(value, False)]
    while stack:
        item, opened = stack.pop()
        if isinstance(item, list):
            stack += [(x, False) for x in reversed(item)]
        elif isinstance(item, dict):
            graph = item.get("@graph")
            if opened or not isinstance(graph, list):
                yield item
            else:
                stack += [(item, True)] + [(x, False) for x in reversed(graph)]


def product_of(item: dict) -> dict | None:
    kind = item.get("@type")
    if "Product" not in (kind if isinstance(kind, list) else [kind]):
        return None
    brand, listed = item.get("brand"), item.get("additionalProperty") or []
    pairs = [{"name": clean(p["name"]), "value": clean(p.get("value"))} for p in (listed if isinstance(listed, list) else []) if isinstance(p, dict) and p.get("name")]
    return {"name": clean(item.get("name")), "model": clean(item.get("model") or item.get("mpn") or item.get("sku")), "brand": clean(brand.get("name") if isinstance(brand, dict) else brand), "category": clean(item.get("category")), "properties": pairs}


class Page(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = [{"tag": ""}]
        self.open: Counter[str] = Counter()  # tags, and classes with a dot, of the elements that are open
        self.in_rows: list[tuple[list, list]] = []
        self.asking: list[list[str]] = []  # texts of open elements that asked for them
        self.rows: list[tuple[list, list]] = []  # cells that stand in a row itself; all within it
        self.terms: list[tuple[list[str], list[list[str]]]] = []  # a term's text; its definition's, if there is one
        self.heading: list[str] | None = None
        self.crumbs: list[list[str]] = []
        self.scripts: list[list[str]] = []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        attr, top, texts = dict(attrs), self.stack[-1], []
        ask = lambda: texts.append([]) or texts[-1]
        names = [tag, *("." + c for c in {*(attr.get("class") or "").split()} & CLASSES)]
        element = {"tag": tag, "names": names, "texts": texts}
        if tag == "tr" and any(self.open[x] for x in ROWS):
            element["row"] = ([], [])
            self.rows.append(element["row"])
            self.in_rows.append(element["row"])
        elif tag in ("td", "th"):
            cell = ask()
            for row in self.in_rows:
                row[1].append(cell)
            if "row" in top:
                top["row"][0].append(cell)
        elif tag == "dt" and self.open["dl"]:
            term = (ask(), [])
            self.terms.append(term)
            top.setdefault("waiting", []).append(term)
        elif tag == "dd" and top.get("waiting"):
            said = ask()
            for term in top.pop("waiting"):
                term[1].append(said)
        elif tag == "h1" and self.heading is None:
            self.heading = ask()
        elif tag == "script" and attr.get("type") == "application/ld+json":
            self.scripts.append(ask())
        if attr.get("itemprop") == "itemListElement" or (tag == "a" and any(self.open[x] for x in CRUMBS)):
            self.crumbs.append(ask())
        if tag not in VOID:
            self.stack.append(element)
            self.open.update(names)
            self.asking += texts

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag]:
            element = self.stack.pop()
            self.open.subtract(element["names"])
            if "row" in element:
                self.in_rows.pop()
            for _ in element["texts"]:  # those of the innermost element are the last
                self.asking.pop()
            if element["tag"] == tag:
                break

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top["tag"] in SILENT:
            for text in top["texts"]:
                text.append(data)
        else:
            for text in self.asking:
                text.append(data)

    def facts(self) -> dict:
        said = lambda texts: clean(" ".join(texts))
        products = []
        for script in self.scripts:
            try:
                data = json.loads("".join(script) or "{}")
            except (ValueError, RecursionError):
                continue
            products += [p for item in jsonld_items(data) if (p := product_of(item))]
        seen = {(key(a["name"]), key(a["value"])) for p in products for a in p["properties"]}
        pairs = []

        def add(name: str, value: str) -> None:
            if name and value and (k := (key(name), key(value))) not in seen:
                seen.add(k)
                pairs.append({"name": name, "value": value})

        for direct, every in self.rows:
            cells = direct or every
            if len(cells) > 1 and (name := said(cells[0])) != (value := said(cells[-1])):
                add(name, value)
        for term, definitions in self.terms:
            if definitions:
                add(said(term), said(definitions[0]))
        crumbs = list(dict.fromkeys(t for c in self.crumbs if (t := said(c))))
        return {"products": products, "pairs": pairs, "heading": said(self.heading or []), "crumbs": crumbs}


NOTHING = {"products": [], "pairs": [], "heading": "", "crumbs": []}


def page_facts(html: Column) -> Column:
    """struct<products, pairs, heading, crumbs> of a page; null and pages that cannot hold any have none. Products of JSON-LD come in page order, at any depth of lists and graphs; pairs
    are distinct by key, also from the products' own properties."""

    @F.pandas_udf(f"struct<{FACTS}>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Page(p).facts() if p else NOTHING for p in pages], columns=list(NOTHING))

    return run(F.when(html.rlike(TELLING), html))
