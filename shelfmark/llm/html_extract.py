"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden label: boilerplate, content, or frame (what only holds
both). A node's tag, class and id words,
text length, link share and punctuation are its evidence; a potential ties its label to its
parent's. Sum-product message passing, once from the leaves up and once down, gives
the exact marginals; the text directly in nodes that are more likely content than not is kept.
The tables are counted from labelled pages, which a fixed generator writes in many layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labelled pages that the tables are counted from.
TRAINING_PAGES, SEED = 1500, 7

# Element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed".split())
DROPPED = RAW | frozenset("head template select option button svg datalist".split())
#: What may stand in a head; anything else, text too, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that hold a whole page.
OUTER = frozenset("#root html body".split())
#: A start tag of the key ends an open element of the values, up to an element of the scope.
IMPLIED = {"button": {"button"}, "select": {"select"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Lists and buttons whose end tag is missing end where such an element starts.
UNENDED = {"select": BLOCKS - {"option"}, "datalist": BLOCKS - {"option"}, "option": BLOCKS, "button": BLOCKS - {"div", "br", "hr", "option", "ul", "li"}}
SCOPE = frozenset("html body article section div main aside nav header footer form table td th ul ol dl blockquote".split())

# Linear in the page: every part is possessive. Quotes hold '>' in values only, and one that is never closed holds nothing; a tag that
# the page ends in is no tag, and takes the rest of the page with it.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")
_ENDS = re.compile(r"[.!?,;:]")


@dataclass
class Page:
    """Elements in page order; the parent of each stands before it. Node 0 is the root. Elements whose text never counts are no nodes: an icon in an article says nothing about it."""

    parents: list[int]
    tags: list[str]
    names: list[str]
    labels: list[str]
    pieces: list[tuple[int, str]]  # element and its text; -1: a block begins or ends


def parse(source: str) -> Page:
    page = Page([-1], ["#root"], [""], [""], [])
    stack, tags, at = [0], ["#root"], 0  # open nodes and their tags; an element that is no node stands for the one around it
    dropped = 0  # open elements whose text never counts
    opened: Counter[str] = Counter()

    def text(a: int, b: int) -> None:
        if b > a and tags[-1] == "head" and not source[a:b].isspace():
            close(len(stack) - 1)
        if b > a and not dropped:
            page.pieces.append((stack[-1], html.unescape(source[a:b])))

    def close(to: int) -> None:
        nonlocal dropped
        while len(stack) > to:
            stack.pop()
            tag = tags.pop()
            opened[tag] -= 1
            dropped -= tag in DROPPED
            if tag in BLOCKS:
                page.pieces.append((-1, ""))

    def open_at(wanted) -> int:
        """Place in the stack of the nearest open element among wanted, within the scope; 0 if there is none."""
        for k in range(len(stack) - 1 if any(opened[w] for w in wanted) else 0, 0, -1):
            tag = tags[k]
            if tag in wanted:
                return k
            if tag in SCOPE:
                return 0
        return 0

    position = 0
    while m := _TAG.search(source, position):
        text(at, m.start())
        at = position = m.end()
        end, tag, rest = m[1], m[2], m[3]
        if not tag or not m[0].endswith(">"):
            continue
        tag = tag.lower()
        if end:
            for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if tags[k] == tag:
                    close(k)
                    break
            continue
        if tag not in IN_HEAD and tags[-1] == "head":
            close(len(stack) - 1)
        if dropped and tag in BLOCKS:
            while (k := len(stack) - 1) and tag in UNENDED.get(tags[k], ()):
                close(k)
        if tag in BLOCKS:
            if tag != "br" and (k := open_at({"p"})):
                close(k)
            page.pieces.append((-1, ""))
        if tag in IMPLIED and (k := open_at(IMPLIED[tag])):
            close(k)
        if tag in VOID or (rest.endswith("/") and tag not in BLOCKS and tag not in RAW):
            continue
        dropped += tag in DROPPED
        if dropped:
            stack.append(stack[-1])
        else:
            named = {a.lower(): b or c or d for a, b, c, d in _NAMES.findall(rest)} if "=" in rest else {}
            page.parents.append(stack[-1])
            page.tags.append(tag)
            page.names.append(" ".join(named.get(k, "") for k in ("class", "id", "role")).lower())
            page.labels.append(named.get("data-y", ""))
            stack.append(len(page.tags) - 1)
        tags.append(tag)
        opened[tag] += 1
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = position = stop.start() if stop else len(source)
    text(at, len(source))
    close(1)
    return page


def evidence(page: Page) -> list[list[str]]:
    """What is seen of each node."""
    n = len(page.tags)
    own, linked, ends = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = page.tags[k] == "a" or in_link[page.parents[k]]
    for k, t in page.pieces:
        if k >= 0:
            size = len(t.strip())
            own[k] += size
            linked[k] += size if in_link[k] else 0
            ends[k] += len(_ENDS.findall(t))
    total, links, marks = own[:], linked[:], ends[:]
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        total[p] += total[k]
        links[p] += links[k]
        marks[p] += marks[k]
    out = []
    for k in range(n):
        t = total[k]
        # text of its own makes another element of what is a mere frame otherwise
        bare = "+text" if page.tags[k] in OUTER and _bucket(own[k]) >= 3 else ""
        seen = ["tag=" + page.tags[k] + bare, f"own={_bucket(own[k])}", f"all={_bucket(t)}", f"links={_share(links[k], t)}", f"ends={min(4, marks[k] * 100 // t) if t else 'none'}"]
        seen += ["name=" + w for w in dict.fromkeys(_WORD.findall(page.names[k]))]
        out.append(seen)
    return out


def _bucket(size: int) -> int:
    return 0 if not size else 1 if size < 15 else 2 if size < 50 else 3 if size < 160 else 4


def _share(part: int, whole: int) -> str:
    return "none" if not whole else str(min(4, 5 * part // whole)) if part else "zero"


LABELS = ("boilerplate", "content", "frame")


@dataclass(frozen=True)
class Model:
    """seen: log likelihoods of what is seen under each label; root: chances of the root's label; child: of a child's label by the parent's, for blocks and for what runs in a line."""

    seen: dict[str, tuple[float, float, float]]
    root: tuple[float, float, float]
    child: tuple[tuple[tuple[float, float, float], ...], ...]


def marginals(page: Page, model: Model) -> list[float]:
    """Chance that each node is content, by messages up and down the tree."""
    n, parents, known = len(page.tags), page.parents, model.seen.get
    tables = [model.child[t not in BLOCKS] for t in page.tags]
    up: list[tuple[float, float, float]] = []  # local evidence, then times the messages of the children
    for seen in evidence(page):
        x = y = z = 0.0
        for s in seen:
            if (e := known(s)) is not None:
                x, y, z = x + e[0], y + e[1], z + e[2]
        top = max(x, y, z)
        up.append((math.exp(x - top), math.exp(y - top), math.exp(z - top)))
    to = [(1.0, 1.0, 1.0)] * n  # message to the parent
    for k in range(n - 1, 0, -1):
        x, y, z = up[k]
        (b0, b1, b2), (c0, c1, c2), (f0, f1, f2) = tables[k]
        m = x * b0 + y * b1 + z * b2, x * c0 + y * c1 + z * c2, x * f0 + y * f1 + z * f2
        to[k] = m
        p = up[parents[k]]
        x, y, z = p[0] * m[0], p[1] * m[1], p[2] * m[2]
        top = max(x, y, z) or 1.0
        up[parents[k]] = x / top, y / top, z / top
    belief = [(0.0, 1.0, 0.0)] * n
    belief[0] = _normal(*(u * r for u, r in zip(up[0], model.root)))
    for k in range(1, n):
        # the parent's belief without this child's message
        p, m = belief[parents[k]], to[k]
        x, y, z = p[0] / max(m[0], 1e-300), p[1] / max(m[1], 1e-300), p[2] / max(m[2], 1e-300)
        u = up[k]
        (b0, b1, b2), (c0, c1, c2), (f0, f1, f2) = tables[k]
        belief[k] = _normal(u[0] * (x * b0 + y * c0 + z * f0), u[1] * (x * b1 + y * c1 + z * f1), u[2] * (x * b2 + y * c2 + z * f2))
    return [b[1] for b in belief]


def _normal(x: float, y: float, z: float) -> tuple[float, float, float]:
    s = x + y + z
    return (x / s, y / s, z / s) if s > 0 else (0.5, 0.5, 0.0)


def main_text(source: str | None, model: Model) -> str:
    """The main text of a page: blanks of a block as one, blocks joined by one; '' for null, empty or none."""
    if not source:
        return ""
    page = parse(source)
    chance = marginals(page, model)
    kept = "".join(t if k >= 0 and chance[k] > 0.5 else " " if k < 0 else "" for k, t in page.pieces)
    return _BLANKS.sub(" ", kept).strip(" ")


# --- labelled pages


def _words(rng: random.Random, low: int, high: int) -> str:
    parts = "ta re mi on the an er is ou le de un al en st qu ch ie ra so".split()
    out = []
    for k in range(rng.randint(low, high)):
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append((w.capitalize() if not k else w) + (rng.choice(".,") if rng.random() < 0.12 else ""))
    return " ".join(out) + ("." if rng.random() < 0.8 else "")


def _el(tag: str, y: int, inner: str, name: str = "") -> str:
    attr = f' class="{name}"' if name else ""
    return f'<{tag} data-y="{y}"{attr}>{inner}</{tag}>'


def _links(rng: random.Random, n: int, y: int = 0) -> str:
    return _el("ul", y, "".join(_el("li", y, _el("a", y, _words(rng, 1, 3))) for _ in range(n)))


def _named(rng: random.Random, tags: str, names: str, bare: float = 0.0) -> tuple[str, str]:
    """A tag and a class; bare: how often a telling tag has no class."""
    tag = rng.choice(tags.split())
    return tag, "" if tag not in ("div", "section", "p", "span", "ul") and rng.random() < bare else rng.choice(names.split())


def _side(rng: random.Random, kind: str) -> str:
    if kind == "nav":
        tag, name = _named(rng, "nav nav div ul", "nav menu navbar navigation topmenu breadcrumb breadcrumbs", 0.7)
        return _el(tag, 0, _links(rng, rng.randint(2, 8)), name)
    if kind == "header":
        tag, name = _named(rng, "header header div", "header masthead site-header top branding", 0.6)
        return _el(tag, 0, _el(rng.choice(["div", "h1", "p", "span"]), 0, _words(rng, 1, 8), rng.choice(["", "logo", "title"])) + (_side(rng, "nav") if rng.random() < 0.5 else ""), name)
    if kind == "footer":
        tag, name = _named(rng, "footer footer div", "footer site-footer copyright bottom legal imprint", 0.7)
        inner = "&copy; " + _words(rng, 2, 14)
        return _el(tag, 0, inner if rng.random() < 0.5 else _el("p", 0, inner) + (_links(rng, 3) if rng.random() < 0.4 else ""), name)
    if kind == "ad":
        tag, name = _named(rng, "div div aside section p ins", "ad ads advert advertisement sponsored promo banner sponsor adbox", 0.1)
        inner = _words(rng, 3, 30)
        return _el(tag, 0, inner if rng.random() < 0.6 else _el("p", 0, inner) if rng.random() < 0.6 else _el("a", 0, inner), name)
    if kind == "notice":
        tag, name = _named(rng, "div div section aside p", "notice cookie cookies consent alert warning banner gdpr message popup modal paywall", 0.1)
        return _el(tag, 0, _el("p", 0, _words(rng, 4, 40)) if rng.random() < 0.6 else _words(rng, 4, 40), name)
    if kind == "sidebar":
        tag, name = _named(rng, "aside aside div section", "sidebar related widget rail recommended more trending popular teaser share social tags author-box", 0.6)
        return _el(tag, 0, _el(rng.choice(["h2", "h3", "p"]), 0, _words(rng, 1, 4)) + (_links(rng, rng.randint(2, 6)) if rng.random() < 0.6 else "".join(_el("p", 0, _words(rng, 5, 40)) for _ in range(rng.randint(1, 3)))), name)
    if kind == "comments":
        tag, name = _named(rng, "section div section ol ul", "comments comment-list discussion responses replies disqus reader-comments feedback", 0.0)
        one = lambda: _el(rng.choice(["div", "li", "article"]), 0, _el("p", 0, _words(rng, 5, 60)) + (_el("span", 0, _words(rng, 1, 2), "author") if rng.random() < 0.5 else ""), rng.choice("comment reply response message".split()))
        return _el(tag, 0, (_el(rng.choice(["h2", "h3"]), 0, _words(rng, 1, 3)) if rng.random() < 0.7 else "") + "".join(one() for _ in range(rng.randint(1, 5))), name)
    inner = _el("label", 0, _words(rng, 1, 6)) + '<input name="q">' + (_el("p", 0, _words(rng, 4, 20)) if rng.random() < 0.5 else "")
    return _el("form", 0, inner, rng.choice(["", "search", "newsletter", "subscribe", "login", "signup", "contact"]))


def _article(rng: random.Random) -> str:
    out = [_el("h1", 1, _words(rng, 2, 12))] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 9)):
        r, long_ = rng.random(), _words(rng, 1, 120)
        if r < 0.62:
            inline = rng.random()
            if inline < 0.15:
                long_ += " " + _el(rng.choice(["b", "i", "em", "strong", "span", "code"]), 1, _words(rng, 1, 40)) + " " + _words(rng, 1, 20)
            elif inline < 0.3:
                long_ += " " + _el("a", 1, _words(rng, 1, 6)) + " " + _words(rng, 1, 20)
            elif inline < 0.4:
                long_ = _el("b", 1, long_)
            out.append(_el("p", 1, long_))
        elif r < 0.7:
            out.append(_el(rng.choice(["h2", "h3", "h4"]), 1, _words(rng, 1, 8)))
        elif r < 0.77:
            out.append(_el(rng.choice(["ul", "ol"]), 1, "".join(_el("li", 1, _words(rng, 1, 25)) for _ in range(rng.randint(1, 5)))))
        elif r < 0.81:
            out.append(_el("blockquote", 1, _el("p", 1, long_) if rng.random() < 0.5 else long_))
        elif r < 0.84:
            out.append(_el("table", 1, "".join(_el("tr", 1, "".join(_el("td", 1, _words(rng, 1, 6)) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
        elif r < 0.87:
            out.append(_el("pre", 1, _words(rng, 3, 40)))
        elif r < 0.9:
            out.append(_el("figure", 1, "<img src=x>" + _el("figcaption", 1, _words(rng, 2, 12))))
        elif r < 0.93:
            out.append(_el(rng.choice(["div", "section"]), 1, _el("p", 1, long_), rng.choice(["", "text", "paragraph", "section", "body"])))
        else:
            out.append(_side(rng, rng.choice(["ad", "ad", "notice", "sidebar", "form", "nav"])))
    return "".join(out)


def _bare(rng: random.Random) -> str:
    """A page whose article has no element of its own: text and line breaks in the body, or in no element at all."""
    text = rng.choice(["<br>", "<br><br>", "\n", "<hr>"]).join(_words(rng, 4, 120) for _ in range(rng.randint(1, 8)))
    if rng.random() < 0.3:
        return text
    sides = [_side(rng, k) if rng.random() < 0.25 else "" for k in ("header", "nav", "footer")]
    return f'<html data-y="2"><head data-y="0"><title data-y="0">{_words(rng, 1, 6)}</title></head><body data-y="1">{sides[0]}{sides[1]}{text}{sides[2]}</body></html>'


def labelled_page(rng: random.Random) -> str:
    if rng.random() < 0.08:
        return _bare(rng)
    tag, name = _named(rng, "article article article main div div div section", "content article post entry story main article-body post-content entry-content text body-text page-content", 0.7)
    inner = _article(rng)
    if rng.random() < 0.15:
        inner += _side(rng, "comments")
    body = inner if rng.random() < 0.07 else _el(tag, 1, inner, name)
    if rng.random() < 0.2:
        body = _el("main", 2, body + (_side(rng, "comments") if rng.random() < 0.5 else ""))
    before = [_side(rng, k) for k in ("header", "nav", "notice", "ad", "sidebar", "form") if rng.random() < 0.4]
    after = [_side(rng, k) for k in ("comments", "sidebar", "ad", "form", "nav", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    page = "".join(before) + body + "".join(after)
    if rng.random() < 0.4:
        page = _el("div", 2, page, rng.choice(["", "wrap", "wrapper", "container", "page", "site", "row", "layout", "root"]))
    return f'<html data-y="2"><head data-y="0"><title data-y="0">{_words(rng, 1, 6)}</title></head><body data-y="2">{page}</body></html>'


def train(pages: list[str]) -> Model:
    """Counts over pages whose elements carry their label's number in data-y."""
    seen: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5, 0.5])
    child = [[[0.5] * 3 for _ in LABELS] for _ in range(2)]
    nodes, root = [1.0] * 3, [0.5] * 3
    for source in pages:
        page = parse(source)
        labels = [int(y or 2) for y in page.labels]
        if any(k == 0 and not t.isspace() for k, t in page.pieces):  # text in no element
            labels[0] = 1
        root[labels[0]] += 1
        for k, e in enumerate(evidence(page)):
            nodes[labels[k]] += 1
            for s in e:
                seen[s][labels[k]] += 1
            if k:
                child[page.tags[k] not in BLOCKS][labels[page.parents[k]]][labels[k]] += 1
    logs = {}
    for s, counts in seen.items():
        # sizes and shares of a node hang together: they count half
        weight = 1.0 if s.startswith(("tag=", "name=")) else 0.5
        logs[s] = tuple(weight * math.log(c / m) for c, m in zip(counts, nodes))
    return Model(logs, tuple(r / sum(root) for r in root), tuple(tuple(tuple(c / sum(row) for c in row) for row in table) for table in child))


@lru_cache(maxsize=1)
def default_model() -> Model:
    rng = random.Random(SEED)
    return train([labelled_page(rng) for _ in range(TRAINING_PAGES)])


def extract(source: Column, model: Model | None = None) -> Column:
    """The main text of whole html. Null, empty and pages without any give ''. Pages may be very long: the time grows in
    proportion. A page depends on itself alone: repeated rows get equal texts, an empty table gives none, and other columns are not
    looked at. A node that is as likely content as not is left out.
    """
    model = model or default_model()

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, model) for p in pages], dtype="object")

    return run(source)
