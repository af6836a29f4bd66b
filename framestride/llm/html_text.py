"""Operator 13, HTML extraction: composite text density.

A page becomes a tree of elements in page order. Boilerplate that names itself
(menus, page headers, footers, asides, forms, adverts, notices, comments, hidden
parts, scripts) is set aside first. Every other element has a density: characters
for each tag, adjusted by the share of characters and tags that stand in links
(Sun, Song and Liao, SIGIR 2011). The element with the largest sum of its children's
densities is the core of the article; its own text counts as a child. The lowest
density on the way from there to the body is the threshold: while most of the text
beside the core reaches it, the parent is taken as a whole, otherwise only the
neighbours that reach it. All that the chosen elements hold is text of the article.

A page is one row and is read whole; pages are independent, so nothing is shuffled.
Parsing and all walks take time in proportion to the page, however deep or broken.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framestride.llm.common import pick, table

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that don't part the text around them into blocks.
FLOWS = INLINE | frozenset("script style template noscript svg canvas object audio video iframe button select input textarea datalist label output progress meter math".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: Elements that end an open one of their family, and what shelters an outer one from that.
FAMILY = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option", "thead": "rows", "tbody": "rows", "tfoot": "rows"}
SHELTER = {
    "table": ("p", "li", "dd", "tr", "td", "rows"), "td": ("p", "li", "dd"), "th": ("p", "li", "dd"), "caption": ("p", "li", "dd"), "tr": ("td",), "thead": ("tr", "td"), "tbody": ("tr", "td"), "tfoot": ("tr", "td"),
    "ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dd",), "button": ("p",), "object": ("p", "li", "dd"), "select": ("option",), "article": ("li", "dd"), "section": ("li", "dd"), "blockquote": ("li", "dd")}
FAMILIES = ("p", "li", "dd", "tr", "td", "option", "rows")

# What is never part of an article, by element, by role, and by a word of the class or id.
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg canvas object audio video button select input datalist dialog nav footer aside menu".split())
#: Dropped too, unless the article stands inside.
DOUBTFUL = frozenset(["form", "header", "fieldset"])
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class or an id; ids are anchors of sections too, so fewer words count there.
IN_IDS = frozenset(
    """ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos banner sidebar sidebars nav navbar navigation menu
    breadcrumb breadcrumbs pagination header masthead topbar footer colophon cookie cookies consent gdpr notice newsletter comments commentlist disqus respond""".split())
MARKS = IN_IDS | frozenset(
    """promotion promoted banners aside rail menus submenu pager toc copyright notices alert alerts popup modal overlay lightbox subscribe subscription signup signin login
    paywall share sharing social related recommended recommendations trending popular comment reply replies form search widget widgets toolbar skip hidden""".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

NAME = re.compile(r"[a-zA-Z][^\s/>\0]*")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:>|([^\s/>=]=*[^\s/>=]*)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>]*))?)?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: The least base of the logarithm that adjusts a density for links.
LEAST_BASE = 2.0
#: Share of link characters from which a list of several links inside the article is a menu.
LINKED, LINKS = 0.8, 3


@dataclass
class Tree:
    """Elements in page order: an element's descendants follow it up to ``end``. Text belongs to the element that holds it."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    attributes: list[dict] = field(default_factory=list)
    #: (element, number of elements that began before, text) in page order
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def read_attributes(page: str, at: int) -> tuple[dict, int]:
    """Attributes of a start tag from the end of its name, and the place after the tag; -1 where it never ends."""
    out: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if m.end() == at:
            if at >= len(page):
                return out, -1
            at += 1  # a stray sign
            continue
        at = m.end()
        if m[1] is None:
            if page[at - 1] == ">":
                return out, at
            if at >= len(page):
                return out, -1
            continue
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(m[1].lower(), value)


def parse(page: str) -> Tree:
    """The tree of a page; end tags that are left out are implied, those without a start are ignored."""
    t = Tree()
    stack: list[int] = []
    opened: dict[str, int] = {}
    # for each family, places in the stack of open elements; -1 where a shelter begins
    family: dict[str, list[int]] = {f: [-1] for f in FAMILIES}

    def push(tag: str, attributes: dict) -> None:
        t.tag.append(tag)
        t.parent.append(stack[-1] if stack else -1)
        t.end.append(0)
        t.attributes.append(attributes)
        stack.append(len(t.tag) - 1)
        opened[tag] = opened.get(tag, 0) + 1
        if (f := FAMILY.get(tag)) is not None:
            family[f][-1] = len(stack) - 1
        for f in SHELTER.get(tag, ()):
            family[f].append(-1)

    def pop() -> None:
        i = stack.pop()
        tag = t.tag[i]
        t.end[i] = len(t.tag)
        opened[tag] -= 1
        for f in SHELTER.get(tag, ()):
            family[f].pop()
        if (f := FAMILY.get(tag)) is not None and family[f][-1] >= len(stack):
            family[f][-1] = -1

    def cut(depth: int) -> None:
        while len(stack) > depth:
            pop()

    def leave_head() -> None:
        if opened.get("head"):
            while t.tag[stack[-1]] != "head":
                pop()
            pop()

    def text(s: str) -> None:
        if s and not (opened.get("head") and s.isspace()):
            leave_head()
            t.texts.append((stack[-1], len(t.tag), s))

    push("#page", {})
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?" or (nxt == "/" and not NAME.match(page, lt + 2)):
            text(page[at:lt])
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
            elif page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = size if close < 0 else close + 3
            else:
                close = page.find(">", lt + 1)
                at = size if close < 0 else close + 1
            continue
        name = NAME.match(page, lt + (2 if nxt == "/" else 1))
        if name is None:
            # a plain sign
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        tag = name[0].lower()
        attributes, at = read_attributes(page, name.end())
        if at < 0:
            break  # the page ends within a tag
        if nxt == "/":
            if tag in ("html", "body"):
                continue  # what follows still belongs to the page
            if (f := FAMILY.get(tag)) is not None:
                # not beyond the cell or list around
                if family[f][-1] >= 0 and t.tag[stack[family[f][-1]]] == tag:
                    cut(family[f][-1])
            elif opened.get(tag):
                while t.tag[stack[-1]] != tag:
                    pop()
                pop()
            continue
        if tag in ("html", "body", "head") and opened.get(tag):
            continue
        if tag not in IN_HEAD:
            leave_head()
        if tag in ENDS_P and family["p"][-1] >= 0:
            cut(family["p"][-1])
        own = FAMILY.get(tag)
        if own == "rows":
            for f in ("td", "tr", "rows"):
                if family[f][-1] >= 0:
                    cut(family[f][-1])
        elif own == "tr":
            for f in ("td", "tr"):
                if family[f][-1] >= 0:
                    cut(family[f][-1])
        elif own is not None and family[own][-1] >= 0:
            cut(family[own][-1])
        push(tag, attributes)
        if tag in VOID:
            pop()
        elif tag in RAW:
            stop = RAW_END[tag].search(page, at)
            at = size if stop is None else stop.start()
            if stop is None:
                pop()
    cut(0)
    return t


def marks_of(attributes: dict) -> set[str]:
    """Words of class and id that name boilerplate: ``topAd site-header`` has ad and header."""
    found: set[str] = set()
    for key, known in (("class", MARKS), ("id", IN_IDS)):
        if attributes.get(key):
            found.update(known.intersection(w.lower() for w in WORDS.findall(attributes[key])))
    return found


def boilerplate(t: Tree) -> list[bool]:
    """Whether each element is set aside, itself or by an element around it."""
    n = len(t.tag)
    own = [marks_of(a) if a else set() for a in t.attributes]
    # elements that show where an article is; what holds them is no boilerplate by its name alone
    sign = [t.tag[i] in ("main", "h1") or (t.tag[i] == "article" and not own[i] & COMMENTS) or t.attributes[i].get("itemprop", "").lower() == "articlebody" for i in range(n)]
    holds = [0] * (n + 1)
    for i in range(n):
        holds[i + 1] = holds[i] + sign[i]
    out, within = [False] * n, [False] * n
    for i in range(n):
        tag, a, p = t.tag[i], t.attributes[i], t.parent[i]
        within[i] = (p >= 0 and within[p]) or tag in ("article", "main")
        if p >= 0 and out[p]:
            out[i] = True
            continue
        article_inside = holds[t.end[i]] > holds[i + 1]
        if tag in DROPPED:
            out[i] = True
        elif tag in ("#page", "html", "body", "main", "h1"):
            continue
        elif "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
            out[i] = True
        elif tag == "article":
            out[i] = bool(own[i] & COMMENTS)
        elif tag == "header" and within[i]:
            # the head of an article, not of the page
            out[i] = not any(t.tag[j] in HEADINGS for j in range(i + 1, t.end[i]))
        elif tag in HEADINGS or (tag in INLINE and tag != "a"):
            # a heading's class tells its rank, and code is coloured by inline classes
            out[i] = bool(own[i] & COMMENTS) if tag in HEADINGS else bool(own[i] - COMMENTS)
        elif tag in DOUBTFUL or a.get("role", "").lower() in ROLES or own[i]:
            out[i] = not article_inside
    return out


def squeezed(s: str) -> str:
    return " ".join(s.split())


@dataclass
class Measures:
    """Characters and tags below each element, all and in links; for all elements, set aside or not, only those kept count."""

    chars: list[int]
    link_chars: list[int]
    tags: list[int]
    link_tags: list[int]
    own: list[int]
    density: list[float]
    total: list[float]


def measure(t: Tree, out: list[bool], plain: list[tuple[int, int, str]]) -> Measures:
    n = len(t.tag)
    chars, link_chars, tags, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(n):
        in_link[i] = t.tag[i] == "a" or (t.parent[i] >= 0 and in_link[t.parent[i]])
    all_chars = all_links = 0
    for i, _, s in plain:
        size = len(squeezed(s))
        all_chars += size
        all_links += size if in_link[i] else 0
        if not out[i]:
            own[i] += size
            chars[i] += size
            link_chars[i] += size if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        if not out[i]:
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (t.tag[i] == "a")
    # the share of links in the page as it came, menus included
    share = all_links / all_chars if all_chars else 0.0

    def density(c: int, lc: int, tg: int, lt: int) -> float:
        if not c:
            return 0.0
        base = max(LEAST_BASE, math.log(c / max(1, c - lc) * lc + share * c + math.e))
        return c / max(1, tg) * max(0.0, math.log(c / max(1, lc) * max(1, tg) / max(1, lt))) / math.log(base)

    own_density = [density(own[i], own[i] if in_link[i] else 0, 1, 1 if in_link[i] else 0) for i in range(n)]
    dense = [0.0 if out[i] else density(chars[i], link_chars[i], tags[i], link_tags[i]) for i in range(n)]
    total = list(own_density)
    for i in range(1, n):
        if not out[i]:
            total[t.parent[i]] += dense[i]
    return Measures(chars, link_chars, tags, link_tags, own, dense, total)


def chosen(t: Tree, out: list[bool], m: Measures) -> list[int]:
    """The elements whose texts are the article, in page order."""
    scope = range(len(t.tag))
    for kind in ("article", "main"):
        named = [i for i in range(len(t.tag)) if t.tag[i] == kind and not out[i] and m.chars[i]]
        if named and all(i < t.end[named[0]] for i in named):
            scope = range(named[0], t.end[named[0]])  # the page says which element it is
            break
    best = max((i for i in scope if not out[i]), key=lambda i: (m.total[i], -i))
    path = [best]
    while t.parent[path[-1]] >= 0 and t.tag[path[-1]] != "body":
        path.append(t.parent[path[-1]])
    limit = min(m.density[i] for i in path)
    beside: dict[int, list[int]] = {i: [] for i in path}
    for i in range(1, len(t.tag)):
        if not out[i] and m.chars[i] and t.parent[i] in beside:
            beside[t.parent[i]].append(i)
    named = [i for kind in ("article", "main") for i in reversed(path) if t.tag[i] == kind]
    core, more = (named or [best])[0], set()
    for below, up in zip(path, path[1:], strict=False):
        if up >= core:
            continue  # inside a named article
        others = [i for i in beside[up] if i != below]
        dense = [] if named else [i for i in others if m.density[i] >= limit and m.link_chars[i] * 2 <= m.chars[i]]
        if core == below and not named and sum(m.chars[i] for i in dense) * 2 >= m.chars[up] - m.chars[below]:
            core = up  # what stands beside is mostly of the article's kind
        else:
            more.update(dense)
            more.update(i for i in others if t.tag[i] in HEADINGS and i < core)
    return sorted({core, *more})


def menus(t: Tree, m: Measures, i: int) -> bool:
    """A list or block inside the article that is all but links."""
    return t.tag[i] in ("ul", "ol", "div", "table", "dl", "section") and m.link_tags[i] >= LINKS and m.link_chars[i] >= LINKED * m.chars[i]


def main_text(page: str | None) -> str:
    """The article of a page: blocks joined by empty lines; empty where there is none."""
    if not page:
        return ""
    t = parse(page)
    n = len(t.tag)
    out = boilerplate(t)
    plain = [(i, begun, html.unescape(s)) for i, begun, s in t.texts]
    m = measure(t, out, plain)
    if not m.chars[0]:
        return ""
    take = [False] * n
    for i in chosen(t, out, m):
        take[i] = True
    block = [0] * n
    for i in range(1, n):
        p = t.parent[i]
        block[i] = block[p] if t.tag[i] in FLOWS else i
        out[i] = out[i] or out[p] or (take[p] and menus(t, m, i))
        take[i] = take[i] or take[p]
    blocks: list[list[str]] = []
    last, seen = None, 0
    for i, begun, s in plain:
        if not take[i] or out[i]:
            continue
        between = range(seen, begun)
        if block[i] != last or any(block[j] == j for j in between):
            blocks.append([])
        elif any(t.tag[j] == "br" for j in between):
            blocks[-1].append(" ")
        blocks[-1].append(s)
        last, seen = block[i], begun
    return "\n\n".join(x for x in (squeezed("".join(parts)) for parts in blocks) if x)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page.

    Null and empty html, and pages without text, have an empty text; very long and
    very deep pages are read whole; ties between elements go to the outer one;
    repeated rows and null ids are rows like others; an empty table gives none;
    further columns don't matter.
    """
    return extracted(pick(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
