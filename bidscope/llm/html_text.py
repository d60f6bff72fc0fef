"""Main text of web pages by composite text density.

A page becomes a tree of elements, built as browsers do it for unclosed and misnested tags (``Page``). Elements that never hold the
article (menus, footers, forms, scripts and so on, by tag, role or name) are left out. For every other element the composite text
density is the characters per tag, raised where few of them are links:

    C / T * log_B(C / LC * T / LT),   B = ln(C / (C - LC) * LC + LCb / Cb * C + e)

with C characters, T tags, LC characters and LT tags of links in the element, and LCb, Cb those of the body. An element's density sum
adds up the densities of its children. The subtree of the largest sum is the main text; headings and parts of similar weight
beside it are taken along where they reach the threshold, the smallest density on the path from that subtree to the body. A page's only
``article`` or ``main`` element is taken whole where it holds a third of the page's text.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Fixed values of HTML: elements without content, with raw text, that close a paragraph, that bound a search for an open element.
VOID = names("area base br col embed hr img input link meta param source track wbr")
RAW = names("script style textarea title iframe noembed noframes")
IN_HEAD = names("base link meta noscript script style template title")
HEADINGS = names("h1 h2 h3 h4 h5 h6")
BLOCKS = HEADINGS | names("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr "
                          "html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul")
KEEP_P = names("body caption html legend optgroup option tbody td tfoot th thead tr")
SCOPE = names("caption html marquee object table td template th")
#: A new element of the first kind closes open ones of the second, up to an element of the third.
IMPLIED = {name: (names(closed), names(stop)) for some, closed, stop in (
    ("li", "li", "ul ol menu table td th"), ("dd dt", "dd dt", "dl table td th"), ("option", "option", "select datalist"), ("optgroup", "option optgroup", "select"),
    ("tr", "tr td th caption", "table"), ("td th", "td th", "tr table"), ("tbody thead tfoot", "tbody thead tfoot tr td th caption", "table"), ("a", "a", "table td th"))
    for name in some.split()}

#: Elements that are never part of an article.
NEVER = RAW | names("head nav footer aside button select option optgroup datalist label input template noscript object embed applet canvas svg math audio video menu dialog search")
NEVER_ROLES = names("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search")
#: Words of a class or id that name what is not the article.
NOISE = names("ad ads advert advertisement advertising adverts aside banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disclaimer disqus "
              "discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion "
              "recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets")
#: Such words mark reader comments whatever their share of the page; others don't where the element holds half of the text.
COMMENTS = names("comment comments disqus discussion replies respond")
#: Next to these words a header is that of the article.
OF_ARTICLE = names("article entry post story content main page title")
LISTS = names("ul ol dl div section table")


class Page:
    """Elements of a page by number, parents before children, and the runs of text with their element and block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes = ["#page"], [-1], [""]
        self.runs: list[tuple[int, int, str]] = []  # element, block, text
        self.block = 0
        self.open = [0]
        self.seen: set[str] = set()
        self.read(html)

    def read(self, html: str) -> None:
        at = 0
        while at < len(html):
            m = TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                return
            if m.start() > at:
                self.text(html[at:m.start()])
            at = m.end()
            if m[1]:
                self.end(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                self.start(tag, m[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else len(html)
                    self.close(len(self.open) - 1)

    def text(self, raw: str) -> None:
        if raw.strip() and self.tag[self.open[-1]] == "head":
            self.close(len(self.open) - 1)
        self.runs.append((self.open[-1], self.block, unescape(raw) if "&" in raw else raw))

    def close(self, place: int) -> None:
        """Close the open element at ``place`` and all in it."""
        if any(self.tag[x] in BLOCKS for x in self.open[place:]):
            self.block += 1
        del self.open[place:]

    def find(self, tags, stop) -> int:
        """Place of the innermost open element of ``tags`` inside the innermost one of ``stop``; 0 without one."""
        for place in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[place]]
            if tag in tags:
                return place
            if tag in stop:
                return 0
        return 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.runs.append((self.open[-1], self.block, " "))
            return
        if tag in ("html", "head", "body"):
            if tag in self.seen:
                return
            self.seen.add(tag)
        if tag not in IN_HEAD and self.tag[self.open[-1]] == "head":
            self.close(len(self.open) - 1)
        if tag in BLOCKS:
            if tag not in KEEP_P and (place := self.find({"p"}, SCOPE | {"button"})):
                self.close(place)
            self.block += 1
        if tag in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
            self.close(len(self.open) - 1)
        if tag in IMPLIED:
            closed, stop = IMPLIED[tag]
            while place := self.find(closed, stop):
                self.close(place)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.attributes.append(attributes)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if tag in ("html", "body", "br") or tag in VOID:
            return
        stop = BLOCKS | SCOPE if tag not in BLOCKS else {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else SCOPE - {"table"} if tag == "table" else SCOPE
        if tag == "li":
            stop = SCOPE | {"ul", "ol", "menu"}
        if tag in HEADINGS:
            place = self.find(HEADINGS, stop)
        else:
            place = self.find({tag}, stop - {tag})
        if place:
            self.close(place)


def attribute_words(raw: str) -> tuple[str, set[str], bool]:
    """Role, the words of class and id, and whether the element is hidden."""
    role, words, hidden = "", set(), False
    for key, value in ATTRIBUTE.findall(raw):
        key, value = key.lower(), unescape(value.strip("\"'"))
        if key == "role":
            role = value.strip().lower()
        elif key in ("class", "id"):
            words.update(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return role, words, hidden


class Density:
    """Characters and tags of the elements that are not left out, their densities and density sums."""

    def __init__(self, page: Page):
        self.page = page
        n = len(page.tag)
        self.size = [0] * n  # characters of an element's own runs, then of its subtree
        for node, _, text in page.runs:
            self.size[node] += len("".join(text.split()))
        whole = list(self.size)
        for x in range(n - 1, 0, -1):
            whole[page.parent[x]] += whole[x]
        visible = whole[0] - sum(whole[x] for x in range(1, n) if page.tag[x] == "head" or page.tag[x] in RAW)
        self.out = [False] * n
        self.role = [""] * n
        inside = [False] * n  # an article or main element
        around = [False] * n  # has one inside
        for x in range(n - 1, 0, -1):
            around[page.parent[x]] |= around[x] or page.tag[x] in ("article", "main")
        for x in range(1, n):
            up, tag = page.parent[x], page.tag[x]
            self.role[x], words, hidden = attribute_words(page.attributes[x]) if page.attributes[x].strip() else ("", set(), False)
            inside[x] = inside[up] or tag in ("article", "main")
            large = 2 * whole[x] > visible
            noise = words & NOISE
            if noise <= {"header", "banner"} and (inside[x] or words & OF_ARTICLE):
                noise = set()
            if tag in ("html", "body", "article", "main") or around[x]:
                noise = set()
            self.out[x] = (self.out[up] or tag in NEVER or hidden and not large or self.role[x] in NEVER_ROLES and not around[x] or tag == "header" and not inside[x] and not large
                           or tag == "form" and not large and not around[x] or bool(noise) and (not large or bool(noise & COMMENTS)))
        links = [page.tag[x] == "a" for x in range(n)]
        for x in range(1, n):
            links[x] |= links[page.parent[x]]
        self.size = [0 if o else s for o, s in zip(self.out, self.size)]
        self.link = [s if a else 0 for s, a in zip(self.size, links)]
        self.tags = [0] * n
        self.link_tags = [0] * n
        for x in range(n - 1, 0, -1):
            if not self.out[x]:
                up = page.parent[x]
                self.size[up] += self.size[x]
                self.link[up] += self.link[x]
                self.tags[up] += self.tags[x] + 1
                self.link_tags[up] += self.link_tags[x] + (page.tag[x] == "a")
        self.value = [self.density(x) for x in range(n)]
        self.sum = [0.0] * n
        for x in range(1, n):
            self.sum[page.parent[x]] += self.value[x]

    def density(self, x: int) -> float:
        c, t, lc, lt = self.size[x], max(self.tags[x], 1), self.link[x], self.link_tags[x]
        if not c:
            return 0.0
        if not self.link[0]:  # without links on the page the base is 1: plain characters per tag
            return c / t
        base = math.log(c / max(c - lc, 1) * lc + self.link[0] / self.size[0] * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(base)

    def below(self, x: int) -> set[int]:
        """``x`` and the elements in it that are not left out."""
        found = {x}
        for y in range(x + 1, len(self.out)):
            if self.page.parent[y] in found and not self.out[y]:
                found.add(y)
        return found

    def chosen(self) -> set[int]:
        """The elements whose own text is main text."""
        page, n = self.page, len(self.out)
        marked = [x for x in range(1, n) if not self.out[x] and (page.tag[x] in ("article", "main") or self.role[x] in ("article", "main"))]
        for only in (["article"], ["main"]):
            found = [x for x in marked if page.tag[x] in only or self.role[x] in only]
            outer = [x for x in found if not any(y in found for y in self.path(page.parent[x]))]
            if len(outer) == 1 and 3 * self.size[outer[0]] >= self.size[0]:
                return self.without_link_lists(self.below(outer[0]))
        body = next((x for x in range(1, n) if page.tag[x] == "body"), 0)
        inside = [x for x in range(n) if not self.out[x] and self.size[x]]
        if not inside:
            return set()
        best = max(inside, key=lambda x: (self.sum[x], -x))
        if not self.sum[best]:  # text without any element around it
            return self.below(body if self.size[body] == self.size[0] else 0)
        path = self.path(best)
        threshold = min(self.value[x] for x in path if x != 0) if best else 0.0
        keep = self.below(best)
        for x in inside:
            if page.parent[x] in path[1:] and x not in path and self.value[x] >= threshold and (page.tag[x] in ("h1", "h2") and x < best or 2 * self.sum[x] >= self.sum[best]):
                keep |= self.below(x)
        return self.without_link_lists(keep)

    def path(self, x: int) -> list[int]:
        out = []
        while x >= 0:
            out.append(x)
            x = self.page.parent[x]
        return out

    def without_link_lists(self, keep: set[int]) -> set[int]:
        """Without lists and boxes that are nearly all links."""
        gone: set[int] = set()
        for x in sorted(keep):
            if self.page.parent[x] in gone or self.page.tag[x] in LISTS and self.link_tags[x] >= 3 and 5 * self.link[x] > 4 * self.size[x]:
                gone.add(x)
        return keep - gone


def main_text(html: str | None) -> str:
    """The main text of a page, a line for each block."""
    if not html:
        return ""
    page = Page(html)
    keep = Density(page).chosen()
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.runs:
        if node in keep:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_text(df: DataFrame, html_col: str = "html", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """Add the main text of each page (``text_col``) and its number of code points (``n_chars_col``, long).

    Character references are decoded, white space inside a block becomes one space, and the blocks of the main text are joined in
    page order by one line feed; nothing else is dropped or cut. A line break element counts as white space. A null or empty page, and
    one without main text, has an empty text; text without markup is taken as it is, as one block. Pages are independent of each other, so
    repeated rows have equal results. Columns with the new names are replaced, others are kept; an empty table stays empty.
    """

    def make():
        def work(b):
            texts = [main_text(x) for x in b.column(html_col).to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

        return work

    return add_columns(df, [T.StructField(text_col, T.StringType()), T.StructField(n_chars_col, T.LongType())], make)
