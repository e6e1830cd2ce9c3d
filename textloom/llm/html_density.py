"""Main text of web pages by composite text density.

Each page becomes a table of DOM nodes in page order. A node's density is its characters per tag, raised
where few of them are links and lowered where the node has a larger share of links than the page. The
node whose children's densities sum highest marks the article, and the lowest density on its path to the
body is the threshold: from the body down, only nodes at or above it are looked into, and the node of largest sum
in each of them is text. Paragraphs and headings beside the path to the densest node belong to it, but not a
page's own beside a box that holds the article. An article element around that node settles its borders. Navigation, forms, adverts and comments are taken out
beforehand by their elements and names, so that they add no density.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
STATE = re.compile(r"(?:no|has|have|with|without|hide|show|is|js)[-_]", re.I)  # says how a page is laid out
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output "
    "q s samp small span strike strong sub sup time tt u var wbr".split()
)
# elements that are never part of an article's text
NOISE_TAGS = frozenset(
    "head script style noscript template iframe object embed applet canvas svg math audio video map "
    "nav menu footer button select option datalist textarea input".split()
)
# elements that are as a rule no part of it, but may stand around it
WRAPPERS = frozenset("form fieldset aside dialog".split())
WRAPPER_NAMES = frozenset("form aside dialog complementary".split())  # names that say no more than the element does
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# words of class and id names
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored "
    "sponsors promo promos promotion promotions breadcrumb breadcrumbs menu menus nav navbar navigation navi "
    "sidebar sidebars side aside footer footers masthead toolbar pagination pager cookie cookies consent gdpr notice "
    "notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist discussion disqus reply "
    "replies respond widget widgets search form hidden skip toc".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure fieldset".split())  # beside the article, a part of it
KEEP_TAGS = frozenset(["html", "body", "article", "main"])
CLOSED_BY_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Page:
    """The DOM of one page as parallel lists, and its text runs with the node that holds them."""

    def __init__(self, html: str):
        self.tag, self.parent, self.noise, self.named = ["#root"], [-1], [False], [False]
        self.runs: list[tuple[int, str]] = []  # (node, text); a negative node ends a block
        self.body = 0
        self._read(html)

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        noise, named = tag in NOISE_TAGS, False
        said = WRAPPER_NAMES if tag in WRAPPERS else frozenset()
        if attributes and tag not in KEEP_TAGS:
            for key, a, b, c, hidden in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key == "role" and value.lower() in NOISE_ROLES - said or hidden or key == "aria-hidden" and value == "true":
                    named = True
                elif key in ("class", "id") and not named:
                    names = (n for n in value.split() if not STATE.match(n))
                    named = any(not (NOISE_WORDS - said).isdisjoint(map(str.lower, WORD.findall(n))) for n in names)
        self.noise.append(noise)
        self.named.append(named)
        if tag == "body" and not self.body:
            self.body = node
        return node

    def _read(self, html: str) -> None:
        stack, open_tags, at, end = [0], {}, 0, html.rfind(">") + 1
        runs = self.runs

        def close(depth: int) -> None:
            while len(stack) > depth:
                open_tags[self.tag[stack.pop()]] -= 1

        def text(upto: int) -> None:
            if upto > at:
                runs.append((stack[-1], html[at:upto]))

        while True:
            found = TAG.search(html, at, end)
            if found is None:
                break
            text(found.start())
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            tag, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
            if tag not in INLINE:
                runs.append((-1, ""))
            if tag == "br":
                runs.append((stack[-1], " "))
                continue
            if closing:
                if open_tags.get(tag):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
                continue
            if tag not in INLINE and open_tags.get("p"):
                depth = len(stack) - 1
                while depth and self.tag[stack[depth]] in INLINE:
                    depth -= 1
                if self.tag[stack[depth]] == "p":
                    close(depth)
            if tag in CLOSED_BY_SELF and open_tags.get(tag):
                depth = len(stack) - 1
                while self.tag[stack[depth]] != tag and self.tag[stack[depth]] not in CLOSED_BY_SELF[tag]:
                    depth -= 1
                if self.tag[stack[depth]] == tag:
                    close(depth)
            node = self._add(tag, attributes, stack[-1])
            if tag in RAW:
                after = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at) if not attributes.endswith("/") else None
                if after is None and not attributes.endswith("/"):
                    at = len(html)
                    break
                at = after.end() if after else at
            elif tag not in VOID and not attributes.endswith("/"):
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        tail = html.find("<", at)
        while tail >= 0 and not re.match(r"[a-zA-Z/!?]", html[tail + 1 : tail + 2] or "<"):
            tail = html.find("<", tail + 1)
        text(len(html) if tail < 0 else tail)


def _marked(page: Page, noise: list[bool], densities: list[float], sums: list[float], path: list[int], threshold: float, linked: list[bool]) -> set[int]:
    """The roots of the main text: from the body down, through nodes at or above the threshold, the node of
    largest sum in each of them; and the paragraphs and headings that stand beside the densest node's path."""
    tag, parent, size = page.tag, page.parent, len(page.tag)
    top = list(range(size))  # the node of largest sum in each subtree, the outermost of equal ones
    for i in range(size - 1, 0, -1):
        if not noise[i] and tag[i] not in INLINE and sums[top[i]] >= sums[top[parent[i]]] and sums[top[i]] > sums[parent[i]]:
            top[parent[i]] = top[i]
    start, roots, passed, way = path[-1], {path[0]}, [False] * size, set(path)
    for i in range(start, size):
        passed[i] = i == start or (passed[parent[i]] and densities[i] >= threshold and not noise[i] and tag[i] not in INLINE)
        if passed[i] and i not in way:
            roots.add(top[i])
        beside = parent[i] in way and parent[i] != path[0] and (parent[i] != start or parent[path[0]] == start)
        if beside and i not in way and tag[i] in TEXT_TAGS and not noise[i] and not linked[i]:
            roots.add(i)
    return roots


def main_text(html: str | None) -> str:
    """The article's blocks, one per line; empty where a page (null, empty, or markup only) has none."""
    if not html:
        return ""
    page = Page(html)
    tag, parent, size = page.tag, page.parent, len(page.tag)
    runs = [(n, " ".join(unescape(t).split()) if n >= 0 else "", t) for n, t in page.runs]

    own = [0] * size
    for n, clean, _ in runs:
        if n >= 0:
            own[n] += len(clean)
    linked = [False] * size
    for i in range(1, size):
        linked[i] = linked[parent[i]] or tag[i] == "a"

    def totals(skip: list[bool]):
        chars = [0 if skip[i] else own[i] for i in range(size)]
        links = [chars[i] if linked[i] else 0 for i in range(size)]
        tags, link_tags = [0] * size, [0] * size
        for i in range(size - 1, 0, -1):
            if skip[i]:
                continue
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + (tag[i] not in ("br", "wbr"))
            link_tags[p] += link_tags[i] + (tag[i] == "a")
        return chars, links, tags, link_tags

    # noise by element, by name where the node holds no article or page heading, and by wrapper where it is
    # not the one that stands around the page's text
    noise, inside = [False] * size, [False] * size
    holds = [t in ("article", "main", "h1") for t in tag]
    for i in range(size - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    for i in range(1, size):
        inside[i] = inside[parent[i]] or tag[i] in ("article", "main")
        noise[i] = noise[parent[i]] or page.noise[i] or (tag[i] == "header" and not inside[i])
    unnamed = noise.copy()
    for i in range(1, size):
        noise[i] = noise[i] or noise[parent[i]] or (page.named[i] and not holds[i])

    def wrapped(noise: list[bool]) -> list[bool]:
        if WRAPPERS.isdisjoint(tag):
            return noise
        # of the text besides links, and of the articles, headings and controls, what is in each node; text
        # under a noisy name counts too, or a small form would hold most where names have taken the rest
        plain = [0 if unnamed[i] or linked[i] else own[i] for i in range(size)]
        articles = [int(t in ("article", "main")) for t in tag]
        headings = [int(t == "h1") for t in tag]
        controls = [int(t in ("button", "input", "select", "textarea")) for t in tag]
        for i in range(size - 1, 0, -1):
            for count in (plain, articles, headings, controls):
                count[parent[i]] += count[i]

        def around(i: int) -> bool:
            if tag[i] == "fieldset" and not controls[i]:
                return True  # a box around text
            most = 2 * plain[i] > plain[0]
            if inside[i] or most and articles[i]:
                return most
            return articles[i] == articles[0] and bool(most or articles[i] or headings[i] and headings[i] == headings[0])

        noise = noise.copy()
        for i in range(1, size):
            noise[i] = noise[i] or noise[parent[i]] or (tag[i] in WRAPPERS and not around(i))
        return noise

    named, noise = noise, wrapped(noise)
    chars, links, tags, link_tags = totals(noise)
    if not chars[0]:  # the names or wrappers have taken everything, so they are not what they say
        noise = max(wrapped(unnamed), named, key=lambda n: totals(n)[0][0])
        chars, links, tags, link_tags = totals(noise)
    if not chars[0]:
        noise = unnamed
        chars, links, tags, link_tags = totals(noise)

    body = page.body
    share = links[body] / chars[body] if chars[body] else 0.0

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], max(tags[i], 1), links[i], link_tags[i]
        if not c:
            return 0.0
        # the published ratio; its base starts at e so that pages without links have one
        base = log(c * lc / max(c - lc, 1) + share * c + e) + e - 1
        return c / t * log(1 + (c / max(lc, 1)) * (t / max(lt, 1))) / log(base)

    densities = [0.0 if noise[i] else density(i) for i in range(size)]
    sums = [0.0] * size
    for i in range(1, size):
        if tag[i] not in INLINE:
            sums[parent[i]] += densities[i]
    best = max((i for i in range(body, size) if not noise[i] and tag[i] not in INLINE), key=lambda i: (sums[i], -i), default=body)
    if not sums[best]:
        best = body
    path = [best]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    threshold = min(densities[i] for i in path)
    # an article element around the densest node has its borders; else the densities have to find them
    chosen = next((i for i in path if tag[i] == "article"), None)
    roots = {chosen} if chosen is not None else _marked(page, noise, densities, sums, path, threshold, linked)
    keep = [False] * size
    for i in range(size):
        within = i in roots or (i and keep[parent[i]])
        menu = (
            i not in roots and tag[i] not in INLINE and link_tags[i] > 1
            and 2 * links[i] > chars[i] and densities[i] < threshold
        )
        aside = best == body and parent[i] == body and tag[i] in ("div", "section", "table") and densities[i] < threshold and i not in roots
        keep[i] = bool(within) and not noise[i] and not menu and not (aside and chosen is None)

    blocks, block = [], []
    for n, clean, raw in runs:
        if n < 0:
            if block:
                blocks.append(block)
                block = []
        elif keep[n]:
            block.append(raw)
    if block:
        blocks.append(block)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(df: DataFrame, html: str, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``df`` without ``html``, with the main text of each page and its number of code points.

    One row per row, repeated rows included; a null page has an empty text; an empty table gives none.
    Columns of ``df`` named like the two new ones are replaced; all others are kept as they are.
    """
    rest = [c for c in df.columns if c.lower() not in (html.lower(), text.lower(), chars.lower())]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]

    def run(batches):
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(len(rest))]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made], names=[*rest, text, chars])

    return df.select(*rest, html).mapInArrow(run, ", ".join([*fields, f"`{text}` string", f"`{chars}` long"]))
