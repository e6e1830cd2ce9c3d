"""HTML pages to text, anchors and bibliography rows.

The pages are a table; each Arrow batch is parsed by the standard library's tokenizer, one
row in and one nested row out, so the work follows Spark's partitions.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import links
from textloom.functions.text import strip

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

PARSED = (
    "title string, block string, body string, "
    "anchors array<struct<href string, label string>>, references array<array<string>>"
)


class _Page(HTMLParser):
    """Collects the texts of the wanted elements while they are open.

    An open element remembers its depth; it is closed when the stack falls below that.
    """

    def __init__(self, block_tag: str, block_class: str, list_class: str):
        super().__init__(convert_charrefs=True)
        self.block_tag, self.list_class = block_tag, list_class
        self.block_class = set(block_class.split())
        self.stack: list[str] = []
        self.count: Counter = Counter()
        self.titles: list[str] = []
        self.title_done = False
        self.block: list[str] | None = None
        self.body: list[str] = []
        self.anchors: list[tuple[str, list[str]]] = []
        self.items: list[list[list[str]]] = []
        self.list_depth = 0
        self.collecting: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.stack.append(tag)
        self.count[tag] += 1
        depth = len(self.stack)
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        if tag == "a" and attrs.get("href") is not None:
            self.anchors.append((attrs["href"], self._open(depth)))
        if tag == self.block_tag and self.block is None and self.block_class.issubset(classes):
            self.block = self._open(depth)
        if tag == "ul" and self.list_class in classes and not self.list_depth:
            self.list_depth = depth
        elif self.list_depth and tag == "li":
            self.items.append([])
        elif self.list_depth and tag == "span" and self.items:
            self.items[-1].append(self._open(depth))

    def _open(self, depth):
        text: list[str] = []
        self.collecting.append((depth, text))
        return text

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        while True:
            last = self.stack.pop()
            self.count[last] -= 1
            if last == tag:
                break
        if tag == "title":
            self.title_done = True
        depth = len(self.stack)
        if depth < self.list_depth:
            self.list_depth = 0
        self.collecting = [c for c in self.collecting if c[0] <= depth]

    def handle_data(self, data):
        if self.count["script"] or self.count["style"]:
            return
        if self.count["title"]:
            if not self.title_done:
                self.titles.append(data)
            return
        self.body.append(data)
        for _, text in self.collecting:
            text.append(data)


def parse_pages(
    pages: DataFrame,
    html: str = "html",
    block_tag: str = "blockquote",
    block_class: str = "abstract mathjax",
    list_class: str = "ltx_biblist",
    prefix: str = "Abstract:",
) -> DataFrame:
    """Add the parts of each page: title, one marked block, body text, anchors, and the span
    texts of every list item of the bibliography. The block loses its label."""
    keep = [c for c in pages.columns if c != html]

    def parse(batches):
        for batch in batches:
            rows = []
            for source in batch[html]:
                page = _Page(block_tag, block_class, list_class)
                page.feed(source or "")
                page.close()
                block = None
                if page.block is not None:
                    block = "".join(page.block).strip().removeprefix(prefix).strip()
                rows.append(
                    (
                        "".join(page.titles) if page.titles else None,
                        block,
                        " ".join("".join(page.body).split()),
                        [{"href": h, "label": "".join(label)} for h, label in page.anchors],
                        [["".join(span) for span in item] for item in page.items],
                    )
                )
            out = batch[keep].copy()
            for i, name in enumerate(["title", "block", "body", "anchors", "references"]):
                out[name] = [r[i] for r in rows]
            yield out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)
    return pages.select(*keep, html).mapInPandas(parse, f"{kept}, {PARSED}")


def bibliography(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One citation row per bibliography item with at least three spans."""
    items = parsed.select(*keys, F.posexplode("references").alias("item", "parts")).where(
        F.size("parts") >= 3
    )
    source = F.when(F.size("parts") > 3, F.col("parts")[3])
    return items.select(
        *keys,
        "item",
        strip(F.col("parts")[0]).alias("ref_name"),
        strip(F.col("parts")[1]).alias("authors"),
        strip(F.col("parts")[2]).alias("title"),
        source.alias("source"),
        links.citation_source_type(source).alias("source_type"),
        links.citation_year(F.col("parts")[0]).alias("year"),
    )


def encode_each(df: DataFrame, column: str, fn, name: str, kind: str, error: str = "error") -> DataFrame:
    """``fn`` over every value of a column inside Arrow batches; a failing item gives a null
    and its message instead of stopping the job."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for batch in batches:
            values, errors = [], []
            for item in batch[column]:
                try:
                    values.append(fn(item))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - reported in the error column
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(**{name: pd.Series(values, dtype=object), error: pd.Series(errors, dtype=object)})

    return df.mapInPandas(run, f"{schema}, `{name}` {kind}, `{error}` string")


def anchors(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.select(*keys, F.posexplode("anchors").alias("no", "anchor")).select(
        *keys, "no", "anchor.href", "anchor.label"
    )


def hrefs(pages: DataFrame, keys: list[str], html: Column) -> DataFrame:
    """Anchor targets by pattern, without leaving the JVM."""
    return pages.select(*keys, F.posexplode(links.html_hrefs(html)).alias("no", "href"))
