"""Book pages to contents tables, chapters, sections and paragraphs; subtitle cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import dates
from textloom.functions.text import WHITESPACE, strip
from textloom.scale import PART_BYTES, concat_parts, neighbourhood, running, salted_join, settle

# Patterns of a contents line, a contents entry in running text, a section
# heading, a bare page number, a date range and any number.
CONTENTS_LINE = r"^([IVXLCDM]+)\.\s+(.+?)(?:\s+(\d+))?\s*$"
CONTENTS_ENTRY = r"(?:CHAPTER\s*\n)?([IVXLCDM]+)\.[\s\n]+([A-Z][A-Z\s'-]+)(?:\s+(\d+))?"
HEADING_LINE = r"^(PART|CHAPTER)[^\S\n]+[IVXLCDM]+\.?[^\S\n]*:?[^\S\n]*.*"
PAGE_NUMBER = r"^\s*(\d+|[IVXLCDM]+)\s*$"
YEAR_RANGE = r"\d{4}[-–—]\d{4}"
ANY_NUMBER = r"\d+|[IVXLCDM]+\.?"
PAGE_BLOCK = 64


def _entries(roman, title, ref) -> Column:
    return F.struct(
        roman.alias("roman"),
        strip(title).alias("title"),
        F.nullif(ref, F.lit("")).try_cast("int").alias("ref"),
    )


def _listed(text: Column) -> Column:
    """Entries on the lines after the CONTENTS line of a page."""
    lines = F.split(text, "\n")
    at = F.coalesce(
        F.array_min(
            F.filter(
                F.transform(lines, lambda line, i: F.when(line.contains("CONTENTS"), i)),
                lambda i: i.isNotNull(),
            )
        )
        + 1,
        F.lit(0),
    )
    after = F.transform(F.slice(lines, at + 1, F.size(lines)), strip)
    hits = F.filter(after, lambda line: F.regexp_like(line, F.lit(CONTENTS_LINE)))
    group = lambda line, i: F.regexp_extract(line, CONTENTS_LINE, i)
    return F.transform(hits, lambda line: _entries(group(line, 1), group(line, 2), group(line, 3)))


def _scattered(text: Column) -> Column:
    """Entries anywhere in the text of a page."""
    parts = [F.regexp_extract_all(text, F.lit(CONTENTS_ENTRY), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(
        F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("r", "t", "p"))]),
        lambda z: _entries(z["r"], z["t"], z["p"]),
    )


def contents(pages: DataFrame, first_page: Column | int | None = None) -> DataFrame:
    """Contents rows per book: (book, entry, page_ref, roman, title), in page order.

    ``pages`` has book, page_num, text. Entries come from the page marked CONTENTS and the
    one after it, else from running text around it (or anywhere without such a page).
    ``first_page`` is the known page of the first chapter and shifts all references. Entries without a
    page number come after all others, on places past the last page. Books without page numbers
    get evenly spaced chapters. ``page_num`` is unique in a book.
    """
    placed = running(pages.select("book", "page_num"), ["book"], ["page_num"])
    text = pages.select(F.col("book").alias("_book"), F.col("page_num").alias("_page"), "text")
    numbered = settle(
        placed.join(text, F.col("book").eqNullSafe(F.col("_book")) & (F.col("page_num") == F.col("_page"))).drop("_book", "_page")
    )
    marked = numbered.where(F.col("text").contains("CONTENTS")).groupBy("book").agg(F.min("pos").alias("c"))
    around = salted_join(numbered, settle(marked), ["book"], "left")
    listed = around.where((F.col("pos") == F.col("c")) | (F.col("pos") == F.col("c") + 1)).select(
        "book", "pos", F.posexplode(_listed(F.col("text"))).alias("k", "e")
    )
    near = F.col("c").isNull() | F.col("pos").between(F.col("c") - 1, F.col("c") + 2)
    scattered = around.where(near).select(
        "book", "pos", F.posexplode(_scattered(F.col("text"))).alias("k", "e"),
        (F.col("c").isNotNull() | (F.col("pos") <= 10)).alias("early"),
    )
    scattered = salted_join(scattered, listed.select("book").distinct(), ["book"], "left_anti")
    found = listed.withColumn("early", F.lit(True)).unionByName(scattered)
    found = running(found.select("book", "pos", "k", "early", "e.roman", "e.title", "e.ref"),
                    ["book"], ["pos", "k"], position="nth")
    if first_page is not None:
        given = F.lit(first_page) if isinstance(first_page, int) else first_page
        shift = found.where("early").groupBy("book").agg(F.coalesce(given - F.min("ref"), F.lit(0)).alias("shift"))
        found = salted_join(found, settle(shift), ["book"], "left")
    else:
        found = found.withColumn("shift", F.lit(0))
    found = found.withColumn("paged", F.col("ref") + F.coalesce("shift", F.lit(0))).withColumn("late", F.col("paged").isNull())
    placed = settle(running(found, ["book"], ["late", "paged", "nth"], position="entry"))
    size = placed.groupBy("book").agg(F.max("entry").alias("n"), F.max("paged").alias("high"))
    span = numbered.groupBy("book").agg(
        F.min(F.when(F.length("text") > 0, F.col("page_num"))).alias("start"),
        F.max("page_num").alias("stop"),
    )
    even = F.col("start") + (F.col("entry") - 1) * F.floor(F.col("stop") / (F.col("n") + 1))
    past = F.greatest("stop", "high") + F.col("nth")
    return salted_join(placed, settle(size.join(span, "book")), ["book"]).select(
        "book",
        "entry",
        F.when(F.col("high").isNull(), even).otherwise(F.coalesce("paged", past)).cast("int").alias("page_ref"),
        "roman",
        "title",
    )


def chapter_spans(toc: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Contents rows with their last page: one before the next entry, or the book's last."""
    ends = neighbourhood(toc, ["book"], "entry", 0, 1, {"_next": F.nth_value("page_ref", 2)})
    ends = salted_join(ends, settle(last_pages), ["book"])
    return ends.select(
        *toc.columns, F.coalesce(F.col("_next") - 1, F.col("last_page")).cast("int").alias("end_page")
    )


def pages_in_chapters(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Every page with the chapter it lies in; pages before the first entry are dropped.

    Chapters of a book do not overlap, so each page block meets few of them: the join is on
    (book, block), not on the book alone. A book without entries goes to one last chapter.
    """
    block = lambda c: F.floor(c / PAGE_BLOCK)
    wide = spans.where("end_page >= page_ref").withColumn(
        "_block", F.explode(F.sequence(block(F.col("page_ref")), block(F.col("end_page"))))
    )
    inside = (
        pages.withColumn("_block", block(F.col("page_num")))
        .join(wide, ["book", "_block"])
        .where(F.col("page_num").between(F.col("page_ref"), F.col("end_page")))
        .select(
            "book", "page_num", "text", F.col("entry"),
            F.concat("roman", F.lit(". "), "title").alias("chapter"),
        )
    )
    listed = spans.select("book").distinct()
    rest = salted_join(pages.where("page_num >= 1"), listed, ["book"], "left_anti").select(
        "book", "page_num", "text", F.lit(0).cast("long").alias("entry"),
        F.lit("Remaining Content").alias("chapter"),
    )
    return inside.unionByName(rest)


def chapter_texts(pages: DataFrame, spans: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Chapters with the joined text of their non-blank pages; empty chapters are skipped.

    Texts longer than ``part_bytes`` come as ordered parts.
    """
    rows = settle(pages_in_chapters(pages, spans).withColumn("text", strip(F.col("text"))).where("text <> ''"))
    return concat_parts(rows, ["book", "entry", "chapter"], ["page_num"], "text", " ", part_bytes)


def _is_header(line: Column, title_words: list[str]) -> Column:
    bare = strip(line)
    short = F.length(bare) < 80
    has = lambda p: F.regexp_like(bare, F.lit(p))
    rule = F.regexp_like(line, F.lit(PAGE_NUMBER)) | (has(YEAR_RANGE) & short)
    if title_words:
        rule = rule | (has(ANY_NUMBER) & has(f"(?i)({'|'.join(title_words)})") & short)
    plain = (bare == "") | (bare == "---") | F.regexp_like(line, F.lit(HEADING_LINE))
    return ~plain & rule


def paragraphs(text: Column, title_words: list[str] | None = None) -> Column:
    """Paragraphs of a text: page headers and ``---`` lines go, blank lines part.

    The lines of one text are one cell, so the grouping stays inside the row.
    """
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: ~_is_header(line, title_words or []) & (strip(line) != "---"),
    )
    whole = F.array_join(F.transform(lines, strip), "\n")
    parts = F.transform(
        F.split(whole, r"\n\n+"), lambda p: strip(F.regexp_replace(p, WHITESPACE, " "))
    )
    return F.filter(parts, lambda p: p != "")


def sections(text: Column, title_words: list[str] | None = None) -> Column:
    """Sections as structs of title and paragraphs; those without text are left out.

    A line of PART or CHAPTER and a Roman numeral opens a section; what comes before the
    first one is the front matter.
    """
    cuts = F.split(F.concat(F.lit("\n"), text), rf"(?m)(?={HEADING_LINE}$)")
    parts = F.transform(
        cuts,
        lambda part, i: F.struct(
            i.alias("no"),
            F.when(i == 0, F.lit("Front Matter"))
            .otherwise(strip(F.split(part, "\n", 2)[0]))
            .alias("title"),
            paragraphs(
                F.when(i == 0, part).otherwise(F.coalesce(F.get(F.split(part, "\n", 2), F.lit(1)), F.lit(""))),
                title_words,
            ).alias("paragraphs"),
        ),
    )
    return F.filter(parts, lambda s: F.size(s["paragraphs"]) > 0)


def cues(segments: DataFrame, media: str, start: str, end: str, text: str, order: list[str]) -> DataFrame:
    """Numbered subtitle cues per medium, each with its printed block."""
    rows = running(segments, [media], order, position="cue")
    span = dates.srt_range(F.col(start), F.col(end))
    return rows.select(
        media,
        "cue",
        span.alias("span"),
        F.concat_ws("\n", F.col("cue").cast("string"), span, strip(F.col(text)), F.lit("")).alias("block"),
    )
