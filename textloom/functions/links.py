"""Links, headings, addresses and note properties found in text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import strip

# Link prefixes that do not lead to an article.
SKIPPED_PREFIXES = ("File:", "Category:", "Image:")

# Addresses of images, left out of a crawl.
IMAGE_PATTERN = r".*\.(jpg|jpeg|png|gif|webp|svg|ico|bmp)$"

# Patterns of links, headings, note ids and paper ids.
WIKITEXT_LINK = r"\[\[([^\]]+)\]"
HEADING = r"(?md)^(=+)\s*([^=]+?)\s*\1\s*$"
WIKI_LINK = r"\[\[(.*?)\]\]"
NOTE_LINK = r"(?<=\[\[id:)([a-zA-Z0-9\-]+)(?=\]\[)"
FILE_DATE = r"(?s)^([^0-9]*)([0-9]+)(.*)$"
ARXIV_ID = r"arXiv:(\d+\.\d+)"


def wikitext_links(text: Column) -> Column:
    """``[[page#section|label]]`` targets as structs; section-only links have a null page."""
    targets = F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WIKITEXT_LINK), F.lit(1)),
        lambda m: F.split(m, r"\|", 2)[0],
    )
    kept = F.filter(targets, lambda t: ~t.rlike(f"^({'|'.join(SKIPPED_PREFIXES)})"))
    return F.transform(
        kept,
        lambda t: F.struct(
            F.when(t.contains("#"), F.nullif(F.split(t, "#", 2)[0], F.lit("")))
            .otherwise(t)
            .alias("page"),
            F.when(t.contains("#"), F.split(t, "#", 2)[1]).alias("section"),
        ),
    )


def wikitext_headings(text: Column) -> Column:
    """``== title ==`` lines as structs of level and title."""
    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(HEADING), F.lit(2))
    return F.zip_with(
        marks,
        titles,
        lambda m, t: F.struct(F.length(m).cast("int").alias("level"), strip(t).alias("title")),
    )


def wiki_links(text: Column) -> Column:
    """Second dialect: shortest ``[[...]]``, no ``[[!`` directives, each once."""
    found = F.regexp_extract_all(text, F.lit(WIKI_LINK), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.startswith("!")))


def note_links(text: Column) -> Column:
    """Ids between ``[[id:`` and ``][``."""
    return F.regexp_extract_all(text, F.lit(NOTE_LINK), F.lit(1))


def note_id(text: Column) -> Column:
    """Value of the first line that starts with ``:ID:``; null when there is none."""
    return F.when(
        F.regexp_like(text, F.lit(r"(?md)^:ID:")),
        strip(F.regexp_extract(text, r"(?md)^:ID:(.*)$", 1)),
    )


def note_path(path: Column) -> Column:
    """Root folder, first digit run and rest of a note path; null parts when it has no digits."""
    trimmed = lambda part: F.regexp_replace(
        F.regexp_replace(part, r"^/+|/+$", ""), r"^-+|-+$", ""
    )
    has = F.regexp_like(path, F.lit(r"[0-9]"))
    part = lambda i: F.when(has, trimmed(F.regexp_extract(path, FILE_DATE, i)))
    return F.struct(
        part(1).alias("root_path"), part(2).alias("date"), part(3).alias("name"), path.alias("path")
    )


# Endings of bare host names that count as addresses, besides those of countries.
HOST_ENDINGS = (
    "com net org edu gov mil aero asia biz cat coop info int jobs mobi museum name post pro tel travel xxx app dev "
    "ac an cs dd eu ja su tp uk yu"
).split()


@lru_cache(maxsize=1)
def country_endings() -> tuple[str, ...]:
    """The two-letter codes of all countries, from the table that the Java runtime keeps of ISO 3166."""
    codes = SparkContext._active_spark_context._jvm.java.util.Locale.getISOCountries()
    return tuple(sorted(c.lower() for c in codes))


def urls(text: Column, endings: Sequence[str] | None = None) -> Column:
    """Web addresses in order: those with http or https, www hosts, and bare hosts with one of ``endings``,
    by default ``HOST_ENDINGS`` and those of all countries.

    Round brackets belong to an address while they are balanced; signs that close a sentence do not.
    A host beside an @ is a mail address and no web address.
    """
    known = [*HOST_ENDINGS, *country_endings()] if endings is None else endings
    plain = r"[^\s()<>{}\[\]\"'`«»“”‘’]"
    brackets = rf"\((?:{plain}++|\({plain}*+\))*+\)"
    rest = rf"(?:{plain}++|{brackets})*+"
    host = rf"(?:[a-z0-9-]+\.)+(?:{'|'.join(known)})(?![\w@-]|\.\w)"
    www = r"www\d{0,3}(?:\.[a-z0-9-]+)+"
    found = F.regexp_extract_all(
        text, F.lit(rf"(?i)(?<![@\w.-])(https?://(?={plain}){rest}|(?:{www}|{host})(?!@)(?::\d+)?(?:[/?#]{rest})?)"), F.lit(1)
    )
    return F.transform(found, lambda u: F.regexp_replace(u, r"[!;:.,?]+$", ""))


def repo_url(url: Column, host: str = "github.com") -> Column:
    """Address with scheme and without trailing slash; null when it is not on ``host``."""
    full = F.when(url.startswith(f"https://{host}/"), url).when(
        url.startswith(f"{host}/"), F.concat(F.lit("https://"), url)
    )
    return F.regexp_replace(full, r"/+$", "")


def url_host(url: Column) -> Column:
    """Host and port of an address, as a crawler compares them."""
    return F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def arxiv_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ARXIV_ID, 1), F.lit(""))


def citation_year(ref_name: Column) -> Column:
    return F.regexp_extract(ref_name, r"\d+", 0).try_cast("int")


def citation_source_type(source: Column) -> Column:
    return F.split(strip(source), ", ", 2)[0]


def html_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def html_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
