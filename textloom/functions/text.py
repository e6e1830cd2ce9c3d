"""Text columns: cleaning, measures, identifiers. All run inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the classic English stop list of inverted-index text search.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()

# Whitespace in the Unicode sense plus the four ASCII separators.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def terms(text: Column, stop_words=STOP_WORDS) -> Column:
    found = words(text)
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(list(stop_words)))


def ascii_ratio(text: Column) -> Column:
    """Share of characters in the ASCII range; null for an empty text."""
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.nullif(F.length(text), F.lit(0))


def clip_and_squash(text: Column, length: int) -> Column:
    """First ``length`` characters, then every whitespace run to one space."""
    return F.regexp_replace(F.substring(text, 1, length), WHITESPACE, " ")


def strip(text: Column) -> Column:
    """Text without whitespace of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+\z", "")


def line_count(text: Column) -> Column:
    """Newline-separated lines after trimming."""
    return F.size(F.split(strip(text), "\n"))


def merge_columns(names: list[str], joiner: str = "\n\n", missing: str = "nan") -> Column:
    """``name:\\nvalue`` parts in order; a null prints as ``missing``."""
    parts = [
        F.concat(F.lit(f"{n}:\n"), F.coalesce(F.col(n).cast("string"), F.lit(missing))) for n in names
    ]
    return F.concat_ws(joiner, *parts)


def list_to_text(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def text_to_list(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"[\[\]]", ""), ", ")


def unsnake(text: Column) -> Column:
    """Underscores to spaces; free-standing numbers and long digit runs to NUMBER."""
    return F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r" \d+ |\d{3,}", " NUMBER ")


def drop_control(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{C}", "")


def document_id(name: Column) -> Column:
    return F.sha1(name)


def chunk_id(name: Column, chunk: Column) -> Column:
    return F.sha1(F.concat(name, chunk))


def marked_sections(text: Column, mark: str = "##") -> Column:
    """Parts between marks as structs of header line and body."""
    parts = F.split(text, mark)
    return F.transform(
        parts,
        lambda part, i: F.struct(
            i.alias("no"), F.split(part, "\n", 2)[0].alias("header"), part.alias("body")
        ),
    )


def run_name(folder: Column, group: Column, algo: Column, env: Column, seed: Column) -> Column:
    return F.format_string("%s/%s/%s_%s_seed%d", folder, group, algo, env, seed)


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: cuts after . ! ? and at line ends."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, F.trim), lambda s: F.length(s) > 0)


def sentence_windows(found: Column, reach: int = 3) -> Column:
    """Every sentence of a sentence list with up to ``reach`` neighbours on both sides.

    ``found`` should be a plain column: it is read again for every window.
    """
    return F.transform(
        found,
        lambda s, i: F.struct(
            i.alias("no"),
            s.alias("sentence"),
            F.array_join(
                F.slice(found, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1),
                " ",
            ).alias("window"),
        ),
    )


def topk_entropy(scores: Column, k: int = 3) -> Column:
    """Entropy in nats of the ``k`` largest scores after renormalising: ln S - sum(x ln x) / S."""
    top = F.slice(F.sort_array(scores, asc=False), 1, k)
    both = F.aggregate(
        top,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("xlnx")),
        lambda a, x: F.struct(
            (a["s"] + x).alias("s"),
            (a["xlnx"] + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))).alias("xlnx"),
        ),
        lambda a: F.log(a["s"]) - a["xlnx"] / a["s"],
    )
    return both


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.lit(2.0) / (F.lit(1.0) / a + F.lit(1.0) / b)


def inherit(child: Column, base: Column, marker: str = "_base") -> Column:
    """Base entries overridden by the child's, without the inheritance marker."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base = F.coalesce(base, empty)
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(child), k))
    return F.map_filter(F.map_concat(kept, child), lambda k, _: k != F.lit(marker))
