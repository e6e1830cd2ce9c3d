"""Outline notes (org files) to rows and file-level links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import dates, links
from textloom.functions.text import strip
from textloom.scale import salted_join

# States that may stand before a heading.
STATES = ("TODO", "DONE")


def _bare_heading(line: Column) -> Column:
    line = F.regexp_replace(line, r"^\*+\s+", "")
    line = F.regexp_replace(line, rf"^(?:{'|'.join(STATES)})\s+", "")
    line = F.regexp_replace(line, r"^\[#[A-Z]\]\s+", "")
    return strip(F.regexp_replace(line, r"\s+:[\w@#%:]+:\s*$", ""))


def _body(node: Column) -> Column:
    """Lines without heading, planning line and property drawer."""
    rest = F.regexp_replace(node, r"^\*+ [^\n]*\n?", "")
    rest = F.regexp_replace(rest, r"(?m)^\s*(?:SCHEDULED|DEADLINE|CLOSED):[^\n]*\n?", "")
    return F.regexp_replace(rest, r"(?ms)^\s*:PROPERTIES:[ \t]*\n.*?^\s*:END:[ \t]*\n?", "")


def note_elements(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    changed: str | None = "changed",
    name_pattern: str = r"([^/]+)\.org$",
    whole_file: bool = False,
) -> DataFrame:
    """Root and heading rows of each file; headings take id, name and dates from the root.

    With ``whole_file`` there is one row per file that holds all of its nodes. Every file is
    one row, so the tree is taken apart inside the row and nothing is shuffled.
    """
    pieces = F.split(F.concat(F.lit("\n"), F.col(text)), r"(?m)(?=^\*+ )")
    nodes = F.transform(pieces, lambda p: F.regexp_replace(p, r"\A\n|\n+\z", ""))
    name = F.regexp_extract(F.col(path), name_pattern, 1)
    base = files.select(
        F.col(path).alias("path"),
        name.alias("file_name"),
        links.note_id(F.get(nodes, F.lit(0))).alias("org_id"),
        dates.file_name_time(name).alias("creation_date"),
        (F.col(changed).cast("timestamp_ntz") if changed else F.lit(None).cast("timestamp_ntz")).alias(
            "last_edit_date"
        ),
        nodes.alias("nodes"),
    ).where(F.col("org_id").isNotNull())
    later = F.slice("nodes", F.lit(2), F.size("nodes"))
    below = F.flatten(F.transform(later, links.note_links))
    if whole_file:
        return base.select(
            "path", "file_name", "org_id", F.lit("").alias("heading"), F.lit(0).alias("level"),
            _body(F.col("nodes")[0]).alias("body"), below.alias("links"),
            F.array_join("nodes", "\n\n").alias("text"), "creation_date", "last_edit_date",
        )
    rows = base.select("*", below.alias("_below"), F.posexplode("nodes").alias("no", "node"))
    first = F.split("node", "\n", 2)[0]
    is_root = F.col("no") == 0
    heading = F.when(is_root, F.lit("")).otherwise(_bare_heading(first))
    body = _body(F.col("node"))
    return rows.select(
        "path",
        "file_name",
        "org_id",
        "no",
        heading.alias("heading"),
        F.when(is_root, F.lit(0)).otherwise(F.length(F.regexp_extract("node", r"^(\*+) ", 1))).alias("level"),
        body.alias("body"),
        F.when(is_root, F.col("_below")).otherwise(links.note_links(F.col("node"))).alias("links"),
        F.concat(heading, F.lit("\n"), body).alias("text"),
        "creation_date",
        "last_edit_date",
    )


def unreadable_notes(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Files without an id, with the reason they give no rows."""
    root = F.get(F.split(F.concat(F.lit("\n"), F.col(text)), r"(?m)(?=^\*+ )"), F.lit(0))
    return files.where(links.note_id(root).isNull()).select(
        F.col(path).alias("path"), F.lit("no :ID: property in the root node").alias("error")
    )


def note_edges(elements: DataFrame, direction: str = "from_target") -> DataFrame:
    """File-level edges from id links; links to unknown ids are dropped.

    ``from_target`` gives (linked file, linking file), ``from_source`` the reverse. Links of
    the heading rows are used once: the root row repeats them.
    """
    ids = elements.groupBy(F.col("org_id").alias("link")).agg(F.min("file_name").alias("target"))
    wanted = elements.where("level > 0").select(
        F.col("file_name").alias("source"), F.explode("links").alias("link")
    )
    found = salted_join(wanted, ids, ["link"])
    pair = ("target", "source") if direction == "from_target" else ("source", "target")
    return found.select(F.col(pair[0]).alias("src"), F.col(pair[1]).alias("dst")).distinct()
