"""Line deduplication by a fixed-depth tree of line templates, in column functions only.

A line is parsed as a log line: words with a digit are variable and become <*>, and the number of words and
the first three (or all, of shorter lines) lead to a leaf. A leaf holds any number of templates, found in two
steps. First the usual word of each place in the leaf makes a template, and lines that agree with it in most
places are one template whatever stands in the others. Then the places behind the leading words of all lines
left over are cut into five stretches; lines of the leaf that are equal in a stretch meet, the usual words
among them make a template again, and a line takes the largest of those it agrees with. So a template whose
variable words leave one of the stretches alone is found beside others of its leaf. Lines equal after masking
are one template anyway; a line without any fixed word, an empty one too, has none and stays.

A template found in two or more different texts is recurring: its first line stays and all others go.
Copies of a whole text count as one text here and keep the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.names import fresh, others
from textloom.scale import Salted, fit_broadcast, release, settle

# a word with a digit, matched from its start in one pass
VARIABLE = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"
# a run of white space that is not one plain space
RUN = "(?:[\\x09-\\x0D]|\\x20(?=[\\x20\\x09-\\x0D]))[\\x20\\x09-\\x0D]*+"
HOLE = "<*>"
DEPTH = 3
ALIKE = 0.8
STRETCHES = 5


def masked_lines(text: Column) -> Column:
    """The lines of a text with their variable words masked and one space between words.

    A text without a digit and without unusual white space, as most are, is only split.
    """
    def masked(line: Column) -> Column:
        return F.trim(F.regexp_replace(F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, HOLE)).otherwise(line), RUN, " "))

    lines = F.split(text, "\n")
    odd = text.rlike("[\\x09\\x0B-\\x0D0-9]") | text.startswith(" ") | text.endswith(" ")
    for pair in ("  ", "\n ", " \n"):
        odd = odd | text.contains(pair)
    return F.when(odd, F.transform(lines, masked)).otherwise(lines)


def parsed_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, body, at, leaf, line): the masked lines of ``df`` that reach a leaf.

    ``body`` is the text's hash, ``at`` the line's place, ``leaf`` a hash of word count and leading words.
    Lines without a fixed word have no leaf.
    """
    lines = df.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.posexplode(masked_lines(F.col(text))).alias("at", "line")
    )
    gaps = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    leaf = F.xxhash64(gaps, F.substring_index("line", " ", DEPTH))
    holes = F.col("line").startswith(HOLE) & F.col("line").rlike("^<\\*>( <\\*>)*$")
    return lines.where((F.col("line") != "") & ~holes).select("key", "body", "at", leaf.alias("leaf"), "line")


def usual_lines(members: DataFrame) -> DataFrame:
    """(sign, part, group, size): the members that agree with the usual words of their group, and its size."""
    members = settle(members)
    places = members.select("group", F.posexplode("words").alias("place", "word"))
    counted = places.groupBy("group", "place", "word").agg(F.count(F.lit(1)).alias("n"))
    usual = counted.groupBy("group", "place").agg(F.max(F.struct("n", "word"))["word"].alias("word"), F.sum("n").alias("size"))
    in_order = F.array_sort(F.collect_list(F.struct("place", "word")))
    templates = settle(
        usual.groupBy("group").agg(F.transform(in_order, lambda x: x["word"]).alias("template"), F.max("size").alias("size"))
    )
    agreeing = F.size(F.filter(F.zip_with("words", "template", lambda a, b: a == b), lambda same: same))
    found = Salted(members, ["group"]).join(templates)
    return found.where(agreeing >= F.lit(ALIKE) * F.size("words")).select("sign", "part", "group", "size")


def stretch_groups(lines: DataFrame) -> DataFrame:
    """(sign, words, part, group): every line once per stretch of its places, in the group of equal ones of its leaf."""
    rest = F.size("words") - DEPTH

    def edge(j: int) -> Column:
        return F.ceil(j * rest / STRETCHES).cast("int")

    def group(j: int) -> Column:
        stretch = F.slice("words", edge(j) + DEPTH + 1, edge(j + 1) - edge(j))
        found = F.struct(F.lit(j).alias("part"), F.xxhash64("leaf", F.lit(j), stretch).alias("group"))
        return F.when(edge(j + 1) > edge(j), found)

    groups = F.filter(F.array(*[group(j) for j in range(STRETCHES)]), lambda g: g.isNotNull())
    return lines.where(rest > 0).select("sign", "words", F.inline(groups).alias("part", "group"))


def alike_lines(df: DataFrame, key: str, text: str, signs: DataFrame) -> DataFrame:
    """(sign, template) of the masked lines that share a template with others of their leaf."""
    several = signs.groupBy("leaf").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi")).where("lo <> hi").select("leaf")
    lines = parsed_lines(df, key, text).select("leaf", "line").join(fit_broadcast(settle(several)), "leaf", "left_semi")
    shared = settle(
        lines.distinct().select("leaf", _sign().alias("sign"), F.split("line", " ").alias("words"))
    )
    first = settle(usual_lines(shared.select("sign", "words", F.lit(-1).alias("part"), F.col("leaf").alias("group"))))
    groups = settle(stretch_groups(shared.join(first, "sign", "left_anti")))
    sizes = settle(groups.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    met = Salted(groups, ["group"], counts=sizes).join(sizes.select("group"), "left_semi")
    later = usual_lines(met).groupBy("sign").agg(
        F.max_by(F.struct("part", "group"), F.struct("size", -F.col("part"))).alias("best")
    )
    named = first.select("sign", "part", "group").unionByName(later.select("sign", "best.part", "best.group"))
    return named.select("sign", F.concat_ws(":", "part", "group").alias("template"))


def _sign() -> Column:
    """A 128-bit digest of a masked line."""
    return F.unhex(F.md5(F.col("line").cast("binary")))


def recurring_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, body, drop): the places of the lines to drop, for texts that have any."""
    every = settle(parsed_lines(df, key, text).select("key", "body", "at", "leaf", _sign().alias("sign")))
    # a line whose leaf is met in one text only cannot recur, which sets most lines aside by plain numbers
    met = settle(
        every.groupBy("leaf").agg(F.min("body").alias("lo"), F.max("body").alias("hi"), F.count(F.lit(1)).alias("_n"))
        .where("lo <> hi").select("leaf", "_n")
    )
    lines = settle(Salted(every, ["leaf"], counts=met).join(met.select("leaf"), "left_semi"))
    release(every, met)
    signs = settle(
        lines.groupBy("leaf", "sign").agg(
            F.min(F.struct("key", "body", "at")).alias("first"), F.min("body").alias("lo"), F.max("body").alias("hi"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    merged = alike_lines(df, key, text, signs)
    # a line that shares no template is one by itself
    named = settle(
        signs.join(merged, "sign", "left").select(
            "sign", "first", "lo", "hi", F.coalesce("template", F.hex("sign")).alias("template")
        )
    )
    again = settle(
        named.groupBy("template").agg(F.min("first").alias("_first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where("lo <> hi").select("template", "_first")
    )
    recurring = settle(
        Salted(named, ["template"]).join(again).select("sign", F.col("_first.body").alias("_body"), F.col("_first.at").alias("_at"))
    )
    found = Salted(lines.select("key", "body", "at", "sign"), ["sign"], counts=signs.select("sign", "_n")).join(recurring)
    later = (F.col("body") != F.col("_body")) | (F.col("at") != F.col("_at"))
    return found.where(later).groupBy("key", "body").agg(F.collect_set("at").alias("drop"))


def drop_recurring(df: DataFrame, key: str, text: str, counts: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the recurring lines of ``text`` left out; a text without any is unchanged.

    The first line of a template is that of the smallest key. A null text stays null, an empty one
    empty; a text may become empty; repeated rows keep the same lines, and an empty table gives no
    rows. ``counts`` names two columns to add, for lines and dropped lines; columns of ``df`` with
    these names are replaced.
    """
    of, body, at = fresh(df, "_of", "_body", "_at")
    drops = settle(recurring_lines(df.select(key, text), key, text)).toDF(of, body, at)
    same = F.col(key).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(body))
    lines = F.split(F.col(text), "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at)))
    left = F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))[0]
    joined = df.join(drops, same, "left")
    names = others(df, counts or ())
    made = [F.when(F.col(at).isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in names]
    if counts:
        made += [
            F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
            F.coalesce(F.size(at), F.lit(0)).cast("long").alias(counts[1]),
        ]
    return joined.select(*made)
