"""Quality rules as one projection: a table of thresholds over ratios of counts.

The counts of a text (words, characters, symbols, lines, stop words, repeated windows) are built-in
column functions; the table is compiled into conditions over them. No user function runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.names import fresh, others

BLANKS = " \t\n\x0b\x0c\r"
WHITE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
VERDICTS = ("base_failed", "failed_rules", "kept")

# Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from not or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les en un du une que pour est dans qui par sur pas au avec ne "
    "el y los se las del por con no una su para al es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A bound on ``numerator / denominator``; a text with a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", least=3.0, most=10.0),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("exclamations", "n_exclamations", "n_words", most=0.5),
    Rule("upper_case", "n_upper", "word_chars", most=0.4),
    Rule("stop_words", "n_stop_words", "n_words", least=0.03),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.5),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _count_outside(text: Column, chars: str) -> Column:
    """Code points left when ``chars`` are taken out."""
    return F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """Words inside windows of three words that the text holds twice or more.

    Hashes of the windows show whether any can repeat; only then are the windows sorted as text.
    """
    last = F.size(words) - 3

    def exact(words: Column) -> Column:
        windows = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 3)).alias("w"), i.alias("at")),
            )
        )

        def starts(sorted_windows: Column) -> Column:
            def keep(x: Column, k: Column) -> Column:
                return (F.get(sorted_windows, k - 1)["w"] == x["w"]) | (F.get(sorted_windows, k + 1)["w"] == x["w"])

            return F.filter(sorted_windows, lambda x, k: F.coalesce(keep(x, k), F.lit(False)))

        return bind(
            windows,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(F.transform(starts(s), lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
                )
            ),
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    prints = bind(
        hashes,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
        ),
    )
    some = bind(prints, lambda p: F.size(F.array_distinct(p)) < F.size(p))
    return F.when(last < 1, 0).when(~some, 0).otherwise(exact(words)).cast("long")


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_exclamations", "n_upper", "n_lines", "n_dup_lines", "n_stop_words",
    "n_repeat_words",
)


def _words(source: Column) -> Column:
    return F.filter(F.split(source, WHITE + "+"), lambda w: w != "")


def _lines(source: Column) -> Column:
    return F.filter(F.split(source, "\n"), lambda x: F.translate(x, BLANKS, "") != "")


def _counts(source: Column, words: Column, lines: Column) -> list[Column]:
    """The columns of ``COUNTS``, in that order, from a text, its words and its lines with a word."""
    plain = F.length(source)
    found = (
        F.size(words),
        _count_outside(source, BLANKS),
        plain - _count_outside(source, SYMBOLS),
        plain - _count_outside(source, "!"),
        plain - F.length(F.regexp_replace(source, "\\p{Lu}", "")),
        F.size(lines),
        F.size(lines) - F.size(F.array_distinct(lines)),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        _repeated(words),
    )
    return [c.cast("long").alias(n) for n, c in zip(COUNTS, found)]


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one long column per count of the whole text; a null text counts as empty.

    n_words, word_chars (code points in words), n_symbols, n_exclamations, n_upper (capital letters),
    n_lines and n_dup_lines (lines with a word; those equal to an earlier one), n_stop_words,
    n_repeat_words. Columns of ``df`` with these names are replaced.
    """
    words, lines = fresh(df, "_words", "_lines")
    source = F.coalesce(F.col(text), F.lit(""))
    split = df.withColumn(words, _words(source)).withColumn(lines, _lines(source))
    return split.select(*others(df, COUNTS), *_counts(source, F.col(words), F.col(lines)))


def compile_rules(
    rules: Sequence[Rule] = RULES, count: Callable[[str], Column] = F.col
) -> dict[str, Column]:
    """Each rule's condition by name, over the counts that ``count`` names; true where it fails."""
    found = {}
    for rule in rules:
        above, below = count(rule.numerator).cast("double"), count(rule.denominator)
        fails = F.lit(False)
        if rule.least is not None:
            fails = fails | (above < rule.least * below)
        if rule.most is not None:
            fails = fails | (above > rule.most * below)
        found[rule.name] = fails & (below > 0)
    return found


def _base_fails(count: Callable[[str], Column]) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (count("n_words") < MIN_WORDS) | (100 * count("n_repeat_words") > MAX_REPEAT_PERCENT * count("n_words"))


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with its counts, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.
    A null or empty text has no words and so fails. Every row is judged by itself: repeated rows get
    equal verdicts, an empty table gives an empty result, and other columns stay as they are.
    """
    counted = text_counts(df.select(*others(df, VERDICTS)), text)
    named = F.array(*[F.when(fails, F.lit(name)) for name, fails in compile_rules(rules).items()])
    return counted.select(
        "*", _base_fails(F.col).alias("base_failed"), F.array_compact(named).alias("failed_rules")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def is_kept(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The verdict of ``judge`` as one condition, in which every count is computed once."""
    parts = F.struct(text.alias("source"), _words(text).alias("words"), _lines(text).alias("lines"))

    def verdict(c: Column) -> Column:
        bad = _base_fails(lambda n: c[n])
        for fails in compile_rules(rules, lambda n: c[n]).values():
            bad = bad | fails
        return ~bad

    return bind(parts, lambda p: bind(F.struct(*_counts(p["source"], p["words"], p["lines"])), verdict))


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, unchanged."""
    return df.where(is_kept(F.coalesce(F.col(text), F.lit("")), rules))
