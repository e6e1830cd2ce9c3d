"""Document tables: standardise, filter, validate, deduplicate, build a collection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import dates, text as tx
from textloom.scale import best_per_group, running


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df


def standardise(
    df: DataFrame,
    text: str,
    title: str,
    date: str | None = None,
    on_bad_date: str = "error",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns text, title and date (plus ``keep``); rows without text or title are dropped.

    A date that cannot be read stops the job, or becomes null with ``on_bad_date='null'``.
    """
    require_columns(df, [text, title, *keep, *([date] if date else [])])
    out = [F.col(text).alias("text"), F.col(title).alias("title")]
    if date:
        given = F.col(date)
        if dict(df.dtypes)[date] == "string":
            read = F.try_to_timestamp(given)
            if on_bad_date == "error":
                complaint = F.raise_error(F.concat(F.lit("unreadable date: "), given))
                read = F.when(read.isNull() & given.isNotNull(), complaint.cast("timestamp")).otherwise(read)
            given = read.cast("timestamp_ntz")
        out.append(given.cast("timestamp_ntz").alias("date"))
    return df.select(*keep, *out).dropna(subset=["text", "title"])


def min_tokens(df: DataFrame, least: int, text: str = "text", count: Column | None = None) -> DataFrame:
    """Rows with at least ``least`` tokens. ``count`` is any token-count column, such as an
    injected BPE pandas UDF; words are counted by default."""
    if least <= 0:
        return df
    count = F.size(tx.words(F.col(text))) if count is None else count
    return df.where(count >= least)


def assign_periods(df: DataFrame, granularity: str, date: str = "date") -> DataFrame:
    return df.withColumn("time_period", dates.period_ordinal(F.col(date), granularity))


def ascii_filter(df: DataFrame, text: str = "text", above: float = 0.9) -> DataFrame:
    return df.where(tx.ascii_ratio(F.col(text)) > above)


def filter_texts(
    df: DataFrame,
    text: str,
    title: str | None,
    order: Sequence[str],
    above: float = 0.9,
    n_docs: int | None = None,
) -> DataFrame:
    """Non-null, non-empty, mostly ASCII texts. With ``n_docs``: of the first ``2 n`` rows by
    ``order``, the first ``n`` that pass."""
    if n_docs is not None:
        df = df.orderBy(*order).limit(2 * n_docs)
    kept = df.dropna(subset=[text, *([title] if title else [])]).where(F.length(text) > 0)
    kept = ascii_filter(kept, text, above)
    return kept if n_docs is None else kept.orderBy(*order).limit(n_docs)


def min_lines(df: DataFrame, least: int = 4, text: str = "text") -> DataFrame:
    return df.where(tx.line_count(F.col(text)) >= least)


def exclude_containing(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(~F.col(column).contains(part))


def keep_pages(df: DataFrame, url: str, without: Sequence[str] = ("?p=", "?tag=")) -> DataFrame:
    """Rows whose address holds none of the query parts."""
    for part in without:
        df = df.where(~F.col(url).contains(part))
    return df


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key by ``order``."""
    return best_per_group(df, keys, [F.col(o) for o in order])


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Ids 1..n in order, without a single-task window."""
    return running(df, [], order, position=name)


def build_collection(
    df: DataFrame,
    text: str,
    order: Sequence[str],
    title: str | None = None,
    n_docs: int | None = None,
    doc_len: int = 1024,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Collection rows: id from 1, clipped content, title, extra columns with lists as text."""
    kept = filter_texts(df, text, title, order, n_docs=n_docs)
    kinds = dict(df.dtypes)
    flat = [
        (tx.list_to_text(F.col(c)) if kinds[c].startswith("array") else F.col(c)).alias(c) for c in extra
    ]
    rows = kept.select(
        *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
        tx.clip_and_squash(F.col(text), doc_len).alias("content"),
        *([F.col(title).alias("title")] if title else []),
        *flat,
    )
    marks = [f"_o{i}" for i in range(len(order))]
    if title:
        rows = dedup_first(rows, ["title"], marks)
    rows = assign_ids(rows, marks)
    return rows.select("id", "content", *(["title"] if title else []), *extra)


@dataclass(frozen=True)
class Rule:
    """One check on a column: its type after coercion, nullability and lower bound."""

    column: str
    kind: str
    nullable: bool = False
    at_least: float | None = None


def _failures(rule: Rule) -> dict[str, Column]:
    given = F.col(rule.column)
    value = given.try_cast(rule.kind)
    checks = {"type": given.isNotNull() & value.isNull()}
    if not rule.nullable:
        checks["not_null"] = given.isNull()
    if rule.at_least is not None:
        checks[f"at_least_{rule.at_least:g}"] = F.coalesce(value < F.lit(rule.at_least), F.lit(False))
    return checks


def check_schema(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations per column and rule in one pass: (column, rule, n_bad)."""
    require_columns(df, [r.column for r in rules])
    named = [(r.column, label, bad) for r in rules for label, bad in _failures(r).items()]
    counted = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(named)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(label).alias("rule"), F.col(f"c{i}").alias("n_bad"))
            for i, (c, label, _) in enumerate(named)
        ]
    )
    return counted.select(F.inline(rows))


def rejects(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(bad, F.lit(f"{r.column}:{label}"))
                for r in rules
                for label, bad in _failures(r).items()
            ]
        )
    )
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def coerce(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for rule in rules:
        df = df.withColumn(rule.column, F.col(rule.column).try_cast(rule.kind))
    return df


def preprocess(
    df: DataFrame,
    granularity: str,
    text: str,
    title: str,
    date: str | None,
    least_tokens: int = 64,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Standardise, filter by tokens and assign periods, as one lazy plan."""
    rows = min_tokens(standardise(df, text, title, date, keep=keep), least_tokens)
    return assign_periods(rows, granularity) if date else rows


