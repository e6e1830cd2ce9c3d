"""Row-wise operators keep no state, so they run on a streaming DataFrame as they are.

Limits, ids, windows and everything that ranks whole tables stay batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import dates, links, text as tx
from textloom.operators import books, corpus


def clean(stream: DataFrame, text: str, title: str, date: str | None = None, least_tokens: int = 64,
          granularity: str = "day", keep=()) -> DataFrame:
    """Standardised, filtered rows with their period, for a batch or a stream."""
    return corpus.preprocess(stream, granularity, text, title, date, least_tokens, keep)


def link_rows(stream: DataFrame, row_id: str, text: str) -> DataFrame:
    """Wikitext links of each row."""
    return stream.select(row_id, F.explode(links.wikitext_links(F.col(text))).alias("link")).select(
        row_id, "link.page", "link.section"
    )


def sentence_rows(stream: DataFrame, row_id: str, text: str, reach: int = 3) -> DataFrame:
    found = stream.select(row_id, tx.sentences(F.col(text)).alias("found"))
    return found.select(row_id, F.inline(tx.sentence_windows(F.col("found"), reach)))


def paragraph_rows(stream: DataFrame, row_id: str, text: str, title_words=None) -> DataFrame:
    return stream.select(row_id, F.posexplode(books.paragraphs(F.col(text), title_words)).alias("no", "paragraph"))


def with_period(stream: DataFrame, moment: str, granularity: str) -> DataFrame:
    return stream.withColumn("time_period", dates.period_ordinal(F.col(moment), granularity))
