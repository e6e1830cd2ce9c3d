"""Counts, group summaries, overlaps and moving frames over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.scale import exact_quantiles, neighbourhood, running, salted_join, settle, top_per_group


def value_counts(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    return counts if top is None else counts.orderBy(F.desc("count"), *columns).limit(top)


def exploded_counts(
    df: DataFrame, key: str, items: str, order: Sequence[Column], floor: int, item: str = "item"
) -> DataFrame:
    """Rows per list item over one row per key, items with at least ``floor`` rows."""
    lists = df.groupBy(key).agg(F.min_by(items, F.struct(*order)).alias(items))
    return (
        lists.select(F.explode(items).alias(item))
        .groupBy(item)
        .agg(F.count(F.lit(1)).alias("doc_count"))
        .where(F.col("doc_count") >= floor)
    )


def conditional_mean(df: DataFrame, by: str, value: str, upto: int) -> DataFrame:
    """Mean of ``value`` for every whole number 0..upto in ``by``; null where there is none."""
    means = df.groupBy(F.col(by).cast("long").alias(by)).agg(F.avg(value).alias("mean"))
    return df.sparkSession.range(upto + 1).withColumnRenamed("id", by).join(means, by, "left")


def describe(df: DataFrame, value: str, tie: str, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, deviation, extremes and exact quantiles as (statistic, value) rows."""
    moments = df.agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    long = moments.unpivot([], moments.columns, "statistic", "value")
    quantiles = exact_quantiles(df, [], value, tie, probs).select(
        F.format_string("q%.2f", "q").alias("statistic"), F.col("quantile").cast("double").alias("value")
    )
    return long.unionByName(quantiles)


def group_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def sum_scores(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(score).alias(score))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Size of the common part of two key sets and its share of each side."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    flags = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    both = F.sum(F.col("l") * F.col("r"))
    return flags.agg(
        both.alias("common"),
        (both / F.sum("l")).alias("share_left"),
        (both / F.sum("r")).alias("share_right"),
    )


def nonzero_norm_mean(df: DataFrame, norm: Column, above: float = 1e-6) -> DataFrame:
    return df.agg(F.avg(F.when(norm > above, norm)).alias("mean_norm"))


def moving_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 250
) -> DataFrame:
    """Mean of the last ``window`` rows; null until that many are there."""
    placed = running(df, keys, order)
    framed = neighbourhood(placed, keys, "pos", window - 1, 0, {"sma": F.avg(value)})
    return framed.withColumn("sma", F.when(F.col("pos") >= window, F.col("sma")))


def ranks(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """Competition rank (equal values share the lowest place) in groups of any size."""
    placed = running(df, keys, [value, tie])
    lowest = settle(placed.groupBy(*keys, value).agg(F.min("pos").alias(name), F.count(F.lit(1)).alias("_n")))
    return salted_join(placed.drop("pos"), lowest.drop("_n"), [*keys, value], counts=lowest)


def latest(df: DataFrame, keys: Sequence[str], moment: str, tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(moment, tie)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def nearest_to_centroid(df: DataFrame, cluster: str, vector: str, row_id: str, n: int | None) -> DataFrame:
    """The ``n`` rows of each cluster nearest to its mean vector, with their distance; all when ``n`` is None."""
    means = df.groupBy(cluster).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("_centroid"))
    gap = F.zip_with(vector, "_centroid", lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
    away = F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)), 9)
    rows = salted_join(df, settle(means), [cluster]).withColumn("distance", away).drop("_centroid")
    return rows if n is None else top_per_group(rows, [cluster], [F.asc("distance"), F.asc(row_id)], n)
