"""DataFrames to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keep blanks at both ends, and tell an empty text from a missing one.
PLAIN = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": '""',
}


def write_csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none") -> None:
    df.write.options(**PLAIN, quote='"', escape='"', sep=sep, compression=compression).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab separated with backslash escapes."""
    df.write.options(**PLAIN, sep="\t", escape="\\").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_snapshot(df: DataFrame, path: str, user: str, moment: str) -> None:
    """A dated star snapshot per user, as CSV folders named by user and moment."""
    (
        df.withColumn("username", F.col(user))
        .withColumn("snapshot_ts", F.date_format(moment, "yyyyMMdd_HHmmss"))
        .write.options(**PLAIN, quote='"', escape='"')
        .partitionBy("username", "snapshot_ts")
        .mode("append")
        .csv(path)
    )
