"""Period ordinals, time bins and time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_ordinal(moment: Column, granularity: str) -> Column:
    """Days, Monday-to-Sunday weeks or months since 1970-01, as whole numbers."""
    day = F.to_date(moment)
    if granularity == "day":
        return F.unix_date(day).cast("int")
    if granularity == "week":
        return (F.floor((F.unix_date(day) + 3) / 7) + 1).cast("int")
    if granularity == "month":
        return ((F.year(day) - 1970) * 12 + F.month(day) - 1).cast("int")
    raise ValueError(f"granularity must be day, week or month, not {granularity!r}")


def millis_of(moment: Column) -> Column:
    """Whole milliseconds since the epoch, free of the session time zone."""
    start = F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    return F.timestamp_diff("MILLISECOND", start, moment.cast("timestamp_ntz"))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of equal width over [low, high]; bins are closed on the right."""
    raw = F.ceil((value - low) / (high - low) * bins) - 1
    return F.when(high <= low, F.lit(0)).otherwise(F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0))).cast("int")


def file_name_time(name: Column) -> Column:
    """Timestamp from a leading run of 14 digits and a dash; null when there is none."""
    return F.try_to_timestamp(
        F.nullif(F.regexp_extract(name, r"^(\d{14})-", 1), F.lit("")), F.lit("yyyyMMddHHmmss")
    ).cast("timestamp_ntz")


def iso_to_utc_text(text: Column) -> Column:
    """An ISO time with Z or an offset as ``yyyy-MM-dd HH:mm:ss UTC``."""
    moment = F.try_to_timestamp(text)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def utc_text_date(text: Column) -> Column:
    return F.to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` with truncated milliseconds; hours wrap at a day."""
    whole = F.floor(seconds)
    millis = F.floor((seconds - whole) * 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.pmod(F.floor(whole / 3600), F.lit(24)),
        F.pmod(F.floor(whole / 60), F.lit(60)),
        F.pmod(whole, F.lit(60)),
        millis,
    )


def srt_range(start: Column, end: Column) -> Column:
    return F.concat(srt_time(start), F.lit(" --> "), srt_time(end))
