"""Time expressions.  Times are integer nanoseconds UTC; Spark timestamps only parse or print whole seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_SECOND = 1_000_000_000


def decimal_seconds_ns(text: Column) -> Column:
    """Decimal epoch seconds as text to nanoseconds, cut off after the ninth digit."""
    return (text.cast("decimal(38,12)") * F.lit(NS_PER_SECOND).cast("decimal(10,0)")).cast("bigint")


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.trim(text.cast("string")), "Z+$", "")


def _digits(text: Column) -> Column:
    return F.left(F.regexp_extract(_clean(text), r"^[^.]*\.([0-9]+)", 1), F.lit(9))


def fraction_ns(text: Column) -> Column:
    """Nanoseconds written behind the first point, cut off after nine digits."""
    return F.rpad(_digits(text), 9, "0").cast("bigint")


def precision_ns(text: Column) -> Column:
    """Span of one tick of the written time: a second, or 10^(9 - fraction digits)."""
    return F.rpad(F.lit("1"), F.lit(10) - F.length(_digits(text)), "0").cast("bigint")


def datetime_ns(text: Column) -> Column:
    """``YYYY:mm:ddTHH:MM:SS`` or ``YYYY-mm-ddTHH:MM:SS`` with optional fraction and Z; null if unreadable."""
    base = F.substring_index(_clean(text), ".", 1)
    stamp = F.coalesce(
        F.try_to_timestamp(base, F.lit("yyyy:M:d'T'H:m:s")),
        F.try_to_timestamp(base, F.lit("yyyy-M-d'T'H:m:s")),
    )
    return F.unix_seconds(stamp) * F.lit(NS_PER_SECOND) + fraction_ns(text)


def lenient_int(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("bigint")


def whole_seconds(ns: Column) -> Column:
    return F.call_function("div", ns - F.pmod(ns, F.lit(NS_PER_SECOND)), F.lit(NS_PER_SECOND))


def event_timestamp(tool: Column, attributes: Column) -> Column:
    """Timestamp struct of an edge.  ``source`` names the preferred field even when the other one was read."""
    recap = tool == "recap"
    ts, date = attributes["ts"], attributes["cf:date"]
    raw = F.when(recap, F.coalesce(ts, date)).otherwise(F.coalesce(date, ts))
    wall = datetime_ns(raw)
    first = attributes["cf:jiffies"]
    text = F.when(first.isin("", "0"), attributes["jiffies"]).otherwise(
        F.coalesce(first, attributes["jiffies"])
    )
    count = F.when(tool == "camflow", lenient_int(text))
    jiffies = F.when(count > 0, count)
    counted = jiffies.isNotNull()
    return F.struct(
        wall.alias("wall_time_ns"),
        precision_ns(raw).alias("wall_time_precision_ns"),
        F.when(recap, wall).otherwise(F.coalesce(jiffies, whole_seconds(wall))).alias("model_time"),
        F.when(recap, "ns").when(counted, "jiffies").otherwise("seconds").alias("model_time_unit"),
        F.coalesce(jiffies, F.lit(0).cast("bigint")).alias("order"),
        F.when(recap, "ts").when(counted, "cf:date+cf:jiffies").otherwise("cf:date").alias("source"),
        raw.alias("raw"),
        jiffies.alias("jiffies"),
    )


def event_end_ns(wall: Column, precision: Column) -> Column:
    """Last nanosecond covered by an event written with the given precision."""
    return wall + F.greatest(F.lit(1), F.coalesce(precision, F.lit(1))) - F.lit(1)


def ns_label(ns: Column) -> Column:
    """``YYYY-mm-dd HH:MM:SS.nnnnnnnnn`` in UTC."""
    second = F.timestamp_seconds(whole_seconds(ns))
    nanos = F.lpad(F.pmod(ns, F.lit(NS_PER_SECOND)).cast("string"), 9, "0")
    return F.concat_ws(".", F.date_format(second, "yyyy-MM-dd HH:mm:ss"), nanos)


def window_name(start: Column, end: Column) -> Column:
    return F.concat_ws("~", ns_label(start), ns_label(end))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return (start_a <= end_b) & (end_a >= start_b)


def label_window_ns(tool: Column, column: str) -> Column:
    """Start or end (``cve_start`` / ``cve_end``) of a label row: date text for recap, else epoch decimals."""
    return F.when(tool == "recap", datetime_ns(F.col(column))).otherwise(
        decimal_seconds_ns(F.col(f"{column}_epoch"))
    )
