"""Time-slot keys: ``H:M`` text → hour, minute, minute of day, and derived columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440
# Decimal numbers as text; Java's suffixes (5d, 1f), NaN and Infinity are not numbers here.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_time_strict(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Split ``H:M`` into int ``hour``/``minute`` and ``t = hour*60+minute``.

    Strict: a malformed value raises at run time (ANSI cast), like ``astype(int)``.
    """
    parts = F.split(F.col(col), ":")
    return (df.withColumn("hour", parts.getItem(0).cast("int"))
              .withColumn("minute", parts.getItem(1).cast("int"))
              .withColumn("t", F.col("hour") * 60 + F.col("minute")))


def _lenient_int(c: Column) -> Column:
    # decimal text (also "7.5", " 7 ") → truncated int; anything else, NaN, infinity and overflow → 0
    text = F.when(c.rlike(NUMBER), c)
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(0))


def parse_time_tolerant(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Tolerant parse: NULL → ``0:0``, split at the first ``:``, junk parts → 0."""
    text = F.coalesce(F.col(col).cast("string"), F.lit("0:0"))
    parts = F.split(text, ":", 2)
    return (df.withColumn("hour", _lenient_int(F.try_element_at(parts, F.lit(1))))
              .withColumn("minute", _lenient_int(F.try_element_at(parts, F.lit(2))))
              .withColumn("t", F.col("hour") * 60 + F.col("minute")))


def cyclical(c: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2π·c/period``."""
    angle = F.lit(2 * math.pi) * c / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def with_cyclical(df: DataFrame) -> DataFrame:
    """hour/24, minute/60, t/1440 and day/7 encodings."""
    out = df
    for name, src, period in (("hour", "hour", 24), ("minute", "minute", 60),
                              ("t", "t", MINUTES_PER_DAY), ("day", "day", 7)):
        s, c = cyclical(F.col(src), period)
        out = out.withColumn(f"{name}_sin", s).withColumn(f"{name}_cos", c)
    return out


# Hour bands used by the time flags.
EARLY_MORNING_LAST_HOUR = 5
RUSH_HOURS = [7, 8, 9, 17, 18, 19]
MIDDAY_HOURS = [10, 11, 12, 13]


def with_time_flags(df: DataFrame, hour: str = "hour") -> DataFrame:
    h = F.col(hour)
    return (df.withColumn("is_early_morning", (h <= EARLY_MORNING_LAST_HOUR).cast("int"))
              .withColumn("is_rush_hour", h.isin(RUSH_HOURS).cast("int"))
              .withColumn("is_midday", h.isin(MIDDAY_HOURS).cast("int")))


def slot_text(t: Column) -> Column:
    """Unpadded ``H:M`` text for a minute of day."""
    return F.format_string("%d:%d", F.floor(t / 60).cast("int"), F.pmod(t, F.lit(60)))
