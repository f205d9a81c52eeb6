"""Timestamps, half-hour slots, market and civil clocks, calendar columns.

A slot is the number of whole steps since 1970-01-01 on the series' own clock.
Slots make lags, gaps, chunks and joins plain integer arithmetic.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadtide.config import STEP_MINUTES

ONE_MINUTE = 60_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch(), _col(ts))


def from_micros(us) -> Column:
    return F.timestamp_add("MICROSECOND", _col(us), epoch())


def floor_div(value, size: int) -> Column:
    """Integer floor division without leaving whole numbers."""
    value = _col(value)
    return ((value - F.pmod(value, F.lit(size))) / F.lit(size)).cast("long")


def slot(ts, minutes: int = STEP_MINUTES, closed: str = "left") -> Column:
    """Slot of a reading: left-closed bins carry their start, right-closed their end."""
    width = minutes * ONE_MINUTE
    us = micros(ts)
    return floor_div(us if closed == "left" else us + F.lit(width - 1), width)


def slot_by_label(ts, label: Column, minutes: int = STEP_MINUTES) -> Column:
    """Slot with the convention taken from a column ('ending' or 'beginning')."""
    return (F.when(label == "ending", slot(ts, minutes, "right"))
            .otherwise(slot(ts, minutes, "left")))


def slot_start(hh, minutes: int = STEP_MINUTES) -> Column:
    return from_micros(_col(hh) * F.lit(minutes * ONE_MINUTE))


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def day_of(ts) -> Column:
    return F.to_date(_col(ts)).cast("timestamp_ntz")


def month_start(ts) -> Column:
    return F.trunc(F.to_date(_col(ts)), "month").cast("timestamp_ntz")


def lookup(key, table: dict) -> Column:
    """Constant table as a map literal: no join for configuration."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), _col(key))


def resolve_clocks(df: DataFrame, market_zone: Column, civil_zone: Column, ts="ts") -> DataFrame:
    """Fixed-offset market time to civil time and civil date."""
    local = F.convert_timezone(market_zone, civil_zone, _col(ts))
    return (df.withColumn("local_timestamp", local)
            .withColumn("local_date", day_of("local_timestamp")))


def half_hour_index(ts) -> Column:
    return F.hour(_col(ts)) * 2 + (F.minute(_col(ts)) >= 30).cast("int")


def with_calendar(df: DataFrame, ts="local_timestamp") -> DataFrame:
    """Nine calendar parts, the year, and sine/cosine pairs for the four cycles."""
    t = _col(ts)
    dow = F.weekday(t)
    df = df.withColumns({
        "half_hour_index": half_hour_index(t),
        "hour": F.hour(t),
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(t),
        "week_of_year": F.weekofyear(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "year": F.year(t),
        "day_of_year": F.dayofyear(t),
        "is_weekend": (dow >= 5).cast("int"),
    })
    cycles = {"half_hour": ("half_hour_index", 48.0), "day_of_week": ("day_of_week", 7.0),
              "month": ("month", 12.0), "day_of_year": ("day_of_year", 365.25)}
    waves = {}
    for name, (source, period) in cycles.items():
        angle = F.lit(2.0) * F.pi() * F.col(source) / F.lit(period)
        waves[f"sin_{name}"] = F.sin(angle)
        waves[f"cos_{name}"] = F.cos(angle)
    return df.withColumns(waves)


def training_cutoff(origin) -> tuple[Column, Column]:
    """Last half-hour of the previous full month, and the first of this month."""
    first = month_start(origin)
    return F.timestamp_add("MINUTE", F.lit(-STEP_MINUTES), first), first


def horizon_end(first, months: int = 4) -> Column:
    """Last half-hour label of the month ``months - 1`` after ``first``."""
    stop = F.add_months(F.to_date(_col(first)), months).cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", F.lit(-STEP_MINUTES), stop)
