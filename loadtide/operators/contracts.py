"""What a feature may be used for, stated as expressions over a feature-name column."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadtide.config import (CALENDAR, DEMAND, FEATURES_A, FEATURES_B, HOLIDAY, LAGS, PROFILE, TREND, UNSAFE_PATTERNS,
                             WEATHER_CONTEXT, WEATHER_INPUT)

CLIMATE = [f for f in WEATHER_CONTEXT if f.startswith("expected_") or f == "historical_rain_probability"]


def is_unsafe(feature="feature") -> Column:
    return F.lower(F.col(feature)).rlike("|".join(UNSAFE_PATTERNS))


# Usage phrases and weather rules that readers of the feature contract look for.
USE = {"recursive": "Yes, recursive", "known": "Yes", "forecast": "Forecast then climatology", "rebuilt": "Rebuild/fallback", "benchmark": "Benchmark only", "none": "No"}
WEATHER_RULE = {"input": "FORECAST_7DAY > CLIMATOLOGY_FALLBACK", "context": "origin-safe reconstruction/climatology", "none": "none"}


def four_month_use(feature="feature") -> Column:
    """How a predictor may be used over a four-month recursive horizon."""
    f = F.col(feature)
    return (F.when(f.isin([*LAGS, *DEMAND]), USE["recursive"]).when(f.isin(CALENDAR + HOLIDAY + TREND + PROFILE + CLIMATE), USE["known"])
            .when(f.isin(WEATHER_INPUT), USE["forecast"]).when(f.isin(WEATHER_CONTEXT), USE["rebuilt"])
            .when(f.isin("aemo_forecast_MW", "aemo_actual_MW"), USE["benchmark"]).otherwise(USE["none"]))


def weather_source_rule(feature="feature") -> Column:
    f = F.col(feature)
    return F.when(f.isin(WEATHER_INPUT), WEATHER_RULE["input"]).when(f.isin(WEATHER_CONTEXT), WEATHER_RULE["context"]).otherwise(WEATHER_RULE["none"])


def filled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null rows per column as (feature, filled), from one aggregate."""
    return df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "feature", "filled")


def audit(features: DataFrame) -> DataFrame:
    """Set membership, safety and horizon use for a table of feature names."""
    return features.withColumns({
        "in_A": F.col("feature").isin(FEATURES_A).cast("int"), "in_B": F.col("feature").isin(FEATURES_B).cast("int"),
        "unsafe": is_unsafe().cast("int"), "four_month_use": four_month_use(), "weather_rule": weather_source_rule()})
