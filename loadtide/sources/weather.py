"""Daily, hourly and forecast weather."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadtide.functions.clock import day_of, slot
from loadtide.functions.numeric import number
from loadtide.operators.ordered import keep_one
from loadtide.operators.regular import carry_one, interpolate_grid
from loadtide.sources.readings import parse_ts

# Name fragments that identify the daily columns.
DAILY_FRAGMENTS = {"date": "date", "temp_max_c": "temp_max", "temp_min_c": "temp_min",
                   "temp_mean_c": "temp_mean", "rainfall_mm": "rainfall"}


def daily_weather(df: DataFrame, keys=("region",), seq: str = "seq") -> DataFrame:
    """Columns found by name, coerced; the mean is derived only where a series has none; last copy per date."""
    low = {c.strip().lower(): c for c in df.columns}
    found = {k: next((low[c] for c in low if frag in c), None) for k, frag in DAILY_FRAGMENTS.items()}
    cols = {"date": day_of(parse_ts(F.col(found["date"]).cast("string")))}
    for c in ("temp_max_c", "temp_min_c", "temp_mean_c", "rainfall_mm"):
        cols[c] = number(found[c]) if found[c] else F.lit(None).cast("double")
    rows = df.select(*keys, seq, *[v.alias(k) for k, v in cols.items()]).where("date is not null")
    has_mean = rows.groupBy(*keys).agg(F.count("temp_mean_c").alias("_n"))
    mean = F.when(F.col("_n") == 0, (F.col("temp_max_c") + F.col("temp_min_c")) / 2).otherwise(F.col("temp_mean_c"))
    rows = rows.join(has_mean, list(keys)).withColumn("temp_mean_c", mean).drop("_n")
    return keep_one(rows, [*keys, "date"], seq).drop(seq)


def reject_empty_series(df: DataFrame, column: str = "temp_max_c", keys=("region",)) -> DataFrame:
    """Series whose column is null throughout are dropped."""
    ok = df.groupBy(*keys).agg(F.count(column).alias("_n")).where("_n > 0").select(*keys)
    return df.join(ok, list(keys))


def daily_from_hourly(df: DataFrame, keys=("region",), ts="ts") -> DataFrame:
    """Day extremes and means; rain is NULL when every hour is."""
    return df.groupBy(*keys, day_of(ts).alias("date")).agg(
        F.max("temp_c").alias("temp_max_c"), F.min("temp_c").alias("temp_min_c"),
        F.avg("temp_c").alias("temp_mean_c"), F.avg("humidity_pct").alias("humidity_mean_pct"),
        F.sum("rainfall_mm").alias("rainfall_mm"))


def half_hourly(df: DataFrame, keys=("region",), columns=("temp_c", "humidity_pct"), ts="ts") -> DataFrame:
    points = df.select(*keys, slot(ts).alias("hh"), *columns)
    return interpolate_grid(points, list(keys), list(columns), limit=2)


def forecast_half_hourly(df: DataFrame, keys=("region",), origin="forecast_origin_date", ts="ts",
                         columns=("temp_c", "humidity_pct")) -> DataFrame:
    """Forecast hours on half-hours, one step past the end, last value carried once, lead day recomputed."""
    points = df.select(*keys, slot(ts).alias("hh"), *columns)
    out = interpolate_grid(points, list(keys), list(columns), limit=2, extra_steps=1)
    for c in columns:
        out = carry_one(out, list(keys), c)
    issued = df.groupBy(*keys).agg(F.min(origin).alias("weather_forecast_origin"))
    return (out.join(issued, list(keys))
            .withColumns({"weather_source_type": F.lit("FORECAST_7DAY"),
                          "weather_lead_day": F.datediff(F.to_date("ts"), F.to_date("weather_forecast_origin"))}))


def forecast_vintage(df: DataFrame, origin: Column, days: int = 7, keys=("region",), ts="ts") -> DataFrame:
    """Rows of the ``days`` target dates after the origin, with lead day, for complete series only."""
    lead = F.datediff(F.to_date(ts), F.to_date(origin))
    rows = df.withColumn("lead_day", lead).where(F.col("lead_day").between(1, days))
    whole = (rows.groupBy(*keys).agg(F.count_distinct("lead_day").alias("_n"))
             .where(F.col("_n") == days).select(*keys))
    return rows.join(whole, list(keys))


def write_vintage(df: DataFrame, path: str) -> None:
    """Archive and latest in one table: partitions by retrieval time, the newest is the latest."""
    df.write.mode("append").partitionBy("retrieved_at").parquet(path)


def latest_common_origin(manifest: DataFrame, rows: DataFrame, origin="forecast_origin_date") -> DataFrame:
    """Newest origin of the manifest, or of the rows when the manifest is empty."""
    m = manifest.agg(F.max(origin).alias("m"))
    r = rows.agg(F.max(origin).alias("r"))
    both = m.select("m", F.lit(None).cast(rows.schema[origin].dataType).alias("r")).unionByName(
        r.select(F.lit(None).cast(rows.schema[origin].dataType).alias("m"), "r"))
    return both.agg(F.coalesce(F.max("m"), F.max("r")).alias("forecast_origin_date"))


def clip_range(start: Column, end: Column, today: Column, lag_days: int = 5) -> tuple[Column, Column]:
    """Requested range cut to what the source can already hold."""
    return start, F.least(end, F.date_sub(today, lag_days))
