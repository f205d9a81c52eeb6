"""Demand, trend, holiday, profile and weather features on the half-hour grid."""
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.config import DAY, LAGS, RAIN_DAY_MM
from loadtide.functions.clock import day_of, floor_div, with_calendar
from loadtide.functions.numeric import positive, safe_corr
from loadtide.operators.ordered import framed, require_keys, with_row_number
from loadtide.operators.quantiles import average_ranks
from loadtide.session import cut_lineage

KEYS = ["region"]


def demand_features(df: DataFrame, keys=KEYS, value="y", skip_nulls: bool = True) -> DataFrame:
    """Lags, strict previous-day summaries and same-half-hour means, one shuffle for all.

    Needs the gap-free grid, where the k-th row before is k steps before.

    ``skip_nulls`` averages the days that exist (training rule); otherwise one
    missing day makes the mean null (recursion rule).
    """
    def build(w):
        day = w.rangeBetween(-(2 * DAY - 1), -DAY)
        out = {f"_back{d}": F.lag(value, DAY * d).over(w) for d in range(1, 15)}
        for name, f in (("_n", F.count), ("_mean", F.avg), ("_max", F.max), ("_min", F.min), ("_std", F.stddev_samp)):
            out[name] = f(value).over(day)
        return out

    wide = framed(df, keys, "hh", build, back=14 * DAY)
    full = F.col("_n") == DAY
    out = {name: F.col(f"_back{k // DAY}") for name, k in LAGS.items()}
    for name, c in (("previous_day_mean", "_mean"), ("previous_day_peak", "_max"), ("previous_day_min", "_min"),
                    ("rolling_mean_24h_at_t_minus_48", "_mean"), ("rolling_std_24h_at_t_minus_48", "_std")):
        out[name] = F.when(full, F.col(c))
    for days in (7, 14):
        same = [f"_back{d}" for d in range(1, days + 1)]
        if skip_nulls:
            # an array skips what is missing: sum and size of the days that exist
            there = F.array_compact(F.array(*same))
            total = F.aggregate(there, F.lit(0.0), lambda acc, x: acc + x)
            out[f"same_half_hour_{days}day_mean"] = F.when(F.size(there) > 0, total / F.size(there))
        else:
            out[f"same_half_hour_{days}day_mean"] = F.expr(f"({' + '.join(same)}) / {float(days)}")
    made = wide.withColumns(out)
    return made.drop(*[f"_back{d}" for d in range(1, 15)], "_n", "_mean", "_max", "_min", "_std")


def demand_features_by_join(df: DataFrame, keys=KEYS, value="y") -> DataFrame:
    """The lags again as equi-joins on slot arithmetic: an independent formulation."""
    out = df
    for name, k in LAGS.items():
        past = df.select(*keys, (F.col("hh") + k).alias("hh"), F.col(value).alias(name))
        out = out.join(past, [*keys, "hh"], "left")
    return out


def trend_features(df: DataFrame, keys=KEYS) -> DataFrame:
    """Position and days since the start; on a gap-free grid position is slot arithmetic."""
    df = require_keys(df, list(keys))
    start = df.groupBy(*keys).agg(F.min("hh").alias("_h0"))
    return (df.join(start, keys)
            .withColumns({"time_index": F.col("hh") - F.col("_h0"),
                          "days_since_start": (F.col("hh") - F.col("_h0")) / F.lit(float(DAY))})
            .drop("_h0"))


def holiday_features(df: DataFrame, holidays: DataFrame, on: list[str] = ("local_date",)) -> DataFrame:
    """Holiday flag and name on the civil date, with the day before and after.

    The calendar is unfolded to three rows per holiday and folded to one row per
    date, so a single join serves all three flags.
    """
    other = [c for c in on if c != "local_date"]
    marks = (holidays.where("is_public_holiday = 1")
             .select(*other, F.inline(F.array(
                 F.struct(F.col("date").alias("local_date"), F.lit(1).alias("_on"), F.lit(0).alias("_b"),
                          F.lit(0).alias("_a"), F.col("holiday_name").alias("_name")),
                 F.struct((F.col("date") - F.expr("interval 1 day")).alias("local_date"), F.lit(0).alias("_on"),
                          F.lit(1).alias("_b"), F.lit(0).alias("_a"), F.lit(None).cast("string").alias("_name")),
                 F.struct((F.col("date") + F.expr("interval 1 day")).alias("local_date"), F.lit(0).alias("_on"),
                          F.lit(0).alias("_b"), F.lit(1).alias("_a"), F.lit(None).cast("string").alias("_name")))))
             .groupBy(*on).agg(F.max("_on").alias("_on"), F.max("_b").alias("_b"),
                               F.max("_a").alias("_a"), F.max("_name").alias("_name")))
    return (df.join(marks, list(on), "left")
            .withColumns({"is_public_holiday": F.coalesce("_on", F.lit(0)),
                          "holiday_name": F.coalesce("_name", F.lit("")),
                          "is_day_before_holiday": F.coalesce("_b", F.lit(0)),
                          "is_day_after_holiday": F.coalesce("_a", F.lit(0))})
            .drop("_on", "_b", "_a", "_name"))


# --- profiles -------------------------------------------------------------------------------

def halfhour_profile(df: DataFrame, keys=KEYS, value="y") -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, "month", "half_hour_index")
            .agg(F.avg(value).alias("historical_month_halfhour_mean"),
                 F.median(value).alias("historical_month_halfhour_median")))


def dow_halfhour_profile(df: DataFrame, keys=KEYS, value="y") -> DataFrame:
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, "month", "day_of_week", "half_hour_index")
            .agg(F.avg(value).alias("historical_month_dow_halfhour_mean")))


def daily_profile(df: DataFrame, keys=KEYS, value="y") -> DataFrame:
    """Day means and peaks first, then month means of both and the spread of day means."""
    daily = (df.where(F.col(value).isNotNull()).groupBy(*keys, "month", "local_date")
             .agg(F.avg(value).alias("_mean"), F.max(value).alias("_peak")))
    return daily.groupBy(*keys, "month").agg(
        F.avg("_mean").alias("historical_month_daily_mean"),
        F.avg("_peak").alias("historical_month_peak_mean"),
        F.stddev_samp("_mean").alias("historical_month_variability"))


def attach_profiles(df: DataFrame, history: DataFrame, keys=KEYS, value="y") -> DataFrame:
    """Left-join all profile tables. Their size is series x month x clock; the optimiser
    broadcasts them when they are small and shuffles them when they are not."""
    return (df.join(halfhour_profile(history, keys, value), [*keys, "month", "half_hour_index"], "left")
            .join(dow_halfhour_profile(history, keys, value),
                  [*keys, "month", "day_of_week", "half_hour_index"], "left")
            .join(daily_profile(history, keys, value), [*keys, "month"], "left"))


# --- weather --------------------------------------------------------------------------------

def one_row_per_day(df: DataFrame, keys=KEYS, columns: list[str] = (), order: str = "hh",
                    by: list[str] = ("local_date",)) -> DataFrame:
    """First row of each day, as an aggregate."""
    return df.groupBy(*keys, *by).agg(*[F.min_by(c, order).alias(c) for c in columns])


def daily_weather_features(daily: DataFrame, keys=KEYS, base: str | None = None) -> DataFrame:
    """Daily lags 1 and 7 and the strict 7-row mean ending yesterday; degree days if a base is given.

    Days are rows here, as in the source table, so the chunk is a block of day numbers.
    """
    daily = daily.withColumn("_day", F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    daily = with_row_number(daily, keys, [F.col("_day")], floor_div("_day", 366), "_pos")
    degree = {}
    if base:
        degree = {"hdd": positive(F.col(base) - F.col("temp_mean_c")),
                  "cdd": positive(F.col("temp_mean_c") - F.col(base))}
        daily = daily.withColumns(degree)

    def build(w):
        week = w.rowsBetween(-7, -1)
        out = {"temp_mean_lag_1d": F.lag("temp_mean_c", 1).over(w),
               "temp_mean_lag_7d": F.lag("temp_mean_c", 7).over(w),
               "rolling_temp_mean_7d": F.when(F.count("temp_mean_c").over(week) == 7,
                                              F.avg("temp_mean_c").over(week))}
        for c in degree:
            out[f"{c}_lag_1d"] = F.lag(c, 1).over(w)
        return out

    return framed(daily, keys, "_pos", build, back=7, chunk=366 * 4).drop("_pos", "_day")


def balance_point(days: DataFrame, keys=KEYS, first: float = 10.0, last: float = 27.5, step: float = 0.5,
                  min_days: int = 365) -> DataFrame:
    """Base temperature whose distance explains demand best; the lowest base wins ties.

    The candidate bases form a fixed array per row, folded straight into
    per-base moments, so nothing but (series, base) groups is shuffled.
    """
    n = int(round((last - first) / step)) + 1
    bases = F.array(*[F.lit(first + i * step) for i in range(n)])
    rows = (days.where("demand is not null and temp is not null")
            .select(*keys, "demand", "temp", F.explode(bases).alias("base")))
    corr = (rows.groupBy(*keys, "base")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.abs(safe_corr("demand", F.abs(F.col("temp") - F.col("base")))).alias("corr"))
            .where((F.col("n") >= min_days) & F.col("corr").isNotNull()))
    best = F.max(F.struct(F.col("corr").alias("c"), (-F.col("base")).alias("b")))
    return (corr.groupBy(*keys).agg(best.alias("_x"))
            .select(*keys, (-F.col("_x.b")).alias("balance_point_c"), F.col("_x.c").alias("balance_point_corr")))


def temperature_climatology(days: DataFrame, keys=KEYS, by: str = "day_of_year") -> DataFrame:
    return (days.where("temp_mean_c is not null").groupBy(*keys, by)
            .agg(F.avg("temp_mean_c").alias("expected_temp_climatology")))


def rain_climatology(days: DataFrame, keys=KEYS, threshold: float = RAIN_DAY_MM) -> DataFrame:
    wet = (F.col("rainfall_mm") > threshold).cast("double")
    return (days.where("rainfall_mm is not null").groupBy(*keys, "month")
            .agg(F.avg(wet).alias("historical_rain_probability"),
                 F.avg("rainfall_mm").alias("mean_rainfall_mm")))


def exact_or_monthly(target: DataFrame, history: DataFrame, value: str, keys=KEYS,
                     exact: list[str] = ("month", "day_of_month"), coarse: list[str] = ("month",),
                     name: str | None = None) -> DataFrame:
    """Climatology by the fine key, with the coarse key where the fine one never occurred."""
    name = name or value
    known = history.where(F.col(value).isNotNull())
    fine = known.groupBy(*keys, *exact).agg(F.avg(value).alias("_fine"))
    wide = known.groupBy(*keys, *coarse).agg(F.avg(value).alias("_wide"))
    return (target.join(fine, [*keys, *exact], "left").join(wide, [*keys, *coarse], "left")
            .withColumn(name, F.coalesce("_fine", "_wide")).drop("_fine", "_wide"))


def weather_context(history: DataFrame, origins: DataFrame, base: str, keys=KEYS) -> DataFrame:
    """Temperature lags, week mean and lagged degree days on a daily path no forecast could have cheated on.

    Days before the origin carry observations (their month's mean where one is
    missing); from the origin on the path is month-day climatology of earlier
    days, or the month's. ``origins`` has (keys, origin, last_day, ``base``).
    """
    first = F.date_sub(F.to_date("origin"), 14)
    path = (origins.select(*keys, "origin", base, F.explode(F.sequence(first, F.to_date("last_day"), F.expr("interval 1 day"))).alias("_d"))
            .withColumns({"date": F.col("_d").cast("timestamp_ntz"), "month": F.month("_d"), "day_of_month": F.dayofmonth("_d"),
                          "_day": F.datediff("_d", F.lit("1970-01-01").cast("date")).cast("long")}).drop("_d"))
    past = (history.join(origins.select(*keys, "origin"), keys).where(F.col("date") < F.col("origin"))
            .withColumns({"month": F.month("date"), "day_of_month": F.dayofmonth("date")}))
    by = [*keys, "origin"]
    path = exact_or_monthly(path, past, "temp_mean_c", by, name="_climate")
    path = exact_or_monthly(path, past, "temp_mean_c", by, exact=["month"], name="_month")
    path = path.join(past.select(*by, "date", F.col("temp_mean_c").alias("_seen")), [*by, "date"], "left")
    path = path.withColumn("safe_temp", F.when(F.col("date") < F.col("origin"), F.coalesce("_seen", "_month")).otherwise(F.col("_climate")))

    def build(w):
        return {"temp_mean_lag_1d": F.lag("safe_temp", 1).over(w), "temp_mean_lag_7d": F.lag("safe_temp", 7).over(w),
                "rolling_temp_mean_7d": F.avg("safe_temp").over(w.rowsBetween(-7, -1))}

    out = framed(path, by, "_day", build, back=7, chunk=366 * 4).where(F.col("date") >= F.col("origin"))
    lag1 = F.col("temp_mean_lag_1d")
    return (out.withColumns({"hdd_lag_1d": positive(F.col(base) - lag1), "cdd_lag_1d": positive(lag1 - F.col(base))})
            .select(*by, "date", "safe_temp", "temp_mean_lag_1d", "temp_mean_lag_7d", "rolling_temp_mean_7d", "hdd_lag_1d", "cdd_lag_1d"))


def civil_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Calendar columns when the market clock is the civil clock."""
    return with_calendar(df.withColumns({"local_timestamp": F.col(ts), "local_date": day_of(ts)}))


# --- summaries ------------------------------------------------------------------------------

def month_to_date(df: DataFrame, keys=KEYS, value="y", origin: DataFrame | None = None) -> DataFrame:
    """The origin's month cut at its day and half-hour, for every year, against prior years."""
    origin = origin if origin is not None else df.groupBy(*keys).agg(F.max("local_timestamp").alias("_o"))
    o = F.col("_o")
    cut = F.dayofmonth(o) * DAY + F.hour(o) * 2 + (F.minute(o) >= 30).cast("int")
    rows = (df.join(origin, keys)
            .where((F.col("month") == F.month(o))
                   & (F.col("day_of_month") * DAY + F.col("half_hour_index") <= cut)))
    by_year = rows.groupBy(*keys, "year").agg(
        F.count(F.lit(1)).alias("intervals"), F.avg(value).alias("mean_MW"),
        F.max(value).alias("peak_MW"), F.min(value).alias("min_MW"), F.max(F.year(o)).alias("_oy"))
    w = W.partitionBy(*keys)
    base = F.avg(F.when(F.col("year") < F.col("_oy"), F.col("mean_MW"))).over(w)
    return by_year.withColumn("pct_vs_prior_year_mean",
                              F.when(base != 0, (F.col("mean_MW") / base - 1) * 100)).drop("_oy")


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = (), name="feature", value="value") -> DataFrame:
    return df.unpivot([F.col(c) for c in keep], [F.col(c).cast("double").alias(c) for c in columns], name, value)


def feature_correlations(df: DataFrame, features: list[str], keys=KEYS, target="y") -> DataFrame:
    """Pearson and Spearman of each feature with the target on jointly complete rows.

    The complete rows are written once and read by every pass below. Ranks come from value histograms, one (series, feature, value) row per
    distinct value, so ties are settled before any ordering and a hot value is one row.
    """
    full = cut_lineage(df.select(*keys, target, *features).dropna(), "complete-rows")
    long = unpivot(full, features, [*keys, target])
    pearson = long.groupBy(*keys, "feature").agg(
        safe_corr("value", target).alias("pearson"), F.count(F.lit(1)).alias("n"))

    value_rank = average_ranks(long, [*keys, "feature"], "value", "_rv").drop("copies")
    target_rank = average_ranks(full.select(*keys, target), keys, target, "_rt").drop("copies")
    both = (long.join(value_rank, [*keys, "feature", "value"]).join(target_rank, [*keys, target]))
    spearman = both.groupBy(*keys, "feature").agg(safe_corr("_rv", "_rt").alias("spearman"))
    out = pearson.join(spearman, [*keys, "feature"])
    gap = F.abs("spearman") - F.abs("pearson")
    return out.withColumns({
        "abs_gap": gap,
        "finding": F.when((F.abs("pearson") < 0.05) & (F.abs("spearman") < 0.05), "no monotonic association")
        .when(gap > 0.10, "non-linear association").otherwise("linear association")})


def weather_response(df: DataFrame, keys=KEYS, target="y") -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.max("balance_point_c").alias("balance_point_c"),
        safe_corr(target, "hdd").alias("corr_hdd"), safe_corr(target, "cdd").alias("corr_cdd"),
        safe_corr(target, "temp_mean_c").alias("corr_temp_mean"))
    return out.withColumn("character", F.when(F.col("corr_hdd") > F.col("corr_cdd") + 0.1, "heating-driven")
                          .when(F.col("corr_cdd") > F.col("corr_hdd") + 0.1, "cooling-driven").otherwise("mixed"))
