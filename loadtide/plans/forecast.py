"""Seasonal-naive forecasts, weather policy and forecast vintages."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.config import DAY, NAIVE_LAG
from loadtide.plans.panel import horizon_rows, lag_sources, series_starts

KEYS = ["region"]


def seasonal_naive(df: DataFrame, origins: DataFrame, lag: int, keys=KEYS, value="y",
                   model: str | None = None) -> DataFrame:
    """Recursive naive in closed form: each target reads the last actual in its own phase.

    y[t - lag * (floor((t - origin) / lag) + 1)] is always before the origin, so
    the recursion is a single equi-join on (series, slot).
    """
    fc = horizon_rows(origins, keys)
    ahead = F.col("hh") - F.col("origin_hh")
    cycles = (ahead - F.pmod(ahead, F.lit(lag))) / F.lit(lag) + 1
    fc = fc.withColumn("src_hh", (F.col("hh") - F.lit(lag) * cycles).cast("long"))
    src = df.select(*keys, F.col("hh").alias("src_hh"), F.col(value).alias("forecast"))
    out = fc.join(src, [*keys, "src_hh"], "left").drop("src_hh")
    return out.withColumn("model", F.lit(model or f"Naive{lag}"))


def naive_forecasts(df: DataFrame, origins: DataFrame, keys=KEYS, value="y") -> DataFrame:
    """All naive models in one join: the lag is a column."""
    fc = horizon_rows(origins, keys).withColumn("_m", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.lit(k).cast("long").alias("lag")) for n, k in NAIVE_LAG.items()])))
    fc = fc.select("*", "_m.model", "_m.lag").drop("_m")
    ahead = F.col("hh") - F.col("origin_hh")
    cycles = (ahead - ahead % F.col("lag")) / F.col("lag") + 1
    fc = fc.withColumn("src_hh", (F.col("hh") - F.col("lag") * cycles).cast("long"))
    src = df.select(*keys, F.col("hh").alias("src_hh"), F.col(value).alias("forecast"))
    return fc.join(src, [*keys, "src_hh"], "left").drop("src_hh", "lag")


def with_actual(fc: DataFrame, df: DataFrame, keys=KEYS, value="y") -> DataFrame:
    """Exact-timestamp match of forecast and actual."""
    return fc.join(df.select(*keys, "hh", F.col(value).alias("actual")), [*keys, "hh"])


def forecast_frame(fc: DataFrame, history: DataFrame, vintage: str, keys=KEYS) -> DataFrame:
    """One vintage with its horizon step, days ahead and lag provenance."""
    out = lag_sources(fc, series_starts(history, keys), keys)
    return out.withColumns({
        "forecast_horizon_days": F.rint(F.col("step") / F.lit(float(DAY)) * 1000) / 1000,
        "weather_feature_source": F.lit("NOT_APPLICABLE"),
        "weather_policy": F.lit("NOT_APPLICABLE"),
        "forecast_vintage": F.lit(vintage)})


def latest_vintage(rows: DataFrame, keys: list[str], issued: str, cutoff) -> DataFrame:
    """Per target, the newest row issued no later than ``cutoff``, as an aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    known = rows.where(F.col(issued).isNotNull() & (F.col(issued) <= cutoff))
    return (known.groupBy(*keys).agg(F.max_by(F.struct(*rest), issued).alias("_r"))
            .select(*keys, "_r.*"))


def allowed_sources(mode: str):
    """Which supplied weather rows a policy may use: (source, issue, information origin) -> test."""
    def use(source, issued, origin):
        fresh = (source == "FORECAST_7DAY") & issued.isNotNull() & (issued <= origin)
        climate = source == "CLIMATOLOGY_FALLBACK"
        observed = source == "OBSERVED_REANALYSIS"
        return {"live": fresh | climate, "frozen": fresh | climate,
                "retrospective": observed | climate}.get(mode, F.lit(False))
    return use


# Label of the row source and note of each weather policy.
POLICY_NOTE = {
    "historical_backtest": "HISTORICAL_BACKTEST_ORIGIN_SAFE_CLIMATOLOGY",
    "frozen": "FROZEN_ORIGIN_VINTAGE_ONLY_THEN_CLIMATOLOGY",
    "live": "LIVE_FORECAST_7DAY_THEN_CLIMATOLOGY",
    "retrospective": "RETROSPECTIVE_OBSERVED_WHERE_AVAILABLE_NOT_MODEL_SELECTION",
}


def apply_weather_policy(frame: DataFrame, mode: str, columns: list[str], source="source",
                         issued="issued", origin="information_origin") -> DataFrame:
    """Keep a supplied value only where the policy allows it, else the safe fallback.

    ``frame`` carries each supplied column ``c`` beside its fallback ``fb_c``.
    """
    use = F.coalesce(allowed_sources(mode)(F.col(source), F.col(issued), F.col(origin)), F.lit(False))
    base = "BACKTEST_CLIMATOLOGY" if mode == "historical_backtest" else "CLIMATOLOGY_FALLBACK"
    picked = {c: F.when(use & F.col(c).isNotNull(), F.col(c)).otherwise(F.col(f"fb_{c}")) for c in columns}
    return frame.withColumns({**picked,
                              "weather_feature_source": F.when(use, F.col(source)).otherwise(base),
                              "weather_policy_note": F.lit(POLICY_NOTE[mode])})


def rolling_segments(fc: DataFrame, origin, ts="ts", source="weather_feature_source") -> DataFrame:
    """Month-to-date prediction, live week, then climatology bridge."""
    return fc.withColumn("segment_type",
                         F.when(F.col(ts) < origin, "MONTH_TO_DATE_MODEL_PREDICTION")
                         .when(F.col(source) == "FORECAST_7DAY", "LIVE_FORECAST_7DAY")
                         .otherwise("CLIMATOLOGY_BRIDGE"))
