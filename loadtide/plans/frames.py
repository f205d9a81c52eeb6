"""The feature frames of set A at many origins: training rows before each origin, and the horizon after it.

What looks back a fixed way (lags, strict day windows, same-clock means, calendar, holidays, trend) is the same for every origin and is computed once, with one
window pass; what depends on the origin (the profiles) is joined from its maps. Demand columns of the horizon stay null until the recursion fills them.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.config import CALENDAR, DEMAND, FEATURES_A, HOLIDAY, LAGS, PROFILE, TREND
from loadtide.operators import features as ft
from loadtide.operators.ordered import require_keys
from loadtide.plans import origin_maps, panel
from loadtide.session import cut_lineage

KEYS = ["region"]
#: Columns whose value is known ahead without any history.
AHEAD = [*CALENDAR, *HOLIDAY]


def base_frame(grid: DataFrame, holidays: DataFrame, keys=KEYS) -> DataFrame:
    """keys, hh, y, local_date and all features that don't depend on an origin, a row a slot of the gap-free grid; written once."""
    rows = ft.holiday_features(ft.civil_calendar(require_keys(grid, list(keys))), holidays)
    rows = ft.trend_features(ft.demand_features(rows, list(keys)), list(keys))
    return cut_lineage(rows.select(*keys, "hh", "ts", "y", "local_date", *[c for c in FEATURES_A if c not in PROFILE]), "base-frame")


def training_frame(base: DataFrame, origins: DataFrame, keys=KEYS) -> DataFrame:
    """keys, origin_hh, hh, y and the features of set A: the rows before each origin, with profiles as that origin sees them."""
    rows = origin_maps.known_rows(base, origins, keys)
    past = base.join(require_keys(origins, list(keys)).select(*keys, "origin_hh"), list(keys)).where(F.col("hh") < F.col("origin_hh"))
    return origin_maps.attach_maps(past, rows, origins, keys).select(*keys, "origin_hh", "hh", "y", *FEATURES_A)


def horizon_frame(base: DataFrame, origins: DataFrame, holidays: DataFrame, keys=KEYS) -> DataFrame:
    """keys, origin_hh, hh and the features of set A over each horizon: calendar, holidays, trend and the origin's profiles; lags and demand windows are null."""
    rows = origin_maps.known_rows(base, origins, keys)
    starts = base.groupBy(*keys).agg(F.min("hh").alias("_h0"))
    ahead = panel.horizon_rows(origins, list(keys)).select(*keys, "origin_hh", "hh", "ts")
    ahead = ft.holiday_features(ft.civil_calendar(ahead), holidays).join(starts, list(keys))
    ahead = ahead.withColumns({"time_index": F.col("hh") - F.col("_h0"), "days_since_start": (F.col("hh") - F.col("_h0")) / F.lit(48.0),
                               **{c: F.lit(None).cast("double") for c in [*LAGS, *DEMAND]}})
    return origin_maps.attach_maps(ahead, rows, origins, keys).select(*keys, "origin_hh", "hh", *FEATURES_A)


def checked(frame: DataFrame, features=tuple(FEATURES_A)) -> DataFrame:
    """Per feature: rows, nulls, smallest and largest value, as one aggregate."""
    one = [F.struct(F.lit(c).alias("feature"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(F.col(c).cast("double")).alias("low"),
                    F.max(F.col(c).cast("double")).alias("high")) for c in features]
    return frame.agg(F.array(*one).alias("_c")).select(F.inline("_c"))


assert set(FEATURES_A) == {*LAGS, *CALENDAR, *HOLIDAY, *PROFILE, *DEMAND, *TREND}
