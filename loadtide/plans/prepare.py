"""Raw readings to the prepared half-hour table: the stage boundary of every plan.

The raw table is scanned once. Its half-hour bins, a small fraction of it, are
written to the shared folder; grid, features, origins and scores read those.
"""
from pyspark.sql import DataFrame

from loadtide.operators.regular import continuous_grid, resample_mean
from loadtide.session import cut_lineage


def half_hour_bins(readings: DataFrame, keys=("region",), **resample) -> DataFrame:
    return cut_lineage(resample_mean(readings, list(keys), **resample), "half-hours")


def half_hour_grid(readings: DataFrame, keys=("region",), zero_columns=(), **resample) -> DataFrame:
    """Continuous half-hour grid over bins written once."""
    return continuous_grid(half_hour_bins(readings, keys, **resample), list(keys), list(zero_columns))
