import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadtide.functions.clock import resolve_clocks, slot, slot_start
from loadtide.operators import clean, regular
from loadtide.sources.weather import forecast_half_hourly


def frame(spark, values, region="a"):
    return spark.createDataFrame([(region, i, v) for i, v in enumerate(values)], "region string, hh long, y double")


N = None
RUNS = [N, N, 1.0, N, 3.0, N, N, 9.0, N, N, N, 20.0, N, N]


def reference_fill(values, limit=2):
    s = pd.Series(values, dtype=float)
    gone = s.isna()
    size = gone.groupby((gone != gone.shift()).cumsum()).transform("size")
    short = gone & (size <= limit)
    out = s.copy()
    out[short] = s.interpolate(limit=limit)[short]
    return out, short


@pytest.mark.parametrize("values", [RUNS, RUNS[2:], RUNS[:12], [N, 1.0, N], [1.0, N, N, N], [N, N, N, 2.0], [N, N]])
def test_short_gaps_match_pandas(spark, values):
    got = clean.fill_short_gaps(frame(spark, values), pos="hh").toPandas().sort_values("hh")
    want, short = reference_fill(values)
    np.testing.assert_allclose(got["y"].to_numpy(float), want.to_numpy(), equal_nan=True)
    assert got["is_imputed"].tolist() == short.astype(int).tolist()


def test_null_runs_of_any_length(spark):
    got = clean.null_runs(frame(spark, RUNS), pos="hh", chunk=3).toPandas().sort_values("run_start")
    assert got[["run_start", "run_length"]].values.tolist() == [[0, 2], [3, 1], [5, 2], [8, 3], [12, 2]]


def minutes(spark, rows):
    return spark.createDataFrame([("a", pd.Timestamp(t).to_pydatetime(), float(v), i) for i, (t, v) in enumerate(rows)],
                                 "region string, ts timestamp_ntz, y double, seq long")


def test_regime_change_is_not_a_gap(spark):
    old = pd.date_range("2023-09-01", "2023-09-30 23:30", freq="30min").delete(10)
    new = pd.date_range("2023-10-01", "2023-10-03", freq="5min").delete([20, 21])
    df = minutes(spark, [(t, 1.0) for t in old.append(new)])
    res = {str(r["month"])[:7]: r["resolution_minutes"] for r in clean.native_resolution(clean.with_steps(df)).collect()}
    assert res == {"2023-09": 30.0, "2023-10": 5.0}
    assert clean.completeness(df).first()["missing_intervals"] == 3
    dense = clean.repair(df)
    assert dense.where("y is null").count() == 0 and dense.where("is_imputed = 1").count() == 3


def test_modal_step_ties_take_the_smallest(spark):
    df = minutes(spark, [("2024-01-01 00:00", 1.0), ("2024-01-01 00:05", 1.0), ("2024-01-01 00:35", 1.0)])
    assert clean.native_resolution(clean.with_steps(df)).first()["resolution_minutes"] == 5.0


def test_bin_edges(spark):
    rows = ["2024-01-01 00:00:00", "2024-01-01 00:00:00.000001", "2024-01-01 00:29:59.999999", "2024-01-01 00:30:00", "2024-01-01 00:30:00.000001"]
    df = minutes(spark, [(r, 1.0) for r in rows])
    got = df.select("seq", slot_start(slot("ts")).alias("l"), slot_start(slot("ts", closed="right")).alias("r")).toPandas().sort_values("seq")
    assert got["l"].dt.strftime("%H:%M").tolist() == ["00:00", "00:00", "00:00", "00:30", "00:30"]
    assert got["r"].dt.strftime("%H:%M").tolist() == ["00:00", "00:30", "00:30", "00:30", "01:00"]


@pytest.mark.parametrize("closed", ["left", "right"])
def test_resample_matches_pandas(spark, closed):
    rng = np.random.default_rng(3)
    t = pd.to_datetime("2024-03-01") + pd.to_timedelta(np.sort(rng.integers(0, 86400 * 3, 300)), unit="s")
    y = np.round(rng.random(300) * 100, 2)
    df = minutes(spark, list(zip(t, y)))
    got = regular.resample_mean(df, closed=closed).toPandas().sort_values("ts")
    want = pd.Series(y, index=t).resample("30min", closed=closed, label=closed).mean().dropna()
    assert (got["ts"].to_numpy() == want.index.to_numpy()).all()
    np.testing.assert_allclose(got["y"].to_numpy(), want.to_numpy())


def test_hourly_interpolation_matches_pandas(spark):
    idx = pd.date_range("2024-01-01", periods=12, freq="60min").delete([3, 4, 5, 9])
    vals = [N, 2.0, 4.0, 10.0, 11.0, N, 13.0, 14.0]
    pts = spark.createDataFrame([("a", i.to_pydatetime(), v) for i, v in zip(idx, vals)], "region string, ts timestamp_ntz, t double")
    pts = pts.withColumn("hh", slot("ts"))
    got = regular.interpolate_grid(pts, columns=["t"], limit=2).toPandas().sort_values("hh")
    want = pd.Series(vals, index=idx, dtype=float).resample("30min").interpolate(method="time", limit=2)
    np.testing.assert_allclose(got["t"].to_numpy(float), want.to_numpy(), equal_nan=True)


def test_forecast_carries_the_last_half_hour(spark):
    idx = pd.date_range("2024-01-02", periods=24, freq="60min")
    df = spark.createDataFrame([("a", t.to_pydatetime(), float(i), 50.0, pd.Timestamp("2024-01-01").to_pydatetime()) for i, t in enumerate(idx)],
                               "region string, ts timestamp_ntz, temp_c double, humidity_pct double, forecast_origin_date timestamp_ntz")
    got = forecast_half_hourly(df).toPandas().sort_values("hh")
    assert len(got) == 48 and got["temp_c"].iloc[-1] == 23.0 and (got["weather_lead_day"] == 1).all()


def test_recent_series_interpolates_both_ways(spark):
    got = regular.recent_model_series(frame(spark, RUNS), last_n=3).toPandas().sort_values("hh")
    assert got["hh"].tolist() == list(range(4, 12))
    want = pd.Series(RUNS, dtype=float)[4:12].interpolate(limit_direction="both")
    np.testing.assert_allclose(got["y"].to_numpy(), want.to_numpy())


def test_outlier_types(spark):
    y = [10.0] * 5 + [11.0] * 5 + [12.0] * 10 + [500.0] + [11.0] * 4 + [600.0, 601.0] + [10.5] * 6 + [-1.0] + [11.0]
    got = clean.flag_outliers(frame(spark, y), pos="hh").toPandas().sort_values("hh")
    assert got["outlier_type"][got["y"] == 500].tolist() == ["isolated_extreme"]
    assert got["outlier_type"][got["y"] > 550].tolist() == ["sustained_extreme_event"] * 2
    assert got["outlier_type"][got["y"] < 0].tolist() == ["invalid_impossible"]
    valid = np.array([v for v in y if v > 0])
    mad = np.median(np.abs(valid - np.median(valid)))
    np.testing.assert_allclose(got["robust_z"], (np.array(y) - np.median(valid)) / (1.4826 * mad))


def test_constant_series_has_no_robust_z(spark):
    got = clean.flag_outliers(frame(spark, [5.0] * 6), pos="hh").toPandas()
    assert got["robust_z"].isna().all() and (got["is_stat_outlier"] == 0).all()


@pytest.mark.parametrize("market,civil,at,want", [
    ("Etc/GMT-10", "Australia/Sydney", "2026-10-04 01:30", "2026-10-04 01:30"), ("Etc/GMT-10", "Australia/Sydney", "2026-10-04 02:00", "2026-10-04 03:00"),
    ("Etc/GMT-10", "Australia/Sydney", "2026-04-05 01:30", "2026-04-05 02:30"), ("Etc/GMT-10", "Australia/Sydney", "2026-04-05 02:30", "2026-04-05 02:30"),
    ("Etc/GMT-10", "Australia/Brisbane", "2026-10-04 02:00", "2026-10-04 02:00"), ("Etc/GMT-8", "Australia/Perth", "2026-10-04 02:00", "2026-10-04 02:00")])
def test_civil_clock(spark, market, civil, at, want):
    df = minutes(spark, [(at, 1.0)])
    assert str(resolve_clocks(df, F.lit(market), F.lit(civil)).first()["local_timestamp"])[:16] == want
