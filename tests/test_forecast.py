import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadtide.functions.clock import horizon_end, month_start, training_cutoff
from loadtide.operators import features as ft
from loadtide.operators.evaluate import error_metrics, learning_curves
from loadtide.operators.sequences import training_windows
from loadtide.plans import custom, forecast, models, panel, selection

SENTINEL = 1e9


def history(spark, n=2000, origin=1500, sentinel=True, gap=None):
    rng = np.random.default_rng(5)
    y = 100 + 10 * np.sin(np.arange(n) * 2 * np.pi / 48) + rng.normal(size=n)
    y[origin:] = SENTINEL if sentinel else y[origin:]
    rows = [("a", i, None if gap and gap[0] <= i < gap[1] else float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "region string, hh long, y double")


def origins(spark, origin=1500, end=1999):
    return spark.createDataFrame([("a", origin, end)], "region string, origin_hh long, end_hh long")


@pytest.mark.parametrize("lag", [48, 336])
def test_naive_closed_form_equals_block_recursion(spark, lag):
    df, gap = history(spark, gap=(1460, 1470)), (1460, 1470)
    got = forecast.seasonal_naive(df, origins(spark), lag).toPandas().sort_values("hh")["forecast"].to_numpy(float)
    y = df.toPandas().sort_values("hh")["y"].to_numpy(float)
    y[1500:] = np.nan
    for start in range(1500, 2000, 48):
        block = np.arange(start, min(start + 48, 2000))
        y[block] = y[block - lag]
    np.testing.assert_allclose(got, y[1500:], equal_nan=True)
    assert np.nanmax(got) < SENTINEL and gap


def test_panel_hides_the_target(spark):
    p = panel.build_panel(history(spark), origins(spark)).toPandas()
    assert p.loc[p["is_horizon"] == 1, "y"].isna().all() and (p.loc[p["is_horizon"] == 1, "actual"] == SENTINEL).all()
    assert p["y"].max() < SENTINEL and len(p) == 2000


def test_sequence_windows_end_before_the_origin(spark):
    w = training_windows(history(spark, gap=(900, 901)), origins(spark), 336, 48).toPandas()
    assert len(w) and (w["start_hh"] + 48 <= 1500).all()
    assert all(len(e) == 336 and max(e) < SENTINEL for e in w["encoder"]) and all(len(t) == 48 and max(t) < SENTINEL for t in w["target"])
    assert not ((w["start_hh"] - 336 <= 900) & (w["start_hh"] + 48 > 900)).any()


def test_user_forecaster_sees_only_the_past(spark):
    got = custom.run_forecaster(history(spark), origins(spark), custom.clock_mean(), 336, "m").toPandas()
    assert len(got) == 500 and got["forecast"].max() < SENTINEL


def test_recursion_sees_only_the_past(spark):
    df, feats = history(spark), ["lag_48", "same_half_hour_7day_mean"]
    known = panel.horizon_rows(origins(spark, end=1500 + 95)).select("region", "hh")
    med = spark.createDataFrame([("a", 1.0, 1.0)], "region string, med_lag_48 double, med_same_half_hour_7day_mean double")
    got = models.recursive_forecast(df, known, med, ["region"], feats, lambda d: d.withColumn("prediction", F.col("lag_48")), origins(spark, end=1500 + 95)).toPandas().sort_values("hh")
    y = df.toPandas().sort_values("hh")["y"].to_numpy()
    np.testing.assert_allclose(got["forecast"], np.tile(y[1452:1500], 2))


def test_demand_features_match_direct_formulas(spark):
    df = history(spark, n=900, sentinel=False, origin=900, gap=(500, 503))
    y = df.toPandas().sort_values("hh")["y"]
    for skip in (True, False):
        got = ft.demand_features(df, skip_nulls=skip).toPandas().sort_values("hh").reset_index(drop=True)
        prior = y.reset_index(drop=True).shift(48)
        same = pd.concat([y.reset_index(drop=True).shift(48 * k) for k in range(1, 8)], axis=1)
        np.testing.assert_allclose(got["previous_day_mean"], prior.rolling(48).mean(), equal_nan=True)
        np.testing.assert_allclose(got["rolling_std_24h_at_t_minus_48"], prior.rolling(48).std(), equal_nan=True)
        np.testing.assert_allclose(got["same_half_hour_7day_mean"], same.mean(axis=1, skipna=skip), equal_nan=True)
        np.testing.assert_allclose(got["lag_336"], y.reset_index(drop=True).shift(336), equal_nan=True)


def test_leaked_frame_is_caught(spark):
    p = panel.build_panel(history(spark), origins(spark))
    leaked = p.withColumn("y", F.coalesce("y", "actual"))
    rule = (F.col("is_horizon") == 1) & F.col("y").isNotNull()
    assert p.where(rule).count() == 0 and leaked.where(rule).count() == 500


@pytest.mark.parametrize("anchor,start,end", [("2026-09-14 10:00", "2026-09-01 00:00", "2026-12-31 23:30"), ("2026-12-02 00:00", "2026-12-01 00:00", "2027-03-31 23:30"),
                                              ("2027-01-31 23:30", "2027-01-01 00:00", "2027-04-30 23:30")])
def test_rolling_horizons(spark, anchor, start, end):
    df = spark.createDataFrame([(pd.Timestamp(anchor).to_pydatetime(),)], "o timestamp_ntz")
    cut, first = training_cutoff("o")
    r = df.select(first.alias("a"), horizon_end(month_start("o")).alias("z"), cut.alias("c")).first()
    assert (str(r["a"])[:16], str(r["z"])[:16]) == (start, end)
    assert r["a"] - r["c"] == pd.Timedelta(minutes=30)


def test_metrics_against_hand_formula(spark):
    rows = [("a", 10.0, 12.0), ("a", 0.2, 0.3), ("a", -5.0, 5.0), ("a", None, 1.0), ("a", 4.0, None)]
    df = spark.createDataFrame(rows, "region string, actual double, forecast double")
    for bounded in (True, False):
        r = error_metrics(df, ["region"], bounded_groups=bounded).first()
        e = np.array([2.0, 0.1, 10.0])
        assert r["matched_intervals"] == 3 and r["smape_excluded_intervals"] == 1
        np.testing.assert_allclose([r["MAE"], r["RMSE"], r["Bias"], r["MedAE"]], [e.mean(), np.sqrt((e ** 2).mean()), e.mean(), 2.0])
        np.testing.assert_allclose(r["sMAPE"], np.mean([200 * 2 / 22, 200 * 10 / 10]))


def score_rows(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 1.0, 0.0, 0.0, "MODEL_READY") for r in rows],
                                 "region string, model string, origin long, MAE double, RMSE double, sMAPE double, Bias double, skill_vs_naive_pct double, status string")


def test_choice_prefers_the_simpler_of_near_ties(spark):
    s = score_rows(spark, [("a", "Naive48", 1, 100.5), ("a", "RandomForest_A", 1, 100.0), ("a", "XGBoost_A", 1, 99.9), ("b", "Naive48", 1, 110.0), ("b", "RandomForest_B", 1, 100.0)])
    got = {r["region"]: r["selected_model"] for r in selection.choose(selection.aggregate_scores(s)).collect()}
    assert got == {"a": "Naive48", "b": "RandomForest_B"}


def test_warning_rows_only_without_ready_ones(spark):
    s = score_rows(spark, [("a", "Naive48", 1, 5.0), ("a", "RandomForest_A", 1, 1.0), ("b", "Naive48", 1, 3.0)])
    s = s.withColumn("status", F.when((F.col("model") == "RandomForest_A") | (F.col("region") == "b"), "MODEL_READY_WITH_WARNING").otherwise(F.col("status")))
    got = {r["region"]: r["selected_model"] for r in selection.choose(selection.aggregate_scores(s)).collect()}
    assert got == {"a": "Naive48", "b": "Naive48"}


def test_screen_never_drops_everything(spark):
    s = score_rows(spark, [("a", "Naive48", 1, 1.0), ("a", "XGBoost_A", 1, 9.0), ("b", "Naive48", 1, 1.0), ("b", "XGBoost_A", 1, 9.0), ("b", "RandomForest_A", 1, 1.5)])
    got = {(r["region"], r["model"]): r["keep"] for r in selection.screen(s).collect()}
    assert got[("a", "XGBoost_A")] == 1 and got[("b", "XGBoost_A")] == 0 and got[("b", "RandomForest_A")] == 1


def test_equal_mae_goes_to_model_order(spark):
    s = score_rows(spark, [("a", "Naive336", 1, 2.0), ("a", "Naive48", 1, 2.0)])
    assert selection.fold_winners(s).first()["winner"] == "Naive48"


def test_balance_point_lowest_base_wins(spark):
    rows = [("a", float(abs(t - 18)), float(t)) for t in range(0, 36) for _ in range(12)]
    df = spark.createDataFrame(rows, "region string, demand double, temp double")
    r = ft.balance_point(df).first()
    assert r["balance_point_c"] == 18.0 and abs(r["balance_point_corr"] - 1) < 1e-9
    assert ft.balance_point(df, min_days=10_000).count() == 0
    flat = df.withColumn("demand", F.lit(1.0))
    assert ft.balance_point(flat).count() == 0


def test_learning_curve_verdicts(spark):
    rows = [("limit", e, 1.0 / e, 1.0 / e) for e in range(1, 6)] + [("over", e, 1.0 / e, v) for e, v in enumerate([2.0, 1.0, 1.5], 1)] + [("ok", e, 1.0 / e, v) for e, v in enumerate([2.0, 1.0, 1.05], 1)]
    df = spark.createDataFrame(rows, "run string, epoch long, loss double, val_loss double")
    got = {r["run"]: r["verdict"] for r in learning_curves(df, ["run"], 5).collect()}
    assert got == {"limit": "EPOCH_LIMIT_REACHED", "over": "OVERFITTING_SIGNAL", "ok": "CONVERGED"}


def two_series(spark, n=1100):
    """y(t) = 10 + 0.5 y(t - 48) in region a, 4 + 0.25 y(t - 48) in b."""
    rows = []
    for region, c, k in (("a", 10.0, 0.5), ("b", 4.0, 0.25)):
        y = list(range(100, 148))
        while len(y) < n:
            y.append(c + k * y[-48])
        rows += [(region, i, float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "region string, hh long, y double")


def test_backtest_of_fitted_models_over_two_series_and_origins(spark):
    """A recursion that the linear model can learn exactly, over two regions and origins; nothing after an origin is seen."""
    from loadtide.plans.backtest import backtest, backtest_scores
    grid = two_series(spark)
    o = spark.createDataFrame([(r, h, h + 95) for r in "ab" for h in (700, 900)], "region string, origin_hh long, end_hh long")
    train = ft.demand_features(grid)
    known = o.select("region", F.explode(F.sequence("origin_hh", "end_hh")).alias("hh")).distinct()
    detail, status = backtest(grid, train, known, o, ["region"], {"Linear": {"kind": "linear", "features": ["lag_48"]}, "Starved": {"kind": "linear", "features": ["lag_48", "lag_96"]}},
                              min_rows=500)
    got = detail.toPandas()
    assert got.groupby(["region", "model", "origin_hh"]).size().eq(96).all() and len(got) == 4 * 4 * 96
    linear = got[got["model"] == "Linear"]
    np.testing.assert_allclose(linear["forecast"], linear["y"], rtol=1e-6)
    s = backtest_scores(detail, ["region"]).toPandas().set_index(["region", "model", "origin_hh"])
    assert s.loc[("a", "Linear", 700), "MAE"] < 1e-4 < s.loc[("a", "Naive48", 700), "MAE"] and s.loc[("b", "Linear", 900), "MAE_first_7d"] < 1e-4
    assert status.count() == 16


def test_a_group_without_a_model_comes_back_without_a_forecast(spark):
    from loadtide.plans.backtest import backtest
    grid = two_series(spark).where("region = 'a' OR hh > 600")
    o = spark.createDataFrame([("a", 700, 795), ("b", 700, 795)], "region string, origin_hh long, end_hh long")
    detail, status = backtest(grid, ft.demand_features(grid), o.select("region", F.col("origin_hh").alias("hh")), o, ["region"], {"Linear": {"kind": "linear", "features": ["lag_48"]}},
                              naive=["Naive48"], min_rows=200)
    got = detail.where("model = 'Linear'").groupBy("region", "status").agg(F.count("*").alias("n"), F.count("forecast").alias("f")).collect()
    assert {(r["region"], r["status"], r["n"], r["f"]) for r in got} == {("a", "OK", 96, 96), ("b", "NO_MODEL", 96, 0)}
    assert {(r["region"], r["status"]) for r in status.where("model = 'Linear'").collect()} == {("a", "MODEL_READY"), ("b", "MODEL_FAILED")}


def test_predictors_keep_rows_and_agree(spark):
    grid = two_series(spark)
    train = ft.demand_features(grid).dropna(subset=["lag_48"])
    made, _ = models.fit_groups(train, ["region"], [("a",), ("b",)], "linear", ["lag_48"], min_rows=10)
    rows = train.select("region", "hh", "lag_48").unionByName(spark.createDataFrame([("c", 1, 2.0), (None, 2, 2.0)], "region string, hh long, lag_48 double"))
    one = models.predict_linear(made, ["region"], ["lag_48"])(rows).toPandas().sort_values(["region", "hh"])
    other = models.predict_groups(made, ["region"])(rows).toPandas().sort_values(["region", "hh"])
    assert len(one) == len(other) == rows.count() and one["prediction"].isna().sum() == other["prediction"].isna().sum() == 2
    np.testing.assert_allclose(one["prediction"].dropna(), other["prediction"].dropna())
