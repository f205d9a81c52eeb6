"""Aggregations, windows and research statistics."""
from pyspark.sql import functions as F

from loadtide.catalog import views as v
from loadtide.catalog.registry import query
from loadtide.functions.clock import day_of, floor_div, lookup

from loadtide.functions.numeric import positive
from loadtide.operators import evaluate as ev
from loadtide.operators import features as ft
from loadtide.operators import spectrum, stats

from loadtide.operators.ordered import CHUNK, framed, with_neighbour, with_row_number
from loadtide.plans import selection
from loadtide.plans.forecast import forecast_frame, seasonal_naive
from loadtide.session import cut_lineage

HIST = "SELECT c.* FROM cal_a c JOIN origin_one o ON c.region = o.region WHERE c.hh < o.origin_hh AND c.y IS NOT NULL"


def _history(spark, folder):
    c = v.cal_a(spark, folder)
    return c.join(v.origin_one(c), "region").where("hh < origin_hh and y is not null")


@query("G01_month_halfhour_profile", f"""SELECT region, month, half_hour_index, avg(y) AS historical_month_halfhour_mean, median(y) AS historical_month_halfhour_median
    FROM ({HIST}) GROUP BY 1, 2, 3""", nums="historical_month_halfhour_mean historical_month_halfhour_median", ints="half_hour_index")
def g01(spark, folder):
    return ft.halfhour_profile(_history(spark, folder))


@query("G02_month_dow_halfhour_profile", f"""SELECT region, month, day_of_week, half_hour_index, avg(y) AS historical_month_dow_halfhour_mean FROM ({HIST}) GROUP BY 1, 2, 3, 4""",
       nums="historical_month_dow_halfhour_mean", ints="half_hour_index")
def g02(spark, folder):
    return ft.dow_halfhour_profile(_history(spark, folder))


@query("G03_two_level_daily_profile", """SELECT region, month(d) AS month, avg(m) AS historical_month_daily_mean, avg(x) AS historical_month_peak_mean, stddev_samp(m) AS historical_month_variability
    FROM (SELECT r_name AS region, o_orderdate AS d, avg(o_totalprice / 1000) AS m, max(o_totalprice / 1000) AS x FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(o_orderdate) < 2000 GROUP BY 1, 2) GROUP BY 1, 2""",
       nums="historical_month_daily_mean historical_month_peak_mean historical_month_variability")
def g03(spark, folder):
    o, c = v.table(spark, folder, "orders"), v.table(spark, folder, "customer")
    n, r = v.table(spark, folder, "nation"), v.table(spark, folder, "region")
    j = (o.where(F.year("o_orderdate") < 2000).join(c, o.o_custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    return ft.daily_profile(j.select(F.col("r_name").alias("region"), F.col("o_orderdate").alias("local_date"),
                                     F.month("o_orderdate").alias("month"), (F.col("o_totalprice") / 1000).alias("y")))


@query("G04_temperature_climatology", """SELECT dayofyear(date) AS day_of_year, avg(temp_mean_c) AS expected_temp_climatology FROM daily_weather WHERE year(date) < 2000 GROUP BY 1""",
       nums="expected_temp_climatology")
def g04(spark, folder):
    w = v.daily_weather(spark, folder).where("year(date) < 2000").withColumn("day_of_year", F.dayofyear("date"))
    return ft.temperature_climatology(w, keys=[])


@query("G05_rain_climatology", """SELECT month(date) AS month, avg(CASE WHEN rainfall_mm > 0.45 THEN 1.0 ELSE 0.0 END) AS historical_rain_probability, avg(rainfall_mm) AS mean_rainfall_mm
    FROM daily_weather GROUP BY 1""", nums="historical_rain_probability mean_rainfall_mm")
def g05(spark, folder):
    return ft.rain_climatology(v.daily_weather(spark, folder).withColumn("month", F.month("date")), keys=[], threshold=0.45)


@query("G06_balance_point", """SELECT region, base AS balance_point_c, c AS balance_point_corr FROM (SELECT region, base, count(*) AS n, abs(corr(demand, abs(temp - base))) AS c FROM demand_temp,
    (SELECT unnest(range(20, 56)) / 2.0 AS base) WHERE year < 2000 GROUP BY 1, 2) WHERE n >= 365 QUALIFY row_number() OVER (PARTITION BY region ORDER BY c DESC, base) = 1""",
       nums="balance_point_c balance_point_corr")
def g06(spark, folder):
    return ft.balance_point(v.demand_temp(spark, folder).where("year < 2000"))


@query("G07_month_year_summary", """SELECT region, month(date) AS month, year(date) AS year, avg(demand / 1000) AS mean_MW, max(peak) AS peak_MW, min(demand / 1000) AS min_MW, count(*) AS days
    FROM daily_demand GROUP BY 1, 2, 3""", nums="mean_MW peak_MW min_MW")
def g07(spark, folder):
    k = F.col("demand") / 1000
    return v.daily_demand(spark, folder).groupBy("region", F.month("date").alias("month"), F.year("date").alias("year")).agg(
        F.avg(k).alias("mean_MW"), F.max("peak").alias("peak_MW"), F.min(k).alias("min_MW"), F.count(F.lit(1)).alias("days"))


@query("G08_day_type_pivot", """SELECT c.region, c.half_hour_index, avg(CASE WHEN h.date IS NOT NULL THEN y END) AS holiday, avg(CASE WHEN h.date IS NULL AND day_of_week < 5 THEN y END) AS weekday,
    avg(CASE WHEN h.date IS NULL AND day_of_week >= 5 THEN y END) AS weekend FROM cal_a c LEFT JOIN holidays h ON h.date = c.local_date GROUP BY 1, 2""",
       nums="holiday weekday weekend", ints="half_hour_index")
def g08(spark, folder):
    f = ft.holiday_features(v.cal_a(spark, folder), v.holidays(spark, folder))
    kind = F.when(F.col("is_public_holiday") == 1, "holiday").when(F.col("is_weekend") == 1, "weekend").otherwise("weekday")
    return f.withColumn("kind", kind).groupBy("region", "half_hour_index").pivot("kind", ["holiday", "weekday", "weekend"]).agg(F.avg("y"))


@query("G09_month_to_date", """WITH o AS (SELECT region, max(date) AS o FROM daily_demand GROUP BY 1), t AS (SELECT d.region, year(date) AS year, count(*) AS intervals, avg(demand / 1000) AS mean_MW,
      max(demand / 1000) AS peak_MW, min(demand / 1000) AS min_MW, max(year(o)) AS oy FROM daily_demand d JOIN o ON o.region = d.region
      WHERE month(date) = month(o) AND day(date) <= day(o) GROUP BY 1, 2)
    SELECT region, year, intervals, mean_MW, peak_MW, min_MW, (mean_MW / avg(CASE WHEN year < oy THEN mean_MW END) OVER (PARTITION BY region) - 1) * 100 AS pct_vs_prior_year_mean FROM t""",
       nums="mean_MW peak_MW min_MW pct_vs_prior_year_mean")
def g09(spark, folder):
    d = v.daily_demand(spark, folder).select("region", F.col("date").alias("local_timestamp"), (F.col("demand") / 1000).alias("y"), F.month("date").alias("month"),
                                             F.dayofmonth("date").alias("day_of_month"), F.lit(0).alias("half_hour_index"), F.year("date").alias("year"))
    return ft.month_to_date(d)


@query("G10_feature_correlations", """WITH f AS (SELECT a.region, a.y, a.half_hour_index::DOUBLE AS half_hour_index, a.day_of_week::DOUBLE AS day_of_week, b.y AS lag_48 FROM cal_b a JOIN grid_b b ON b.hh = a.hh - 48
      WHERE a.y IS NOT NULL AND b.y IS NOT NULL),
    l AS (SELECT region, y, 'half_hour_index' AS feature, half_hour_index AS value FROM f UNION ALL SELECT region, y, 'day_of_week', day_of_week FROM f UNION ALL SELECT region, y, 'lag_48', lag_48 FROM f),
    r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rv,
      rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l),
    c AS (SELECT region, feature, count(*) AS n, corr(value, y) AS pearson, corr(rv, ry) AS spearman FROM r GROUP BY 1, 2)
    SELECT *, abs(spearman) - abs(pearson) AS abs_gap, CASE WHEN abs(pearson) < 0.05 AND abs(spearman) < 0.05 THEN 'no monotonic association' WHEN abs(spearman) - abs(pearson) > 0.1 THEN 'non-linear association'
      ELSE 'linear association' END AS finding FROM c""", nums="pearson spearman abs_gap")
def g10(spark, folder):
    f = ft.demand_features(v.cal_b(spark, folder))
    return ft.feature_correlations(f, ["half_hour_index", "day_of_week", "lag_48"])


@query("G11_weather_response", """SELECT *, CASE WHEN corr_hdd > corr_cdd + 0.1 THEN 'heating-driven' WHEN corr_cdd > corr_hdd + 0.1 THEN 'cooling-driven' ELSE 'mixed' END AS character FROM (
    SELECT region, 25.0 AS balance_point_c, corr(demand, greatest(25 - temp, 0)) AS corr_hdd, corr(demand, greatest(temp - 25, 0)) AS corr_cdd, corr(demand, temp) AS corr_temp_mean FROM demand_temp GROUP BY region)""",
       nums="balance_point_c corr_hdd corr_cdd corr_temp_mean")
def g11(spark, folder):
    d = v.demand_temp(spark, folder).withColumns({"balance_point_c": F.lit(25.0), "temp_mean_c": F.col("temp"), "hdd": positive(25 - F.col("temp")),
                                                  "cdd": positive(F.col("temp") - 25)})
    return ft.weather_response(d, target="demand")


METRICS = "matched_intervals MAE RMSE sMAPE Bias MedAE smape_excluded_intervals".split()
MSQL = """count(*) AS matched_intervals, avg(ae) AS MAE, sqrt(avg(err * err)) AS RMSE, avg(sm) AS sMAPE, avg(err) AS Bias, median(ae) AS MedAE,
    count(*) - count(sm) AS smape_excluded_intervals"""
MNUM = "MAE RMSE sMAPE Bias MedAE"


@query("G12_error_metrics", f"SELECT region, model, {MSQL} FROM scored_many GROUP BY 1, 2", nums=MNUM)
def g12(spark, folder):
    s = v.scored_many(v.grid_a(spark, folder))
    return ev.error_metrics(s, ["region", "model"], bounded_groups=False).select("region", "model", *METRICS)


@query("G13_normalised_mae", "SELECT region, model, 100 * avg(ae) / avg(actual) AS nMAE_pct FROM scored_many GROUP BY 1, 2", nums="nMAE_pct")
def g13(spark, folder):
    return ev.error_metrics(v.scored_many(v.grid_a(spark, folder)), ["region", "model"]).select("region", "model", "nMAE_pct")


@query("G14_verification_tables", f"""SELECT region, model, day, half_hour_index, max(actual) AS actual_peak, max(forecast) AS forecast_peak, {MSQL} FROM (
    SELECT *, date_trunc('day', make_timestamp(hh * 1800000000)) AS day, CAST(hh % 48 AS DOUBLE) AS half_hour_index FROM scored_many) GROUP BY GROUPING SETS ((region, model), (region, model, day), (region, model, half_hour_index))""",
       nums=MNUM + " actual_peak forecast_peak half_hour_index")
def g14(spark, folder):
    s = ev.score_rows(v.scored_many(v.grid_a(spark, folder))).withColumns({"day": day_of("ts"), "half_hour_index": (F.col("hh") % 48).cast("double")})
    sets = [[F.col("region"), F.col("model")], [F.col("region"), F.col("model"), F.col("day")], [F.col("region"), F.col("model"), F.col("half_hour_index")]]
    t = s.groupingSets(sets, "region", "model", "day", "half_hour_index").agg(
        F.max("actual").alias("actual_peak"), F.max("forecast").alias("forecast_peak"), *ev.metric_columns())
    return t.select("region", "model", "day", "half_hour_index", "actual_peak", "forecast_peak", *METRICS)


@query("G15_lead_band_metrics", f"""SELECT region, model, CASE WHEN hh - origin_hh < 336 THEN 'first_7d' ELSE 'days_8_30' END AS band, {MSQL} FROM (
    SELECT f.*, a.y AS actual, f.forecast - a.y AS err, abs(f.forecast - a.y) AS ae, CASE WHEN abs(f.forecast) + abs(a.y) >= 1.0 THEN 200.0 * abs(f.forecast - a.y) / (abs(f.forecast) + abs(a.y)) END AS sm
    FROM naive_one f JOIN grid_a a ON a.region = f.region AND a.hh = f.hh WHERE a.y IS NOT NULL AND f.forecast IS NOT NULL) GROUP BY 1, 2, 3""", nums=MNUM)
def g15(spark, folder):
    from loadtide.plans.forecast import naive_forecasts, with_actual
    g = v.grid_a(spark, folder)
    s = with_actual(naive_forecasts(g, v.origin_one(g)), g).withColumn("band", ev.lead_band(F.col("step") - 1))
    return ev.error_metrics(s, ["region", "model", "band"]).select("region", "model", "band", *METRICS)


@query("G16_model_aggregate", """SELECT region, model, avg(MAE) AS mean_backtest_MAE, median(MAE) AS median_backtest_MAE, avg(RMSE) AS mean_RMSE, avg(sMAPE) AS mean_sMAPE, avg(Bias) AS mean_Bias,
    stddev_samp(MAE) AS mae_spread, count(DISTINCT origin) AS origins, avg(skill_vs_naive_pct) AS skill_vs_naive_pct FROM skilled GROUP BY 1, 2""",
       nums="mean_backtest_MAE median_backtest_MAE mean_RMSE mean_sMAPE mean_Bias mae_spread skill_vs_naive_pct")
def g16(spark, folder):
    return selection.aggregate_scores(v.skilled(v.grid_a(spark, folder))).drop("win_rate_pct", "model_status")


@query("G17_monthly_forecast_summary", """SELECT f.region, f.model, strftime(make_timestamp(f.hh * 1800000000), '%Y-%m') AS month, avg(forecast) AS mean_forecast_MW, median(forecast) AS median_forecast_MW,
    min(forecast) AS minimum_forecast_MW, max(forecast) AS maximum_forecast_MW, make_timestamp(-(max({'v': forecast, 't': -f.hh}).t) * 1800000000) AS peak_timestamp, count(*) AS number_of_intervals,
    sum(forecast) * 0.5 AS forecast_energy_MWh, 100.0 * avg(CASE WHEN f.hh - 48 >= s.origin_hh OR f.hh - 336 < s.lo THEN 1.0 ELSE 0.0 END) AS recursive_input_share_pct
    FROM naive_one f JOIN (SELECT o.region, o.origin_hh, min(g.hh) AS lo FROM origin_one o JOIN grid_a g ON g.region = o.region GROUP BY 1, 2) s ON s.region = f.region
    WHERE forecast IS NOT NULL AND model = 'Naive336' GROUP BY 1, 2, 3""", nums="mean_forecast_MW median_forecast_MW minimum_forecast_MW maximum_forecast_MW forecast_energy_MWh recursive_input_share_pct")
def g17(spark, folder):
    g = v.grid_a(spark, folder)
    f = forecast_frame(seasonal_naive(g, v.origin_one(g), 336), g, "FROZEN")
    return ev.monthly_forecast_summary(f, ["region", "model"])


@query("G18_source_consistency", """SELECT a.region, count(*) AS matched_intervals, min(a.hh) AS window_start, max(a.hh) AS window_end, avg(abs(a.y - b.y)) AS MAE_between_sources_MW, sqrt(avg((a.y - b.y) * (a.y - b.y))) AS RMSE_between_sources_MW,
    avg(a.y - b.y) AS Bias_between_sources_MW, corr(a.y, b.y) AS correlation FROM bins_a a JOIN bins_b b ON a.hh = b.hh GROUP BY a.region""",
       nums="MAE_between_sources_MW RMSE_between_sources_MW Bias_between_sources_MW correlation")
def g18(spark, folder):
    r = v.readings(spark, folder)
    a = v.resample_mean(r).select("region", "hh", F.col("y").alias("benchmark"))
    b = v.resample_mean(r.withColumn("region", v.one_series("ts"))).select("hh", F.col("y").alias("own"))
    return ev.source_consistency(a.join(b, "hh"), ["region"], "benchmark", "own", ts="hh")


@query("G19_margin_summary", """SELECT a.region, 0.5 * (max(a.hh) - min(a.hh)) + 0.5 AS available_horizon_hours, count(*) AS available_intervals, avg(a.forecast - b.forecast) AS mean_margin_MW,
    avg(abs(a.forecast - b.forecast)) AS mean_absolute_margin_MW FROM naive_one a JOIN naive_one b ON a.region = b.region AND a.hh = b.hh AND b.model = 'Naive336'
    WHERE a.model = 'Naive48' AND a.forecast IS NOT NULL AND b.forecast IS NOT NULL GROUP BY a.region""", nums="available_horizon_hours mean_margin_MW mean_absolute_margin_MW")
def g19(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_one(g)
    rev = ev.revision_table(seasonal_naive(g, o, 336), seasonal_naive(g, o, 48))
    return rev.groupBy("region").agg((0.5 * (F.max("hh") - F.min("hh")) + 0.5).alias("available_horizon_hours"), F.count(F.lit(1)).alias("available_intervals"),
                                     F.avg("revision_MW").alias("mean_margin_MW"), F.avg("absolute_revision_MW").alias("mean_absolute_margin_MW"))


@query("G20_coverage_row", """SELECT region, count(*) AS rows_30min, count(*) - count(y) AS missing_demand_rows, count(CASE WHEN n >= 2 THEN 1 END) AS observed_rows, count(CASE WHEN n = 1 THEN 1 END) AS single_rows,
    min(ts) AS start_ts, max(ts) AS end_ts, avg(y) AS mean_demand_MW, max(y) AS peak_demand_MW FROM grid_a GROUP BY region""", nums="mean_demand_MW peak_demand_MW")
def g20(spark, folder):
    n = F.col("n_source_readings")
    return v.grid_a(spark, folder).groupBy("region").agg(
        F.count(F.lit(1)).alias("rows_30min"), F.count_if(F.col("y").isNull()).alias("missing_demand_rows"), F.count_if(n >= 2).alias("observed_rows"), F.count_if(n == 1).alias("single_rows"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.avg("y").alias("mean_demand_MW"), F.max("y").alias("peak_demand_MW"))


@query("G21_data_dictionary", """SELECT * FROM (SELECT 'y' AS feature, 'double' AS dtype, 100.0 * count(y) / count(*) AS non_null_pct FROM grid_a UNION ALL SELECT 'region', 'string', 100.0 * count(region) / count(*) FROM grid_a
    UNION ALL SELECT 'hh', 'bigint', 100.0 * count(hh) / count(*) FROM grid_a)""", nums="non_null_pct")
def g21(spark, folder):
    g = v.grid_a(spark, folder).select("region", "hh", "y")
    kinds = dict(g.dtypes)
    row = g.agg(*[(100.0 * F.count(c) / F.count(F.lit(1))).alias(c) for c in kinds]).unpivot([], list(kinds), "feature", "non_null_pct")
    return row.withColumn("dtype", lookup("feature", kinds))


@query("G22_column_profile", """SELECT region, width_bucket AS bucket, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS sd FROM (SELECT region, y, CAST(floor(y / 10) AS BIGINT) AS width_bucket FROM readings) GROUP BY 1, 2""", nums="mean sd")
def g22(spark, folder):
    return v.readings(spark, folder).groupBy("region", F.floor(F.col("y") / 10).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))


@query("G23_peak_evidence", """SELECT region, model, avg(abs(fp - ap)) AS daily_peak_MAE, avg(fp - ap) AS daily_peak_Bias, max(d_mae) AS worst_day_MAE, count(*) AS days FROM (
    SELECT region, model, origin_hh, hh // 48 AS d, max(forecast) AS fp, max(actual) AS ap, avg(ae) AS d_mae FROM scored_many GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""", nums="daily_peak_MAE daily_peak_Bias worst_day_MAE")
def g23(spark, folder):
    s = ev.score_rows(v.scored_many(v.grid_a(spark, folder))).withColumn("d", floor_div("hh", 48))
    days = s.groupBy("region", "model", "origin_hh", "d").agg(F.max("forecast").alias("fp"), F.max("actual").alias("ap"), F.avg("absolute_error").alias("d_mae"))
    diff = F.col("fp") - F.col("ap")
    return days.groupBy("region", "model").agg(F.avg(F.abs(diff)).alias("daily_peak_MAE"), F.avg(diff).alias("daily_peak_Bias"),
                                               F.max("d_mae").alias("worst_day_MAE"), F.count(F.lit(1)).alias("days"))


@query("G24_learning_curves", """SELECT region, max(epoch) AS epochs_run, min(val_loss) AS min_val_loss, (min({'v': val_loss, 'e': epoch}) FILTER (val_loss IS NOT NULL)).e AS best_epoch, arg_max(val_loss, epoch) AS final_val_loss,
    CASE WHEN (min({'v': val_loss, 'e': epoch}) FILTER (val_loss IS NOT NULL)).e = max(epoch) AND max(epoch) = 30 THEN 'EPOCH_LIMIT_REACHED'
      WHEN arg_max(val_loss, epoch) > 1.10 * min(val_loss) AND arg_max(loss, epoch) < (min({'v': val_loss, 'e': epoch, 'l': loss}) FILTER (val_loss IS NOT NULL)).l THEN 'OVERFITTING_SIGNAL' ELSE 'CONVERGED' END AS verdict
    FROM (SELECT region, day(ts) AS epoch, avg(CASE WHEN hour(ts) < 12 THEN y END) AS loss, avg(CASE WHEN hour(ts) >= 12 THEN y END) AS val_loss FROM readings GROUP BY 1, 2) GROUP BY region""",
       nums="min_val_loss final_val_loss")
def g24(spark, folder):
    r = v.readings(spark, folder)
    hist = r.groupBy("region", F.dayofmonth("ts").alias("epoch")).agg(
        F.avg(F.when(F.hour("ts") < 12, F.col("y"))).alias("loss"), F.avg(F.when(F.hour("ts") >= 12, F.col("y"))).alias("val_loss"))
    return ev.learning_curves(hist, ["region"], 30).select("region", "epochs_run", "min_val_loss", "best_epoch", "final_val_loss", "verdict")


# --- windows ---------------------------------------------------------------------------------------

DAYW = "PARTITION BY region ORDER BY hh RANGE BETWEEN 95 PRECEDING AND 48 PRECEDING"


@query("W01_horizon_safe_lags", """SELECT g.region, g.hh, a.y AS lag_48, b.y AS lag_96, c.y AS lag_336 FROM grid_a g LEFT JOIN grid_a a ON a.region = g.region AND a.hh = g.hh - 48
    LEFT JOIN grid_a b ON b.region = g.region AND b.hh = g.hh - 96 LEFT JOIN grid_a c ON c.region = g.region AND c.hh = g.hh - 336""", nums="lag_48 lag_96 lag_336")
def w01(spark, folder):
    return ft.demand_features(v.grid_a(spark, folder)).select("region", "hh", "lag_48", "lag_96", "lag_336")


@query("W02_previous_day_strict", f"""SELECT region, hh, CASE WHEN count(y) OVER w = 48 THEN avg(y) OVER w END AS previous_day_mean, CASE WHEN count(y) OVER w = 48 THEN max(y) OVER w END AS previous_day_peak,
    CASE WHEN count(y) OVER w = 48 THEN min(y) OVER w END AS previous_day_min FROM grid_b WINDOW w AS ({DAYW})""", nums="previous_day_mean previous_day_peak previous_day_min")
def w02(spark, folder):
    return ft.demand_features(v.grid_b(spark, folder)).select("region", "hh", "previous_day_mean", "previous_day_peak", "previous_day_min")


@query("W03_rolling_24h_at_t48", f"""SELECT region, hh, CASE WHEN count(y) OVER w = 48 THEN avg(y) OVER w END AS rolling_mean_24h_at_t_minus_48,
    CASE WHEN count(y) OVER w = 48 THEN stddev_samp(y) OVER w END AS rolling_std_24h_at_t_minus_48 FROM grid_b WINDOW w AS ({DAYW})""",
       nums="rolling_mean_24h_at_t_minus_48 rolling_std_24h_at_t_minus_48")
def w03(spark, folder):
    return ft.demand_features(v.grid_b(spark, folder)).select("region", "hh", "rolling_mean_24h_at_t_minus_48", "rolling_std_24h_at_t_minus_48")


@query("W04_same_half_hour_means", """SELECT g.region, g.hh, avg(CASE WHEN k <= 7 THEN p.y END) AS same_half_hour_7day_mean, avg(p.y) AS same_half_hour_14day_mean,
    CASE WHEN count(CASE WHEN k <= 7 THEN p.y END) = 7 THEN avg(CASE WHEN k <= 7 THEN p.y END) END AS strict_7day_mean
    FROM grid_b g CROSS JOIN (SELECT unnest(range(1, 15)) AS k) LEFT JOIN grid_b p ON p.region = g.region AND p.hh = g.hh - 48 * k GROUP BY 1, 2""",
       nums="same_half_hour_7day_mean same_half_hour_14day_mean strict_7day_mean")
def w04(spark, folder):
    g = v.grid_b(spark, folder)
    a = ft.demand_features(g).select("region", "hh", "same_half_hour_7day_mean", "same_half_hour_14day_mean")
    b = ft.demand_features(g, skip_nulls=False).select("region", "hh", F.col("same_half_hour_7day_mean").alias("strict_7day_mean"))
    return a.join(b, ["region", "hh"])


@query("W05_daily_weather_lags", """SELECT date, lag(temp_mean_c) OVER w AS temp_mean_lag_1d, lag(temp_mean_c, 7) OVER w AS temp_mean_lag_7d,
    CASE WHEN count(temp_mean_c) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN avg(temp_mean_c) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS rolling_temp_mean_7d
    FROM daily_weather WINDOW w AS (ORDER BY date)""", nums="temp_mean_lag_1d temp_mean_lag_7d rolling_temp_mean_7d")
def w05(spark, folder):
    w = v.daily_weather(spark, folder).withColumn("region", v.one_series("date"))
    return ft.daily_weather_features(w).select("date", "temp_mean_lag_1d", "temp_mean_lag_7d", "rolling_temp_mean_7d")


@query("W06_degree_days", """SELECT date, greatest(25 - temp_mean_c, 0) AS hdd, greatest(temp_mean_c - 25, 0) AS cdd, lag(greatest(25 - temp_mean_c, 0)) OVER w AS hdd_lag_1d, lag(greatest(temp_mean_c - 25, 0)) OVER w AS cdd_lag_1d
    FROM daily_weather WINDOW w AS (ORDER BY date)""", nums="hdd cdd hdd_lag_1d cdd_lag_1d")
def w06(spark, folder):
    w = v.daily_weather(spark, folder).withColumns({"region": v.one_series("date"), "base_c": F.lit(25.0)})
    return ft.daily_weather_features(w, base="base_c").select("date", "hdd", "cdd", "hdd_lag_1d", "cdd_lag_1d")


@query("W07_rolling_7_row_mean", """SELECT region, model, origin_hh, d, avg(m) OVER (PARTITION BY region, model, origin_hh ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7day_MAE,
    avg(m) OVER (PARTITION BY region, model, origin_hh ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_to_yesterday FROM (
      SELECT region, model, origin_hh, hh // 48 AS d, avg(ae) AS m FROM scored_many GROUP BY 1, 2, 3, 4)""", nums="rolling_7day_MAE rolling_to_yesterday")
def w07(spark, folder):
    s = ev.score_rows(v.scored_many(v.grid_a(spark, folder))).withColumn("d", floor_div("hh", 48))
    keys = ["region", "model", "origin_hh"]
    days = s.groupBy(*keys, "d").agg(F.avg("absolute_error").alias("m"))
    out = framed(days, keys, "d", lambda w: {"rolling_7day_MAE": F.avg("m").over(w.rowsBetween(-6, 0)),
                                             "rolling_to_yesterday": F.avg("m").over(w.rowsBetween(-7, -1))}, back=7, chunk=366)
    return out.drop("m")


@query("W08_average_rank", """SELECT region, y, avg_rank, count(*) AS copies FROM (SELECT region, y, rank() OVER (PARTITION BY region ORDER BY y) + (count(*) OVER (PARTITION BY region, y) - 1) / 2.0 AS avg_rank FROM readings) GROUP BY 1, 2, 3""", nums="y avg_rank")
def w08(spark, folder):
    from loadtide.operators.quantiles import average_ranks
    return average_ranks(v.readings(spark, folder).select("region", "y"), ["region"], "y", "avg_rank")


@query("W09_trend_features", """SELECT region, hh, hh - min(hh) OVER (PARTITION BY region) AS time_index, (hh - min(hh) OVER (PARTITION BY region)) / 48.0 AS days_since_start FROM grid_a""", nums="days_since_start")
def w09(spark, folder):
    return ft.trend_features(v.grid_a(spark, folder)).select("region", "hh", "time_index", "days_since_start")


@query("W10_irregular_steps", """SELECT region, count(*) AS steps, count(CASE WHEN s <> 1 THEN 1 END) AS irregular_steps, max(s) AS longest FROM (SELECT region, hh - lag(hh) OVER (PARTITION BY region ORDER BY hh) AS s FROM bins_a) WHERE s IS NOT NULL GROUP BY region""")
def w10(spark, folder):
    b = v.bins_a(spark, folder).select("region", "hh")
    s = with_neighbour(b, ["region"], "hh", floor_div("hh", CHUNK), {"prev_hh": "hh"}).where("prev_hh is not null")
    step = F.col("hh") - F.col("prev_hh")
    return s.groupBy("region").agg(F.count(F.lit(1)).alias("steps"), F.count_if(step != 1).alias("irregular_steps"), F.max(step).alias("longest"))


@query("W11_largest_jump", """SELECT h.region, max_jump, count(CASE WHEN abs(f.forecast - f.p) > max_jump THEN 1 END) AS jumps_above FROM (
      SELECT region, max(abs(y - p)) AS max_jump FROM (SELECT a.region, a.y, b.y AS p FROM grid_a a JOIN origin_one o ON o.region = a.region JOIN grid_a b ON b.region = a.region AND b.hh = a.hh - 1 WHERE a.hh < o.origin_hh) GROUP BY region) h
    JOIN (SELECT a.region, a.forecast, b.forecast AS p FROM naive_one a LEFT JOIN naive_one b ON a.region = b.region AND b.model = a.model AND b.hh = a.hh - 1 WHERE a.model = 'Naive48') f ON f.region = h.region GROUP BY 1, 2""", nums="max_jump")
def w11(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_one(g)

    def jump(df, c):
        return framed(df, ["region"], "hh", lambda w: {"jump": F.abs(F.col(c) - F.max(c).over(w.rangeBetween(-1, -1)))}, back=1)

    hist = jump(g, "y").join(o, "region").where("hh < origin_hh").groupBy("region").agg(F.max("jump").alias("max_jump"))
    fc = jump(seasonal_naive(g, o, 48), "forecast").select("region", "jump")
    return fc.join(hist, "region").groupBy("region", "max_jump").agg(F.count_if(F.col("jump") > F.col("max_jump")).alias("jumps_above"))


@query("W12_horizon_steps", """SELECT region, origin_hh, hh, hh - origin_hh + 1 AS step, round_even((hh - origin_hh + 1) / 48.0, 3) AS forecast_horizon_days, 30 * (hh - origin_hh) AS forecast_horizon_minutes FROM naive_many WHERE model = 'Naive48'""",
       nums="forecast_horizon_days")
def w12(spark, folder):
    g = v.grid_a(spark, folder)
    f = forecast_frame(seasonal_naive(g, v.origin_many(g), 48), g, "FROZEN")
    return f.select("region", "origin_hh", "hh", "step", "forecast_horizon_days", (30 * (F.col("step") - 1)).alias("forecast_horizon_minutes"))


@query("W13_fold_winners", """SELECT region, model, count(CASE WHEN r = 1 THEN 1 END) AS wins, 100.0 * count(CASE WHEN r = 1 THEN 1 END) / count(*) AS win_rate_pct FROM (
    SELECT *, row_number() OVER (PARTITION BY region, origin ORDER BY MAE, CASE model WHEN 'Naive48' THEN 0 ELSE 1 END) AS r FROM scores) GROUP BY 1, 2""", nums="win_rate_pct")
def w13(spark, folder):
    return selection.win_rates(v.scores(v.grid_a(spark, folder))).drop("folds")


@query("W14_skill_vs_best_naive", "SELECT region, model, origin, MAE, baseline_MAE, skill_vs_naive_pct FROM skilled", nums="MAE baseline_MAE skill_vs_naive_pct")
def w14(spark, folder):
    return v.skilled(v.grid_a(spark, folder)).select("region", "model", "origin", "MAE", "baseline_MAE", "skill_vs_naive_pct")


def _daily_series(spark, folder):
    """Daily weather as one numbered series with both variables."""
    w = v.daily_weather(spark, folder).withColumns({"region": v.one_series("date"), "_d": F.datediff(F.to_date("date"), F.lit("1970-01-01").cast("date")).cast("long")})
    return with_row_number(w, ["region"], [F.col("_d")], floor_div("_d", 366), "pos").select("region", "date", "pos", F.col("temp_mean_c").alias("y"), F.col("rainfall_mm").alias("x"))


SERIES = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, temp_mean_c AS y, rainfall_mm AS x FROM daily_weather"


@query("W15_moving_average_10", f"""SELECT date, CASE WHEN count(*) OVER c = 10 THEN avg(y) OVER c END AS centred, CASE WHEN count(*) OVER s = 10 THEN avg(y) OVER s END AS one_sided FROM ({SERIES})
    WINDOW c AS (ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING), s AS (ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", nums="centred one_sided")
def w15(spark, folder):
    s = _daily_series(spark, folder)
    a = stats.moving_average(s).select("pos", "date", F.col("moving_average").alias("centred"))
    b = stats.moving_average(s, centred=False).select("pos", F.col("moving_average").alias("one_sided"))
    return a.join(b, "pos").drop("pos")


@query("W16_acf_ccf", f"""WITH s AS ({SERIES}), m AS (SELECT avg(y) AS my, avg(x) AS mx, count(*) AS n, var_pop(y) AS vy, stddev_pop(y) * stddev_pop(x) AS sxy FROM s)
    SELECT 'acf' AS kind, lag, sum((a.y - my) * (b.y - my)) / max(n) / max(vy) AS value FROM s a CROSS JOIN m CROSS JOIN (SELECT unnest(range(0, 31)) AS lag) JOIN s b ON b.pos = a.pos + lag GROUP BY lag
    UNION ALL SELECT 'ccf', lag, sum((a.y - my) * (b.x - mx)) / max(n) / max(sxy) FROM s b CROSS JOIN m CROSS JOIN (SELECT unnest(range(-15, 16)) AS lag) JOIN s a ON a.pos = b.pos + lag GROUP BY lag""", nums="value")
def w16(spark, folder):
    s = _daily_series(spark, folder)
    a = stats.autocorrelation(s, 30).select(F.lit("acf").alias("kind"), F.col("lag").cast("long").alias("lag"), F.col("acf").alias("value"))
    c = stats.cross_correlation(s, "y", "x", 15).select(F.lit("ccf").alias("kind"), F.col("lag").cast("long").alias("lag"), F.col("ccf").alias("value"))
    return a.unionByName(c)


@query("M17a_one_regressor_fit", """SELECT a.region, count(*) AS n, regr_slope(a.y, b.y) AS slope, regr_intercept(a.y, b.y) AS intercept, regr_r2(a.y, b.y) AS r2 FROM grid_a a JOIN grid_a b ON a.region = b.region AND b.hh = a.hh - 48
    WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY a.region""", nums="slope intercept r2")
def m17a(spark, folder):
    f = ft.demand_features_by_join(v.grid_a(spark, folder))
    return stats.simple_regression(f, "lag_48", "y").drop("rss")


@query("M18a_information_criteria", f"""SELECT n, rss, n * (ln(2 * pi()) + ln(rss / n) + 1) + 6 AS AIC, n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * 3 AS BIC FROM (
    SELECT count(*) AS n, regr_syy(y, pos) * (1 - regr_r2(y, pos)) AS rss FROM ({SERIES}))""", nums="rss AIC BIC")
def m18a(spark, folder):
    fit = stats.simple_regression(_daily_series(spark, folder), "pos", "y")
    return fit.withColumns(stats.gaussian_criteria(F.col("n"), F.col("rss"), F.lit(2))).select("n", "rss", "AIC", "BIC")


@query("M18c_nested_f", f"""SELECT n, (syy - rss) / (rss / (n - 2)) AS f_statistic FROM (SELECT count(*) AS n, regr_syy(y, pos) AS syy, regr_syy(y, pos) * (1 - regr_r2(y, pos)) AS rss FROM ({SERIES}))""", nums="f_statistic")
def m18c(spark, folder):
    fit = stats.simple_regression(_daily_series(spark, folder), "pos", "y")
    flat = F.col("rss") / (1 - F.col("r2"))                      # the mean-only fit leaves the whole variation
    return fit.select("n", stats.nested_f(F.col("n"), flat, F.lit(1), F.col("rss"), F.lit(2)).alias("f_statistic"))


@query("M18b_box_pierce", f"""WITH s AS ({SERIES}), m AS (SELECT avg(y) AS my, count(*) AS n, var_pop(y) AS vy FROM s),
    a AS (SELECT lag, sum((p.y - my) * (q.y - my)) / max(n) / max(vy) AS r, max(n) AS n FROM s p CROSS JOIN m CROSS JOIN (SELECT unnest(range(1, 6)) AS lag) JOIN s q ON q.pos = p.pos + lag GROUP BY lag) SELECT max(n) * sum(r * r) AS Q FROM a""", nums="Q")
def m18b(spark, folder):
    s = _daily_series(spark, folder)
    return stats.box_pierce(stats.autocorrelation(s, 5), s.groupBy("region").agg(F.count(F.lit(1)).alias("n")), 5).select("Q")


# Periods in days at which daily series are looked at.
PERIODS = {"year": 365.25, "half_year": 182.625, "quarter": 91.3125, "month": 30.4375, "fortnight": 14.0, "week": 7.0, "half_week": 3.5}
PERIOD_SQL = "(VALUES " + ", ".join(f"('{k}', {length})" for k, length in PERIODS.items()) + ") p(period, len)"
SPECTRUM = f"""WITH s AS (SELECT *, count(*) OVER () AS n, y - avg(y) OVER () AS dy, x - avg(x) OVER () AS dx FROM ({SERIES})),
    t AS (SELECT period, k, n, 1.0 / len + k * 1.0 / n AS freq, sum(dy * cos(2 * pi() * pos * (1.0 / len + k * 1.0 / n))) AS ca, sum(dy * sin(2 * pi() * pos * (1.0 / len + k * 1.0 / n))) AS sa,
      sum(dx * cos(2 * pi() * pos * (1.0 / len + k * 1.0 / n))) AS cb, sum(dx * sin(2 * pi() * pos * (1.0 / len + k * 1.0 / n))) AS sb
      FROM s, {PERIOD_SQL}, (SELECT unnest(range(-12, 13)) AS k) GROUP BY period, k, n, len)"""


@query("M19_periodogram", f"{SPECTRUM} SELECT period, freq, (ca * ca + sa * sa) / n AS power FROM t WHERE k = 0", nums="freq power")
def m19(spark, folder):
    return stats.power_at(_daily_series(spark, folder), PERIODS).select("period", "freq", F.col("p_a").alias("power"))


@query("M19b_smoothed_coherence", f"""{SPECTRUM} SELECT period, avg((ca * ca + sa * sa) / n) AS smooth_a, avg((cb * cb + sb * sb) / n) AS smooth_b,
      (pow(avg((ca * cb + sa * sb) / n), 2) + pow(avg((ca * sb - sa * cb) / n), 2)) / (avg((ca * ca + sa * sa) / n) * avg((cb * cb + sb * sb) / n)) AS coherence FROM t GROUP BY period""", nums="smooth_a smooth_b coherence")
def m19b(spark, folder):
    spec = stats.power_at(_daily_series(spark, folder), PERIODS, values=["y", "x"], spread=12)
    return stats.coherence_at(spec).select("period", "smooth_a", "smooth_b", "coherence")


def _daniell(source, name):
    """Both window sums of a modified Daniell window of 12 steps to either side."""
    sums = ", ".join(f"(sum({c}) OVER (ORDER BY k ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) + sum({c}) OVER (ORDER BY k ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)) / 48 AS {c}" for c in ("sa", "sb", "cr", "ci"))
    return f"{name} AS (SELECT k, size, power, power_b, {sums} FROM {source})"


# The transform by its definition, every frequency against every position.
FULL_SPECTRUM = f"""WITH s AS ({SERIES}), m AS (SELECT count(*) AS n, avg(pos) AS tm, avg(y) AS my, avg(x) AS mx, regr_slope(y, pos) AS sy, regr_slope(x, pos) AS sx FROM s),
    d AS (SELECT pos, n, y - my - sy * (pos - tm) AS v0, x - mx - sx * (pos - tm) AS v1 FROM s, m),
    z AS (SELECT min(p) AS size FROM (SELECT CAST(pow(2, a) * pow(3, b) * pow(5, c) AS BIGINT) AS p FROM (SELECT unnest(range(20)) AS a), (SELECT unnest(range(13)) AS b), (SELECT unnest(range(9)) AS c)), m WHERE p >= n),
    ks AS (SELECT size, unnest(range(0, size // 2 + 1)) AS k FROM z),
    f AS (SELECT k, size, max(n) AS n, sum(v0 * cos(2 * pi() * ((k * pos) % size) / size)) AS r0, -sum(v0 * sin(2 * pi() * ((k * pos) % size) / size)) AS i0, sum(v1 * cos(2 * pi() * ((k * pos) % size) / size)) AS r1,
      -sum(v1 * sin(2 * pi() * ((k * pos) % size) / size)) AS i1 FROM d, ks GROUP BY k, size),
    p AS (SELECT k, size, (r0 * r0 + i0 * i0) / n AS power, (r1 * r1 + i1 * i1) / n AS power_b, (r0 * r1 + i0 * i1) / n AS cr, (i0 * r1 - r0 * i1) / n AS ci FROM f),
    e AS (SELECT * FROM p UNION ALL SELECT -k, size, power, power_b, cr, -ci FROM p WHERE k BETWEEN 1 AND 24 UNION ALL SELECT size - k, size, power, power_b, cr, -ci FROM p WHERE size - k > size // 2 AND size - k <= size // 2 + 24),
    e0 AS (SELECT k, size, power, power_b, """ + ", ".join(
    f"CASE WHEN k = 0 THEN (lag({c}) OVER (ORDER BY k) + lead({c}) OVER (ORDER BY k)) / 2 ELSE {c} END AS {n}" for c, n in (("power", "sa"), ("power_b", "sb"), ("cr", "cr"), ("ci", "ci"))) + f""" FROM e),
    {_daniell("e0", "e1")}, {_daniell("e1", "e2")}, sp AS (SELECT k, k / size AS freq, power, sa AS smoothed, power_b, sb AS smoothed_b, (cr * cr + ci * ci) / (sa * sb) AS coherence FROM e2 WHERE k > 0 AND k <= size // 2)"""


@query("M19c_full_spectrum", f"{FULL_SPECTRUM} SELECT * FROM sp", nums="freq power smoothed power_b smoothed_b coherence")
def m19c(spark, folder):
    """Power, smoothed power and coherence of temperature and rain at every Fourier frequency."""
    spec = spectrum.spectrum(_daily_series(spark, folder), values=("y", "x"))
    return spec.select("k", "freq", "power", "smoothed", "power_b", "smoothed_b", "coherence")


@query("M19d_spectral_peaks", f"""{FULL_SPECTRUM} SELECT row_number() OVER (ORDER BY smoothed DESC, k) AS rank, k, freq, 1 / freq AS period, smoothed FROM (SELECT *, max(smoothed) OVER (ORDER BY k ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS b,
      max(smoothed) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS a FROM sp) WHERE coalesce(b, -1) < smoothed AND coalesce(a, -1) <= smoothed QUALIFY rank <= 5""", nums="freq period smoothed")
def m19d(spark, folder):
    """The five highest places of the smoothed spectrum, found and not named."""
    spec = cut_lineage(spectrum.spectrum(_daily_series(spark, folder)), "spectrum")
    return spectrum.peaks(spec).drop("region")
