"""Panels, forecasts, backtests, selection, models and streaming."""
from pyspark.sql import functions as F

from loadtide.catalog import views as v
from loadtide.catalog.registry import query
from loadtide.config import FEATURES_A, LAGS
from loadtide.functions.clock import slot_start
from loadtide.functions.numeric import percent_of
from loadtide.operators import evaluate as ev
from loadtide.operators import features as ft
from loadtide.operators import least_squares as lsq
from loadtide.operators import sequences as sq
from loadtide.plans import custom, forecast, frames, models, panel, selection, trees
from loadtide.plans import origin_maps as maps
from loadtide.plans.backtest import backtest, backtest_scores, fitted_model
from loadtide.session import cut_lineage
from loadtide.streaming import live

METRICS = "matched_intervals MAE RMSE sMAPE Bias MedAE".split()
MNUM = "MAE RMSE sMAPE Bias MedAE"


@query("M01_panel", """SELECT p.region, p.origin_hh, p.hh, CAST(p.hh >= p.origin_hh AS INT) AS is_horizon, CASE WHEN p.hh < p.origin_hh THEN g.y END AS y, g.y AS actual FROM (
    SELECT o.region, o.origin_hh, unnest(range(s.lo, o.end_hh + 1)) AS hh FROM origin_many o JOIN (SELECT region, min(hh) AS lo FROM grid_a GROUP BY region) s ON s.region = o.region) p
    LEFT JOIN grid_a g ON g.region = p.region AND g.hh = p.hh""", nums="y actual", ints="is_horizon")
def m01(spark, folder):
    g = v.grid_a(spark, folder)
    return panel.build_panel(g, v.origin_many(g)).select("region", "origin_hh", "hh", "is_horizon", "y", "actual")


@query("M02_analogue_origins", """SELECT region, anchor, origin, horizon_end, row_number() OVER (PARTITION BY region, anchor ORDER BY origin DESC) AS rank FROM (
    SELECT region, a AS anchor, make_timestamp(y, month(a), 1, 0, 0, 0) AS origin, make_timestamp(y, month(a), 1, 0, 0, 0) + INTERVAL 4 MONTH - INTERVAL 30 MINUTE AS horizon_end, s, e FROM (
      SELECT region, min(date) AS s, max(date) AS e FROM daily_demand GROUP BY region), (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS a FROM orders), (SELECT unnest(range(1990, 2003)) AS y)
    WHERE y < year(a) AND y >= year(s)) WHERE origin > s AND datediff('day', s, origin) >= 240 AND horizon_end <= e
    QUALIFY row_number() OVER (PARTITION BY region, anchor ORDER BY origin DESC) <= 3""")
def m02(spark, folder):
    d = v.daily_demand(spark, folder)
    spans = d.groupBy("region").agg(F.min("date").alias("s"), F.max("date").alias("e"))
    months = v.table(spark, folder, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("a")).distinct()
    anchors = F.explode(F.sequence(F.trunc(F.to_date("lo"), "month"), F.trunc(F.to_date("hi"), "month"), F.expr("interval 1 month")))
    ends = months.agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()        # two dates
    spans = (spans.withColumns({"lo": F.lit(ends["lo"]), "hi": F.lit(ends["hi"])})
             .select("region", "s", "e", anchors.alias("anchor")).withColumn("anchor", F.col("anchor").cast("timestamp_ntz")))
    return panel.analogue_origins(spans, "anchor", "s", "e").select("region", "anchor", "origin", "horizon_end", "rank")


@query("M03_walk_forward_folds", """SELECT region, 3 - b // 144 AS fold, min(hh) AS origin_hh, max(hh) AS end_hh, count(*) AS test_rows FROM (
    SELECT region, hh, row_number() OVER (PARTITION BY region ORDER BY hh DESC) - 1 AS b FROM grid_a WHERE y IS NOT NULL) WHERE b < 432 GROUP BY 1, 2""")
def m03(spark, folder):
    return panel.fold_table(v.grid_a(spark, folder), 3, 144)


@query("M04_screen_gate", """SELECT region, model, avg(MAE) AS mean_MAE, CASE WHEN model LIKE 'Naive%' OR avg(MAE) <= 2 * min(avg(MAE)) OVER (PARTITION BY region) THEN 1 ELSE 0 END AS keep FROM (
    SELECT region, model, MAE FROM scores UNION ALL SELECT region, 'XGBoost_A', MAE * 2.6 FROM scores WHERE model = 'Naive48'
    UNION ALL SELECT region, 'RandomForest_A', MAE * 0.995 FROM scores WHERE model = 'Naive48') GROUP BY 1, 2""", nums="mean_MAE", ints="keep")
def m04(spark, folder):
    return selection.screen(_more_models(v.scores(v.grid_a(spark, folder))))


def _more_models(s):
    """Two more candidates with scaled errors, to exercise gate and choice."""
    base = s.where("model = 'Naive48'")
    return (s.unionByName(base.withColumns({"model": F.lit("XGBoost_A"), "MAE": F.col("MAE") * 2.6}))
            .unionByName(base.withColumns({"model": F.lit("RandomForest_A"), "MAE": F.col("MAE") * 0.995})))


@query("M05_seasonal_naive", "SELECT region, model, origin_hh, hh, forecast FROM naive_one", nums="forecast")
def m05(spark, folder):
    g = v.grid_a(spark, folder)
    return forecast.naive_forecasts(g, v.origin_one(g)).select("region", "model", "origin_hh", "hh", "forecast")


def _src(k):
    return f"CASE WHEN hh - {k} < lo THEN 'MISSING' WHEN hh - {k} < origin_hh THEN 'ACTUAL_HISTORY' ELSE 'RECURSIVE_FORECAST' END"


PROV = f"""SELECT region, origin_hh, hh, forecast, {_src(48)} AS lag48_source, {_src(96)} AS lag96_source, {_src(336)} AS lag336_source FROM (SELECT f.*, s.lo FROM naive_many f
    JOIN (SELECT region, min(hh) AS lo FROM grid_a GROUP BY region) s ON s.region = f.region WHERE model = 'Naive48')"""


@query("M06_lag_provenance", f"""SELECT region, origin_hh, hh, lag48_source, lag96_source, lag336_source, CASE WHEN lag48_source = 'ACTUAL_HISTORY' AND lag96_source = 'ACTUAL_HISTORY' AND lag336_source = 'ACTUAL_HISTORY' THEN 0 ELSE 1 END AS recursive_input_used
    FROM ({PROV})""", ints="recursive_input_used")
def m06(spark, folder):
    g = v.grid_a(spark, folder)
    h = panel.horizon_rows(v.origin_many(g))
    return panel.lag_sources(h, panel.series_starts(g)).select("region", "origin_hh", "hh", *[f"lag{k}_source" for k in LAGS.values()], "recursive_input_used")


@query("M07_origin_maps", """SELECT o.region, o.origin_hh, c.month, c.half_hour_index, avg(y) AS historical_month_halfhour_mean, median(y) AS historical_month_halfhour_median, count(*) AS history_rows, max(c.hh) AS history_end
    FROM origin_many o JOIN cal_a c ON c.region = o.region AND c.hh < o.origin_hh WHERE y IS NOT NULL GROUP BY 1, 2, 3, 4""", nums="historical_month_halfhour_mean historical_month_halfhour_median", ints="half_hour_index")
def m07(spark, folder):
    c = v.cal_a(spark, folder)
    o = v.origin_many(c)
    return maps.halfhour_map(maps.known_rows(c, o), o)


ORIGIN_DAYS = """SELECT o.region, o.origin_hh, c.month, c.local_date, avg(y) AS m, max(y) AS x FROM origin_many o JOIN cal_a c ON c.region = o.region AND c.hh < o.origin_hh WHERE y IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query("M07b_origin_monthly_map", f"""SELECT region, origin_hh, month, avg(m) AS historical_month_daily_mean, avg(x) AS historical_month_peak_mean, stddev_samp(m) AS historical_month_variability FROM ({ORIGIN_DAYS}) GROUP BY 1, 2, 3""",
       nums="historical_month_daily_mean historical_month_peak_mean historical_month_variability")
def m07b(spark, folder):
    c = v.cal_a(spark, folder)
    o = v.origin_many(c)
    return maps.monthly_map(maps.known_rows(c, o), o)


@query("M07c_origin_weekday_map", """SELECT o.region, o.origin_hh, c.month, c.day_of_week, c.half_hour_index, avg(y) AS historical_month_dow_halfhour_mean
    FROM origin_many o JOIN cal_a c ON c.region = o.region AND c.hh < o.origin_hh WHERE y IS NOT NULL GROUP BY 1, 2, 3, 4, 5""", nums="historical_month_dow_halfhour_mean", ints="half_hour_index")
def m07c(spark, folder):
    c = v.cal_a(spark, folder)
    o = v.origin_many(c)
    return maps.dow_halfhour_map(maps.known_rows(c, o), o)


@query("M07d_origin_history", """SELECT o.region, o.origin_hh, count(*) AS history_rows, max(c.hh) AS history_end, string_agg(DISTINCT CAST(c.year AS VARCHAR), ',' ORDER BY CAST(c.year AS VARCHAR)) AS years_used
    FROM origin_many o JOIN cal_a c ON c.region = o.region AND c.hh < o.origin_hh WHERE y IS NOT NULL GROUP BY 1, 2""")
def m07d(spark, folder):
    c = v.cal_a(spark, folder)
    o = v.origin_many(c)
    return maps.history_map(maps.known_rows(c, o), o)


#: Days since 1990 at which the daily maps are taken: inside a year and at its end.
MAP_DAYS = (2000, 2191, 2700)
WEATHER_DAYS = f"SELECT o.origin_day, w.*, month(w.date) AS month, dayofyear(w.date) AS day_of_year FROM daily_weather w, (SELECT unnest({list(MAP_DAYS)}) AS origin_day) o WHERE date_diff('day', DATE '1990-01-01', CAST(w.date AS DATE)) < origin_day"


def _day_origins(days):
    return days.select("region").distinct().withColumn("origin_day", F.explode(F.array(*[F.lit(d).cast("long") for d in MAP_DAYS])))


def _weather_days(spark, folder):
    w = v.daily_weather(spark, folder).withColumn("region", v.one_series("date"))
    w = w.withColumns({"day": F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long"), "month": F.month("date"), "day_of_year": F.dayofyear("date")})
    return cut_lineage(w, "weather-days")


@query("M07e_origin_temperature_map", f"SELECT origin_day, day_of_year, avg(temp_mean_c) AS expected_temp_climatology, count(*) AS days FROM ({WEATHER_DAYS}) GROUP BY 1, 2", nums="expected_temp_climatology")
def m07e(spark, folder):
    w = _weather_days(spark, folder)
    return maps.temperature_map(w, _day_origins(w)).drop("region")


@query("M07f_origin_rain_map", f"""SELECT origin_day, month, avg(CASE WHEN rainfall_mm > 0.45 THEN 1.0 ELSE 0.0 END) AS historical_rain_probability, avg(rainfall_mm) AS mean_rainfall_mm FROM ({WEATHER_DAYS}) GROUP BY 1, 2""",
       nums="historical_rain_probability mean_rainfall_mm")
def m07f(spark, folder):
    w = _weather_days(spark, folder)
    return maps.rain_map(w, _day_origins(w), threshold=0.45).drop("region")


@query("M07g_origin_balance_point", f"""SELECT region, origin_day, base AS balance_point_c, c AS balance_point_corr, n AS days FROM (SELECT region, origin_day, base, count(*) AS n, abs(corr(demand, abs(temp - base))) AS c FROM demand_temp,
    (SELECT unnest(range(28, 51)) / 2.0 AS base), (SELECT unnest({list(MAP_DAYS)}) AS origin_day) WHERE date_diff('day', DATE '1990-01-01', CAST(date AS DATE)) < origin_day GROUP BY 1, 2, 3)
    WHERE n >= 60 QUALIFY row_number() OVER (PARTITION BY region, origin_day ORDER BY c DESC, base) = 1""", nums="balance_point_c balance_point_corr")
def m07g(spark, folder):
    d = v.demand_temp(spark, folder).withColumn("day", F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long"))
    d = cut_lineage(d, "demand-days")
    return maps.balance_map(d, _day_origins(d))


def _policy_sql(mode, use, base):
    return f"""SELECT region, hh, '{mode}' AS mode, CASE WHEN {use} AND v IS NOT NULL THEN v ELSE fb END AS weather_temp_c, CASE WHEN {use} THEN source ELSE '{base}' END AS weather_feature_source FROM policy_rows"""


FRESH = "(source = 'FORECAST_7DAY' AND issued <= info)"


@query("M08_weather_policy", """WITH policy_rows AS (SELECT g.region, g.hh, g.y AS v, f.fb, o.origin_hh AS info, CASE WHEN (g.hh - o.origin_hh) % 3 = 0 THEN 'FORECAST_7DAY' WHEN (g.hh - o.origin_hh) % 3 = 1 THEN 'OBSERVED_REANALYSIS' ELSE 'CLIMATOLOGY_FALLBACK' END AS source,
      CASE WHEN g.hh < o.origin_hh + 96 THEN o.origin_hh - 48 ELSE o.origin_hh + 48 END AS issued FROM grid_a g JOIN origin_one o ON o.region = g.region AND g.hh >= o.origin_hh
      LEFT JOIN (SELECT g.region, g.hh % 48 AS k, avg(g.y) AS fb FROM grid_a g JOIN origin_one o ON o.region = g.region AND g.hh < o.origin_hh GROUP BY 1, 2) f ON f.region = g.region AND f.k = g.hh % 48) """ +
       " UNION ALL ".join([_policy_sql("historical_backtest", "false", "BACKTEST_CLIMATOLOGY"), _policy_sql("frozen", f"({FRESH} OR source = 'CLIMATOLOGY_FALLBACK')", "CLIMATOLOGY_FALLBACK"),
                           _policy_sql("live", f"({FRESH} OR source = 'CLIMATOLOGY_FALLBACK')", "CLIMATOLOGY_FALLBACK"),
                           _policy_sql("retrospective", "source IN ('OBSERVED_REANALYSIS', 'CLIMATOLOGY_FALLBACK')", "CLIMATOLOGY_FALLBACK")]), nums="weather_temp_c")
def m08(spark, folder):
    g = v.grid_a(spark, folder).select("region", "hh", "y")
    rows = g.join(v.origin_one(g), "region")
    clock = F.col("hh") % 48
    fb = rows.where("hh < origin_hh").groupBy("region", clock.alias("k")).agg(F.avg("y").alias("fb_weather_temp_c"))
    step = F.col("hh") - F.col("origin_hh")
    frame = (rows.where("hh >= origin_hh").withColumn("k", clock).join(fb, ["region", "k"], "left")
             .withColumns({"weather_temp_c": F.col("y"), "information_origin": F.col("origin_hh"),
                           "source": F.when(step % 3 == 0, "FORECAST_7DAY").when(step % 3 == 1, "OBSERVED_REANALYSIS").otherwise("CLIMATOLOGY_FALLBACK"),
                           "issued": F.when(step < 96, F.col("origin_hh") - 48).otherwise(F.col("origin_hh") + 48)}))
    out = None
    for mode in ("historical_backtest", "frozen", "live", "retrospective"):
        part = forecast.apply_weather_policy(frame, mode, ["weather_temp_c"]).select("region", "hh", F.lit(mode).alias("mode"), "weather_temp_c", "weather_feature_source")
        out = part if out is None else out.unionByName(part)
    return out


@query("M08b_weather_context", """WITH o AS (SELECT date_trunc('day', max(date) - INTERVAL 400 DAY) AS origin, max(date) AS last_day FROM daily_weather),
    h AS (SELECT w.* FROM daily_weather w JOIN o ON w.date < o.origin), e AS (SELECT month(date) AS mo, day(date) AS d, avg(temp_mean_c) AS m FROM h GROUP BY 1, 2), c AS (SELECT month(date) AS mo, avg(temp_mean_c) AS m FROM h GROUP BY 1),
    p AS (SELECT t.date, origin, CASE WHEN t.date < origin THEN coalesce(h.temp_mean_c, c.m) ELSE coalesce(e.m, c.m) END AS safe_temp FROM (SELECT origin, unnest(generate_series(origin - INTERVAL 14 DAY, last_day, INTERVAL 1 DAY)) AS date FROM o) t
      LEFT JOIN h ON h.date = t.date LEFT JOIN e ON e.mo = month(t.date) AND e.d = day(t.date) LEFT JOIN c ON c.mo = month(t.date)),
    l AS (SELECT *, lag(safe_temp) OVER w AS temp_mean_lag_1d, lag(safe_temp, 7) OVER w AS temp_mean_lag_7d, avg(safe_temp) OVER (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_temp_mean_7d FROM p WINDOW w AS (ORDER BY date))
    SELECT date, safe_temp, temp_mean_lag_1d, temp_mean_lag_7d, rolling_temp_mean_7d, greatest(25 - temp_mean_lag_1d, 0) AS hdd_lag_1d, greatest(temp_mean_lag_1d - 25, 0) AS cdd_lag_1d FROM l WHERE date >= origin""",
       nums="safe_temp temp_mean_lag_1d temp_mean_lag_7d rolling_temp_mean_7d hdd_lag_1d cdd_lag_1d")
def m08b(spark, folder):
    w = v.daily_weather(spark, folder).withColumn("region", v.one_series("date"))
    o = w.groupBy("region").agg(F.date_sub(F.to_date(F.max("date")), 400).cast("timestamp_ntz").alias("origin"), F.max("date").alias("last_day"))
    return ft.weather_context(w, o.withColumn("base_c", F.lit(25.0)), "base_c").drop("region", "origin")


@query("M09_future_feature_frame", """SELECT f.region, f.hh, f.half_hour_index, f.day_of_week, f.month, CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_public_holiday, f.hh - s.lo AS time_index, p.m AS historical_month_halfhour_mean,
      q.m AS historical_month_dow_halfhour_mean, NULL::DOUBLE AS lag_48 FROM cal_a f JOIN origin_one o ON o.region = f.region AND f.hh >= o.origin_hh JOIN (SELECT region, min(hh) AS lo FROM grid_a GROUP BY region) s ON s.region = f.region
    LEFT JOIN holidays h ON h.date = f.local_date
    LEFT JOIN (SELECT c.region, month, half_hour_index, avg(y) AS m FROM cal_a c JOIN origin_one o ON o.region = c.region WHERE c.hh < o.origin_hh GROUP BY 1, 2, 3) p ON p.region = f.region AND p.month = f.month AND p.half_hour_index = f.half_hour_index
    LEFT JOIN (SELECT c.region, month, day_of_week, half_hour_index, avg(y) AS m FROM cal_a c JOIN origin_one o ON o.region = c.region WHERE c.hh < o.origin_hh GROUP BY 1, 2, 3, 4) q
      ON q.region = f.region AND q.month = f.month AND q.day_of_week = f.day_of_week AND q.half_hour_index = f.half_hour_index""",
       nums="historical_month_halfhour_mean historical_month_dow_halfhour_mean", ints="half_hour_index is_public_holiday")
def m09(spark, folder):
    g, h = v.grid_a(spark, folder), v.holidays(spark, folder)
    frame = frames.horizon_frame(frames.base_frame(g, h), v.origin_one(g), h)
    return frame.select("region", "hh", "half_hour_index", "day_of_week", "month", "is_public_holiday", "time_index",
                        "historical_month_halfhour_mean", "historical_month_dow_halfhour_mean", "lag_48")


WIN = """SELECT g.region, o.origin_hh, g.hh - s.lo AS pos, g.hh AS start_hh, count(g2.y) FILTER (g2.hh < g.hh) AS encoder_len, count(g2.y) FILTER (g2.hh >= g.hh) AS target_len, sum(g2.y) FILTER (g2.hh < g.hh) AS encoder_sum,
      sum(g2.y) FILTER (g2.hh >= g.hh) AS target_sum FROM grid_b g JOIN (SELECT region, min(hh) AS lo FROM grid_b GROUP BY region) s ON s.region = g.region JOIN origin_one_b o ON o.region = g.region
      JOIN grid_b g2 ON g2.region = g.region AND g2.hh BETWEEN g.hh - 336 AND g.hh + 47 WHERE (g.hh - s.lo - 672) % 24 = 0 AND g.hh - s.lo >= 672 AND g.hh + 48 <= o.origin_hh + 336 GROUP BY 1, 2, 3, 4
      HAVING count(g2.y) FILTER (g2.hh < g.hh) = 336 AND count(g2.y) FILTER (g2.hh >= g.hh) = 48"""


def _late_origin(g):
    return v.origin_one(g).withColumn("origin_hh", F.col("origin_hh") + 336)


@query("M10_sequence_windows", f"""SELECT w.region, w.pos, w.start_hh, encoder_len, target_len, encoder_sum, target_sum, e.clock AS encoder_clock_sum, d.clock AS decoder_clock_sum, d.dow AS decoder_weekday_sum, e.wave AS encoder_wave_sum FROM ({WIN}) w
    JOIN LATERAL (SELECT sum(half_hour_index) AS clock, sum(half_hour_index * c.hh % 7) AS wave FROM cal_b c WHERE c.region = w.region AND c.hh BETWEEN w.start_hh - 336 AND w.start_hh - 1) e ON true
    JOIN LATERAL (SELECT sum(half_hour_index) AS clock, sum(day_of_week * (c.hh - w.start_hh + 1)) AS dow FROM cal_b c WHERE c.region = w.region AND c.hh BETWEEN w.start_hh AND w.start_hh + 47) d ON true""",
       nums="encoder_sum target_sum", ints="encoder_clock_sum decoder_clock_sum decoder_weekday_sum encoder_wave_sum")
def m10(spark, folder):
    """Encoder with its calendar, decoder of columns known ahead, and target of every full block."""
    g = v.grid_b(spark, folder)
    c = ft.civil_calendar(g).withColumn("wave", F.col("half_hour_index") * F.col("hh") % 7)
    w = sq.sequence_blocks(c, _late_origin(g), 336, 24, encoder=["half_hour_index", "wave"], decoder=["half_hour_index", "day_of_week"])

    def total(c, start=0.0):
        return F.aggregate(c, F.lit(start), lambda a, x: a + x)

    steps = F.aggregate(F.transform("decoder_day_of_week", lambda x, i: x * (i + 1)), F.lit(0), lambda a, x: a + x)
    whole = {n: F.aggregate(F.transform(c, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) for n, c in
             (("encoder_clock_sum", "encoder_half_hour_index"), ("decoder_clock_sum", "decoder_half_hour_index"), ("encoder_wave_sum", "encoder_wave"))}
    return w.select("region", "pos", "start_hh", F.size("encoder").alias("encoder_len"), F.size("target").alias("target_len"),
                    total("encoder").alias("encoder_sum"), total("target").alias("target_sum"), steps.alias("decoder_weekday_sum"), *[c.alias(n) for n, c in whole.items()])


@query("M11_chronological_split", f"""SELECT region, start_hh, CASE WHEN row_number() OVER (PARTITION BY region ORDER BY start_hh) <= floor(count(*) OVER (PARTITION BY region) * 0.9) THEN 'train' ELSE 'validation' END AS part FROM ({WIN})""")
def m11(spark, folder):
    g = v.grid_b(spark, folder)
    o = _late_origin(g)
    starts = sq.before_origins(sq.window_starts(g, o, 336, 24), o)
    return sq.chronological_split(starts).select("region", "start_hh", "part")


@query("M12_training_scaler", """SELECT g.region, o.origin_hh, max(hh) AS fitted_until_hh, count(*) AS fitted_rows, avg(y) AS y_mean, stddev_samp(y) AS y_std FROM grid_a g JOIN origin_many o ON o.region = g.region AND g.hh < o.origin_hh GROUP BY 1, 2""", nums="y_mean y_std")
def m12(spark, folder):
    g = v.grid_a(spark, folder)
    return maps.scaler(g.select("region", "hh", "y"), v.origin_many(g), ["y"])


def _frames(spark, folder):
    """Training and horizon frames of set A of the dense series at three origins."""
    g, h = v.grid_b(spark, folder), v.holidays(spark, folder)
    o = cut_lineage(v.origin_many(g), "origins")
    base = frames.base_frame(g, h)
    return g, o, cut_lineage(frames.training_frame(base, o), "training"), frames.horizon_frame(base, o, h)


def _same(days):
    return "list_avg([" + ", ".join(f"lag(y, {48 * k}) OVER s" for k in range(1, days + 1)) + "])"


WAVES = ", ".join(f"{f}(2 * pi() * {c} / {p}) AS {f}_{n}" for n, c, p in (("half_hour", "half_hour_index", 48), ("day_of_week", "day_of_week", 7), ("month", "month", 12),
                                                                         ("day_of_year", "day_of_year", 365.25)) for f in ("sin", "cos"))
FRAME_A = f"""WITH b AS (SELECT c.*, hour(ts) AS hour, weekofyear(ts) AS week_of_year, quarter(ts) AS quarter, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, {WAVES},
      CAST(local_date IN (SELECT date FROM holidays) AS INT) AS is_public_holiday, CAST(local_date + INTERVAL 1 DAY IN (SELECT date FROM holidays) AS INT) AS is_day_before_holiday,
      CAST(local_date - INTERVAL 1 DAY IN (SELECT date FROM holidays) AS INT) AS is_day_after_holiday, lag(y, 48) OVER s AS lag_48, lag(y, 96) OVER s AS lag_96, lag(y, 336) OVER s AS lag_336,
      CASE WHEN count(y) OVER d = 48 THEN avg(y) OVER d END AS previous_day_mean, CASE WHEN count(y) OVER d = 48 THEN max(y) OVER d END AS previous_day_peak, CASE WHEN count(y) OVER d = 48 THEN min(y) OVER d END AS previous_day_min,
      CASE WHEN count(y) OVER d = 48 THEN stddev_samp(y) OVER d END AS rolling_std_24h_at_t_minus_48, {_same(7)} AS same_half_hour_7day_mean, {_same(14)} AS same_half_hour_14day_mean,
      hh - min(hh) OVER (PARTITION BY region) AS time_index, (hh - min(hh) OVER (PARTITION BY region)) / 48.0 AS days_since_start
      FROM cal_b c WINDOW s AS (PARTITION BY region ORDER BY hh), d AS (PARTITION BY region ORDER BY hh RANGE BETWEEN 95 PRECEDING AND 48 PRECEDING)),
    past AS (SELECT o.origin_hh, b.* FROM b JOIN origin_many_b o ON o.region = b.region AND b.hh < o.origin_hh),
    p1 AS (SELECT region, origin_hh, month, half_hour_index, avg(y) AS historical_month_halfhour_mean, median(y) AS historical_month_halfhour_median FROM past GROUP BY 1, 2, 3, 4),
    p2 AS (SELECT region, origin_hh, month, day_of_week, half_hour_index, avg(y) AS historical_month_dow_halfhour_mean FROM past GROUP BY 1, 2, 3, 4, 5),
    p3 AS (SELECT region, origin_hh, month, avg(m) AS historical_month_daily_mean, avg(x) AS historical_month_peak_mean, stddev_samp(m) AS historical_month_variability FROM (
      SELECT region, origin_hh, month, local_date, avg(y) AS m, max(y) AS x FROM past WHERE y IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
    frame AS (SELECT past.*, previous_day_mean AS rolling_mean_24h_at_t_minus_48, p1.historical_month_halfhour_mean, p1.historical_month_halfhour_median, p2.historical_month_dow_halfhour_mean, p3.historical_month_daily_mean,
      p3.historical_month_peak_mean, p3.historical_month_variability FROM past LEFT JOIN p1 USING (region, origin_hh, month, half_hour_index) LEFT JOIN p2 USING (region, origin_hh, month, day_of_week, half_hour_index)
      LEFT JOIN p3 USING (region, origin_hh, month))"""
WHOLE = {"half_hour_index", "hour", "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "day_of_year", "is_weekend", "is_public_holiday", "is_day_before_holiday", "is_day_after_holiday", "time_index", "year"}


@query("M13_design_matrix", f"{FRAME_A} SELECT region, origin_hh, hh, y, {', '.join(FEATURES_A)} FROM frame WHERE y IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES_A)}",
       nums=" ".join(["y", *[c for c in FEATURES_A if c not in WHOLE]]), ints=" ".join(c for c in FEATURES_A if c in WHOLE))
def m13(spark, folder):
    """Complete training rows of all 39 features at three origins."""
    _, _, train, _ = _frames(spark, folder)
    return train.dropna()


def _fitted(spark, folder, kind, **settings):
    _, o, train, _ = _frames(spark, folder)
    predict, _ = fitted_model(kind, train, o, ["region"], FEATURES_A, 200, **settings)
    return predict(train.dropna(subset=[*FEATURES_A, "y"])).select("region", "origin_hh", "hh", "y", "prediction")


@query("M14_random_forest_fit")
def m14(spark, folder):
    """The quick forest on all 39 features, three origins grown together."""
    return _fitted(spark, folder, "forest", **trees.FOREST["quick"])


@query("M14b_one_split", f"""{FRAME_A}, k AS (SELECT region, origin_hh, y, unnest(['half_hour_index', 'day_of_week']) AS feature, unnest([half_hour_index, day_of_week]) AS x FROM frame WHERE y IS NOT NULL),
    c AS (SELECT region, origin_hh, feature, x, sum(count(*)) OVER w AS nl, sum(sum(y)) OVER w AS sl, sum(count(*)) OVER a AS n, sum(sum(y)) OVER a AS t FROM k GROUP BY 1, 2, 3, 4
      WINDOW w AS (PARTITION BY region, origin_hh, feature ORDER BY x), a AS (PARTITION BY region, origin_hh, feature)),
    g AS (SELECT *, pow(sl, 2) / nl + pow(t - sl, 2) / (n - nl) - pow(t, 2) / n AS gain FROM c WHERE nl >= 5 AND n - nl >= 5)
    SELECT region, origin_hh, feature, x AS threshold, n, nl AS n_left, sl / nl AS mean_left, (t - sl) / (n - nl) AS mean_right FROM g
    QUALIFY row_number() OVER (PARTITION BY region, origin_hh ORDER BY round(gain, 9) DESC, feature DESC, x) = 1""", nums="threshold mean_left mean_right", ints="n n_left")
def m14b(spark, folder):
    """A tree of one split without bootstrap, which SQL can search too."""
    _, o, train, _ = _frames(spark, folder)
    made, groups, _ = trees.fit_forest(train, ["region", "origin_hh"], ["half_hour_index", "day_of_week"], trees=1, depth=1, min_leaf=5, features_a_split=2, bootstrap=False, min_rows=5)
    group = ["region", "origin_hh"]
    top = made.where("level = 0").join(groups.select(*group, F.col("level").alias("base")), group)
    side = made.where("level = 1").groupBy(*group).agg(F.max(F.when(F.col("node") == 1, F.col("n"))).alias("n_left"), F.max(F.when(F.col("node") == 1, F.col("value"))).alias("l"),
                                                       F.max(F.when(F.col("node") == 2, F.col("value"))).alias("r"))
    return top.where("feature IS NOT NULL").join(side, group).select(*group, "feature", "threshold", F.col("n").cast("long").alias("n"), F.col("n_left").cast("long").alias("n_left"),
                                                                     (F.col("base") + F.col("l")).alias("mean_left"), (F.col("base") + F.col("r")).alias("mean_right"))


#: Rounds of the registered boosted fits; the quick setting has 300, see the README for their time.
ROUNDS = 10


@query("M15_boosted_trees_fit")
def m15(spark, folder):
    """Boosted trees of the quick depth and step on all 39 features, three origins together."""
    return _fitted(spark, folder, "boost", **(trees.BOOST["quick"] | {"rounds": ROUNDS}))


@query("M16_recursive_forecast")
def m16(spark, folder):
    """A linear model of all 39 features, recursive over a week, at three origins."""
    g, o, train, future = _frames(spark, folder)
    predict, _ = fitted_model("linear", train, o, ["region"], FEATURES_A, 200)
    medians = cut_lineage(models.training_medians(train, ["region", "origin_hh"], FEATURES_A), "medians")
    return models.recursive_forecast(g, future, medians, ["region"], FEATURES_A, predict, o).drop("status")


def _train_and_future(spark, folder):
    """One origin: the rows before it, and the slots after it."""
    g = v.grid_b(spark, folder)
    o = v.origin_one(g)
    hist = ft.civil_calendar(g).join(o.select("region", "origin_hh"), "region").where("hh < origin_hh").drop("origin_hh")
    return g, o, cut_lineage(ft.demand_features(hist), "features"), panel.horizon_rows(o).select("region", "hh")


LAGGED = """SELECT h.hh, h.y, b.y AS x1, sin(2 * pi() * h.half_hour_index / 48) AS x2 FROM (SELECT c.* FROM cal_b c JOIN origin_one_b o ON o.region = c.region WHERE c.hh < o.origin_hh) h LEFT JOIN grid_b b ON b.hh = h.hh - 48"""


@query("M16b_recursive_one_lag", f"""WITH l AS ({LAGGED}), f AS (SELECT regr_intercept(y, x1) AS a, regr_slope(y, x1) AS b FROM l), m AS (SELECT median(x1) AS med FROM l),
    h AS (SELECT *, unnest(range(origin_hh, end_hh + 1)) AS hh FROM origin_one_b), k AS (SELECT region, hh, (hh - origin_hh) // 48 + 1 AS k FROM h)
    SELECT k.region, k.hh, a * (1 - pow(b, k)) / (1 - b) + pow(b, k) * coalesce(g.y, med) AS forecast FROM k CROSS JOIN f CROSS JOIN m LEFT JOIN grid_b g ON g.hh = k.hh - 48 * k.k""", nums="forecast")
def m16b(spark, folder):
    """The same recursion with one lag, where a linear model has a closed form to check against."""
    g, o, train, future = _train_and_future(spark, folder)
    predict, _ = fitted_model("linear", train, o, ["region"], ["lag_48"], 20)
    out = models.recursive_forecast(train, future, models.training_medians(train, ["region"], ["lag_48"]), ["region"], ["lag_48"], predict, o)
    return out.select("region", "hh", "forecast")


@query("M17b_two_regressor_fit", f"""WITH l AS (SELECT * FROM ({LAGGED}) WHERE y IS NOT NULL AND x1 IS NOT NULL), s AS (SELECT covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(y, x1) AS s1y, covar_pop(y, x2) AS s2y,
      avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM l), b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
    SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 AS coefficient FROM b UNION ALL SELECT 'lag_48', b1 FROM b UNION ALL SELECT 'sin_half_hour', b2 FROM b""", nums="coefficient")
def m17b(spark, folder):
    _, _, train, _ = _train_and_future(spark, folder)
    return lsq.coefficient_rows(lsq.fit_all(train, ["region"], "y", ["lag_48", "sin_half_hour"]), []).select("term", "coefficient")


# The two weekly frequencies, in cycles a day, and the terms of the three daily models.
ARX_CYCLES = {"f1": 0.1428571, "f2": 0.2857143}
ARX_MODELS = {
    "simple": ["y_lag1", "x", "cos_f1", "sin_f1", "cos_f2", "sin_f2"],
    "complex": ["y_lag1", "y_lag2", "y_lag3", "x", "x_lag1", "x_lag2", "x_lag3", "cos_f1", "sin_f1", "cos_f2", "sin_f2"],
    "third": ["y_lag1", "x", "x_lag1", "x_lag2", "cos_f1", "cos_f2", "sin_f2"],
}
ARX_ORIGINS = (2190, 2555)                                           # days since 1990: two years and three years of history


def _arx_sql():
    """Normal equations of each model by Gauss-Jordan steps over lists, one recursion a model."""
    ctes = ["o AS (SELECT unnest([%s]) AS origin_day)" % ", ".join(map(str, ARX_ORIGINS)),
            "raw AS (SELECT region, date_diff('day', DATE '1990-01-01', CAST(date AS DATE)) AS d, demand AS y, temp AS x FROM demand_temp)",
            "z AS (SELECT a.region, a.d, a.y, a.x, " + ", ".join(f"l{k}.y AS y_lag{k}, l{k}.x AS x_lag{k}" for k in (1, 2, 3)) + ", "
            + ", ".join(f"{fn}(2 * pi() * {f} * a.d) AS {fn}_{n}" for n, f in ARX_CYCLES.items() for fn in ("cos", "sin")) + " FROM raw a "
            + " ".join(f"LEFT JOIN raw l{k} ON l{k}.region = a.region AND l{k}.d = a.d - {k}" for k in (1, 2, 3)) + ")"]
    parts = []
    for model, terms in ARX_MODELS.items():
        p = len(terms) + 1
        known = " AND ".join(f"{t} IS NOT NULL" for t in terms)
        c = [f"({t} - m_{t})" for t in terms] + ["(y - m_y)"]
        means = ", ".join(f"avg({t}) OVER g AS m_{t}" for t in [*terms, "y"])
        matrix = "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in c) + "]" for a in c[:-1]) + "]"
        ctes.append(f"rows_{model} AS (SELECT region, origin_day, y, {', '.join(terms)}, {means} FROM z, o WHERE d < origin_day AND {known} WINDOW g AS (PARTITION BY region, origin_day))")
        ctes.append(f"""solve_{model} AS (SELECT region, origin_day, count(*) AS n, {matrix} AS a, sum({c[-1]} * {c[-1]}) AS yy, [{', '.join(f'sum({x} * {c[-1]})' for x in c[:-1])}] AS b,
            [{', '.join(f'avg({t})' for t in terms)}] AS mx, avg(y) AS my, 1 AS k FROM rows_{model} GROUP BY region, origin_day HAVING count(*) > {p} UNION ALL
          SELECT region, origin_day, n, [CASE WHEN i = k THEN [v / a[k][k] FOR v IN a[k]] ELSE [a[i][j] - a[i][k] * a[k][j] / a[k][k] FOR j IN range(1, {p + 1})] END FOR i IN range(1, {p})], yy, b, mx, my, k + 1
          FROM solve_{model} WHERE k < {p})""")
        ctes.append(f"""done_{model} AS (SELECT region, origin_day, n, [r[{p}] FOR r IN a] AS s, (yy - list_sum([a[i][{p}] * b[i] FOR i IN range(1, {p})])) / n AS mse, yy, mx, my FROM solve_{model} WHERE k = {p})""")
        parts.append(f"""SELECT '{model}' AS model, region, origin_day, n, mse, 1 - mse * n / yy AS r2, n * (ln(2 * pi()) + ln(mse) + 1) + 2 * {p + 1} AS AIC, n * (ln(2 * pi()) + ln(mse) + 1) + ln(n) * {p + 1} AS BIC,
          unnest({['intercept', *terms]}) AS term, unnest([my - list_sum([s[i] * mx[i] FOR i IN range(1, {p})])] || s) AS coefficient FROM done_{model}""")
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


@query("M17_linear_arx", _arx_sql(), nums="mse r2 AIC BIC coefficient")
def m17(spark, folder):
    """Daily demand on its own lags, temperature, its lags and two weekly cycles: three models, every series and origin in one plan."""
    d = v.demand_temp(spark, folder).select("region", F.datediff("date", F.lit("1990-01-01").cast("date")).cast("long").alias("d"), F.col("demand").alias("y"), F.col("temp").alias("x"))
    rows = cut_lineage(lsq.cycles(lsq.lagged(d, ["region"], "d", {"y": [1, 2, 3], "x": [1, 2, 3]}), "d", ARX_CYCLES), "arx")
    origins = d.select("region").distinct().withColumn("origin_day", F.explode(F.array(*[F.lit(o).cast("long") for o in ARX_ORIGINS])))
    out = None
    for model, terms in ARX_MODELS.items():
        fits = lsq.fit_all(rows, ["region"], "y", terms, origins, pos="d", origin="origin_day")
        part = lsq.coefficient_rows(fits.withColumn("model", F.lit(model)), ["model", "region", "origin_day", "n", "mse", "r2", "AIC", "BIC"])
        out = part if out is None else out.unionByName(part)
    return out


TREND = """WITH d AS (SELECT temp_mean_c AS y, date_diff('day', DATE '1995-01-01', CAST(date AS DATE)) / 1000.0 - 1.25 AS t FROM daily_weather),
    p1 AS (SELECT y, t, t - (SELECT avg(t) FROM d) AS q1 FROM d), k1 AS (SELECT sum(t * q1 * q1) / sum(q1 * q1) AS a, sum(q1 * q1) / count(*) AS b FROM p1),
    p2 AS (SELECT y, t, q1, (t - a) * q1 - b AS q2 FROM p1, k1), k2 AS (SELECT sum(t * q2 * q2) / sum(q2 * q2) AS a, sum(q2 * q2) / sum(q1 * q1) AS b FROM p2),
    p3 AS (SELECT y, t, q1, q2, (t - a) * q2 - b * q1 AS q3 FROM p2, k2), k3 AS (SELECT sum(t * q3 * q3) / sum(q3 * q3) AS a, sum(q3 * q3) / sum(q2 * q2) AS b FROM p3),
    p4 AS (SELECT y, t, q1, q2, q3, (t - a) * q3 - b * q2 AS q4 FROM p3, k3),
    g AS (SELECT count(*) AS n, regr_syy(y, t) AS syy, pow(sum(y * q1), 2) / sum(q1 * q1) AS g1, pow(sum(y * q2), 2) / sum(q2 * q2) AS g2, pow(sum(y * q3), 2) / sum(q3 * q3) AS g3, pow(sum(y * q4), 2) / sum(q4 * q4) AS g4 FROM p4),
    r AS (SELECT n, unnest([1, 2, 3, 4]) AS degree, unnest([syy - g1, syy - g1 - g2, syy - g1 - g2 - g3, syy - g1 - g2 - g3 - g4]) AS rss FROM g)"""


@query("M18_trend_degree_by_aic", f"{TREND} SELECT degree, n, rss, n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * (degree + 2) AS AIC, n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * (degree + 2) AS BIC FROM r", nums="rss AIC BIC", ints="degree")
def m18(spark, folder):
    """Polynomial degree 1..4 by AIC, all fits from one aggregate of power sums."""
    from loadtide.operators.stats import gaussian_criteria, polynomial_rss
    d = v.daily_weather(spark, folder).select(F.col("temp_mean_c").alias("y"), (F.datediff(F.to_date("date"), F.lit("1995-01-01").cast("date")) / F.lit(1000.0) - 1.25).alias("t"))
    return polynomial_rss(d, "t", "y", 4).withColumns(gaussian_criteria(F.col("n"), F.col("rss"), F.col("degree") + 1)).orderBy("AIC")


@query("M20_exogenous_support", """SELECT region, hi0 - lo0 AS train_range, hi1 - lo1 AS horizon_range, sd AS train_sd, CASE WHEN sd <= 1e-8 THEN 'no training variation' WHEN hi1 - lo1 > 1.5 * greatest(hi0 - lo0, 1e-9) THEN 'horizon outruns training' ELSE 'keep' END AS verdict FROM (
    SELECT g.region, min(y) FILTER (g.hh < o.origin_hh) AS lo0, max(y) FILTER (g.hh < o.origin_hh) AS hi0, min(y) FILTER (g.hh >= o.origin_hh) AS lo1, max(y) FILTER (g.hh >= o.origin_hh) AS hi1, stddev_samp(y) FILTER (g.hh < o.origin_hh) AS sd
    FROM grid_a g JOIN origin_one o ON o.region = g.region GROUP BY g.region)""", nums="train_range horizon_range train_sd")
def m20(spark, folder):
    g = v.grid_a(spark, folder)
    r = g.join(v.origin_one(g), "region")
    past = F.when(F.col("hh") < F.col("origin_hh"), F.col("y"))
    ahead = F.when(F.col("hh") >= F.col("origin_hh"), F.col("y"))
    s = r.groupBy("region").agg((F.max(past) - F.min(past)).alias("train_range"), (F.max(ahead) - F.min(ahead)).alias("horizon_range"), F.stddev_samp(past).alias("train_sd"))
    # The three verdicts.
    return s.withColumn("verdict", F.when(F.col("train_sd") <= 1e-8, "no training variation")
                        .when(F.col("horizon_range") > 1.5 * F.greatest(F.col("train_range"), F.lit(1e-9)), "horizon outruns training").otherwise("keep"))


@query("M21_divergence_guard", """SELECT t.region, lo, hi, count(CASE WHEN forecast * 3 < lo OR forecast * 3 > hi THEN 1 END) AS outside, CASE WHEN min(forecast * 3) < lo OR max(forecast * 3) > hi THEN 'MODEL_FAILED' ELSE 'MODEL_READY' END AS status FROM (
    SELECT g.region, min(y) - 3 * stddev_samp(y) AS lo, max(y) + 3 * stddev_samp(y) AS hi FROM grid_a g JOIN origin_one o ON o.region = g.region WHERE g.hh < o.origin_hh GROUP BY g.region) t
    JOIN naive_one f ON f.region = t.region AND f.model = 'Naive336' GROUP BY 1, 2, 3""", nums="lo hi")
def m21(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_one(g)
    band = g.join(o, "region").where("hh < origin_hh").groupBy("region").agg((F.min("y") - 3 * F.stddev_samp("y")).alias("lo"), (F.max("y") + 3 * F.stddev_samp("y")).alias("hi"))
    f = forecast.seasonal_naive(g, o, 336).withColumn("forecast", F.col("forecast") * 3).join(band, "region")
    out = (F.col("forecast") < F.col("lo")) | (F.col("forecast") > F.col("hi"))
    return f.groupBy("region", "lo", "hi").agg(F.count_if(out).alias("outside"), F.when(F.count_if(out) > 0, "MODEL_FAILED").otherwise("MODEL_READY").alias("status"))


@query("M22_backtest_driver", "SELECT region, model, origin, matched_intervals, MAE, RMSE, sMAPE, Bias, MedAE, skill_vs_naive_pct FROM skilled", nums=MNUM + " skill_vs_naive_pct")
def m22(spark, folder):
    return v.skilled(v.grid_a(spark, folder)).select("region", "model", "origin", *METRICS, "skill_vs_naive_pct")


BACKTEST = """WITH t AS (SELECT o.region, o.origin_hh, g.y, b.y AS x FROM origin_many o JOIN grid_a g ON g.region = o.region AND g.hh < o.origin_hh LEFT JOIN grid_a b ON b.region = g.region AND b.hh = g.hh - 48),
    f AS (SELECT region, origin_hh, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, median(x) AS med FROM t GROUP BY 1, 2), h AS (SELECT *, unnest(range(origin_hh, end_hh + 1)) AS hh FROM origin_many),
    k AS (SELECT *, (hh - origin_hh) // 48 + 1 AS k FROM h), d AS (SELECT k.region, k.origin_hh, k.hh, 'Linear' AS model, a * (1 - pow(b, k)) / (1 - b) + pow(b, k) * coalesce(g.y, med) AS forecast
      FROM k JOIN f ON f.region = k.region AND f.origin_hh = k.origin_hh LEFT JOIN grid_a g ON g.region = k.region AND g.hh = k.hh - 48 * k.k UNION ALL SELECT region, origin_hh, hh, model, forecast FROM naive_many)
    SELECT d.region, d.model, d.origin_hh, count(*) AS asked, avg(abs(d.forecast - g.y)) AS MAE, sqrt(avg(pow(d.forecast - g.y, 2))) AS RMSE FROM d LEFT JOIN grid_a g ON g.region = d.region AND g.hh = d.hh GROUP BY 1, 2, 3"""


@query("M22b_model_backtest", BACKTEST, nums="MAE RMSE")
def m22b(spark, folder):
    """Naive and fitted models over all series and origins; with one lag the linear recursion has a closed form to check against."""
    g = v.grid_a(spark, folder)
    o = v.origin_many(g)
    known = panel.horizon_rows(o).select("region", "hh").distinct()
    detail, _ = backtest(g, ft.demand_features(g), known, o, ["region"], {"Linear": {"kind": "linear", "features": ["lag_48"]}}, min_rows=20)
    asked = detail.groupBy("region", "model", "origin_hh").agg(F.count(F.lit(1)).alias("asked"))
    return asked.join(backtest_scores(detail, ["region"]), ["region", "model", "origin_hh"], "left").select("region", "model", "origin_hh", "asked", "MAE", "RMSE")


@query("M22c_family_backtest")
def m22c(spark, folder):
    """Naive, linear, forest and boosted models of set A over three origins, scored from one written detail table; the chosen model is marked."""
    g, o, train, future = _frames(spark, folder)
    families = {"RandomForest_A": {"kind": "forest", "features": FEATURES_A, **trees.FOREST["quick"]},
                "XGBoost_A": {"kind": "boost", "features": FEATURES_A, **(trees.BOOST["quick"] | {"rounds": ROUNDS})},
                "SARIMAX": {"kind": "linear", "features": ["lag_48", "lag_336", "sin_half_hour", "cos_half_hour", "is_weekend"]}}
    detail, status = backtest(g, train, future, o, ["region"], families, min_rows=200)
    scored = backtest_scores(detail, ["region"]).join(status, ["region", "model", "origin_hh"]).withColumnRenamed("origin_hh", "origin")
    scored = cut_lineage(ev.with_skill(scored, ["Naive48", "Naive336"]), "scores")
    chosen = selection.choose(selection.aggregate_scores(scored)).select("region", F.col("selected_model").alias("model"), F.lit(1).alias("chosen"))
    return (scored.join(chosen, ["region", "model"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))
            .select("region", "model", "origin", "train_rows", "status", *METRICS, "MAE_first_7d", "skill_vs_naive_pct", "chosen"))


@query("M23_model_choice", """WITH s AS (SELECT region, model, origin, MAE FROM scores UNION ALL SELECT region, 'XGBoost_A', origin, MAE * 2.6 FROM scores WHERE model = 'Naive48' UNION ALL SELECT region, 'RandomForest_A', origin, MAE * 0.995 FROM scores WHERE model = 'Naive48'),
    a AS (SELECT region, model, avg(MAE) AS m, stddev_samp(MAE) AS sd, count(DISTINCT origin) AS origins FROM s GROUP BY 1, 2)
    SELECT region, model AS selected_model, m AS mean_backtest_MAE, sd AS mae_spread, origins FROM (SELECT *, min(m) OVER (PARTITION BY region) AS best FROM a) WHERE m <= best * 1.01
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY CASE WHEN model LIKE 'Naive%' THEN 0 ELSE 4 END, m, sd) = 1""", nums="mean_backtest_MAE mae_spread")
def m23(spark, folder):
    s = _more_models(v.skilled(v.grid_a(spark, folder)))
    return selection.choose(selection.aggregate_scores(s)).select("region", "selected_model", "mean_backtest_MAE", "mae_spread", "origins")


FAMILIES = {"MODEL_A": ["RandomForest_A", "XGBoost_A"], "MODEL_B": ["RandomForest_B", "XGBoost_B"]}


@query("M24_family_champions", """SELECT region, CASE WHEN model = 'RandomForest_A' THEN 'MODEL_A' ELSE 'MODEL_B' END AS family, model AS selected_model, avg(MAE) AS mean_backtest_MAE, median(MAE) AS median_backtest_MAE, 100.0 AS win_rate_pct FROM renamed GROUP BY 1, 2, 3""",
       nums="mean_backtest_MAE median_backtest_MAE win_rate_pct")
def m24(spark, folder):
    c = selection.family_champions(v.renamed(v.grid_a(spark, folder)), FAMILIES)
    return c.select("region", "family", "selected_model", "mean_backtest_MAE", "median_backtest_MAE", "win_rate_pct")


@query("M25_ab_evidence", """WITH o AS (SELECT region, origin_hh, family, avg(ae) AS m FROM ab_detail GROUP BY 1, 2, 3), w AS (SELECT a.region, count(CASE WHEN a.m < b.m THEN 1 END) AS aw, count(CASE WHEN b.m < a.m THEN 1 END) AS bw, count(*) AS n
      FROM o a JOIN o b ON a.region = b.region AND a.origin_hh = b.origin_hh AND b.family = 'MODEL_B' WHERE a.family = 'MODEL_A' GROUP BY a.region),
    f AS (SELECT region, avg(ae) FILTER (family = 'MODEL_A') AS model_A_MAE, avg(ae) FILTER (family = 'MODEL_B') AS model_B_MAE, sqrt(avg(err * err) FILTER (family = 'MODEL_A')) AS model_A_RMSE, sqrt(avg(err * err) FILTER (family = 'MODEL_B')) AS model_B_RMSE FROM ab_detail GROUP BY region)
    SELECT f.*, CASE WHEN model_A_MAE < model_B_MAE THEN 'MODEL_A' WHEN model_B_MAE < model_A_MAE THEN 'MODEL_B' ELSE 'TIE' END AS closer_to_actual, abs(model_A_MAE - model_B_MAE) AS MAE_gap_MW,
      100.0 * abs(model_A_MAE - model_B_MAE) / greatest(model_A_MAE, model_B_MAE) AS better_family_improvement_pct, aw AS model_A_origin_wins, bw AS model_B_origin_wins, n AS historical_origins_compared FROM f JOIN w ON w.region = f.region""",
       nums="model_A_MAE model_B_MAE model_A_RMSE model_B_RMSE MAE_gap_MW better_family_improvement_pct")
def m25(spark, folder):
    d = v.ab_detail(v.grid_a(spark, folder))
    m = ev.error_metrics(d, ["region", "family"])
    wide = m.groupBy("region").agg(*[F.max(F.when(F.col("family") == f"MODEL_{x}", F.col(c))).alias(f"model_{x}_{c}") for x in "AB" for c in ("MAE", "RMSE")])
    a, b = F.col("model_A_MAE"), F.col("model_B_MAE")
    wide = wide.withColumns({"closer_to_actual": F.when(a < b, "MODEL_A").when(b < a, "MODEL_B").otherwise("TIE"), "MAE_gap_MW": F.abs(a - b),
                             "better_family_improvement_pct": percent_of(F.abs(a - b), F.greatest(a, b))})
    wins = selection.wins_by(ev.error_metrics(d, ["region", "origin_hh", "family"]), ["region"], ["origin_hh"])
    return wide.join(wins.select("region", F.col("model_A_wins").alias("model_A_origin_wins"), F.col("model_B_wins").alias("model_B_origin_wins"),
                                 F.col("units").alias("historical_origins_compared")), "region")


@query("M26_current_month_ab_summary", """SELECT region, family, model, min(ts) AS verification_start, max(ts) AS verification_end, count(*) AS matched_intervals, avg(ae) AS MAE,
    CASE WHEN family = 'MODEL_B' THEN 100.0 * (min(CASE WHEN family = 'MODEL_A' THEN avg(ae) END) OVER (PARTITION BY region) - avg(ae)) / min(CASE WHEN family = 'MODEL_A' THEN avg(ae) END) OVER (PARTITION BY region) END AS weather_skill_vs_A_pct
    FROM ab_detail GROUP BY 1, 2, 3""", nums="MAE weather_skill_vs_A_pct")
def m26(spark, folder):
    from pyspark.sql import Window as W
    m = ev.error_metrics(v.ab_detail(v.grid_a(spark, folder)), ["region", "family", "model"], extra=[F.min("ts").alias("verification_start"), F.max("ts").alias("verification_end")])
    a = F.min(F.when(F.col("family") == "MODEL_A", F.col("MAE"))).over(W.partitionBy("region"))
    return m.select("region", "family", "model", "verification_start", "verification_end", "matched_intervals", "MAE",
                    F.when((F.col("family") == "MODEL_B") & (a > 0), 100.0 * (a - F.col("MAE")) / a).alias("weather_skill_vs_A_pct"))


@query("M27_forecast_frame", f"""SELECT region, origin_hh, hh, forecast, hh - origin_hh + 1 AS step, lag48_source, lag96_source, lag336_source, 'FROZEN' AS forecast_vintage, 'NOT_APPLICABLE' AS weather_policy FROM ({PROV})""", nums="forecast")
def m27(spark, folder):
    g = v.grid_a(spark, folder)
    f = forecast.forecast_frame(forecast.seasonal_naive(g, v.origin_many(g), 48), g, "FROZEN")
    return f.select("region", "origin_hh", "hh", "forecast", "step", "lag48_source", "lag96_source", "lag336_source", "forecast_vintage", "weather_policy")


@query("M28_frozen_live_revision", """SELECT a.region, a.hh, a.forecast AS frozen_forecast_MW, b.forecast AS current_forecast_MW, b.forecast - a.forecast AS revision_MW, abs(b.forecast - a.forecast) AS absolute_revision_MW,
    CASE WHEN abs(a.forecast) > 0 THEN 100.0 * (b.forecast - a.forecast) / a.forecast END AS revision_pct FROM naive_one a JOIN naive_one b ON a.region = b.region AND a.hh = b.hh AND b.model = 'Naive336'
    WHERE a.model = 'Naive48' AND a.forecast IS NOT NULL AND b.forecast IS NOT NULL""", nums="frozen_forecast_MW current_forecast_MW revision_MW absolute_revision_MW revision_pct")
def m28(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_one(g)
    return ev.revision_table(forecast.seasonal_naive(g, o, 48), forecast.seasonal_naive(g, o, 336))


@query("M29_rolling_segments", """SELECT region, CASE WHEN hh < origin_hh + 96 THEN 'MONTH_TO_DATE_MODEL_PREDICTION' WHEN hh < origin_hh + 432 THEN 'LIVE_FORECAST_7DAY' ELSE 'CLIMATOLOGY_BRIDGE' END AS segment_type, count(*) AS rows, avg(forecast) AS mean_forecast
    FROM naive_one WHERE model = 'Naive336' GROUP BY 1, 2""", nums="mean_forecast")
def m29(spark, folder):
    g = v.grid_a(spark, folder)
    f = forecast.seasonal_naive(g, v.origin_one(g), 336).withColumn("weather_feature_source", F.when(F.col("step") <= 432, "FORECAST_7DAY").otherwise("CLIMATOLOGY_FALLBACK"))
    s = forecast.rolling_segments(f, slot_start(F.col("origin_hh") + 96))
    return s.groupBy("region", "segment_type").agg(F.count(F.lit(1)).alias("rows"), F.avg("forecast").alias("mean_forecast"))


@query("M30_feature_importance")
def m30(spark, folder):
    """Share of each feature in the gain of the quick forest, per origin."""
    _, _, train, _ = _frames(spark, folder)
    made, _, _ = trees.fit_forest(train, ["region", "origin_hh"], FEATURES_A, min_rows=200, **trees.FOREST["quick"])
    return trees.importance(made, ["region", "origin_hh"], FEATURES_A)


@query("M31_benchmark_verified_accuracy", """SELECT o.region, CASE WHEN count(a.y) > 0 THEN 'VERIFIED' ELSE 'FORECAST_ONLY' END AS status, count(a.y) AS matched_intervals, avg(abs(f.forecast - a.y)) AS benchmark_MAE, avg(f.forecast - a.y) AS benchmark_Bias FROM origin_one o
    JOIN naive_one f ON f.region = o.region AND f.model = 'Naive336' LEFT JOIN grid_a a ON a.region = f.region AND a.hh = f.hh AND f.region <> 'error' AND f.forecast IS NOT NULL GROUP BY o.region""", nums="benchmark_MAE benchmark_Bias")
def m31(spark, folder):
    g = v.grid_a(spark, folder)
    f = forecast.seasonal_naive(g, v.origin_one(g), 336)
    m = ev.error_metrics(forecast.with_actual(f, g.where("region <> 'error'")), ["region"])
    out = f.select("region").distinct().join(m, "region", "left")
    n = F.coalesce("matched_intervals", F.lit(0))
    return out.select("region", F.when(n > 0, "VERIFIED").otherwise("FORECAST_ONLY").alias("status"), n.alias("matched_intervals"), F.col("MAE").alias("benchmark_MAE"), F.col("Bias").alias("benchmark_Bias"))


@query("M32_run_manifest", """SELECT f.region, f.model, f.origin_hh, count(*) AS horizon_intervals, count(*) - count(forecast) AS unfilled, CASE WHEN count(*) = count(forecast) THEN 'MODEL_READY' ELSE 'MODEL_READY_WITH_WARNING' END AS status, max(t.n) AS train_rows
    FROM naive_many f JOIN (SELECT o.region, o.origin_hh, count(g.y) AS n FROM origin_many o JOIN grid_a g ON g.region = o.region AND g.hh < o.origin_hh GROUP BY 1, 2) t ON t.region = f.region AND t.origin_hh = f.origin_hh GROUP BY 1, 2, 3""")
def m32(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_many(g)
    runs = forecast.naive_forecasts(g, o).groupBy("region", "model", "origin_hh").agg(F.count(F.lit(1)).alias("horizon_intervals"), F.count_if(F.col("forecast").isNull()).alias("unfilled"))
    train = maps.scaler(g.where("y IS NOT NULL").select("region", "hh", "y"), o, []).select("region", "origin_hh", F.col("fitted_rows").alias("train_rows"))
    return runs.join(train, ["region", "origin_hh"]).withColumn("status", F.when(F.col("unfilled") == 0, "MODEL_READY").otherwise("MODEL_READY_WITH_WARNING"))


@query("M33_independent_evidence", """SELECT count(*) AS compared, count(CASE WHEN a.MAE < b.MAE THEN 1 END) AS challenger_better, avg(100 * (a.MAE - b.MAE) / b.MAE) AS mean_change_pct FROM scores a JOIN scores b ON a.region = b.region AND a.origin = b.origin AND b.model = 'Naive336' WHERE a.model = 'Naive48'""", nums="mean_change_pct")
def m33(spark, folder):
    s = v.scores(v.grid_a(spark, folder))
    pair = s.groupBy("region", "origin").agg(F.max(F.when(F.col("model") == "Naive48", F.col("MAE"))).alias("a"), F.max(F.when(F.col("model") == "Naive336", F.col("MAE"))).alias("b")).dropna()
    return pair.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("a") < F.col("b")).alias("challenger_better"), F.avg(100 * (F.col("a") - F.col("b")) / F.col("b")).alias("mean_change_pct"))


@query("M34_block_provenance", """SELECT b.region, b.origin_hh, b.block_start, greatest(b.block_start - greatest(b.block_start - 336, b.origin_hh), 0) AS predicted_steps, 336 - greatest(b.block_start - greatest(b.block_start - 336, b.origin_hh), 0) AS actual_steps,
    count(CASE WHEN g.hh < b.origin_hh AND g.y IS NULL THEN 1 END) AS gap_filled_steps FROM (SELECT *, unnest(range(origin_hh, end_hh + 1, 48)) AS block_start FROM origin_many) b
    LEFT JOIN grid_a g ON g.region = b.region AND g.hh BETWEEN b.block_start - 336 AND b.block_start - 1 GROUP BY 1, 2, 3""")
def m34(spark, folder):
    g = v.grid_a(spark, folder)
    return panel.block_provenance(v.origin_many(g), g, 336).select("region", "origin_hh", "block_start", "predicted_steps", "actual_steps", "gap_filled_steps")


@query("UDF1_registered_forecaster", """SELECT o.region, o.origin_hh, o.hh, c.m AS forecast, 'MeanOfLastDays' AS model FROM (SELECT *, unnest(range(origin_hh, end_hh + 1)) AS hh FROM origin_many) o LEFT JOIN (
    SELECT o.region, o.origin_hh, g.hh % 48 AS k, avg(g.y) AS m FROM origin_many o JOIN grid_a g ON g.region = o.region AND g.hh >= o.origin_hh - 336 AND g.hh < o.origin_hh GROUP BY 1, 2, 3) c
    ON c.region = o.region AND c.origin_hh = o.origin_hh AND c.k = o.hh % 48""", nums="forecast")
def udf1(spark, folder):
    g = v.grid_a(spark, folder)
    return custom.run_forecaster(g, v.origin_many(g), custom.clock_mean(), 336, "MeanOfLastDays")


# --- streaming -------------------------------------------------------------------------------------

def _stream(spark, folder):
    return live.file_stream(spark, folder, "events.parquet").select(F.col("event_type").alias("region"), "ts", F.col("value").alias("y"), F.col("event_id").alias("seq"))


@query("ST1_streaming_half_hour_mean", """SELECT region, make_timestamp(hh * 1800000000) AS ts, y, n AS n_source_readings FROM bins_a WHERE (hh + 1) * 1800000000 <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 - 3600000000 FROM readings)""", nums="y")
def st1(spark, folder):
    return live.run_available(live.stream_half_hour_mean(_stream(spark, folder)), "half-hour")


@query("ST2_streaming_dedupe", "SELECT DISTINCT region, ts FROM minutely")
def st2(spark, folder):
    s = _stream(spark, folder).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return live.run_available(live.stream_dedupe(s), "dedupe").select("region", "ts")


@query("ST2b_streaming_keep_last", """SELECT region, ts, y, seq FROM minutely_last WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) - 3600000000 FROM minutely)""", nums="y")
def st2b(spark, folder):
    s = _stream(spark, folder).select("region", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "y", "seq")
    return live.run_available(live.stream_keep_last(s), "keep-last")


@query("ST3_streaming_forecast_error", """SELECT r.region, date_trunc('day', r.ts) AS day, count(*) AS readings, avg(abs(f.forecast - r.y)) AS MAE, avg(f.forecast - r.y) AS Bias FROM readings r JOIN naive_one f ON f.model = 'Naive336' AND f.region = r.region
    AND f.hh = epoch_us(r.ts) // 1800000000 AND f.forecast IS NOT NULL WHERE date_trunc('day', r.ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM readings) GROUP BY 1, 2""", nums="MAE Bias")
def st3(spark, folder):
    g = v.grid_a(spark, folder)
    frozen = forecast.seasonal_naive(g, v.origin_one(g), 336).select("region", "hh", "forecast")
    return live.run_available(live.stream_forecast_error(_stream(spark, folder), frozen), "forecast-error")


