"""Cleaning, regularisation and joins."""
from pyspark.sql import functions as F

from loadtide.catalog import views as v
from loadtide.catalog.registry import query
from loadtide.config import CIVIL_ZONE, LABEL, MARKET_ZONE
from loadtide.functions.clock import floor_div, lookup, resolve_clocks, slot_by_label
from loadtide.operators import clean, features as ft, regular

from loadtide.plans.forecast import latest_vintage, naive_forecasts, seasonal_naive, with_actual
from loadtide.plans.panel import build_panel
from loadtide.sources import weather as wx

# Shared text of the checks below: minute readings with their step to the previous one.
STEPS = """SELECT region, ts, y, date_trunc('month', ts)::TIMESTAMP AS month, lag(ts) OVER w AS prev_ts,
    date_diff('microsecond', lag(ts) OVER w, ts) / 60000000.0 AS step FROM minutely_last WINDOW w AS (PARTITION BY region ORDER BY ts)"""
MODES = f"""SELECT region, month, step AS res FROM (SELECT region, month, step, count(*) AS n FROM ({STEPS}) WHERE step IS NOT NULL GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY region, month ORDER BY n DESC, step) = 1"""
# Runs of equal null-state on the gappy grid.
RUNS = """SELECT *, count(*) OVER (PARTITION BY region, grp) AS run_len, row_number() OVER (PARTITION BY region, grp ORDER BY hh) AS k FROM (
    SELECT *, sum(turn) OVER (PARTITION BY region ORDER BY hh) AS grp FROM (
      SELECT region, hh, y, y IS NULL AS gone, CASE WHEN (y IS NULL) IS DISTINCT FROM (lag(y) OVER (PARTITION BY region ORDER BY hh) IS NULL)
        OR lag(hh) OVER (PARTITION BY region ORDER BY hh) IS NULL THEN 1 ELSE 0 END AS turn,
        last_value(y IGNORE NULLS) OVER (PARTITION BY region ORDER BY hh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        first_value(y IGNORE NULLS) OVER (PARTITION BY region ORDER BY hh ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM grid_a))"""


@query("C01_duplicate_report", """SELECT region, count(*) AS rows, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_timestamps
    FROM (SELECT region, count(*) OVER (PARTITION BY region, ts) AS n FROM minutely) GROUP BY region""")
def c01(spark, folder):
    return clean.duplicate_report(v.minute(spark, folder))


@query("C02_dedupe_keep_last", "SELECT region, ts, y, seq FROM minutely_last", nums="y")
def c02(spark, folder):
    return clean.dedupe_last(v.minute(spark, folder))


@query("C03_dedupe_keep_first", """SELECT region, ts, y, seq FROM minutely QUALIFY row_number() OVER (PARTITION BY region, ts ORDER BY seq) = 1""", nums="y")
def c03(spark, folder):
    return clean.dedupe_first(v.minute(spark, folder))


@query("C04_native_resolution", f"SELECT region, month, res AS resolution_minutes FROM ({MODES})", nums="resolution_minutes")
def c04(spark, folder):
    return clean.native_resolution(clean.with_steps(v.minute_last(spark, folder)))


@query("C05_completeness", f"""SELECT region, rows, missing_intervals, 100.0 * rows / (rows + missing_intervals) AS completeness_pct FROM (
    SELECT s.region, count(*) AS rows, CAST(sum(CASE WHEN n.res IS NOT NULL AND o.res IS NOT NULL AND s.step IS NOT NULL THEN
      least(greatest(round_even(s.step / n.res, 0) - 1, 0), greatest(round_even(s.step / o.res, 0) - 1, 0)) ELSE 0 END) AS BIGINT) AS missing_intervals
    FROM ({STEPS}) s LEFT JOIN ({MODES}) n ON s.region = n.region AND s.month = n.month
    LEFT JOIN ({MODES}) o ON s.region = o.region AND date_trunc('month', s.prev_ts)::TIMESTAMP = o.month GROUP BY s.region)""", nums="completeness_pct")
def c05(spark, folder):
    return clean.completeness(v.minute_last(spark, folder)).drop("resolution_regimes_min")


@query("C06_densify_months", f"""SELECT g.region, g.ts, m.y FROM (
    SELECT s.region, unnest(generate_series(s.lo, s.hi, to_minutes(CAST(m.res AS BIGINT)))) AS ts FROM (
      SELECT region, date_trunc('month', ts)::TIMESTAMP AS month, min(ts) AS lo, max(ts) AS hi FROM minutely_last GROUP BY 1, 2) s
    JOIN ({MODES}) m ON s.region = m.region AND s.month = m.month) g LEFT JOIN minutely_last m ON g.region = m.region AND g.ts = m.ts""", nums="y")
def c06(spark, folder):
    return clean.densify_months(v.minute_last(spark, folder)).drop("resolution_minutes")


@query("C07_null_run_lengths", f"SELECT region, min(hh) AS run_start, count(*) AS run_length FROM ({RUNS}) WHERE gone GROUP BY region, grp")
def c07(spark, folder):
    return clean.null_runs(v.grid_a(spark, folder), pos="hh")


@query("C08_fill_short_gaps", f"""SELECT region, hh, CASE WHEN gone AND run_len <= 2 THEN coalesce(before + (after - before) * k / (run_len + 1), before) ELSE y END AS y,
    CAST(gone AND run_len <= 2 AS INT) AS is_imputed FROM ({RUNS})""", nums="y", ints="is_imputed")
def c08(spark, folder):
    return clean.fill_short_gaps(v.grid_a(spark, folder), pos="hh").select("region", "hh", "y", "is_imputed")


@query("C09_invalid_flag", """SELECT region, hh, CASE WHEN y <= 12 THEN 1 ELSE 0 END AS is_invalid FROM grid_a""", ints="is_invalid")
def c09(spark, folder):
    return v.grid_a(spark, folder).select("region", "hh", clean.flag_invalid("y", 12.0).alias("is_invalid"))


BOUNDS = """SELECT region, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, median(y) AS med FROM grid_a WHERE y > 2 GROUP BY region"""
MADS = f"SELECT g.region, median(abs(g.y - b.med)) AS mad FROM grid_a g JOIN ({BOUNDS}) b ON g.region = b.region WHERE g.y > 2 GROUP BY g.region"
FLAGGED = f"""SELECT g.region, g.hh, g.y, CASE WHEN g.y <= 2 THEN 1 ELSE 0 END AS is_invalid,
    CASE WHEN g.y > 2 AND (g.y < q1 - 0.8 * (q3 - q1) OR g.y > q3 + 0.8 * (q3 - q1)) THEN 1 ELSE 0 END AS is_stat_outlier,
    (g.y - med) / (1.4826 * mad) AS robust_z FROM grid_a g JOIN ({BOUNDS}) b ON g.region = b.region JOIN ({MADS}) m ON m.region = g.region"""


def _flagged(spark, folder):
    return clean.flag_outliers(v.grid_a(spark, folder), pos="hh", k=0.8, threshold=2.0)


@query("C10_iqr_outliers", f"SELECT region, hh, is_stat_outlier FROM ({FLAGGED})", ints="is_stat_outlier")
def c10(spark, folder):
    return _flagged(spark, folder).select("region", "hh", "is_stat_outlier")


@query("C11_robust_z", f"SELECT region, hh, robust_z FROM ({FLAGGED})", nums="robust_z")
def c11(spark, folder):
    return _flagged(spark, folder).select("region", "hh", "robust_z")


@query("C12_outlier_type", f"""SELECT region, hh, CASE WHEN NOT f THEN '' WHEN is_invalid = 1 THEN 'invalid_impossible'
    WHEN NOT coalesce(lag(f) OVER w, false) AND NOT coalesce(lead(f) OVER w, false) THEN 'isolated_extreme' ELSE 'sustained_extreme_event' END AS outlier_type
    FROM (SELECT *, is_stat_outlier = 1 OR is_invalid = 1 AS f FROM ({FLAGGED})) WINDOW w AS (PARTITION BY region ORDER BY hh)""")
def c12(spark, folder):
    return _flagged(spark, folder).select("region", "hh", "outlier_type")


@query("C13_resample_mean_by_label", """SELECT region, make_timestamp(hh * 1800000000) AS ts, avg(y) AS y, max(flag) AS is_invalid, count(*) AS n_source_readings FROM (
    SELECT region, y, CASE WHEN y <= 12 THEN 1 ELSE 0 END AS flag,
      CASE WHEN region = 'purchase' THEN epoch_us(ts) // 1800000000 ELSE (epoch_us(ts) + 1799999999) // 1800000000 END AS hh FROM readings) GROUP BY region, hh""",
       nums="y", ints="is_invalid")
def c13(spark, folder):
    label = lookup(lookup("region", v.MARKET_OF), LABEL)
    r = v.readings(spark, folder).withColumn("is_invalid", clean.flag_invalid("y", 12.0))
    return regular.resample_mean(r, flags=["is_invalid"], bins=slot_by_label("ts", label)).drop("hh")


@query("C14_continuous_grid", "SELECT region, ts, y, n AS n_source_readings FROM grid_a", nums="y")
def c14(spark, folder):
    return v.grid_a(spark, folder).drop("hh")


@query("C15_market_to_civil_clock", """SELECT region, hh, ((ts AT TIME ZONE mz) AT TIME ZONE cz) AS local_timestamp, date_trunc('day', (ts AT TIME ZONE mz) AT TIME ZONE cz) AS local_date FROM (
    SELECT region, hh, ts, CASE WHEN region = 'purchase' THEN 'Etc/GMT-8' ELSE 'Etc/GMT-10' END AS mz,
      CASE region WHEN 'click' THEN 'Australia/Sydney' WHEN 'view' THEN 'Australia/Brisbane' WHEN 'signup' THEN 'Australia/Adelaide'
        WHEN 'error' THEN 'Australia/Hobart' ELSE 'Australia/Perth' END AS cz FROM grid_a)""")
def c15(spark, folder):
    market = lookup("region", v.MARKET_OF)
    g = resolve_clocks(v.grid_a(spark, folder), lookup(market, MARKET_ZONE), lookup(market, CIVIL_ZONE))
    return g.select("region", "hh", "local_timestamp", "local_date")


# Hourly means of each type, then half-hours between them.
HOURS = """SELECT region, (epoch_us(ts) // 3600000000) * 2 AS hh, avg(y) AS t FROM readings GROUP BY 1, 2"""
BRACKET = f"""SELECT *, hh - h1 AS k FROM (SELECT g.region, g.hh, h.t,
      last_value(h.t IGNORE NULLS) OVER wp AS v1, last_value(CASE WHEN h.t IS NOT NULL THEN g.hh END IGNORE NULLS) OVER wp AS h1,
      first_value(h.t IGNORE NULLS) OVER wn AS v2, first_value(CASE WHEN h.t IS NOT NULL THEN g.hh END IGNORE NULLS) OVER wn AS h2
    FROM (SELECT region, unnest(range(min(hh), max(hh) + 1 + %s)) AS hh FROM ({HOURS}) GROUP BY region) g LEFT JOIN ({HOURS}) h ON g.region = h.region AND g.hh = h.hh
    WINDOW wp AS (PARTITION BY g.region ORDER BY g.hh ROWS UNBOUNDED PRECEDING), wn AS (PARTITION BY g.region ORDER BY g.hh ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
LINE = "CASE WHEN t IS NOT NULL THEN t WHEN k <= 2 THEN coalesce(v1 + (v2 - v1) * (hh - h1) / (h2 - h1), v1) END"


def _hourly(spark, folder):
    r = v.readings(spark, folder).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return r.groupBy("region", "ts").agg(F.avg("y").alias("temp_c"))


@query("C16_hourly_to_half_hour", f"SELECT region, hh, {LINE} AS temp_c FROM ({BRACKET % 0})", nums="temp_c")
def c16(spark, folder):
    return wx.half_hourly(_hourly(spark, folder), columns=["temp_c"]).drop("ts")


@query("C17_forecast_to_half_hour", f"""SELECT region, hh, coalesce(x, lag(x) OVER (PARTITION BY region ORDER BY hh)) AS temp_c,
    datediff('day', o, make_timestamp(hh * 1800000000)) AS weather_lead_day FROM (SELECT region, hh, {LINE} AS x FROM ({BRACKET % 1})),
    (SELECT date_trunc('day', min(ts)) - INTERVAL 1 DAY AS o FROM readings)""", nums="temp_c")
def c17(spark, folder):
    h = _hourly(spark, folder)
    first = h.agg(F.min("ts").alias("t")).first()["t"]          # one value: when this vintage was issued
    h = h.withColumn("forecast_origin_date", F.date_sub(F.to_date(F.lit(first).cast("timestamp_ntz")), 1))
    return wx.forecast_half_hourly(h, columns=["temp_c"]).select("region", "hh", "temp_c", "weather_lead_day")


@query("C18_actual_forecast_split", """SELECT region, kind, hh, y, row_number() OVER (PARTITION BY region, kind ORDER BY hh) AS forecast_horizon_step,
    30 * (hh - min(hh) OVER (PARTITION BY region, kind)) AS forecast_horizon_minutes FROM (
      SELECT region, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'ACTUAL' ELSE 'FORECAST' END AS kind, (epoch_us(ts) + 1799999999) // 1800000000 AS hh, avg(y) AS y
      FROM readings GROUP BY 1, 2, 3)""", nums="y")
def c18(spark, folder):
    from loadtide.operators.ordered import with_row_number
    r = v.readings(spark, folder).withColumn("kind", F.upper(F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), "Actual").otherwise("Forecast")))
    half = regular.resample_mean(r, keys=["region", "kind"], closed="right")
    first = half.groupBy("region", "kind").agg(F.min("hh").alias("h0"))
    n = with_row_number(half, ["region", "kind"], [F.col("hh")], floor_div("hh", 48 * 366), "k")
    return n.join(first, ["region", "kind"]).select("region", "kind", "hh", "y", (F.col("k") + 1).alias("forecast_horizon_step"),
                                                    (30 * (F.col("hh") - F.col("h0"))).alias("forecast_horizon_minutes"))


@query("C19_recent_model_series", """SELECT region, hh, CASE WHEN y IS NOT NULL THEN y ELSE coalesce(v1 + (v2 - v1) * (hh - h1) / (h2 - h1), v1, v2) END AS y FROM (
    SELECT g.region, g.hh, g.y, last_value(g.y IGNORE NULLS) OVER wp AS v1, last_value(CASE WHEN g.y IS NOT NULL THEN g.hh END IGNORE NULLS) OVER wp AS h1,
      first_value(g.y IGNORE NULLS) OVER wn AS v2, first_value(CASE WHEN g.y IS NOT NULL THEN g.hh END IGNORE NULLS) OVER wn AS h2
    FROM grid_a g JOIN (SELECT region, min(hh) AS lo, max(hh) AS hi FROM (SELECT region, hh FROM grid_a WHERE y IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY region ORDER BY hh DESC) <= 500) GROUP BY region) t ON t.region = g.region AND g.hh BETWEEN t.lo AND t.hi
    WINDOW wp AS (PARTITION BY g.region ORDER BY g.hh ROWS UNBOUNDED PRECEDING), wn AS (PARTITION BY g.region ORDER BY g.hh ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
       nums="y")
def c19(spark, folder):
    return regular.recent_model_series(v.grid_a(spark, folder), last_n=500).drop("ts")


# --- joins -----------------------------------------------------------------------------------------

@query("J01_holiday_join", """SELECT c.region, c.hh, CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_public_holiday, coalesce(h.holiday_name, '') AS holiday_name
    FROM cal_a c LEFT JOIN holidays h ON h.date = c.local_date""", ints="is_public_holiday")
def j01(spark, folder):
    f = ft.holiday_features(v.cal_a(spark, folder), v.holidays(spark, folder))
    return f.select("region", "hh", "is_public_holiday", "holiday_name")


@query("J02_holiday_neighbours", """SELECT region, hh, CAST(local_date + INTERVAL 1 DAY IN (SELECT date FROM holidays) AS INT) AS is_day_before_holiday,
    CAST(local_date - INTERVAL 1 DAY IN (SELECT date FROM holidays) AS INT) AS is_day_after_holiday FROM cal_a""", ints="is_day_before_holiday is_day_after_holiday")
def j02(spark, folder):
    f = ft.holiday_features(v.cal_a(spark, folder), v.holidays(spark, folder))
    return f.select("region", "hh", "is_day_before_holiday", "is_day_after_holiday")


@query("J03_daily_weather_join", """SELECT d.region, d.date, w.temp_max_c, w.temp_mean_c, w.rainfall_mm FROM daily_demand d LEFT JOIN daily_weather w ON w.date = d.date""",
       nums="temp_max_c temp_mean_c rainfall_mm")
def j03(spark, folder):
    d, w = v.daily_demand(spark, folder), v.daily_weather(spark, folder)
    return d.select("region", "date").join(w.drop("temp_min_c"), "date", "left")


@query("J04_half_hour_weather_join", f"""SELECT g.region, g.hh, g.y, w.temp_c FROM grid_a g LEFT JOIN (SELECT region, hh, {LINE} AS temp_c FROM ({BRACKET % 0})) w
    ON w.region = g.region AND w.hh = g.hh""", nums="y temp_c")
def j04(spark, folder):
    w = wx.half_hourly(_hourly(spark, folder), columns=["temp_c"]).drop("ts")
    return v.grid_a(spark, folder).select("region", "hh", "y").join(w, ["region", "hh"], "left")


HIST = "SELECT c.* FROM cal_a c JOIN origin_one o ON c.region = o.region WHERE c.hh < o.origin_hh AND c.y IS NOT NULL"


@query("J05_profile_lookup", f"""SELECT c.region, c.hh, p.m AS historical_month_halfhour_mean, p.md AS historical_month_halfhour_median, q.m AS historical_month_dow_halfhour_mean,
      d.dm AS historical_month_daily_mean, d.pk AS historical_month_peak_mean, d.sd AS historical_month_variability
    FROM cal_a c LEFT JOIN (SELECT region, month, half_hour_index, avg(y) AS m, median(y) AS md FROM ({HIST}) GROUP BY 1, 2, 3) p
      ON p.region = c.region AND p.month = c.month AND p.half_hour_index = c.half_hour_index
    LEFT JOIN (SELECT region, month, day_of_week, half_hour_index, avg(y) AS m FROM ({HIST}) GROUP BY 1, 2, 3, 4) q
      ON q.region = c.region AND q.month = c.month AND q.day_of_week = c.day_of_week AND q.half_hour_index = c.half_hour_index
    LEFT JOIN (SELECT region, month, avg(m) AS dm, avg(x) AS pk, stddev_samp(m) AS sd FROM (
      SELECT region, month, local_date, avg(y) AS m, max(y) AS x FROM ({HIST}) GROUP BY 1, 2, 3) GROUP BY 1, 2) d ON d.region = c.region AND d.month = c.month""",
       nums="historical_month_halfhour_mean historical_month_halfhour_median historical_month_dow_halfhour_mean historical_month_daily_mean historical_month_peak_mean historical_month_variability")
def j05(spark, folder):
    c = v.cal_a(spark, folder)
    hist = c.join(v.origin_one(c), "region").where("hh < origin_hh")
    from loadtide.config import PROFILE
    return ft.attach_profiles(c, hist).select("region", "hh", *PROFILE)


@query("J06_densify_to_horizon", """SELECT p.region, p.hh, p.hh >= p.origin_hh AS is_horizon, CASE WHEN p.hh < p.origin_hh THEN g.y END AS y, g.y AS actual FROM (
    SELECT o.region, o.origin_hh, unnest(range(s.lo, o.end_hh + 97)) AS hh FROM origin_one o JOIN (SELECT region, min(hh) AS lo FROM grid_a GROUP BY region) s ON s.region = o.region) p
    LEFT JOIN grid_a g ON g.region = p.region AND g.hh = p.hh""", nums="y actual", ints="is_horizon")
def j06(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_one(g).withColumn("end_hh", F.col("end_hh") + 96)
    return build_panel(g, o).select("region", "hh", "is_horizon", "y", "actual")


@query("J07_forecast_actual_match", """SELECT f.region, f.model, f.hh, f.forecast, g.y AS actual FROM naive_one f JOIN grid_a g ON g.region = f.region AND g.hh = f.hh
    WHERE f.forecast IS NOT NULL AND g.y IS NOT NULL""", nums="forecast actual")
def j07(spark, folder):
    g = v.grid_a(spark, folder)
    s = with_actual(naive_forecasts(g, v.origin_one(g)), g)
    return s.where("forecast is not null and actual is not null").select("region", "model", "hh", "forecast", "actual")


@query("J08_benchmark_actual_match", """SELECT a.region, a.hh, a.y AS benchmark, b.y AS own, a.y - b.y AS source_difference FROM bins_a a JOIN bins_b b ON a.hh = b.hh""",
       nums="benchmark own source_difference")
def j08(spark, folder):
    a = v.resample_mean(v.readings(spark, folder)).select("region", "hh", F.col("y").alias("benchmark"))
    b = v.resample_mean(v.readings(spark, folder).withColumn("region", v.one_series("ts"))).select("hh", F.col("y").alias("own"))
    return a.join(b, "hh").withColumn("source_difference", F.col("benchmark") - F.col("own"))


@query("J09_own_benchmark_forecast_match", """SELECT a.region, a.hh, a.forecast AS own, b.forecast AS benchmark, a.forecast - b.forecast AS margin FROM naive_one a
    JOIN naive_one b ON a.region = b.region AND a.hh = b.hh AND b.model = 'Naive336' WHERE a.model = 'Naive48' AND a.forecast IS NOT NULL""", nums="own benchmark margin")
def j09(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_one(g)
    a = seasonal_naive(g, o, 48).where("forecast is not null").select("region", "hh", F.col("forecast").alias("own"))
    b = seasonal_naive(g, o, 336).select("region", "hh", F.col("forecast").alias("benchmark"))
    return a.join(b, ["region", "hh"]).withColumn("margin", F.col("own") - F.col("benchmark"))


@query("J10_two_vintages", """SELECT a.region, a.hh, a.forecast AS frozen, b.forecast AS live FROM naive_many a JOIN naive_many b
    ON a.region = b.region AND a.hh = b.hh AND a.model = b.model AND b.origin_hh = a.origin_hh + 144 WHERE a.model = 'Naive48'""", nums="frozen live")
def j10(spark, folder):
    g = v.grid_a(spark, folder)
    f = seasonal_naive(g, v.origin_many(g), 48)
    old = f.select("region", "hh", (F.col("origin_hh") + 144).alias("origin_hh"), F.col("forecast").alias("frozen"))
    return old.join(f.select("region", "hh", "origin_hh", F.col("forecast").alias("live")), ["region", "hh", "origin_hh"]).drop("origin_hh")


@query("J11_demand_temperature_join", "SELECT region, date, demand, temp FROM demand_temp", nums="demand temp")
def j11(spark, folder):
    return v.demand_temp(spark, folder).select("region", "date", "demand", "temp")


@query("J12_latest_vintage_before_origin", """SELECT region, hh, origin_hh AS issued_hh, forecast FROM (SELECT f.*, o.o1 FROM naive_many f
    JOIN (SELECT region, min(origin_hh) + 200 AS o1 FROM origin_many GROUP BY region) o ON o.region = f.region WHERE model = 'Naive48' AND origin_hh <= o1)
    QUALIFY row_number() OVER (PARTITION BY region, hh ORDER BY origin_hh DESC) = 1""", nums="forecast")
def j12(spark, folder):
    g = v.grid_a(spark, folder)
    o = v.origin_many(g)
    info = o.groupBy("region").agg((F.min("origin_hh") + 200).alias("info_hh"))
    f = seasonal_naive(g, o, 48).join(info, "region").select("region", "hh", F.col("origin_hh").alias("issued_hh"), "info_hh", "forecast")
    return latest_vintage(f, ["region", "hh"], "issued_hh", F.col("info_hh")).drop("info_hh")


@query("J13_candidate_bases", """SELECT region, base, count(*) AS n, abs(corr(demand, abs(temp - base))) AS corr FROM demand_temp,
    (SELECT unnest([10.0, 12.0, 14.0, 16.0, 18.0, 20.0, 22.0, 24.0, 26.0]) AS base) GROUP BY 1, 2""", nums="base corr")
def j13(spark, folder):
    from loadtide.functions.numeric import safe_corr
    d = v.demand_temp(spark, folder).withColumn("base", F.explode(F.array(*[F.lit(float(b)) for b in range(10, 28, 2)])))
    return d.groupBy("region", "base").agg(F.count(F.lit(1)).alias("n"), F.abs(safe_corr("demand", F.abs(F.col("temp") - F.col("base")))).alias("corr"))


@query("J14_exact_or_monthly_key", """SELECT t.date, coalesce(e.m, c.m) AS climatology FROM (SELECT DISTINCT o_orderdate AS date FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') t
    LEFT JOIN (SELECT month(date) AS mo, day(date) AS d, avg(temp_mean_c) AS m FROM daily_weather WHERE date < TIMESTAMP '1996-06-01' GROUP BY 1, 2) e ON e.mo = month(t.date) AND e.d = day(t.date)
    LEFT JOIN (SELECT month(date) AS mo, avg(temp_mean_c) AS m FROM daily_weather WHERE date < TIMESTAMP '1996-06-01' GROUP BY 1) c ON c.mo = month(t.date)""", nums="climatology")
def j14(spark, folder):
    def keyed(df):
        return df.withColumns({"month": F.month("date"), "day_of_month": F.dayofmonth("date")})
    w = keyed(v.daily_weather(spark, folder)).where("date < timestamp_ntz'1996-06-01'")
    t = v.table(spark, folder, "orders").select(F.col("o_orderdate").alias("date")).where("date >= timestamp_ntz'2000-01-01'").distinct()
    return ft.exact_or_monthly(keyed(t), w, "temp_mean_c", keys=[], name="climatology").select("date", "climatology")


@query("J15_recomputed_vs_published", """SELECT region, origin, model, abs(round(MAE, 4) - MAE) AS MAE_abs_diff, abs(round(Bias, 4) - Bias) AS Bias_abs_diff FROM scores""",
       nums="MAE_abs_diff Bias_abs_diff")
def j15(spark, folder):
    s = v.scores(v.grid_a(spark, folder))
    pub = s.select("region", "origin", "model", F.round("MAE", 4).alias("MAE_p"), F.round("Bias", 4).alias("Bias_p"))
    j = s.join(pub, ["region", "origin", "model"])
    return j.select("region", "origin", "model", *[F.abs(F.col(c) - F.col(f"{c}_p")).alias(f"{c}_abs_diff") for c in ("MAE", "Bias")])


@query("J16_readiness_coverage_join", """SELECT r.region, r.rows, c.rows AS rows_coverage, c.missing FROM (SELECT region, count(*) AS rows FROM readings GROUP BY 1) r
    LEFT JOIN (SELECT region, count(*) AS rows, count(*) - count(y) AS missing FROM grid_a GROUP BY 1) c ON r.region = c.region""")
def j16(spark, folder):
    r = v.readings(spark, folder).groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    c = v.grid_a(spark, folder).groupBy("region").agg(F.count(F.lit(1)).alias("rows_coverage"), F.count_if(F.col("y").isNull()).alias("missing"))
    return r.join(c, "region", "left")


@query("J17_challenger_vs_champion", """SELECT a.region, a.origin, a.MAE AS challenger_MAE, b.MAE AS champion_MAE, 100 * (a.MAE - b.MAE) / b.MAE AS change_pct, CAST(a.MAE < b.MAE AS INT) AS better
    FROM scores a JOIN scores b ON a.region = b.region AND a.origin = b.origin AND b.model = 'Naive336' WHERE a.model = 'Naive48'""",
       nums="challenger_MAE champion_MAE change_pct", ints="better")
def j17(spark, folder):
    s = v.scores(v.grid_a(spark, folder))
    pair = s.groupBy("region", "origin").agg(
        F.max(F.when(F.col("model") == "Naive48", F.col("MAE"))).alias("challenger_MAE"),
        F.max(F.when(F.col("model") == "Naive336", F.col("MAE"))).alias("champion_MAE")).dropna()
    diff = F.col("challenger_MAE") - F.col("champion_MAE")
    return pair.withColumns({"change_pct": 100 * diff / F.col("champion_MAE"), "better": (diff < 0).cast("int")})
