"""Shared views of the checking SQL (DuckDB dialect)."""

CTES = {
    "readings": "SELECT event_type AS region, ts, value AS y, event_id AS seq, user_id, props FROM events",
    "minutely": "SELECT region, date_trunc('minute', ts) AS ts, y, seq FROM readings",
    "minutely_last": """SELECT region, ts, y, seq FROM minutely
        QUALIFY row_number() OVER (PARTITION BY region, ts ORDER BY seq DESC) = 1""",
    "grid_a": """SELECT g.region, g.hh, make_timestamp(g.hh * 1800000000) AS ts, b.y, coalesce(b.n, 0) AS n
        FROM (SELECT region, unnest(range(min(hh), max(hh) + 1)) AS hh FROM bins_a GROUP BY region) g
        LEFT JOIN bins_a b ON g.region = b.region AND g.hh = b.hh""",
    "bins_a": """SELECT region, epoch_us(ts) // 1800000000 AS hh, avg(y) AS y, count(*) AS n
        FROM readings GROUP BY 1, 2""",
    "grid_b": """SELECT g.region, g.hh, make_timestamp(g.hh * 1800000000) AS ts, b.y
        FROM (SELECT region, unnest(range(min(hh), max(hh) + 1)) AS hh FROM bins_b GROUP BY region) g
        LEFT JOIN bins_b b ON g.region = b.region AND g.hh = b.hh""",
    "bins_b": """SELECT 'ALL' AS region, epoch_us(ts) // 1800000000 AS hh, avg(value) AS y FROM events GROUP BY 1, 2""",
    "cal_a": """SELECT region, hh, ts, y, date_trunc('day', ts) AS local_date, hour(ts) * 2 + CAST(minute(ts) >= 30 AS INT) AS half_hour_index,
        isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month, year(ts) AS year, dayofyear(ts) AS day_of_year FROM grid_a""",
    "cal_b": """SELECT region, hh, ts, y, date_trunc('day', ts) AS local_date, hour(ts) * 2 + CAST(minute(ts) >= 30 AS INT) AS half_hour_index,
        isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month, year(ts) AS year, dayofyear(ts) AS day_of_year FROM grid_b""",
    "origin_one": """SELECT region, (max(hh) // 48 - 13) * 48 AS origin_hh, max(hh) AS end_hh FROM grid_a GROUP BY region""",
    "origin_one_b": """SELECT region, (max(hh) // 48 - 13) * 48 AS origin_hh, max(hh) AS end_hh FROM grid_b GROUP BY region""",
    "origin_many_b": """SELECT region, (h // 48 - 13 + 3 * k) * 48 AS origin_hh, (h // 48 - 13 + 3 * k) * 48 + 335 AS end_hh
        FROM (SELECT region, max(hh) AS h FROM grid_b GROUP BY region), (SELECT unnest([0, 1, 2]) AS k)""",
    "origin_many": """SELECT region, (h // 48 - 13 + 3 * k) * 48 AS origin_hh, (h // 48 - 13 + 3 * k) * 48 + 335 AS end_hh
        FROM (SELECT region, max(hh) AS h FROM grid_a GROUP BY region), (SELECT unnest([0, 1, 2]) AS k)""",
    "naive_many": """SELECT o.region, o.origin_hh, o.end_hh, o.hh, m.model, s.y AS forecast
        FROM (SELECT *, unnest(range(origin_hh, end_hh + 1)) AS hh FROM origin_many) o
        CROSS JOIN (SELECT unnest(['Naive48', 'Naive336']) AS model, unnest([48, 336]) AS lag) m
        LEFT JOIN grid_a s ON s.region = o.region AND s.hh = o.hh - m.lag * ((o.hh - o.origin_hh) // m.lag + 1)""",
    "naive_one": """SELECT o.region, o.origin_hh, o.end_hh, o.hh, m.model, s.y AS forecast
        FROM (SELECT *, unnest(range(origin_hh, end_hh + 1)) AS hh FROM origin_one) o
        CROSS JOIN (SELECT unnest(['Naive48', 'Naive336']) AS model, unnest([48, 336]) AS lag) m
        LEFT JOIN grid_a s ON s.region = o.region AND s.hh = o.hh - m.lag * ((o.hh - o.origin_hh) // m.lag + 1)""",
    "scored_many": """SELECT f.*, a.y AS actual, f.forecast - a.y AS err, abs(f.forecast - a.y) AS ae,
        CASE WHEN abs(f.forecast) + abs(a.y) >= 1.0 THEN 200.0 * abs(f.forecast - a.y) / (abs(f.forecast) + abs(a.y)) END AS sm
        FROM naive_many f JOIN grid_a a ON a.region = f.region AND a.hh = f.hh
        WHERE a.y IS NOT NULL AND f.forecast IS NOT NULL""",
    "scores": """SELECT region, model, origin_hh AS origin, count(*) AS matched_intervals, avg(ae) AS MAE, sqrt(avg(err * err)) AS RMSE,
        avg(sm) AS sMAPE, avg(err) AS Bias, median(ae) AS MedAE, 'MODEL_READY' AS status FROM scored_many GROUP BY 1, 2, 3""",
    "skilled": """SELECT *, min(MAE) OVER (PARTITION BY region, origin) AS baseline_MAE,
        100.0 * (min(MAE) OVER (PARTITION BY region, origin) - MAE) / min(MAE) OVER (PARTITION BY region, origin) AS skill_vs_naive_pct
        FROM scores""",
    "renamed": """SELECT region, CASE model WHEN 'Naive48' THEN 'RandomForest_A' ELSE 'RandomForest_B' END AS model, origin,
        MAE, RMSE, sMAPE, Bias, MedAE, status, baseline_MAE, skill_vs_naive_pct FROM skilled""",
    "ab_detail": """SELECT *, CASE model WHEN 'Naive48' THEN 'MODEL_A' ELSE 'MODEL_B' END AS family, make_timestamp(hh * 1800000000) AS ts
        FROM scored_many""",
    "daily_demand": """SELECT r_name AS region, o_orderdate AS date, avg(o_totalprice) AS demand, max(o_totalprice) AS peak, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "daily_weather": """SELECT l_shipdate AS date, max(l_quantity) AS temp_max_c, min(l_quantity) AS temp_min_c,
        avg(l_quantity) AS temp_mean_c, avg(l_discount) * 10 AS rainfall_mm FROM lineitem GROUP BY 1""",
    "demand_temp": """SELECT d.region, d.date, d.demand / 1000 AS demand, w.temp_mean_c AS temp, w.rainfall_mm,
        month(d.date) AS month, year(d.date) AS year FROM daily_demand d JOIN daily_weather w ON d.date = w.date""",
    "holidays": """SELECT d AS date, CASE strftime(d, '%m-%d') WHEN '01-01' THEN 'New Year' WHEN '01-26' THEN 'January Day'
          WHEN '04-25' THEN 'April Day' WHEN '12-25' THEN 'Christmas' ELSE 'Boxing Day' END AS holiday_name, 1 AS is_public_holiday
        FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS d
              FROM (SELECT date_trunc('day', o_orderdate) AS t FROM orders UNION ALL SELECT date_trunc('day', ts) FROM events))
        WHERE strftime(d, '%m-%d') IN ('01-01', '01-26', '04-25', '12-25', '12-26')""",
}
