"""Projections, filters, sorts, set operations and scalar functions."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.catalog import views as v
from loadtide.catalog.registry import query
from loadtide.config import UNSAFE_PATTERNS, WARMUP
from loadtide.functions.clock import at, floor_div, month_start, slot_start, training_cutoff, with_calendar
from loadtide.functions.numeric import number, percent_of, skill_percent
from loadtide.operators.features import demand_features, trend_features
from loadtide.operators.ordered import CHUNK, with_neighbour, with_row_number
from loadtide.plans.panel import analogue_origins, rolling_window
from loadtide.sources import readings as src


@query("P01_time_range_filter", "SELECT region, ts, y FROM readings WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 06:00:00'", nums="y")
def p01(spark, folder):
    return v.readings(spark, folder).where((F.col("ts") >= at("2024-01-05 00:00:00")) & (F.col("ts") < at("2024-01-12 06:00:00"))).drop("seq")


@query("P02_cut_over_filter", """SELECT region, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'legacy' ELSE 'modern' END AS era, count(*) AS rows
    FROM readings WHERE (region = 'error' AND ts < TIMESTAMP '2024-01-15') OR (region <> 'error' AND ts >= TIMESTAMP '2024-01-15') GROUP BY 1, 2""")
def p02(spark, folder):
    r, cut = v.readings(spark, folder), at("2024-01-15 00:00:00")
    old, new = r.where((F.col("region") == "error") & (F.col("ts") < cut)), r.where((F.col("region") != "error") & (F.col("ts") >= cut))
    return (old.withColumn("era", F.lit("legacy")).unionByName(new.withColumn("era", F.lit("modern")))
            .groupBy("region", "era").agg(F.count(F.lit(1)).alias("rows")))


@query("P03_train_holdout_split", """SELECT region, CASE WHEN hh < o THEN 'train' ELSE 'holdout' END AS part, count(*) AS rows, count(lag48) AS with_lag, min(hh) AS first_hh
    FROM (SELECT g.region, g.hh, o.origin_hh AS o, p.y AS lag48 FROM grid_a g JOIN origin_one o ON g.region = o.region
          LEFT JOIN grid_a p ON p.region = g.region AND p.hh = g.hh - 48) GROUP BY 1, 2""")
def p03(spark, folder):
    g = v.grid_a(spark, folder)
    f = demand_features(g).join(v.origin_one(g), "region")
    part = F.when(F.col("hh") < F.col("origin_hh"), "train").otherwise("holdout")
    return f.groupBy("region", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.count("lag_48").alias("with_lag"),
                                                       F.min("hh").alias("first_hh"))


@query("P04_training_cutoff", """SELECT DISTINCT o_orderdate AS origin, date_trunc('month', o_orderdate)::TIMESTAMP - INTERVAL 30 MINUTE AS cutoff,
    date_trunc('month', o_orderdate)::TIMESTAMP AS forecast_start FROM orders""")
def p04(spark, folder):
    o = v.table(spark, folder, "orders").select(F.col("o_orderdate").alias("origin")).distinct()
    cut, first = training_cutoff("origin")
    return o.select("origin", cut.alias("cutoff"), first.alias("forecast_start"))


@query("P05_rolling_window", """SELECT DISTINCT o_orderdate AS origin, date_trunc('month', o_orderdate)::TIMESTAMP AS anchor_start,
    date_trunc('month', o_orderdate)::TIMESTAMP + INTERVAL 4 MONTH - INTERVAL 30 MINUTE AS horizon_end,
    strftime(o_orderdate, '%Y-%m') || '|' || strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') || '|' ||
    strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m') || '|' || strftime(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, '%Y-%m') AS rolling_window
    FROM orders""")
def p05(spark, folder):
    return rolling_window(v.table(spark, folder, "orders").select(F.col("o_orderdate").alias("origin")).distinct(), "origin")


@query("P06_same_month_prior_years", """SELECT region, year(date) AS year, count(*) AS days, sum(n) AS orders FROM daily_demand
    WHERE month(date) = 3 AND year(date) < 2000 GROUP BY 1, 2""", ints="orders")
def p06(spark, folder):
    d = v.daily_demand(spark, folder).where((F.month("date") == 3) & (F.year("date") < 2000))
    return d.groupBy("region", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("orders"))


@query("P07_numeric_coercion", """SELECT region, count(*) AS rows, count(CASE WHEN region <> 'error' THEN 1 END) AS numeric_rows,
    sum(CASE WHEN region <> 'error' THEN y END) AS total FROM readings GROUP BY region""", nums="total")
def p07(spark, folder):
    r = v.readings(spark, folder)
    text = F.when(F.col("region") == "error", "n/a").otherwise(F.concat(F.lit(" "), F.col("y").cast("string")))
    return (r.withColumn("x", number(F.trim(text))).groupBy("region")
            .agg(F.count(F.lit(1)).alias("rows"), F.count("x").alias("numeric_rows"), F.sum("x").alias("total")))


@query("P08_constant_columns", """SELECT 'period_type' AS feature, 1 AS is_constant UNION ALL SELECT 'region', 0 UNION ALL SELECT 'year', 1
    UNION ALL SELECT 'y', CASE WHEN (SELECT count(DISTINCT y) FROM readings) <= 1 THEN 1 ELSE 0 END""", ints="is_constant")
def p08(spark, folder):
    r = v.readings(spark, folder).withColumns({"period_type": F.lit("ACTUAL"), "year": F.year("ts")})
    cols = ["region", "y", "period_type", "year"]
    flags = r.agg(*[((F.min(c).eqNullSafe(F.max(c))) & (F.count_if(F.col(c).isNull()).isin(0) | F.max(c).isNull()))
                    .cast("int").alias(c) for c in cols])
    return flags.unpivot([], cols, "feature", "is_constant")


@query("P09_unsafe_feature_names", """SELECT feature, CASE WHEN regexp_matches(lower(feature), 'aemo|predispatch|^hdd$|^cdd$|^temp_mean_c$|^rainfall_mm$') THEN 1 ELSE 0 END AS unsafe,
    rows FROM (SELECT unnest(['y', 'lag_48', 'temp_mean_c', 'AEMO_forecast_MW', 'weather_daily_temp_mean_c', 'hdd', 'rainfall_mm']) AS feature),
    (SELECT count(*) AS rows FROM readings)""", ints="unsafe")
def p09(spark, folder):
    names = ["y", "lag_48", "temp_mean_c", "AEMO_forecast_MW", "weather_daily_temp_mean_c", "hdd", "rainfall_mm"]
    frame = v.readings(spark, folder).select(*[F.col("y").alias(n) for n in names])
    counts = frame.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "rows")
    return counts.withColumn("unsafe", F.lower("feature").rlike("|".join(UNSAFE_PATTERNS)).cast("int"))


@query("P10_complete_cases", """SELECT g.region, count(*) AS rows FROM grid_a g JOIN grid_a a ON a.region = g.region AND a.hh = g.hh - 48
    JOIN grid_a b ON b.region = g.region AND b.hh = g.hh - 336 WHERE g.y IS NOT NULL AND a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY g.region""")
def p10(spark, folder):
    f = demand_features(v.grid_a(spark, folder)).dropna(subset=["y", "lag_48", "lag_336"])
    return f.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))


@query("P11_warmup_and_last_n", """SELECT region, hh FROM (SELECT region, hh, y, hh - min(hh) OVER (PARTITION BY region) AS pos FROM grid_b)
    WHERE pos >= 672 AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY region ORDER BY hh DESC) <= 300""")
def p11(spark, folder):
    g = trend_features(v.grid_b(spark, folder)).where(f"time_index >= {WARMUP} and y is not null")
    numbered = with_row_number(g, ["region"], [F.col("hh").desc()], -floor_div("hh", 48), "back")
    return numbered.where("back < 300").select("region", "hh")


@query("P12_source_override", """SELECT region, hh, CASE WHEN n >= 2 THEN y ELSE 10.0 END AS value, CASE WHEN n >= 2 THEN 'OBSERVED' ELSE 'FALLBACK' END AS source FROM grid_a""",
       nums="value")
def p12(spark, folder):
    use = F.col("n_source_readings") >= 2
    return v.grid_a(spark, folder).select("region", "hh", F.when(use, F.col("y")).otherwise(10.0).alias("value"),
                                          F.when(use, "OBSERVED").otherwise("FALLBACK").alias("source"))


# --- sorts, limits, top-k ------------------------------------------------------------------------

@query("K01_stable_sort", """SELECT region, ts, seq, row_number() OVER (PARTITION BY region ORDER BY ts, seq) AS place FROM minutely""")
def k01(spark, folder):
    m = v.minute(spark, folder)
    n = with_row_number(m, ["region"], [F.col("ts"), F.col("seq")], F.struct("ts", floor_div("seq", 100_000).alias("b")), "place")
    return n.select("region", "ts", "seq", (F.col("place") + 1).alias("place")).orderBy("region", "ts", "seq")


@query("K02_top_by_absolute", """SELECT region, hh, d FROM (SELECT a.region, a.hh, a.y - b.y AS d FROM grid_a a JOIN grid_a b ON a.region = b.region AND b.hh = a.hh - 48
    WHERE a.y IS NOT NULL AND b.y IS NOT NULL) ORDER BY abs(d) DESC, region, hh LIMIT 18""", nums="d")
def k02(spark, folder):
    f = demand_features(v.grid_a(spark, folder)).select("region", "hh", (F.col("y") - F.col("lag_48")).alias("d")).dropna()
    return f.orderBy(F.abs("d").desc(), "region", "hh").limit(18)


@query("K03_top_importances", """SELECT region, feature, share, rank FROM (SELECT region, feature, share, row_number() OVER (PARTITION BY region ORDER BY share DESC, feature) AS rank FROM (
      SELECT region, 'hour_' || lpad(hour(ts)::VARCHAR, 2, '0') AS feature, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY region) AS share FROM readings GROUP BY 1, 2))
    WHERE rank <= 15""", nums="share")
def k03(spark, folder):
    c = v.readings(spark, folder).groupBy("region", F.concat(F.lit("hour_"), F.date_format("ts", "HH")).alias("feature")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("region")
    t = c.withColumn("share", F.col("n") / F.sum("n").over(w))
    return (t.withColumn("rank", F.row_number().over(w.orderBy(F.col("share").desc(), "feature")))
            .where("rank <= 15").select("region", "feature", "share", "rank"))


@query("K04_peak_timestamp", """SELECT region, make_timestamp(hh * 1800000000) AS peak_ts, y AS peak FROM grid_a WHERE y IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY y DESC, hh) = 1""", nums="peak")
def k04(spark, folder):
    best = F.max(F.struct(F.col("y").alias("v"), (-F.col("hh")).alias("t")))
    return (v.grid_a(spark, folder).where("y is not null").groupBy("region").agg(best.alias("b"))
            .select("region", slot_start(-F.col("b.t")).alias("peak_ts"), F.col("b.v").alias("peak")))


@query("K05_newest_windows", """SELECT region, origin, row_number() OVER (PARTITION BY region ORDER BY origin DESC) AS rank
    FROM (SELECT region, min(date) AS s, max(date) AS e FROM daily_demand GROUP BY region),
         (SELECT make_timestamp(y, 6, 1, 0, 0, 0) AS origin FROM (SELECT unnest(range(1990, 2003)) AS y))
    WHERE year(origin) >= year(s) AND year(origin) < year(e) AND origin > s AND datediff('day', s, origin) >= 240
      AND origin + INTERVAL 4 MONTH - INTERVAL 30 MINUTE <= e
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY origin DESC) <= 3""")
def k05(spark, folder):
    spans = v.daily_demand(spark, folder).groupBy("region").agg(F.min("date").alias("s"), F.max("date").alias("e"))
    spans = spans.withColumn("anchor", F.make_date(F.year("e"), F.lit(6), F.lit(1)).cast("timestamp_ntz"))
    return analogue_origins(spans, "anchor", "s", "e").select("region", "origin", "rank")


@query("K06_worst_dimension", """SELECT region, half_hour_index AS worst_half_hour_index, MAE AS worst_MAE FROM (
      SELECT s.region, (s.hh % 48) AS half_hour_index, avg(ae) AS MAE FROM scored_many s WHERE model = 'Naive48' GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY MAE DESC, half_hour_index) = 1""", nums="worst_MAE")
def k06(spark, folder):
    from loadtide.operators.evaluate import error_metrics, worst_by
    s = v.scored_many(v.grid_a(spark, folder)).where("model = 'Naive48'").withColumn("half_hour_index", F.col("hh") % 48)
    return worst_by(error_metrics(s, ["region", "half_hour_index"]), ["region"], "MAE", "half_hour_index")


@query("K07_last_value", """SELECT region, y AS last_y, ts AS last_ts FROM readings QUALIFY row_number() OVER (PARTITION BY region ORDER BY ts DESC) = 1""", nums="last_y")
def k07(spark, folder):
    return v.readings(spark, folder).groupBy("region").agg(F.max_by("y", "ts").alias("last_y"), F.max("ts").alias("last_ts"))


@query("K08_deterministic_sample", "SELECT region, hh, y FROM grid_a WHERE y IS NOT NULL ORDER BY md5(region || ':' || hh), region, hh LIMIT 200", nums="y")
def k08(spark, folder):
    return (v.grid_a(spark, folder).where("y is not null")
            .orderBy(F.md5(F.concat_ws(":", "region", "hh")), "region", "hh").limit(200).select("region", "hh", "y"))


# --- set operations ------------------------------------------------------------------------------

@query("U01_union_by_name", """SELECT region, source, count(*) AS rows, count(y) AS with_y FROM (
      SELECT region, 'grid' AS source, y FROM grid_a UNION ALL SELECT region, 'daily', NULL FROM daily_demand) GROUP BY 1, 2""")
def u01(spark, folder):
    g = v.grid_a(spark, folder).select("region", "y", F.lit("grid").alias("source"))
    d = v.daily_demand(spark, folder).select("region", F.lit("daily").alias("source"))
    return (src.union_sources(g, d).groupBy("region", "source")
            .agg(F.count(F.lit(1)).alias("rows"), F.count("y").alias("with_y")))


@query("U02_feature_set_operations", """SELECT 'common' AS part, count(*) AS slots FROM (SELECT hh FROM bins_a WHERE region = 'click' INTERSECT SELECT hh FROM bins_a WHERE region = 'view')
    UNION ALL SELECT 'only_click', count(*) FROM (SELECT hh FROM bins_a WHERE region = 'click' EXCEPT SELECT hh FROM bins_a WHERE region = 'view')
    UNION ALL SELECT 'only_view', count(*) FROM (SELECT hh FROM bins_a WHERE region = 'view' EXCEPT SELECT hh FROM bins_a WHERE region = 'click')""")
def u02(spark, folder):
    b = v.bins_a(spark, folder)
    a, c = b.where("region = 'click'").select("hh"), b.where("region = 'view'").select("hh")

    def size(df, part):
        return df.agg(F.count(F.lit(1)).alias("slots")).withColumn("part", F.lit(part))

    return (size(a.intersect(c), "common").unionByName(size(a.exceptAll(c), "only_click"))
            .unionByName(size(c.exceptAll(a), "only_view")))


@query("U03_timestamp_intersection", """SELECT a.hh, a.y AS click, b.y AS view, c.y AS error, d.y AS signup FROM bins_a a JOIN bins_a b ON a.hh = b.hh AND b.region = 'view'
    JOIN bins_a c ON a.hh = c.hh AND c.region = 'error' JOIN bins_a d ON a.hh = d.hh AND d.region = 'signup' WHERE a.region = 'click'""",
       nums="click view error signup")
def u03(spark, folder):
    b = v.bins_a(spark, folder)
    names = ["click", "view", "error", "signup"]
    wide = b.where(F.col("region").isin(names)).groupBy("hh").agg(
        *[F.max(F.when(F.col("region") == n, F.col("y"))).alias(n) for n in names])
    return wide.dropna()


@query("U04_distinct_years_text", """SELECT region, string_agg(y, ',' ORDER BY y) AS years FROM (SELECT DISTINCT region, year(date)::VARCHAR AS y FROM daily_demand) GROUP BY region""")
def u04(spark, folder):
    years = F.array_sort(F.collect_set(F.year("date").cast("string")))
    return v.daily_demand(spark, folder).groupBy("region").agg(F.array_join(years, ",").alias("years"))


# --- scalar functions ----------------------------------------------------------------------------

@query("F01_string_functions", """SELECT doc_id, trim(lang) AS lang, upper(source) AS source_up, replace(source, '_', ' ') AS source_sp,
    contains(lower(text), 'the') AS has_the, starts_with(text, 'T') AS starts_t, regexp_matches(text, '\\d{2,}') AS has_number, length(text) AS n FROM documents""",
       ints="has_the starts_t has_number")
def f01(spark, folder):
    d = v.table(spark, folder, "documents")
    return d.select("doc_id", F.trim("lang").alias("lang"), F.upper("source").alias("source_up"),
                    F.regexp_replace("source", "_", " ").alias("source_sp"), F.lower("text").contains("the").alias("has_the"),
                    F.col("text").startswith("T").alias("starts_t"), F.col("text").rlike(r"\d{2,}").alias("has_number"),
                    F.length("text").alias("n"))


@query("F02_date_parts", """SELECT region, ts, hour(ts) * 2 + CAST(minute(ts) >= 30 AS INT) AS half_hour_index, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
    day(ts) AS day_of_month, weekofyear(ts) AS week_of_year, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, dayofyear(ts) AS day_of_year,
    CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM grid_a""", ints="half_hour_index is_weekend")
def f02(spark, folder):
    names = ["half_hour_index", "hour", "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year", "day_of_year", "is_weekend"]
    return with_calendar(v.grid_a(spark, folder), "ts").select("region", "ts", *names)


@query("F03_cyclical_encodings", """SELECT region, ts, sin(2 * pi() * half_hour_index / 48) AS sin_half_hour, cos(2 * pi() * half_hour_index / 48) AS cos_half_hour,
    sin(2 * pi() * day_of_week / 7) AS sin_day_of_week, cos(2 * pi() * day_of_week / 7) AS cos_day_of_week, sin(2 * pi() * month / 12) AS sin_month,
    cos(2 * pi() * month / 12) AS cos_month, sin(2 * pi() * day_of_year / 365.25) AS sin_day_of_year, cos(2 * pi() * day_of_year / 365.25) AS cos_day_of_year FROM cal_b""",
       nums="sin_half_hour cos_half_hour sin_day_of_week cos_day_of_week sin_month cos_month sin_day_of_year cos_day_of_year")
def f03(spark, folder):
    waves = [f"{f}_{n}" for n in ("half_hour", "day_of_week", "month", "day_of_year") for f in ("sin", "cos")]
    return v.cal_b(spark, folder).select("region", "ts", *waves)


@query("F04_date_arithmetic", """SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS next_day, o_orderdate - INTERVAL 1 DAY AS prev_day, last_day(o_orderdate)::TIMESTAMP AS month_end,
    date_trunc('month', o_orderdate)::TIMESTAMP AS month_first FROM orders""")
def f04(spark, folder):
    o = v.table(spark, folder, "orders")
    return o.select("o_orderkey", F.date_add("o_orderdate", 1).alias("next_day"), F.date_sub("o_orderdate", 1).alias("prev_day"),
                    F.last_day("o_orderdate").alias("month_end"), month_start("o_orderdate").alias("month_first"))


@query("F05_math_functions", """SELECT seq, abs(y - 20) AS dist, sqrt(y) AS root, least(greatest(y, 5.0), 30.0) AS clipped, greatest(y - 20, 0.0) AS above,
    round_even(y, 0) AS whole, CAST(abs(y - round_even(y, 0)) <= 1e-8 + 1e-5 * abs(round_even(y, 0)) AS INT) AS close FROM readings""",
       nums="dist root clipped above whole", ints="close")
def f05(spark, folder):
    y, whole = F.col("y"), F.rint("y")
    return v.readings(spark, folder).select(
        "seq", F.abs(y - 20).alias("dist"), F.sqrt(y).alias("root"), F.least(F.greatest(y, F.lit(5.0)), F.lit(30.0)).alias("clipped"),
        F.greatest(y - 20, F.lit(0.0)).alias("above"), whole.alias("whole"),
        (F.abs(y - whole) <= 1e-8 + 1e-5 * F.abs(whole)).cast("int").alias("close"))


@query("F06_null_logic", """SELECT region, hh, coalesce(y, 0.0) AS zeroed, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY region ORDER BY hh ROWS UNBOUNDED PRECEDING)) AS forward,
    nullif(n, 0) AS n FROM grid_a""", nums="zeroed forward n")
def f06(spark, folder):
    g = v.grid_a(spark, folder)
    prev = g.where("y is not null")
    linked = with_neighbour(prev, ["region"], "hh", floor_div("hh", CHUNK), {"next_hh": "hh"}, forward=False)
    ends = g.groupBy("region").agg(F.max("hh").alias("hi"))
    held = (linked.join(ends, "region")
            .select("region", F.col("y").alias("forward"),
                    F.explode(F.sequence("hh", F.coalesce(F.col("next_hh") - 1, F.col("hi")))).alias("hh")))
    return g.join(held, ["region", "hh"], "left").select(
        "region", "hh", F.coalesce("y", F.lit(0.0)).alias("zeroed"), "forward", F.nullif(F.col("n_source_readings"), F.lit(0)).cast("double").alias("n"))


@query("F07_conditional", """SELECT seq, CASE WHEN y > 30 THEN 'high' WHEN y > 10 THEN 'mid' ELSE 'low' END AS band, CASE WHEN region = 'error' THEN 'bad' ELSE 'good' END AS tag FROM readings""")
def f07(spark, folder):
    return v.readings(spark, folder).select("seq", F.when(F.col("y") > 30, "high").when(F.col("y") > 10, "mid").otherwise("low").alias("band"),
                                            F.when(F.col("region") == "error", "bad").otherwise("good").alias("tag"))


@query("F08_percent_change", """SELECT region, hh, n48, CASE WHEN abs(p) > 0 THEN 100.0 * (y - p) / p END AS change_pct FROM (
    SELECT a.region, a.hh, a.y, b.y AS p, b.n AS n48 FROM grid_a a LEFT JOIN grid_a b ON a.region = b.region AND b.hh = a.hh - 48)""", nums="change_pct n48")
def f08(spark, folder):
    g = v.grid_a(spark, folder)
    p = g.select("region", (F.col("hh") + 48).alias("hh"), F.col("y").alias("p"), F.col("n_source_readings").cast("double").alias("n48"))
    return g.join(p, ["region", "hh"], "left").select("region", "hh", "n48", percent_of(F.col("y") - F.col("p"), "p").alias("change_pct"))


@query("F09_json_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def f09(spark, folder):
    e = v.table(spark, folder, "events")
    return e.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.*")


@query("F10_array_functions", """SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x, CAST(list_sum(embedding[i + 1:i + 4]) AS DOUBLE) AS next_four
    FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)""", nums="x next_four")
def f10(spark, folder):
    e = v.table(spark, folder, "embeddings").withColumn("d", F.transform("embedding", lambda x: x.cast("double")))
    windows = F.transform("d", lambda _, i: F.aggregate(F.slice(F.col("d"), i + 1, 4), F.lit(0.0), lambda a, b: a + b))
    idx = F.sequence(F.lit(0), F.size("d") - 1)
    return e.select("vec_id", F.inline(F.arrays_zip(idx.alias("i"), F.col("d").alias("x"), windows.alias("next_four"))))


@query("F11_safe_ratio", """SELECT region, model, origin, CASE WHEN baseline_MAE > 0 THEN 100.0 * (baseline_MAE - MAE) / baseline_MAE END AS skill_pct FROM skilled""", nums="skill_pct")
def f11(spark, folder):
    s = v.skilled(v.grid_a(spark, folder))
    return s.select("region", "model", "origin", skill_percent("MAE", "baseline_MAE").alias("skill_pct"))
