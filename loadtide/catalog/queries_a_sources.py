"""Sources and sinks."""
from pyspark.sql import functions as F

from loadtide.catalog import views as v
from loadtide.catalog.registry import query
from loadtide.functions.clock import at, day_of, lookup
from loadtide.functions.numeric import number
from loadtide.operators import clean
from loadtide.session import scratch_path
from loadtide.sources import holidays as hol
from loadtide.sources import readings as src
from loadtide.sources import weather as wx


def _archive_lines(spark, folder):
    """The readings as archive CSV lines."""
    r = v.readings(spark, folder)
    return r.select("region", "seq", F.concat_ws(",", "region", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"),
                                                 F.col("y").cast("string"), F.lit("0.0"), F.lit("TRADE")).alias("line"))


@query("S01_scan_interval_csv", """SELECT region, date_trunc('second', ts) AS ts, y FROM readings""", nums="y")
def s01(spark, folder):
    return src.archive_rows(src.parse_lines(_archive_lines(spark, folder), src.ARCHIVE_SCHEMA))


@query("S02_scan_native_interval_csv", """SELECT region, date_trunc('second', ts) AS ts, y,
    CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 30 ELSE 5 END AS source_interval_min FROM readings""",
       nums="y", ints="source_interval_min")
def s02(spark, folder):
    r = v.readings(spark, folder)
    step = F.when(F.col("ts") < at("2024-01-15 00:00:00"), "30").otherwise("5")
    lines = r.select(F.concat_ws(",", "region", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("y").cast("string"),
                                 F.lit("ACTUAL"), F.lit("FEED"), step).alias("line"))
    return src.native_rows(src.parse_lines(lines, src.NATIVE_SCHEMA))


@query("S03_union_all_regions", """SELECT region, count(*) AS rows, count(CASE WHEN region = 'purchase' THEN 5 END) AS with_interval,
    min(date_trunc('second', ts)) AS first_ts, max(date_trunc('second', ts)) AS last_ts FROM readings GROUP BY region""")
def s03(spark, folder):
    base = s01(spark, folder)
    native = base.where("region = 'purchase'").withColumn("source_interval_min", F.lit(5))
    return (src.union_sources(base.where("region <> 'purchase'"), native).groupBy("region")
            .agg(F.count(F.lit(1)).alias("rows"), F.count("source_interval_min").alias("with_interval"),
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@query("S04_column_format_probe", """SELECT region, count(*) AS rows, count(CASE WHEN region <> 'error' THEN 1 END) AS parsed,
    min(CASE WHEN region <> 'error' THEN date_trunc('second', ts) END) AS first_ts FROM readings GROUP BY region""")
def s04(spark, folder):
    r = v.readings(spark, folder)
    stamp = F.when(F.col("region") == "error", F.date_format("ts", "dd.MM.yyyy HH:mm:ss")).otherwise(
        F.concat(F.lit(' "'), F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit('" ')))
    return (src.parse_probed(r.withColumn("stamp", stamp).drop("ts"), "stamp").groupBy("region")
            .agg(F.count(F.lit(1)).alias("rows"), F.count("ts").alias("parsed"), F.min("ts").alias("first_ts")))


@query("S05_iso_or_day_first_parse", "SELECT seq, region, date_trunc('second', ts) AS ts FROM readings")
def s05(spark, folder):
    r = v.readings(spark, folder)
    stamp = (F.when(F.col("region") == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
             .when(F.col("region") == "click", F.date_format("ts", "yyyy/M/d H:mm:ss"))
             .otherwise(F.date_format("ts", "d/M/yyyy HH:mm:ss")))
    return r.select("seq", "region", src.mixed_date(stamp).alias("ts"))


@query("S06a_resolve_timestamp_datetime", "SELECT DISTINCT 'datetime' AS branch, ts FROM minutely")
def s06a(spark, folder):
    m = v.minute(spark, folder).select("ts").distinct()
    df = m.select(F.date_format("ts", "dd/MM/yyyy HH:mm").alias("Trading Interval"), F.lit("1").alias("Run Number"))
    branch, ts = src.find_timestamp(df, 30)
    return df.select(F.lit(branch).alias("branch"), ts.alias("ts"))


@query("S06b_resolve_timestamp_numbered", """SELECT region, 'numbered' AS branch, make_timestamp(hh * 1800000000) + INTERVAL 8 HOUR AS ts
    FROM bins_a""")
def s06b(spark, folder):
    g = v.bins_a(spark, folder)
    df = g.select("region", F.date_format("ts", "dd/MM/yyyy").alias("Trading Date"),
                  (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30) + 1).cast("string").alias("Interval Number"))
    branch, ts = src.find_timestamp(df.drop("region"), 30)
    return df.select("region", F.lit(branch).alias("branch"), ts.alias("ts"))


@query("S06c_resolve_timestamp_clock", """SELECT region, 'clock' AS branch, make_timestamp(hh * 1800000000) AS ts FROM bins_a""")
def s06c(spark, folder):
    g = v.bins_a(spark, folder)
    df = g.select("region", F.date_format("ts", "yyyy-MM-dd").alias("Trading Date"), F.date_format("ts", "HH:mm").alias("Start Time"))
    branch, ts = src.find_timestamp(df.drop("region"), 30)
    return df.select("region", F.lit(branch).alias("branch"), ts.alias("ts"))


@query("S07_resolve_demand_column", """SELECT 'Operational Demand (MW)' AS demand_column, region, sum(y) AS total FROM readings GROUP BY region""",
       nums="total")
def s07(spark, folder):
    df = v.readings(spark, folder).select(
        "region", (F.col("y") * 2).alias("Demand Forecast"), (F.col("y") * 3).alias("Demand_Withdrawal"),
        F.col("y").alias("Demand"), F.col("y").cast("string").alias("Operational Demand (MW)"))
    name = src.find_demand(df)
    return df.groupBy("region").agg(F.sum(number(name)).alias("total")).withColumn("demand_column", F.lit(name))


@query("S08_normalise_frame", """SELECT 'WA' AS region, ts, y, 'ACTUAL' AS period_type, 'FEED_LEGACY' AS source, 30 AS source_interval_min
    FROM minutely QUALIFY row_number() OVER (PARTITION BY ts ORDER BY seq DESC) = 1""", nums="y", ints="source_interval_min")
def s08(spark, folder):
    m = v.minute(spark, folder)
    # the last copy of every minute, and the first copy again for the night hours, as a file with some repeats
    rows = clean.dedupe_last(m, keys=[]).unionByName(clean.dedupe_first(m, keys=[]).where(F.hour("ts") < 3))
    df = rows.select(
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias("Trading Interval"),
        F.col("y").cast("string").alias("Operational Demand (MW)"), (F.col("y") * 9).alias("Demand Forecast"), "seq")
    return src.normalise(df, "FEED_LEGACY", 30)


@query("S09_largest_record_list", """SELECT region, count(*) AS records, CAST(sum(k) AS BIGINT) AS total_k FROM (
      SELECT region, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM readings UNION ALL SELECT region, seq FROM readings) GROUP BY region""")
def s09(spark, folder):
    e = v.table(spark, folder, "events")
    payload = F.concat(F.lit('{"meta":[{"k":1}],"data":{"records":['), "props", F.lit(',{"k":'),
                       F.col("event_id").cast("string"), F.lit("}]}}"))
    kind = "array<struct<k:bigint>>"
    parsed = F.from_json(payload, f"struct<meta:{kind},data:struct<records:{kind}>>")
    rows = e.select(F.col("event_type").alias("region"), parsed.alias("p"))
    best = src.largest_record_list("p", {"meta": (F.col("p.meta"), kind), "records": (F.col("p.data.records"), kind)})
    return (rows.select("region", F.inline(best)).groupBy("region")
            .agg(F.count(F.lit(1)).alias("records"), F.sum("k").alias("total_k")))


@query("S10_merge_by_priority", """SELECT region, ts, y, source FROM (
      SELECT 'ALL' AS region, ts, y, seq, CASE region WHEN 'click' THEN 'FEED_DAILY' WHEN 'view' THEN 'FEED_WEM_2024' ELSE 'FEED_LEGACY' END AS source
      FROM minutely)
    WHERE ((source = 'FEED_LEGACY' AND ts < TIMESTAMP '2024-01-10') OR (source <> 'FEED_LEGACY' AND ts >= TIMESTAMP '2024-01-10'))
      AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-29'
    QUALIFY row_number() OVER (PARTITION BY ts ORDER BY CASE source WHEN 'FEED_DAILY' THEN 3 WHEN 'FEED_WEM_2024' THEN 2 ELSE 1 END DESC, seq DESC) = 1""",
       nums="y")
def s10(spark, folder):
    tagged = v.minute(spark, folder).withColumn(
        "source", lookup("region", {"click": "FEED_DAILY", "view": "FEED_WEM_2024", "signup": "FEED_LEGACY",
                                    "error": "FEED_LEGACY", "purchase": "FEED_LEGACY"})).withColumn("region", v.one_series("ts"))
    old, new = tagged.where("source = 'FEED_LEGACY'"), tagged.where("source <> 'FEED_LEGACY'")
    return src.merge_by_priority(old, new, at("2024-01-02 00:00:00"), at("2024-01-29 00:00:00"),
                                 cut_over=at("2024-01-10 00:00:00")).select("region", "ts", "y", "source")


@query("S11_merge_monthly_files", """SELECT region, strftime(ts, '%Y/%m/%d %H:%M:%S') AS settlement_text, ts, y FROM minutely_last""", nums="y")
def s11(spark, folder):
    m = v.minute(spark, folder)
    good = m.select(F.concat_ws("_", F.lit("part"), "region", F.date_format("ts", "yyyyMM")).alias("path"), F.col("seq").alias("line_no"),
                    F.concat_ws(",", "region", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.col("y").cast("string")).alias("line"))
    bad = v.table(spark, folder, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("line_no"), F.col("html").alias("line"))
    kept = src.reject_html(good.unionByName(bad))
    rows = kept.select(F.col("line_no").alias("seq"), F.from_csv("line", "region string, settlement_text string, y double").alias("r"))
    return src.merge_months(rows.select("seq", "r.*")).select("region", "settlement_text", "ts", "y")


@query("S12_month_list", """SELECT strftime(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)),
    INTERVAL 1 MONTH)), '%Y-%m') AS month FROM orders""")
def s12(spark, folder):
    ends = v.table(spark, folder, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return src.month_list(ends, "lo", "hi")


@query("S13_split_snapshot_counts", """SELECT region, CASE WHEN dow IN (0, 6) THEN 'FORECAST' ELSE 'ACTUAL' END AS period_type, count(*) AS rows
    FROM (SELECT region, dayofweek(ts) AS dow FROM readings) GROUP BY 1, 2""")
def s13(spark, folder):
    snap = v.readings(spark, folder).withColumn(
        "period_type", F.when(F.weekday("ts") >= 5, "FORECAST").otherwise("ACTUAL"))
    path = scratch_path(spark, "snapshot")
    src.split_snapshot(snap, path, "20240131_0000")
    return spark.read.parquet(path).groupBy("region", "period_type").agg(F.count(F.lit(1)).alias("rows"))


@query("S14_parallel_arrays_to_rows", """SELECT vec_id, count(*) AS n, sum(CAST(x AS DOUBLE)) AS total, CAST(sum(i) AS BIGINT) AS index_sum
    FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY vec_id""", nums="total")
def s14(spark, folder):
    e = v.table(spark, folder, "embeddings").withColumn("i", F.sequence(F.lit(0), F.size("embedding") - 1))
    rows = src.open_block(e.withColumnRenamed("embedding", "x"), ["x", "i"], ["vec_id"])
    return rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("total"),
                                      F.sum("i").alias("index_sum"))


@query("S15_tag_weather_reject_empty", """SELECT l_returnflag AS region, 'DAILY' AS kind, count(DISTINCT l_shipdate) AS days, max(l_quantity) AS hottest
    FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""", nums="hottest")
def s15(spark, folder):
    day = (v.table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("region"), F.col("l_shipdate").alias("date"))
           .agg(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("temp_max_c")))
    kept = wx.reject_empty_series(day).withColumn("kind", F.lit("DAILY"))
    return kept.groupBy("region", "kind").agg(F.count(F.lit(1)).alias("days"), F.max("temp_max_c").alias("hottest"))


@query("S16_forecast_vintage_ingest", """SELECT region, datediff('day', o, date_trunc('day', ts)) AS lead_day, count(*) AS rows, min(ts) AS first_ts
    FROM readings, (SELECT date_trunc('day', max(ts)) - INTERVAL 8 DAY AS o FROM readings)
    WHERE datediff('day', o, date_trunc('day', ts)) BETWEEN 1 AND 7
      AND region IN (SELECT region FROM readings, (SELECT date_trunc('day', max(ts)) - INTERVAL 8 DAY AS o FROM readings)
        WHERE datediff('day', o, date_trunc('day', ts)) BETWEEN 1 AND 7 GROUP BY region HAVING count(DISTINCT date_trunc('day', ts)) = 7)
    GROUP BY 1, 2""")
def s16(spark, folder):
    r = v.readings(spark, folder)
    last = r.agg(F.max("ts").alias("t")).first()["t"]          # one value: the origin of this vintage
    origin = F.date_sub(F.to_date(F.lit(last).cast("timestamp_ntz")), 8)
    return (wx.forecast_vintage(r, origin).groupBy("region", "lead_day")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts")))


@query("S17_daily_from_hourly", """SELECT region, date_trunc('day', ts) AS date, max(y) AS temp_max_c, min(y) AS temp_min_c, avg(y) AS temp_mean_c,
    avg(CASE WHEN region <> 'click' THEN y / 2 END) AS humidity_mean_pct, sum(CASE WHEN region <> 'error' THEN y / 10 END) AS rainfall_mm
    FROM readings GROUP BY 1, 2""", nums="temp_max_c temp_min_c temp_mean_c humidity_mean_pct rainfall_mm")
def s17(spark, folder):
    h = v.readings(spark, folder).select(
        "region", "ts", F.col("y").alias("temp_c"), F.when(F.col("region") != "click", F.col("y") / 2).alias("humidity_pct"),
        F.when(F.col("region") != "error", F.col("y") / 10).alias("rainfall_mm"))
    return wx.daily_from_hourly(h)


@query("S18_scan_daily_weather", """SELECT 'ALL' AS region, date, hi AS temp_max_c, lo AS temp_min_c, (hi + lo) / 2 AS temp_mean_c, rain AS rainfall_mm FROM (
      SELECT l_shipdate AS date, l_returnflag AS f, max(l_quantity) AS hi, min(l_quantity) AS lo, avg(l_discount) * 10 AS rain
      FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY date ORDER BY f DESC) = 1""",
       nums="temp_max_c temp_min_c temp_mean_c rainfall_mm")
def s18(spark, folder):
    raw = (v.table(spark, folder, "lineitem").groupBy("l_shipdate", "l_returnflag")
           .agg(F.max("l_quantity").cast("string").alias("Temp_Max (C)"), F.min("l_quantity").cast("string").alias("Temp_Min (C)"),
                (F.avg("l_discount") * 10).cast("string").alias("Rainfall mm"))
           .select(v.one_series("l_shipdate").alias("region"), F.ascii("l_returnflag").alias("seq"),
                   F.date_format("l_shipdate", "yyyy-MM-dd").alias("Obs Date"), "Temp_Max (C)", "Temp_Min (C)", "Rainfall mm"))
    return wx.daily_weather(raw)


@query("S19_clip_to_source", """SELECT region, min(date) AS start_date, least(max(date) + INTERVAL 30 DAY, max(date) - INTERVAL 5 DAY) AS end_date
    FROM (SELECT region, date_trunc('day', ts) AS date FROM readings) GROUP BY region""")
def s19(spark, folder):
    e = v.readings(spark, folder).groupBy("region").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    lo, hi = wx.clip_range(F.col("a"), F.date_add("z", 30), F.col("z"))
    return e.select("region", lo.alias("start_date"), hi.alias("end_date"))


@query("S20_scan_holidays", """SELECT date, is_public_holiday, holiday_name FROM holidays""", ints="is_public_holiday")
def s20(spark, folder):
    h = v.holidays(spark, folder)
    lines = h.select(F.concat_ws(",", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("1"), "holiday_name").alias("line"))
    return src.parse_lines(lines, hol.SCHEMA)


@query("S21_holidays_covering", """SELECT date, holiday_name, 'acquired' AS provenance FROM holidays WHERE date < TIMESTAMP '2000-01-01'
    UNION ALL SELECT date, holiday_name, 'generated' FROM holidays
    WHERE date > (SELECT max(date) FROM holidays WHERE date < TIMESTAMP '2000-01-01') AND date <= (SELECT max(date_trunc('day', ts)) FROM events)""")
def s21(spark, folder):
    h = v.holidays(spark, folder)
    end = v.calendar_span(spark, folder).first()["hi"]
    return hol.covering(h.where(F.col("date") < at("2000-01-01 00:00:00")), h, F.lit(end).cast("timestamp_ntz")).drop("is_public_holiday")


@query("S22_holiday_day_table", """SELECT s.date, CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS is_public_holiday, coalesce(h.holiday_name, '') AS holiday_name
    FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS date FROM events) s
    LEFT JOIN holidays h ON h.date = s.date""", ints="is_public_holiday")
def s22(spark, folder):
    span = v.table(spark, folder, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return hol.day_table(span, v.holidays(spark, folder), "lo", "hi")


@query("S23_latest_common_origin", "SELECT date_trunc('day', max(ts)) AS forecast_origin_date FROM readings")
def s23(spark, folder):
    rows = v.readings(spark, folder).select(day_of("ts").alias("forecast_origin_date"))
    return wx.latest_common_origin(rows.where("forecast_origin_date is null"), rows)


@query("S24_load_contract_tables", """SELECT region, ts, y, month(ts) AS local_month, isodow(ts) - 1 AS local_dow, dayofyear(ts) AS local_doy FROM minutely
    QUALIFY row_number() OVER (PARTITION BY region, ts ORDER BY seq) = 1""", nums="y")
def s24(spark, folder):
    d = clean.dedupe_first(v.minute(spark, folder))
    return d.select("region", "ts", "y", F.month("ts").alias("local_month"), F.weekday("ts").alias("local_dow"),
                    F.dayofyear("ts").alias("local_doy"))


@query("S25_convention_lookup", """SELECT region, CASE WHEN region = 'purchase' THEN 'interval_beginning' ELSE 'interval_ending' END AS convention,
    count(*) AS rows FROM readings GROUP BY region""")
def s25(spark, folder):
    from loadtide.config import LABEL
    r = v.readings(spark, folder).groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    label = lookup(lookup("region", v.MARKET_OF), LABEL)
    details = r.withColumn("detail", F.concat(label, F.lit("-labelled bins (closed=x)")))
    return details.select("region", "rows", F.concat(
        F.lit("interval_"), F.regexp_extract("detail", r"^(ending|beginning)-labelled", 1)).alias("convention"))


@query("S26_rounded_sink", """SELECT region, count(*) AS rows, sum(round(y + 1e-9, 4)) AS total FROM grid_a GROUP BY region""", nums="total")
def s26(spark, folder):
    path = scratch_path(spark, "sink")
    src.write_rounded(v.grid_a(spark, folder).select("region", "hh", F.round("y", 8).alias("y")), path)
    return (spark.read.parquet(path).groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("total")))
