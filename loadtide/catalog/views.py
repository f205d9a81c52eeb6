"""Views of the given tables in the shape of interval readings, daily series and calendars."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.functions.clock import day_of
from loadtide.operators.evaluate import error_metrics, with_skill
from loadtide.operators.features import civil_calendar
from loadtide.operators.clean import dedupe_last
from loadtide.operators.regular import resample_mean  # noqa: F401  (used by the query modules)
from loadtide.plans.forecast import naive_forecasts, with_actual
from loadtide.plans.prepare import half_hour_bins, half_hour_grid
from loadtide.sources.holidays import fixed_dates

# Holiday dates of the test calendar.
HOLIDAY_DATES = {"01-01": "New Year", "01-26": "January Day", "04-25": "April Day",
                 "12-25": "Christmas", "12-26": "Boxing Day"}
# Market region that lends its clocks and label convention to each event type.
MARKET_OF = {"click": "NSW1", "view": "QLD1", "signup": "SA1", "error": "TAS1", "purchase": "WA"}


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_series(known: str):
    """Series key of a merged series. Tied to a column, so the key stays a key in joins and windows."""
    return F.when(F.col(known).isNotNull(), "ALL")


def readings(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("region"), "ts", F.col("value").alias("y"), F.col("event_id").alias("seq"))


def minute(spark, folder) -> DataFrame:
    return readings(spark, folder).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))


def minute_last(spark, folder) -> DataFrame:
    return dedupe_last(minute(spark, folder))


def bins_a(spark, folder) -> DataFrame:
    """Filled half-hours per event type, written once."""
    return half_hour_bins(readings(spark, folder))


def grid_a(spark, folder) -> DataFrame:
    """One gappy half-hour series per event type."""
    return half_hour_grid(readings(spark, folder), zero_columns=["n_source_readings"])


def grid_b(spark, folder) -> DataFrame:
    """All events as one nearly dense half-hour series."""
    return half_hour_grid(readings(spark, folder).withColumn("region", one_series("ts")))


def cal_a(spark, folder) -> DataFrame:
    return civil_calendar(grid_a(spark, folder))


def cal_b(spark, folder) -> DataFrame:
    return civil_calendar(grid_b(spark, folder))


def _last_day(grid):
    last = grid.groupBy("region").agg(F.max("hh").alias("end_hh"))
    return last.withColumn("_d", ((F.col("end_hh") - F.col("end_hh") % 48) / 48).cast("long"))


def origin_one(grid: DataFrame) -> DataFrame:
    """One origin per series: 13 days before its last day, horizon to the end."""
    return _last_day(grid).select("region", ((F.col("_d") - 13) * 48).alias("origin_hh"), "end_hh")


def origin_many(grid: DataFrame) -> DataFrame:
    """Three origins per series, three days apart, a week of horizon each."""
    o = _last_day(grid).select("region", F.explode(F.array(*[F.lit(3 * k) for k in range(3)])).alias("_k"), "_d")
    return o.select("region", ((F.col("_d") - 13 + F.col("_k")) * 48).cast("long").alias("origin_hh"),
                    ((F.col("_d") - 13 + F.col("_k")) * 48 + 335).cast("long").alias("end_hh"))


def scored_many(grid: DataFrame) -> DataFrame:
    return with_actual(naive_forecasts(grid, origin_many(grid)), grid)


def scores(grid: DataFrame) -> DataFrame:
    """Naive scores per (region, model, origin), all READY."""
    return (error_metrics(scored_many(grid), ["region", "model", "origin_hh"])
            .withColumnRenamed("origin_hh", "origin").withColumn("status", F.lit("MODEL_READY")))


def skilled(grid: DataFrame) -> DataFrame:
    return with_skill(scores(grid), ["Naive48", "Naive336"])


def renamed(grid: DataFrame) -> DataFrame:
    """The naive scores under tree-model names, to exercise the choice rules."""
    return skilled(grid).withColumn("model", F.when(F.col("model") == "Naive48", "RandomForest_A")
                                    .otherwise("RandomForest_B"))


def ab_detail(grid: DataFrame) -> DataFrame:
    return scored_many(grid).withColumn(
        "family", F.when(F.col("model") == "Naive48", "MODEL_A").otherwise("MODEL_B"))


def daily_demand(spark, folder) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    return j.groupBy(F.col("r_name").alias("region"), F.col("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("demand"), F.max("o_totalprice").alias("peak"), F.count(F.lit(1)).alias("n"))


def daily_weather(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").alias("date")).agg(
        F.max("l_quantity").alias("temp_max_c"), F.min("l_quantity").alias("temp_min_c"),
        F.avg("l_quantity").alias("temp_mean_c"), (F.avg("l_discount") * 10).alias("rainfall_mm"))


def demand_temp(spark, folder) -> DataFrame:
    d, w = daily_demand(spark, folder), daily_weather(spark, folder)
    return d.join(w, "date").select("region", "date", (F.col("demand") / 1000).alias("demand"),
                                    F.col("temp_mean_c").alias("temp"), "rainfall_mm",
                                    F.month("date").alias("month"), F.year("date").alias("year"))


def calendar_span(spark, folder) -> DataFrame:
    both = (table(spark, folder, "orders").select(day_of("o_orderdate").alias("t"))
            .unionByName(table(spark, folder, "events").select(day_of("ts").alias("t"))))
    return both.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


def holidays(spark, folder) -> DataFrame:
    days = calendar_span(spark, folder).select(
        F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"), F.expr("interval 1 day"))).alias("date"))
    days = days.select(F.col("date").cast("timestamp_ntz"))
    return fixed_dates(days, HOLIDAY_DATES).withColumn("is_public_holiday", F.lit(1))
