"""Holiday calendars."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "date timestamp_ntz, is_public_holiday int, holiday_name string"


def read_holidays(spark, path) -> DataFrame:
    return spark.read.schema(SCHEMA).csv(path, header=True)


def day_table(spans: DataFrame, listed: DataFrame, lo: str, hi: str, keys=()) -> DataFrame:
    """Every day of the span with a 0/1 flag from a holiday list."""
    days = spans.select(*keys, F.explode(F.sequence(F.to_date(lo), F.to_date(hi), F.expr("interval 1 day"))).alias("date"))
    days = days.withColumn("date", F.col("date").cast("timestamp_ntz"))
    marks = listed.select(*keys, "date", "holiday_name").distinct()
    return (days.join(marks, [*keys, "date"], "left")
            .withColumns({"is_public_holiday": F.col("holiday_name").isNotNull().cast("int"),
                          "holiday_name": F.coalesce("holiday_name", F.lit(""))}))


def fixed_dates(dates: DataFrame, table: dict, date="date") -> DataFrame:
    """Holidays of a month-day table (constant, as a map literal) among given dates."""
    from loadtide.functions.clock import lookup
    name = lookup(F.date_format(date, "MM-dd"), table)
    return dates.select(date, name.alias("holiday_name")).where("holiday_name is not null")


def covering(acquired: DataFrame, supplement: DataFrame, through, keys=()) -> DataFrame:
    """Acquired rows, then supplementary ones after the last acquired date through the horizon end."""
    last = acquired.groupBy(*keys).agg(F.max("date").alias("_last"))
    extra = supplement.join(last, list(keys)) if keys else supplement.join(F.broadcast(last))  # one row
    extra = extra.where((F.col("date") > F.col("_last")) & (F.col("date") <= through)).drop("_last")
    return (acquired.withColumn("provenance", F.lit("acquired"))
            .unionByName(extra.withColumn("provenance", F.lit("generated"))))
