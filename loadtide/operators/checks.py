"""Check rows: (test_group, region, check, result, detail), each group from one aggregate."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK_COLUMNS = ["test_group", "region", "check", "result", "detail"]


def text(*parts) -> Column:
    """Concatenated detail; NULL parts print as 'null'."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null"))
                      for p in parts])


def check(name: str, ok: Column, detail: Column, otherwise: str = "FAIL") -> Column:
    result = F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(otherwise)
    return F.struct(F.lit(name).alias("check"), result.alias("result"), detail.alias("detail"))


def as_rows(facts: DataFrame, group: str, checks: list[Column], region="region") -> DataFrame:
    """Unfold one facts row per series into its check rows."""
    return facts.select(F.lit(group).alias("test_group"), F.col(region).alias("region"),
                        F.inline(F.array(*checks)))


def readiness(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """READY, READY_WITH_WARNINGS or NOT_READY from check rows and coverage facts.

    ``facts`` has region, weather_pct, forecast_available, horizon_holidays.
    """
    fail = F.col("result") == "FAIL"
    critical = fail & F.substring("test_group", 1, 1).isin("1", "2", "3", "6")
    agg = rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("checks_run"), F.count_if(F.col("result") == "PASS").alias("checks_passed"),
        F.count_if(fail).alias("failures"), F.count_if(critical).alias("critical_failures"))
    j = agg.join(facts, "region", "left")
    status = (F.when(F.coalesce("horizon_holidays", F.lit(0)) == 0, "NOT_READY")
              .when(F.col("critical_failures") > 0, "NOT_READY")
              .when((F.col("failures") > 0) | (F.col("weather_pct") == 0) | (F.col("forecast_available") == 0),
                    "READY_WITH_WARNINGS").otherwise("READY"))
    return j.withColumn("status", status)


def roll_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("result") == "PASS").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.concat_ws("; ", F.array_sort(F.collect_set(F.when(F.col("result") != "PASS", F.col("check")))))
        .alias("not_passed"))
