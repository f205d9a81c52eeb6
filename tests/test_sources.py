import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadtide.functions.clock import at
from loadtide.sources import holidays as hol
from loadtide.sources import readings as src
from loadtide.sources import weather as wx


def test_archive_and_native_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("REGION,SETTLEMENTDATE,TOTALDEMAND,RRP,PERIODTYPE\nN1,2024/01/01 00:05:00,1.5,9,TRADE\nN1,bad,2,9,TRADE\n")
    (tmp_path / "b.csv").write_text("REGION,SETTLEMENTDATE,TOTALDEMAND,PERIODTYPE,SOURCE,SOURCE_INTERVAL_MIN\nWA,2024-01-01 00:05:00,3,ACTUAL,X,5\n")
    a, b = src.read_archive(spark, str(tmp_path / "a.csv")), src.read_native(spark, str(tmp_path / "b.csv"))
    both = src.union_sources(a, b).toPandas()
    assert len(both) == 3 and both["ts"].isna().sum() == 1 and both["source_interval_min"].notna().sum() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456), ("b", 2.0)], "region string, y double")
    src.write_rounded(df, str(tmp_path / "out"), fmt="csv")
    assert sorted(r["_c0"] for r in spark.read.csv(str(tmp_path / "out")).collect()) == ["1.2346", "2.0"]
    for pull in ("p1", "p2"):
        src.split_snapshot(df, str(tmp_path / "snap"), pull)
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 4
    wx.write_vintage(df.withColumn("retrieved_at", F.lit("r1")), str(tmp_path / "v"))
    wx.write_vintage(df.withColumn("retrieved_at", F.lit("r2")), str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    assert v.count() == 4 and v.agg(F.max("retrieved_at")).first()[0] == "r2"


def test_html_files_are_rejected_whole(spark):
    rows = [("good", 0, "a"), ("good", 1, "<html"), ("bad", 0, "  <!DOCTYPE html>"), ("bad", 1, "x")]
    out = src.reject_html(spark.createDataFrame(rows, "path string, line_no int, line string"))
    assert out.count() == 2 and {r["path"] for r in out.collect()} == {"good"}


def test_month_files_end_to_end(spark, tmp_path):
    head = "REGION,SETTLEMENTDATE,TOTALDEMAND,RRP,PERIODTYPE"
    (tmp_path / "m1.csv").write_text(f"{head}\nN1,2024/01/31 23:55:00,1,0,T\nN1,bad,1,0,T\n")
    (tmp_path / "m2.csv").write_text(f"{head}\nN1,2024/01/31 23:55:00,2,0,T\nN1,2024/02/01 00:00:00,3,0,T\n")
    (tmp_path / "m3.csv").write_text("<html><body>\nN1,2024/03/01 00:00:00,9,0,T\n</body></html>\n")
    lines = src.read_month_files(spark, str(tmp_path / "*.csv"), head)
    rows = lines.select(F.struct("path", "line_no").alias("seq"), F.from_csv("line", "region string, settlement_text string, y double, rrp double, kind string").alias("r"))
    got = src.merge_months(rows.select("seq", "r.*")).toPandas().sort_values("ts")
    assert got["settlement_text"].tolist() == ["2024/01/31 23:55:00", "2024/02/01 00:00:00"] and got["y"].tolist() == [2.0, 3.0]


def test_json_payloads_take_the_longest_list(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"meta": [{"k": 1}],\n "data": {"rows": [{"k": 5}, {"k": 6}]}}')
    (tmp_path / "e.json").write_text('{"meta": [{"k": 7}], "data": {}}')
    kind = "array<struct<k:bigint>>"
    docs = src.read_json_payloads(spark, str(tmp_path / "*.json"), f"meta {kind}, data struct<rows:{kind}>")
    best = src.largest_record_list("p", {"meta": (F.col("p.meta"), kind), "rows": (F.col("p.data.rows"), kind)})
    assert sorted(r["k"] for r in docs.select(F.inline(best)).collect()) == [5, 6, 7]


@pytest.mark.parametrize("text,want", [("2023-10-01 08:05:00", "2023-10-01 08:05"), ("2023/1/2", "2023-01-02 00:00"), ("03/04/2023 09:30", "2023-04-03 09:30"),
                                       ('"31-12-2022 23:30:00"', "2022-12-31 23:30"), ("2023-10-01T08:05:00", "2023-10-01 08:05"), ("nonsense", None)])
def test_mixed_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(src.mixed_date("s").alias("t")).first()["t"]
    assert (str(got)[:16] if got else None) == want


def test_unresolvable_columns_raise(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    with pytest.raises(ValueError):
        src.find_timestamp(df, 30)
    with pytest.raises(ValueError):
        src.find_demand(df)


def test_parallel_arrays_must_match(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "a array<int>, b array<int>")
    assert src.open_block(df, ["a", "b"]).count() == 2
    bad = spark.createDataFrame([([1, 2], [3])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="unequal length"):
        src.open_block(bad, ["a", "b"]).collect()


def test_priority_merge(spark):
    t = pd.Timestamp("2024-01-02").to_pydatetime()
    new = spark.createDataFrame([("WA", t, 1.0, "FEED_WEM_2024", 1), ("WA", t, 2.0, "FEED_DAILY", 0)], "region string, ts timestamp_ntz, y double, source string, seq long")
    old = new.limit(0)
    got = src.merge_by_priority(old, new, at("2024-01-01 00:00:00"), at("2024-02-01 00:00:00")).collect()
    assert [r["y"] for r in got] == [2.0]


def test_weather_mean_only_when_absent(spark):
    rows = [("a", "2024-01-01", "10", "20", "99", "1", 1), ("a", "2024-01-02", "10", "20", None, "1", 1), ("b", "2024-01-01", "10", "20", None, "x", 1), ("b", "2024-01-01", "0", "10", None, "2", 2)]
    df = spark.createDataFrame(rows, "region string, date string, temp_min_c string, temp_max_c string, temp_mean_c string, rainfall_mm string, seq long")
    got = {(r["region"], str(r["date"])[:10]): (r["temp_mean_c"], r["rainfall_mm"]) for r in wx.daily_weather(df).collect()}
    assert got == {("a", "2024-01-01"): (99.0, 1.0), ("a", "2024-01-02"): (None, 1.0), ("b", "2024-01-01"): (5.0, 2.0)}


def test_holiday_extension(spark, tmp_path):
    (tmp_path / "h.csv").write_text("date,is_public_holiday,holiday_name\n2024-01-01T00:00:00,1,New Year\n")
    acquired = hol.read_holidays(spark, str(tmp_path / "h.csv"))
    extra = spark.createDataFrame([(pd.Timestamp(d).to_pydatetime(), 1, n) for d, n in (("2024-01-01", "x"), ("2024-12-25", "y"), ("2025-12-25", "z"))], hol.SCHEMA)
    got = hol.covering(acquired, extra, at("2025-01-01 00:00:00")).toPandas()
    assert got["holiday_name"].tolist() == ["New Year", "y"] and got["provenance"].tolist() == ["acquired", "generated"]
