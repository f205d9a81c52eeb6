"""Streams over several files: late rows, rows late but within the delay, and the batch rule as the measure."""
import os
from datetime import datetime, timedelta

import pytest

from loadtide.operators.clean import dedupe_last
from loadtide.streaming import live

START = datetime(2024, 1, 1)


@pytest.fixture
def batches(spark, tmp_path):
    """Three files, oldest first. Minutes since START, value, order."""
    parts = [[(0, 1.0, 1), (1, 2.0, 2), (90, 3.0, 3)],
             [(60, 4.0, 4), (1, 99.0, 5), (90, 5.0, 6), (200, 6.0, 7)],        # minute 1 again, in the batch right after the watermark moved: still in time
             [(150, 7.0, 8), (200, 8.0, 10), (200, 9.0, 9), (1, 77.0, 12), (400, 1.0, 11)]]   # and once more, behind the watermark
    for i, rows in enumerate(parts):
        one = spark.createDataFrame([("a", START + timedelta(minutes=m), y, s) for m, y, s in rows], "region string, ts timestamp_ntz, y double, seq long").coalesce(1)
        one.write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            path = tmp_path / "in" / name
            if name.startswith("part") and os.path.getmtime(path) > 1_600_000_000:
                os.utime(path, (1_500_000_000 + i * 60,) * 2)
    return parts, str(tmp_path / "in")


def minutes(df, *columns):
    return sorted((int((r["ts"] - START).total_seconds() // 60), *[r[c] for c in columns]) for r in df.collect())


def test_keep_last_equals_the_batch_rule_but_for_late_rows(spark, batches):
    parts, folder = batches
    got = live.run_available(live.stream_keep_last(live.file_stream(spark, folder, "part-*", 1), "1 hour"), "kept")
    # Emitted up to minute 340. Minute 1 of the third file is late and lost; minutes 60 and 150 are late within the delay and stay.
    assert minutes(got, "y", "seq") == [(0, 1.0, 1), (1, 99.0, 5), (60, 4.0, 4), (90, 5.0, 6), (150, 7.0, 8), (200, 8.0, 10)]
    timely = spark.createDataFrame([("a", START + timedelta(minutes=m), y, s) for i, p in enumerate(parts) for m, y, s in p if (i, m) != (2, 1) and m <= 340],
                                   "region string, ts timestamp_ntz, y double, seq long")
    assert minutes(got, "y", "seq") == minutes(dedupe_last(timely), "y", "seq")


def test_first_copies_and_half_hour_means_drop_late_rows(spark, batches):
    _, folder = batches
    stream = live.file_stream(spark, folder, "part-*", 1)
    assert minutes(live.run_available(live.stream_dedupe(stream), "first"), "seq") == [(0, 1), (1, 2), (60, 4), (90, 3), (150, 8), (200, 7), (400, 11)]
    means = live.run_available(live.stream_half_hour_mean(live.file_stream(spark, folder, "part-*", 1)), "means")
    assert minutes(means, "y", "n_source_readings") == [(0, 34.0, 3), (60, 4.0, 1), (90, 4.0, 2), (150, 7.0, 1), (180, pytest.approx(23 / 3), 3)]
