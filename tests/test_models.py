"""Fits, maps and frames of many series and origins at once, against plain versions."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadtide.config import FEATURES_A
from loadtide.operators import features as ft
from loadtide.operators import least_squares as lsq
from loadtide.operators.intervals import at_origins, until_origin
from loadtide.plans import frames, models, origin_maps, trees

ORIGINS = "region string, origin_hh long"


def half_hours(spark, days=40, sentinel=None, seed=2):
    """Two series, one with gaps; from ``sentinel`` on a value that must not be seen."""
    rng = np.random.default_rng(seed)
    rows = []
    for region, level in (("a", 100.0), ("b", 1e7)):
        for h in range(days * 48):
            y = level + 10 * np.sin(h / 48 * 2 * np.pi) + rng.normal()
            y = None if region == "b" and rng.random() < 0.02 else 1e12 if sentinel is not None and h >= sentinel else float(y)
            rows.append((region, 946_080 + h, y))                    # 2023-12-20 on: over a year end
    df = spark.createDataFrame(rows, "region string, hh long, y double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("hh") * 1800).cast("timestamp_ntz"))


def close(left, right, keys):
    left, right = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (left, right))
    assert len(left) == len(right) > 0
    for c in right.columns:
        if right[c].dtype.kind == "f":
            np.testing.assert_allclose(left[c].astype(float), right[c], rtol=1e-7, atol=1e-6, err_msg=c)
        else:
            assert (left[c] == right[c]).all(), c


def test_maps_equal_those_of_copied_history(spark):
    """Origins inside a day, at a day's start and one before any row: every map is that of the rows before its origin."""
    cal = ft.civil_calendar(half_hours(spark)).repartition(5).cache()
    asked = [(r, 946_080 + h) for r in "ab" for h in (-3, 17, 48 * 3, 48 * 3 + 1, 48 * 20 + 30, 48 * 39)] + [("none", 946_100)]
    origins = spark.createDataFrame(asked, ORIGINS)
    rows = origin_maps.known_rows(cal, origins)
    past = cal.join(origins, "region").where("hh < origin_hh AND y IS NOT NULL")
    by = ["region", "origin_hh"]
    half = origin_maps.halfhour_map(rows, origins)
    close(half.drop("history_rows", "history_end"), ft.halfhour_profile(past, by), [*by, "month", "half_hour_index"])
    close(origin_maps.dow_halfhour_map(rows, origins), ft.dow_halfhour_profile(past, by), [*by, "month", "day_of_week", "half_hour_index"])
    close(origin_maps.monthly_map(rows, origins), ft.daily_profile(past, by), [*by, "month"])
    got = {tuple(r[c] for c in by): (r["history_rows"], r["history_end"], r["years_used"]) for r in origin_maps.history_map(rows, origins).collect()}
    want = past.groupBy(*by).agg(F.count("*").alias("n"), F.max("hh").alias("e"), F.array_join(F.array_sort(F.collect_set("year")), ",").alias("t")).collect()
    assert got == {tuple(r[c] for c in by): (r["n"], r["e"], r["t"]) for r in want}
    stats = origin_maps.scaler(cal, origins, ["y"])
    want = cal.join(origins, "region").where("hh < origin_hh").groupBy(*by).agg(F.max("hh").alias("fitted_until_hh"), F.count("*").alias("fitted_rows"), F.avg("y").alias("y_mean"), F.stddev_samp("y").alias("y_std"))
    close(stats, want, by)


def test_intervals_merge_and_refuse_null_keys(spark):
    df = spark.createDataFrame([("a", h, h * 1.0, h % 2) for h in range(10)] + [("b", 1, 5.0, None)], "region string, hh long, x double, c long")
    o = spark.createDataFrame([("a", 3), ("a", 7), ("a", 7), ("b", 9), ("z", 1)], ORIGINS)
    states = until_origin(df, o, ["region"]).groupBy("region", "c", "_until").agg(F.sum("x").alias("s"), F.max("x").alias("m"), F.collect_list("hh").alias("l"))
    got = {(r["region"], r["origin_hh"], r["c"]): (r["s"], r["m"], sorted(r["l"])) for r in at_origins(states, o, ["region"], ["c"], {"s": "sum", "m": "max", "l": "list"}).collect()}
    assert got == {("a", 3, 0): (2.0, 2.0, [0, 2]), ("a", 3, 1): (1.0, 1.0, [1]), ("a", 7, 0): (12.0, 6.0, [0, 2, 4, 6]), ("a", 7, 1): (9.0, 5.0, [1, 3, 5]), ("b", 9, None): (5.0, 5.0, [1])}
    with pytest.raises(Exception, match="NULL in key"):
        until_origin(df.withColumn("region", F.nullif("region", F.lit("b"))), o, ["region"]).count()


def test_least_squares_of_many_groups(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        n = [400, 3, 60][g % 3]
        x = rng.normal(size=(n, 3)) * [1, 50, 1] + [0, 1e5, 0]
        if g == 5:
            x[:, 2] = 2 * x[:, 0]
        y = 1e6 + 3 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n)
        rows += [(f"g{g}", i, *map(float, v), None if i % 50 == 49 else float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "region string, hh long, x0 double, x1 double, x2 double, y double").repartition(7)
    o = spark.createDataFrame([(f"g{g}", h) for g in range(12) for h in (40, 300, 1000)], ORIGINS)
    terms, data = ["x0", "x1", "x2"], pd.DataFrame(rows, columns=["region", "hh", "x0", "x1", "x2", "y"]).dropna()
    got = lsq.fit_all(df, ["region"], "y", terms, o).toPandas()
    assert len(got) == 12 + 8 + 4                                     # origins with rows between them and the one before
    for _, r in got.iterrows():
        d = data[(data["region"] == r["region"]) & (data["hh"] < r["origin_hh"])]
        assert r["n"] == len(d)
        if len(d) <= 4:
            assert r["status"] == "TOO_FEW_ROWS" and r["coefficients"] is None
            continue
        a = np.column_stack([np.ones(len(d)), d[terms]])
        b, *_ = np.linalg.lstsq(a, d["y"], rcond=None)
        rss = ((d["y"] - a @ b) ** 2).sum()
        np.testing.assert_allclose(r["mse"], rss / len(d), rtol=1e-4)
        assert r["status"] == ("RANK_DEFICIENT" if r["region"] == "g5" else "OK")
        if r["region"] != "g5":
            np.testing.assert_allclose([c["coefficient"] for c in r["coefficients"]], b, rtol=1e-4, atol=1e-3)
            np.testing.assert_allclose(r["AIC"], len(d) * (np.log(2 * np.pi) + np.log(rss / len(d)) + 1) + 2 * 5, rtol=1e-5)
    with pytest.raises(Exception, match="NULL in key"):
        lsq.fit_all(df.withColumn("region", F.lit(None).cast("string")), ["region"], "y", terms).count()
    assert lsq.fit_all(df.limit(0), ["region"], "y", terms, o).count() == 0


def test_lags_see_positions_and_not_rows(spark):
    df = spark.createDataFrame([("a", p, float(p)) for p in (1, 2, 4, 5, 8)], "region string, pos long, y double")
    got = {r["pos"]: (r["y_lag1"], r["y_lag3"]) for r in lsq.lagged(df, ["region"], "pos", {"y": [1, 3]}).collect()}
    assert got == {1: (None, None), 2: (1.0, None), 4: (None, 1.0), 5: (4.0, 2.0), 8: (None, 5.0)}


def plain_tree(x, y, depth, min_leaf):
    """Exhaustive search over features and values; ties as in the module."""
    def grow(rows, d):
        best = None
        if d < depth:
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= v]
                    right = rows[x[rows, f] > v]
                    if min(len(left), len(right)) >= min_leaf:
                        t = y[rows].sum() ** 2 / len(rows)
                        gain = round(y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - t, 9)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, f, v)
        if best is None:
            return {int(i): y[rows].mean() for i in rows}
        _, f, v = best
        return grow(rows[x[rows, f] <= v], d + 1) | grow(rows[x[rows, f] > v], d + 1)
    return grow(np.arange(len(y)), 0)


def tree_rows(spark, groups=4, n=300):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(groups):
        x = rng.integers(0, 20, (n, 3)).astype(float)
        y = (x[:, 0] > 7 + g) * 5.0 + (x[:, 1] > 3) * x[:, 0] + rng.normal(size=n) + 1000 * g
        rows += [(f"g{g}", i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return rows, spark.createDataFrame(rows, "region string, hh long, x0 double, x1 double, x2 double, y double").repartition(6)


def test_a_tree_per_group_is_that_of_exhaustive_search(spark):
    rows, df = tree_rows(spark)
    names = ["x0", "x1", "x2"]
    made, groups, status = trees.fit_forest(df, ["region"], names, trees=1, depth=3, min_leaf=7, features_a_split=3, bootstrap=False, min_rows=10)
    got = trees.predict(df, trees.packed(made, groups, ["region"], names, True), ["region"], names).toPandas()
    for region, d in got.sort_values("hh").groupby("region"):
        y = d["y"].to_numpy()
        want = plain_tree(d[names].to_numpy(), y - y.mean(), 3, 7)
        np.testing.assert_allclose(d["prediction"], [want[i] + y.mean() for i in range(len(d))], rtol=1e-9)
    assert {r["status"] for r in status.collect()} == {"MODEL_READY"}
    share = trees.importance(made, ["region"], names).toPandas()
    assert np.allclose(share.groupby("region")["importance"].sum(), 1) and len(share) == 12


def test_forests_and_boosts_learn_and_leave_short_groups_out(spark):
    rows, df = tree_rows(spark, groups=2, n=600)
    df = df.unionByName(spark.createDataFrame([("short", 1, 1.0, 2.0, 3.0, 4.0), ("g0", 9999, None, 1.0, 1.0, 5.0)], df.schema))
    names = ["x0", "x1", "x2"]
    plans = []
    for kind in ("forest", "boost"):
        fit = trees.fit_forest if kind == "forest" else trees.fit_boost
        made, groups, status = fit(df, ["region"], names, min_rows=50, **({"trees": 12, "depth": 6} if kind == "forest" else {"rounds": 12, "depth": 3, "step": 0.3}))
        out = trees.predict(df, trees.packed(made, groups, ["region"], names, kind == "forest"), ["region"], names)
        got = out.toPandas()
        assert len(got) == 1202 and got.loc[got["region"] == "short", "prediction"].isna().all() and got.loc[got["hh"] == 9999, "prediction"].isna().all()
        known = got[got["prediction"].notna()]
        for _, d in known.groupby("region"):
            assert ((d["y"] - d["prediction"]) ** 2).mean() < 0.2 * d["y"].var()
        assert {(r["region"], r["status"]) for r in status.collect()} == {("g0", "MODEL_READY"), ("g1", "MODEL_READY"), ("short", "MODEL_FAILED")}
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    with pytest.raises(Exception, match="NULL in key"):
        trees.fit_forest(df.withColumn("region", F.lit(None).cast("string")), ["region"], names, min_rows=1)
    empty, groups, _ = trees.fit_forest(df.limit(0), ["region"], names, trees=2, depth=2)
    assert empty.count() == 0


def test_nothing_behind_an_origin_reaches_a_frame(spark):
    """Values of 1e12 from the first origin on: no training or horizon feature of that origin may hold them."""
    origin = 946_080 + 48 * 30
    grid = half_hours(spark, sentinel=48 * 30).where("region = 'a'")
    o = spark.createDataFrame([("a", origin, origin + 95)], "region string, origin_hh long, end_hh long")
    holidays = spark.createDataFrame([(pd.Timestamp("2024-01-01").to_pydatetime(), "x", 1)], "date timestamp_ntz, holiday_name string, is_public_holiday int")
    base = frames.base_frame(grid, holidays)
    train, ahead = frames.training_frame(base, o), frames.horizon_frame(base, o, holidays)
    assert train.columns == ["region", "origin_hh", "hh", "y", *FEATURES_A] and ahead.columns == ["region", "origin_hh", "hh", *FEATURES_A]
    assert train.count() == 48 * 30 and ahead.count() == 96
    for frame in (train, ahead):
        assert frame.select(F.greatest(*[F.max(F.abs(F.col(c).cast("double"))) for c in FEATURES_A]).alias("m")).first()["m"] < 1e8
    day = {r["is_public_holiday"]: r["n"] for r in train.groupBy("is_public_holiday").agg(F.count("*").alias("n")).collect()}
    assert day[1] == 48
    assert {r["nulls"] for r in frames.checked(ahead, ["lag_48", "previous_day_mean"]).collect()} == {96}


def test_recursion_refuses_a_null_key(spark):
    state = spark.createDataFrame([("a", h, 1.0) for h in range(800)], "region string, hh long, y double")
    o = spark.createDataFrame([("a", 700, 747), (None, 700, 747)], "region string, origin_hh long, end_hh long")
    known = o.select(F.explode(F.sequence("origin_hh", "end_hh")).alias("hh"), F.lit("a").alias("region"))
    with pytest.raises(Exception, match="NULL in key"):
        models.recursive_forecast(state, known, state.groupBy("region").agg(F.lit(1.0).alias("med_lag_48")), ["region"], ["lag_48"],
                                  lambda rows: rows.withColumn("prediction", F.col("lag_48")), o)


def test_spectrum_in_two_steps_is_the_whole_transform(spark):
    """Lengths with large prime factors, a missing position, two series: power, smoothing and peaks against one transform in memory."""
    from loadtide.operators.spectrum import padded, peaks, spectrum
    rng = np.random.default_rng(12)
    assert [padded(n) for n in (1, 7, 97, 1024, 2399)] == [(1, 1), (8, 2), (100, 10), (1024, 32), (2400, 48)]
    data = {"a": 20 + np.sin(2 * np.pi * np.arange(397) / 7) + rng.normal(size=397) * 0.1, "b": 1e3 + 0.5 * np.arange(601) + rng.normal(size=601)}
    rows = [(r, 100 + t, float(v), float(v) + float(rng.normal())) for r, y in data.items() for t, v in enumerate(y) if (r, t) != ("b", 77)]
    df = spark.createDataFrame(rows, "region string, pos long, y double, x double").repartition(5)
    spec = spectrum(df, values=("y", "x"), spans=(5, 3))
    got = spec.toPandas().sort_values(["region", "k"])
    for region, d in got.groupby("region"):
        mine = pd.DataFrame([r for r in rows if r[0] == region], columns=["region", "pos", "y", "x"])
        size = padded(len(data[region]))[0]
        z = []
        for c in ("y", "x"):
            full = np.zeros(size)
            line = np.polyfit(mine["pos"], mine[c], 1)
            full[mine["pos"] - 100] = mine[c] - np.polyval(line, mine["pos"])
            z.append(np.fft.fft(full))
        n = len(data[region])
        parts = [abs(z[0]) ** 2 / n, abs(z[1]) ** 2 / n, z[0] * z[1].conj() / n]
        low = np.arange(1, size // 2 + 1)
        np.testing.assert_allclose(d["power"], parts[0][low], rtol=1e-6, atol=1e-9)
        smooth = []
        for p in parts:
            p = p.copy()
            p[0] = (p[1] + p[-1]) / 2
            for m in (2, 1):
                w = np.r_[0.5, np.ones(2 * m - 1), 0.5] / (2 * m)
                p = sum(w[j + m] * np.roll(p, -j) for j in range(-m, m + 1))
            smooth.append(p)
        np.testing.assert_allclose(d["smoothed"], smooth[0][low].real, rtol=1e-6)
        np.testing.assert_allclose(d["coherence"], (abs(smooth[2]) ** 2 / (smooth[0] * smooth[1]))[low].real, rtol=1e-6)
    top = {r["region"]: r["period"] for r in peaks(spec, top=1).collect()}
    assert abs(top["a"] - 7) < 0.1
    assert spectrum(df.where("pos < 104"), spans=(25, 25)).where("smoothed IS NOT NULL").count() == 0 and spectrum(df.limit(0)).count() == 0
