"""Chunked windows must equal windows over the whole series, whatever the chunk."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.functions.clock import floor_div
from loadtide.operators.ordered import framed, keep_one, with_halo, with_neighbour, with_row_number
from loadtide.operators.quantiles import exact_median, exact_quantiles


def series(spark, n=400, seed=1, hot=0.7):
    rng = np.random.default_rng(seed)
    rows = [("hot" if rng.random() < hot else f"s{rng.integers(3)}", int(p), float(rng.normal())) for p in rng.permutation(n * 2)[:n]]
    return spark.createDataFrame(rows, "region string, hh long, y double")


@pytest.mark.parametrize("chunk", [16, 50, 10_000])
def test_framed_equals_plain_window(spark, chunk):
    df = series(spark)

    def build(w):
        return {"a": F.sum("y").over(w.rangeBetween(-15, -3)), "b": F.max("y").over(w.rangeBetween(0, 9)),
                "n": F.count("y").over(w.rangeBetween(-7, 7))}

    got = framed(df, ["region"], "hh", build, back=15, ahead=9, chunk=chunk).toPandas().sort_values(["region", "hh"]).reset_index(drop=True)
    w = W.partitionBy("region").orderBy("hh")
    want = df.withColumns(build(w)).toPandas().sort_values(["region", "hh"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_halo_copies_only_near_the_edge(spark):
    df = spark.range(100).select(F.lit("a").alias("region"), F.col("id").alias("hh"))
    out = with_halo(df, "hh", back=2, ahead=1, chunk=10)
    assert out.count() == 100 + 10 * 2 + 10 * 1
    assert out.where("_home").count() == 100
    with pytest.raises(ValueError):
        with_halo(df, "hh", back=11, chunk=10)


@pytest.mark.parametrize("chunk", [7, 64, 5_000])
def test_neighbours_cross_chunks(spark, chunk):
    df = series(spark)
    w = W.partitionBy("region").orderBy("hh")
    want = (df.withColumns({"p": F.lag("hh").over(w), "q": F.lead("y").over(w)}).toPandas().sort_values(["region", "hh"]).reset_index(drop=True))
    a = with_neighbour(df, ["region"], "hh", floor_div("hh", chunk), {"p": "hh"})
    b = with_neighbour(a, ["region"], "hh", floor_div("hh", chunk), {"q": "y"}, forward=False)
    got = b.toPandas().sort_values(["region", "hh"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)


@pytest.mark.parametrize("chunk", [7, 5_000])
def test_row_number_is_global(spark, chunk):
    df = series(spark)
    w = W.partitionBy("region").orderBy("hh")
    bad = (with_row_number(df, ["region"], [F.col("hh")], floor_div("hh", chunk), "k")
           .withColumn("want", F.row_number().over(w) - 1).where("k <> want"))
    assert bad.count() == 0


def test_keep_one_keeps_null_values_of_the_last_copy(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 1, None, 2), ("b", 1, 3.0, 1)], "region string, ts int, y double, seq int")
    rows = {r["region"]: r["y"] for r in keep_one(df, ["region", "ts"], "seq").collect()}
    assert rows == {"a": None, "b": 3.0}
    assert {r["region"]: r["y"] for r in keep_one(df, ["region", "ts"], "seq", last=False).collect()} == {"a": 1.0, "b": 3.0}


@pytest.mark.parametrize("n", [1, 2, 3, 182, 9_999, 10_000, 30_001])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.exponential(50, n), 2)
    y = np.where(rng.random(n) < 0.4, 7.0, x)          # one value holds 40% of the rows
    pdf = pd.DataFrame({"region": ["a"] * n + ["b"] * n, "y": np.concatenate([x, y])})
    probs = {"q0": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "q99": 0.99, "top": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["region"], "y", probs).toPandas().set_index("region")
    for name, v in (("a", x), ("b", y)):
        np.testing.assert_allclose(got.loc[name, list(probs)].to_numpy(float), np.quantile(v, list(probs.values())), rtol=1e-12)


def test_median_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0)], "region string, y double")
    assert exact_median(df, ["region"], "y").first()["median"] == 2.5


def test_average_ranks_match_pandas(spark):
    from loadtide.operators.quantiles import average_ranks
    rng = np.random.default_rng(2)
    y = np.where(rng.random(4000) < 0.35, 5.0, np.round(rng.normal(size=4000), 2))
    pdf = pd.DataFrame({"region": "a", "y": y})
    got = average_ranks(spark.createDataFrame(pdf), ["region"], "y").toPandas().set_index("y")["rank"]
    np.testing.assert_allclose(got.loc[y].to_numpy(), pdf["y"].rank().to_numpy())


def test_acf_and_ccf_match_direct_sums(spark):
    from loadtide.operators.stats import autocorrelation, cross_correlation
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([("a", i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "region string, pos long, x double, y double")
    acf = autocorrelation(df, 5).toPandas().set_index("lag")["acf"]
    ccf = cross_correlation(df, "x", "y", 3).toPandas().set_index("lag")["ccf"]
    dx, dy = x - x.mean(), y - y.mean()
    for k in range(6):
        assert np.isclose(acf[k], (dy[k:] * dy[:300 - k]).sum() / (dy * dy).sum())
    for k in range(-3, 4):
        pairs = [(dx[t + k], dy[t]) for t in range(300) if 0 <= t + k < 300]
        assert np.isclose(ccf[k], sum(a * b for a, b in pairs) / 300 / (x.std() * y.std()))


def test_quantiles_of_small_tied_and_large_groups_by_one_path(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"region": k, "y": v}) for k, v in {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 50 + [1.0], "small": rng.normal(size=37), "large": rng.exponential(size=30_000).round(3)}.items()]
    pdf = pd.concat(frames)
    probs = {"lo": 0.0, "q": 0.1, "m": 0.5, "hi": 0.997, "top": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["region"], "y", probs).toPandas().set_index("region")
    for k, g in pdf.groupby("region"):
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), np.quantile(g["y"], list(probs.values())), rtol=1e-12)


def test_null_keys_raise(spark):
    import pytest
    from loadtide.operators.ordered import with_row_number
    df = spark.createDataFrame([("a", 1, 1.0), (None, 2, 2.0)], "region string, hh long, y double")
    for call in (lambda: exact_median(df, ["region"], "y"), lambda: with_row_number(df, ["region"], ["hh"], F.lit(0))):
        with pytest.raises(Exception, match="NULL in key column region"):
            call().collect()
