"""Research statistics: moving averages, correlograms, spectra, regression by normal equations."""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadtide.operators.ordered import framed, require_keys

KEYS = ["region"]


def moving_average(df: DataFrame, window: int = 10, keys=KEYS, pos="pos", value="y", centred: bool = True) -> DataFrame:
    """Full-window mean; centred windows of even length reach one further forward."""
    lo = -((window - 1) // 2) if centred else -(window - 1)
    hi = window // 2 if centred else 0

    def build(w):
        frame = w.rangeBetween(lo, hi)
        return {"moving_average": F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))}

    return framed(df, keys, pos, build, back=-lo, ahead=hi)


def _lag_sums(dev: DataFrame, left: str, right: str, lags, keys, pos) -> DataFrame:
    """Per lag, the sum of left[t] * right[t - lag] on gap-free positions: one window pass, one aggregate row per series."""
    names = {lag: f"_p{i}" for i, lag in enumerate(lags)}

    def build(w):
        return {n: F.col(left) * (F.lag(right, lag) if lag >= 0 else F.lead(right, -lag)).over(w) for lag, n in names.items()}

    prod = framed(dev, keys, pos, build, back=max(max(lags), 0), ahead=max(-min(lags), 0))
    sums = prod.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names.values()])
    pairs = F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(n).alias("_sum")) for lag, n in names.items()])
    return sums.select(*keys, F.inline(pairs))


def autocorrelation(df: DataFrame, max_lag: int, keys=KEYS, pos="pos", value="y") -> DataFrame:
    """ACF to ``max_lag``: divides by n and the overall variance."""
    df = require_keys(df, list(keys))
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"),
                                  F.var_pop(value).alias("_v"))
    dev = df.join(stats, keys).select(*keys, pos, (F.col(value) - F.col("_m")).alias("_d"))
    return (_lag_sums(dev, "_d", "_d", range(max_lag + 1), keys, pos).join(stats, keys)
            .select(*keys, "lag", F.try_divide(F.col("_sum") / F.col("_n"), F.col("_v")).alias("acf")))


def cross_correlation(df: DataFrame, x: str, y: str, max_lag: int, keys=KEYS, pos="pos") -> DataFrame:
    """CCF at -K..K: x[t + lag] with y[t], divided by n and both deviations."""
    df = require_keys(df, list(keys))
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count(F.lit(1)).alias("_n"),
                                  (F.stddev_pop(x) * F.stddev_pop(y)).alias("_s"))
    dev = df.join(stats, keys).select(*keys, pos, (F.col(x) - F.col("_mx")).alias("_dx"), (F.col(y) - F.col("_my")).alias("_dy"))
    return (_lag_sums(dev, "_dx", "_dy", range(-max_lag, max_lag + 1), keys, pos).join(stats, keys)
            .select(*keys, "lag", F.try_divide(F.col("_sum") / F.col("_n"), F.col("_s")).alias("ccf")))


def box_pierce(acf: DataFrame, n: DataFrame, lag: int, keys=KEYS) -> DataFrame:
    """Q = n * sum of squared autocorrelations to ``lag`` (statistic only)."""
    q = acf.where((F.col("lag") >= 1) & (F.col("lag") <= lag)).groupBy(*keys).agg(
        F.sum(F.col("acf") * F.col("acf")).alias("_s"))
    return q.join(n, keys).select(*keys, (F.col("n") * F.col("_s")).alias("Q"))


def power_at(df: DataFrame, periods: dict, keys=KEYS, pos="pos", values: list[str] = ("y",), spread: int = 0) -> DataFrame:
    """Power of each demeaned series at named periods (name -> length in steps): one aggregate of sums with sines and cosines.

    With two values also the cross-spectrum; ``spread`` adds the frequencies within so many Fourier steps (1/n) of each. Columns:
    keys, period, k (Fourier steps from the period), freq, p_a, p_b, c_re, c_im.
    """
    a, b = values[0], values[-1]
    rows = require_keys(df, list(keys)).select(*keys, F.col(pos).alias("_t"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_a").alias("_ma"), F.avg("_b").alias("_mb"))
    asked = [(name, k, float(length)) for name, length in periods.items() for k in range(-spread, spread + 1)]
    dev = rows.join(stats, list(keys)).select(*keys, "_t", "_n", (F.col("_a") - F.col("_ma")).alias("_a"), (F.col("_b") - F.col("_mb")).alias("_b"))

    def sums(k, length):
        angle = F.lit(2 * math.pi) * F.col("_t") * (F.lit(1 / length) + F.lit(float(k)) / F.col("_n"))
        return F.array(*[F.sum(F.col(v) * f(angle)) for v in ("_a", "_b") for f in (F.cos, F.sin)])

    wide = dev.groupBy(*keys, "_n").agg(*[sums(k, length).alias(f"_s{i}") for i, (_, k, length) in enumerate(asked)])
    parts = F.array(*[F.struct(F.lit(name).alias("period"), F.lit(k).alias("k"), (F.lit(1 / length) + F.lit(float(k)) / F.col("_n")).alias("freq"),
                               F.col(f"_s{i}").alias("_s")) for i, (name, k, length) in enumerate(asked)])
    s = [F.col("_s")[i] for i in range(4)]
    return wide.select(*keys, "_n", F.inline(parts)).select(
        *keys, "period", "k", "freq", ((s[0] * s[0] + s[1] * s[1]) / F.col("_n")).alias("p_a"), ((s[2] * s[2] + s[3] * s[3]) / F.col("_n")).alias("p_b"),
        ((s[0] * s[2] + s[1] * s[3]) / F.col("_n")).alias("c_re"), ((s[0] * s[3] - s[1] * s[2]) / F.col("_n")).alias("c_im"))


def coherence_at(spec: DataFrame, keys=KEYS) -> DataFrame:
    """Mean power over the neighbouring frequencies of each period, and the squared coherence of the two series there."""
    m = spec.groupBy(*keys, "period").agg(*[F.avg(c).alias(c) for c in ("p_a", "p_b", "c_re", "c_im")])
    return m.select(*keys, "period", F.col("p_a").alias("smooth_a"), F.col("p_b").alias("smooth_b"),
                    F.try_divide(F.col("c_re") * F.col("c_re") + F.col("c_im") * F.col("c_im"), F.col("p_a") * F.col("p_b")).alias("coherence"))


def gaussian_criteria(n, rss, params) -> dict[str, Column]:
    """AIC and BIC of a least-squares fit; ``params`` counts coefficients, the variance is added."""
    base = n * (F.log(F.lit(2 * math.pi)) + F.log(rss / n) + 1)
    return {"AIC": base + 2 * (params + 1), "BIC": base + F.log(n) * (params + 1)}


def nested_f(n, rss_small, k_small, rss_large, k_large) -> Column:
    """F statistic of a nested pair of fits with ``k`` coefficients each (statistic only)."""
    return F.try_divide((rss_small - rss_large) / (k_large - k_small), rss_large / (n - k_large))


def simple_regression(df: DataFrame, x: str, y: str, keys=KEYS) -> DataFrame:
    """One-regressor least squares from moments: slope, intercept, R2, RSS."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                                F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
                                F.regr_syy(y, x).alias("syy"))
    return m.withColumn("rss", F.col("syy") * (1 - F.col("r2"))).drop("syy")



def polynomial_rss(df: DataFrame, x: str, y: str, top: int) -> DataFrame:
    """degree (1..top), n, rss of least-squares polynomials of y on x: one aggregate of power sums, then systems of top + 1 numbers.

    Centre and scale ``x`` beforehand: powers of large numbers lose digits.
    """
    import numpy as np
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    m = F.pow
    sums = both.agg(*[F.sum(m("_x", F.lit(i))).alias(f"s{i}") for i in range(2 * top + 1)], *[F.sum(m("_x", F.lit(i)) * F.col("_y")).alias(f"t{i}") for i in range(top + 1)],
                    F.sum(F.col("_y") * F.col("_y")).alias("yy")).first()
    rows = []
    for k in range(1, top + 1) if sums["yy"] is not None else []:
        a = np.array([[sums[f"s{i + j}"] for j in range(k + 1)] for i in range(k + 1)])
        b = np.array([sums[f"t{i}"] for i in range(k + 1)])
        rows.append((k, int(sums["s0"]), float(sums["yy"] - b @ np.linalg.solve(a, b))))
    return df.sparkSession.createDataFrame(rows, "degree int, n long, rss double")
