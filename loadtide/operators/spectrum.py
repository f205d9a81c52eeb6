"""The whole spectrum of long series by a Fourier transform in two steps, smoothed, with coherence and peaks.

A series of N = a * b positions is dealt into a classes of every a-th position; each class is transformed, turned by its offset, and the classes' values of one
index are transformed across. A task holds a class or an index, about the square root of the series, never the series, and the work is N log N.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.operators.ordered import framed, require_keys

KEYS = ["region"]


def padded(n: int) -> tuple[int, int]:
    """The least number of at least n without prime factors over 5, and its divisor nearest to its square root from below."""
    size = max(n, 1)
    while True:
        rest = size
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            break
        size += 1
    return size, max(d for d in range(1, math.isqrt(size) + 1) if size % d == 0)


def residuals(df: DataFrame, keys=KEYS, pos="pos", values=("y",), detrend: bool = True) -> DataFrame:
    """keys, n, size, a, t, v0, v1: positions from 0 on and the values without their mean, or without their straight line."""
    names = [f"v{i}" for i in range(len(values))]
    rows = require_keys(df, list(keys)).select(*keys, F.col(pos).cast("long").alias("_t"), *[F.col(c).cast("double").alias(n) for c, n in zip(values, names)])
    first = rows.groupBy(*keys).agg(F.min("_t").alias("_t0"), (F.max("_t") - F.min("_t") + 1).alias("n"), F.avg("_t").alias("_tm"), *[F.avg(n).alias(f"_m{n}") for n in names])
    centred = rows.join(first, list(keys)).withColumn("_c", F.col("_t") - F.col("_tm")).withColumns({n: F.col(n) - F.col(f"_m{n}") for n in names})
    kinds = ", ".join([*(f"`{k}` {dict(first.dtypes)[k]}" for k in keys), "n long, size long, a long"])

    def sizes(batches):
        for b in batches:
            found = [padded(int(n)) for n in b["n"]]
            yield b[[*keys, "n"]].assign(size=[s for s, _ in found], a=[a for _, a in found])

    shape = first.select(*keys, "n").mapInPandas(sizes, kinds)
    slope = {n: F.try_divide(F.sum(F.col("_c") * F.col(n)), F.sum(F.when(F.col(n).isNotNull(), F.col("_c") * F.col("_c")))) for n in names}
    line = centred.groupBy(*keys).agg(*[(c if detrend else F.lit(0.0)).alias(f"_s{n}") for n, c in slope.items()])
    out = centred.drop("n").join(line, list(keys)).join(shape, list(keys))
    return out.select(*keys, "n", "size", "a", (F.col("_t") - F.col("_t0")).alias("t"), *[(F.col(n) - F.coalesce(f"_s{n}", F.lit(0.0)) * F.col("_c")).alias(n) for n in names])


def fourier(rows: DataFrame, keys=KEYS, count: int = 1) -> DataFrame:
    """keys, n, size, k and re/im of each value: sums of v * exp(-2 pi i k t / size) for k from 0 to size / 2. Missing positions count as 0."""
    kinds = dict(rows.dtypes)
    head = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, size long, a long"])
    parts = ", ".join(f"re{i} double, im{i} double" for i in range(count))

    def table(one: dict, length: int, **columns) -> pa.Table:
        same = {c: pa.array([one[c]] * length) for c in (*keys, "n", "size", "a")}
        return pa.table(same | {c: pa.array(v) for c, v in columns.items()})

    def classes(group: pa.Table) -> pa.Table:
        one = group.slice(0, 1).to_pylist()[0]
        size, a, r = one["size"], one["a"], one["class"]
        at = (group["t"].to_numpy() - r) // a
        k2 = np.arange(size // a)
        out = {"index": k2, "class": np.full(len(k2), r)}
        for i in range(count):
            x = np.zeros(size // a)
            x[at] = np.nan_to_num(group[f"v{i}"].to_numpy(zero_copy_only=False).astype(float))
            z = np.fft.fft(x) * np.exp(-2j * np.pi * ((r * k2) % size) / size)
            out |= {f"re{i}": z.real, f"im{i}": z.imag}
        return table(one, len(k2), **out)

    def across(group: pa.Table) -> pa.Table:
        one = group.slice(0, 1).to_pylist()[0]
        size, a, k2 = one["size"], one["a"], one["index"]
        k = k2 + (size // a) * np.arange(a)
        low = k <= size // 2
        out = {"k": k[low]}
        for i in range(count):
            x = np.zeros(a, dtype=complex)
            x[group["class"].to_numpy()] = group[f"re{i}"].to_numpy() + 1j * group[f"im{i}"].to_numpy()
            z = np.fft.fft(x)[low]
            out |= {f"re{i}": z.real, f"im{i}": z.imag}
        return table(one, int(low.sum()), **out)

    dealt = rows.withColumn("class", F.col("t") % F.col("a"))
    first = dealt.groupBy(*keys, "class").applyInArrow(classes, f"{head}, index long, class long, {parts}")
    return first.groupBy(*keys, "index").applyInArrow(across, f"{head}, k long, {parts}").drop("a")


def spectrum(df: DataFrame, keys=KEYS, pos="pos", values=("y",), spans=(25, 25), detrend: bool = True) -> DataFrame:
    """keys, k, freq (cycles a position), power and smoothed of the first value; with a second one power_b, smoothed_b, coherence (squared) and phase.

    Power is squared modulus over the number of positions. The series is padded with zeros to a length without large prime factors. Smoothing is
    by modified Daniell windows of the odd or even ``spans``, one after another, over the spectrum continued on both sides; frequency 0
    takes the mean of its neighbours and is left out of the result. Positions may be missing (0 after the line is taken out); repeated ones are an error. A spectrum shorter than its windows is
    not smoothed (null). A NULL key raises.
    """
    both = len(values) > 1
    f = fourier(residuals(df, keys, pos, values, detrend), keys, len(values))
    n = F.col("n")
    cols = {"power": (F.col("re0") * F.col("re0") + F.col("im0") * F.col("im0")) / n}
    if both:
        cols |= {"power_b": (F.col("re1") * F.col("re1") + F.col("im1") * F.col("im1")) / n, "c_re": (F.col("re0") * F.col("re1") + F.col("im0") * F.col("im1")) / n,
                 "c_im": (F.col("im0") * F.col("re1") - F.col("re0") * F.col("im1")) / n}
    names = list(cols)
    f = f.withColumns(cols).select(*keys, "n", "size", "k", *names)
    reach = [max(1, s // 2) for s in spans]
    margin = sum(reach)
    # Continued by the conjugate on both sides: k and -k have equal power, and cross terms of opposite imaginary part.
    turned = [F.col(c) if c != "c_im" else -F.col(c) for c in names]
    copies = [F.struct(F.col("k").alias("k"), *[F.col(c).alias(c) for c in names], F.lit(True).alias("own")),
              F.when((F.col("k") > 0) & (F.col("k") <= margin), F.struct((-F.col("k")).alias("k"), *[t.alias(c) for t, c in zip(turned, names)], F.lit(False).alias("own"))),
              F.when((F.col("size") - F.col("k") > F.floor(F.col("size") / 2)) & (F.col("size") - F.col("k") <= F.floor(F.col("size") / 2) + margin),
                     F.struct((F.col("size") - F.col("k")).alias("k"), *[t.alias(c) for t, c in zip(turned, names)], F.lit(False).alias("own")))]
    wide = f.select(*keys, "n", "size", F.inline(F.array_compact(F.array(*copies))))
    wide = framed(wide, list(keys), "k", lambda w: {f"_z{c}": (F.lag(c).over(w) + F.lead(c).over(w)) / 2 for c in names}, back=1, ahead=1)
    wide = wide.withColumns({f"s_{c}": F.when(F.col("k") == 0, F.col(f"_z{c}")).otherwise(F.col(c)) for c in names})
    for m in reach:
        def smooth(w, m=m):
            outer, inner = w.rangeBetween(-m, m), w.rangeBetween(-(m - 1), m - 1)
            return {f"t_{c}": (F.sum(f"s_{c}").over(outer) + F.sum(f"s_{c}").over(inner)) / (4 * m) for c in names}
        wide = framed(wide, list(keys), "k", smooth, back=m, ahead=m).withColumns({f"s_{c}": F.col(f"t_{c}") for c in names})
    enough = F.floor(F.col("size") / 2) >= margin
    own = wide.where("own AND k > 0").withColumns({f"s_{c}": F.when(enough, F.col(f"s_{c}")) for c in names})
    out = [*keys, "k", (F.col("k") / F.col("size")).alias("freq"), "power", F.col("s_power").alias("smoothed")]
    if both:
        out += ["power_b", F.col("s_power_b").alias("smoothed_b"),
                F.try_divide(F.col("s_c_re") * F.col("s_c_re") + F.col("s_c_im") * F.col("s_c_im"), F.col("s_power") * F.col("s_power_b")).alias("coherence"),
                F.atan2("s_c_im", "s_c_re").alias("phase")]
    return own.select(*out)


def peaks(spec: DataFrame, keys=KEYS, value: str = "smoothed", top: int = 5, reach: int = 12) -> DataFrame:
    """keys, rank, k, freq, period, value: the highest places of the spectrum that no other within ``reach`` steps is above; the lower frequency wins ties."""
    from pyspark.sql import Window as W

    def build(w):
        return {"_before": F.max(value).over(w.rangeBetween(-reach, -1)), "_behind": F.max(value).over(w.rangeBetween(1, reach))}

    high = framed(spec, list(keys), "k", build, back=reach, ahead=reach)
    high = high.where((F.coalesce("_before", F.lit(-1.0)) < F.col(value)) & (F.coalesce("_behind", F.lit(-1.0)) <= F.col(value)))
    ranked = high.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), "k"))).where(F.col("rank") <= top)
    return ranked.select(*keys, "rank", "k", "freq", (1 / F.col("freq")).alias("period"), value)
