"""Exact quantiles without bringing a group into one task.

A sketch brackets each quantile; the value histogram (pre-aggregated, so copies
of a hot value collapse) gives the count below the bracket and the thin slice
inside it. Ranks are then found exactly on that slice.
"""
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.operators.ordered import require_keys

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (name -> probability).

    Linear interpolation between order statistics; NULLs are skipped. A sketch brackets each quantile whatever the
    size, the bracket is widened by the next distinct value on either side, and a bracket that misses the ranks asked for raises.
    """
    slack = 3.0 / ACCURACY
    asked = list(enumerate(probs.items()))
    rows = require_keys(df, keys).where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = [F.lit(min(max(p + s, 0.0), 1.0)) for p in probs.values() for s in (-slack, slack)]
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*cuts), F.lit(ACCURACY)).alias("_b"),
        F.count(F.lit(1)).alias("_n"))
    histogram = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = histogram.join(bounds, keys)

    def edges(i):
        under, over = F.col("_v") < F.col("_b")[2 * i], F.col("_v") > F.col("_b")[2 * i + 1]
        before = F.max(F.when(under, F.struct("_v", "_c")))
        return F.struct(before["_v"].alias("lo"), F.min(F.when(over, F.col("_v"))).alias("hi"),
                        (F.coalesce(F.sum(F.when(under, F.col("_c"))), F.lit(0)) - F.coalesce(before["_c"], F.lit(0))).alias("below"))

    counts = near.groupBy(*keys).agg(F.array(*[edges(i) for i, _ in asked]).alias("_e"))
    slices = near.join(counts, keys)
    hits = F.array_compact(F.array(*[
        F.when((F.col("_v") >= F.coalesce(F.col("_e")[i]["lo"], F.col("_b")[2 * i])) & (F.col("_v") <= F.coalesce(F.col("_e")[i]["hi"], F.col("_b")[2 * i + 1])),
               F.struct(F.lit(i).alias("_q"), F.lit(float(p)).alias("_p"), F.col("_e")[i]["below"].alias("_below"))) for i, (_, p) in asked]))
    slices = slices.select(*keys, "_n", "_v", "_c", F.inline(hits))
    w = W.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = slices.withColumns({"_cum": F.col("_below") + F.sum("_c").over(w),
                                 "_rank": F.col("_p") * (F.col("_n") - 1)})

    def value_at(i, rank):
        return F.min(F.when((F.col("_q") == i) & (F.col("_cum") > rank), F.col("_v")))

    out = []
    for i, (name, _) in asked:
        mine = F.col("_q") == i
        lo, hi = value_at(i, F.floor("_rank")), value_at(i, F.ceil("_rank"))
        part = F.max(F.when(mine, F.col("_rank") - F.floor("_rank")))
        held = (F.min(F.when(mine, F.col("_below"))) <= F.min(F.when(mine, F.floor("_rank")))) & hi.isNotNull()
        out.append(F.when(held, lo + (hi - lo) * part).otherwise(F.raise_error(F.lit(f"the bracket of {name} misses its rank"))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Average rank and number of copies of every distinct value per key.

    Equal-depth cuts from a sketch split each key's value histogram; ranks run
    inside a cut and add the carried count of the cuts below. The number of cuts
    follows the counted rows (their square root), so a cut grows no faster than their number.
    """
    rows = require_keys(df, keys).where(F.col(value).isNotNull())
    if parts is None:
        parts = min(max(16, math.isqrt(rows.count())), ACCURACY)
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(ACCURACY))
    splitters = rows.groupBy(*keys).agg(cuts.alias("_cuts"))
    sizes = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    placed = (sizes.join(splitters, keys)
              .withColumn("_cut", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts"))
    run = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    below = (placed.groupBy(*keys, "_cut").agg(F.sum("copies").alias("_s"))
             .withColumn("_below", F.coalesce(F.sum("_s").over(run), F.lit(0))).drop("_s"))
    inner = W.partitionBy(*keys, "_cut").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("copies").over(inner) + F.col("_below")
    return (placed.join(below, [*keys, "_cut"])
            .withColumn(name, upto - (F.col("copies") - 1) / F.lit(2.0)).drop("_cut", "_below"))

