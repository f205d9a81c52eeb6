"""Duplicates, native resolution, gaps, invalid values and outliers."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.config import IQR_K, MAD_SCALE, SHORT_GAP
from loadtide.functions.clock import ONE_MINUTE, floor_div, from_micros, micros, month_start
from loadtide.operators.ordered import framed, keep_one, with_neighbour, with_row_number
from loadtide.operators.quantiles import exact_median, exact_quantiles
from loadtide.session import cut_lineage

KEYS = ["region"]


def hour_chunk(ts="ts") -> Column:
    return floor_div(micros(ts), 60 * ONE_MINUTE)


def duplicate_report(df: DataFrame, keys=KEYS, ts="ts") -> DataFrame:
    """Rows and rows sharing their timestamp, all copies counted, in two small aggregates."""
    per_ts = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    return per_ts.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_timestamps"))


def dedupe_last(df: DataFrame, keys=KEYS, ts="ts", seq="seq") -> DataFrame:
    return keep_one(df, [*keys, ts], seq, last=True)


def dedupe_first(df: DataFrame, keys=KEYS, ts="ts", seq="seq") -> DataFrame:
    return keep_one(df, [*keys, ts], seq, last=False)


def with_steps(df: DataFrame, keys=KEYS, ts="ts") -> DataFrame:
    """Previous timestamp, its month and the step to it in minutes."""
    out = with_neighbour(df, keys, ts, hour_chunk(ts), {"prev_ts": ts})
    return out.withColumns({
        "step_minutes": F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col(ts)) / F.lit(float(ONE_MINUTE)),
        "month": month_start(ts),
        "prev_month": month_start("prev_ts"),
    })


def native_resolution(steps: DataFrame, keys=KEYS) -> DataFrame:
    """Modal step per series and month; the smallest of tied modes wins."""
    counts = (steps.where("step_minutes is not null")
              .groupBy(*keys, "month", "step_minutes").agg(F.count(F.lit(1)).alias("_n")))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("step_minutes").alias("m")))
    return counts.groupBy(*keys, "month").agg(best["m"].alias("resolution_minutes"))


def completeness(df: DataFrame, keys=KEYS, ts="ts") -> DataFrame:
    """Missing intervals per series, fair to a change of resolution between two months."""
    steps = with_steps(df, keys, ts)
    res = native_resolution(steps, keys)
    now = res.withColumnRenamed("resolution_minutes", "_now")
    old = res.select(*keys, F.col("month").alias("prev_month"), F.col("resolution_minutes").alias("_old"))
    j = steps.join(now, [*keys, "month"], "left").join(old, [*keys, "prev_month"], "left")

    def holes(expected):
        return F.greatest(F.rint(F.col("step_minutes") / F.col(expected)) - 1, F.lit(0.0))

    both = F.col("_now").isNotNull() & F.col("_old").isNotNull() & F.col("step_minutes").isNotNull()
    miss = F.coalesce(F.when(both, F.least(holes("_now"), holes("_old"))), F.lit(0.0))
    return (j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_join(F.array_sort(F.collect_set("_now")), ",").alias("resolution_regimes_min"),
        F.sum(miss).cast("long").alias("missing_intervals"))
        .withColumn("completeness_pct",
                    F.lit(100.0) * F.col("rows") / (F.col("rows") + F.col("missing_intervals"))))


def densify_months(df: DataFrame, keys=KEYS, ts="ts", value="y") -> DataFrame:
    """Each series-month on its own complete grid from its first to its last reading.

    Readings off that grid drop out. A month too short to show a step takes the
    following month's resolution, else the previous one's.
    """
    res = native_resolution(with_steps(df, keys, ts), keys)
    span = (df.withColumn("month", month_start(ts)).groupBy(*keys, "month")
            .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))
    w = W.partitionBy(*keys).orderBy("month")
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    behind = w.rowsBetween(W.unboundedPreceding, 0)
    spans = (span.join(res, [*keys, "month"], "left")
             .withColumn("resolution_minutes", F.coalesce(
                 F.first("resolution_minutes", ignorenulls=True).over(ahead),
                 F.last("resolution_minutes", ignorenulls=True).over(behind)).cast("long"))
             .where("resolution_minutes >= 1"))
    width = F.col("resolution_minutes") * F.lit(ONE_MINUTE)
    grid = spans.select(*keys, "resolution_minutes",
                        F.explode(F.sequence(micros("_lo"), micros("_hi"), width)).alias("_us"))
    grid = grid.withColumn(ts, from_micros("_us")).drop("_us")
    return grid.join(df.select(*keys, ts, value), [*keys, ts], "left")


def fill_short_gaps(df: DataFrame, keys=KEYS, pos="pos", value="y", limit: int = SHORT_GAP) -> DataFrame:
    """Straight-line fill of null runs up to ``limit``; longer runs stay null.

    A short run at the end repeats the last value, one at the start stays null;
    both are flagged. Needs a gap-free integer position.
    """
    def build(w):
        gone = F.col(value).isNull()
        back, ahead = F.lit(0), F.lit(0)
        go_back, go_ahead = F.lit(True), F.lit(True)
        for k in range(1, limit + 1):
            go_back = go_back & F.lag(gone, k, False).over(w)
            go_ahead = go_ahead & F.lead(gone, k, False).over(w)
            back, ahead = back + go_back.cast("int"), ahead + go_ahead.cast("int")
        before = F.coalesce(*[F.when(back == k, F.lag(value, k + 1).over(w)) for k in range(limit)])
        after = F.coalesce(*[F.when(ahead == k, F.lead(value, k + 1).over(w)) for k in range(limit)])
        short = gone & (back + ahead + 1 <= limit)
        line = before + (after - before) * (back + 1) / (back + ahead + 2)
        return {"is_imputed": short.cast("int"),
                "_filled": F.when(short, F.coalesce(line, before)).otherwise(F.col(value))}

    out = framed(df, keys, pos, build, back=limit + 1, ahead=limit + 1)
    return out.withColumn(value, F.col("_filled")).drop("_filled")


def null_runs(df: DataFrame, keys=KEYS, pos="pos", value="y", chunk: int = 48 * 366) -> DataFrame:
    """Every run of nulls on a gap-free position: where it starts and how long it is.

    Runs are the spaces between neighbouring non-null rows, so a run of any
    length costs two rows, not its own.
    """
    ends = df.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    known = (df.where(F.col(value).isNotNull()).select(*keys, pos)
             .unionByName(ends.select(*keys, (F.col("_lo") - 1).alias(pos)))
             .unionByName(ends.select(*keys, (F.col("_hi") + 1).alias(pos))))
    linked = with_neighbour(known, keys, pos, floor_div(pos, chunk), {"_prev": pos})
    return (linked.where(F.col(pos) - F.col("_prev") > 1)
            .select(*keys, (F.col("_prev") + 1).alias("run_start"),
                    (F.col(pos) - F.col("_prev") - 1).alias("run_length")))


def repair(df: DataFrame, keys=KEYS, ts="ts", value="y") -> DataFrame:
    """Dense months, then short gaps filled by row position."""
    dense = densify_months(df, keys, ts, value)
    numbered = with_row_number(dense, keys, [F.col(ts)], month_start(ts), "pos")
    return fill_short_gaps(numbered, keys, "pos", value)


def flag_invalid(value="y", threshold: float = 0.0) -> Column:
    return F.coalesce((F.col(value) <= threshold), F.lit(False)).cast("int")


def outlier_bounds(df: DataFrame, keys=KEYS, value="y", k: float = IQR_K) -> DataFrame:
    valid = df.where("is_invalid = 0")
    q = exact_quantiles(valid, keys, value, {"q1": 0.25, "q3": 0.75, "med": 0.5})
    return q.withColumns({"lo": F.col("q1") - k * (F.col("q3") - F.col("q1")),
                          "hi": F.col("q3") + k * (F.col("q3") - F.col("q1"))})


def absolute_deviation(valid: DataFrame, medians: DataFrame, keys=KEYS, value="y") -> DataFrame:
    """Median absolute deviation from the given medians (keys, med)."""
    away = valid.join(medians, keys).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    return exact_median(away, keys, "_d", "mad")


def flag_outliers(df: DataFrame, keys=KEYS, pos="pos", value="y", k: float = IQR_K,
                  threshold: float = 0.0) -> DataFrame:
    """Invalid, statistical outlier, robust z, and isolated or sustained type. Nothing is removed."""
    base = df.withColumn("is_invalid", flag_invalid(value, threshold))
    # one row per series, written once: the flags and the deviation both read it
    bounds = cut_lineage(outlier_bounds(base, keys, value, k).select(*keys, "lo", "hi", "med"), "bounds")
    mad = absolute_deviation(base.where("is_invalid = 0"), bounds.select(*keys, "med"), keys, value)
    y = F.col(value)
    outside = (F.col("is_invalid") == 0) & ((y < F.col("lo")) | (y > F.col("hi")))
    flagged = (base.join(bounds, keys, "left").join(mad, keys, "left")
               .withColumns({
                   "is_stat_outlier": F.coalesce(outside, F.lit(False)).cast("int"),
                   "robust_z": F.when(F.col("mad") > 0, (y - F.col("med")) / (MAD_SCALE * F.col("mad")))})
               .drop("lo", "hi", "med", "mad"))

    def build(w):
        on = (F.col("is_stat_outlier") == 1) | (F.col("is_invalid") == 1)
        lonely = ~(F.lag(on, 1, False).over(w) | F.lead(on, 1, False).over(w))
        return {"outlier_type": F.when(~on, "").when(F.col("is_invalid") == 1, "invalid_impossible")
                .when(lonely, "isolated_extreme").otherwise("sustained_extreme_event")}

    return framed(flagged, keys, pos, build, back=1, ahead=1)
