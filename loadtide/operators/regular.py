"""Resampling, continuous grids and interpolation onto them."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadtide.config import STEP_MINUTES
from loadtide.functions.clock import floor_div, slot, slot_start
from loadtide.operators.ordered import CHUNK, with_neighbour

KEYS = ["region"]


def resample_mean(df: DataFrame, keys=KEYS, ts="ts", value="y", closed: str = "left",
                  flags: list[str] = (), bins: Column | None = None) -> DataFrame:
    """Half-hour mean, flags by maximum, count of readings; empty bins are dropped.

    One hash aggregate with map-side combine, so a hot series shrinks before the shuffle.
    """
    hh = slot(ts, STEP_MINUTES, closed) if bins is None else bins
    out = (df.withColumn("hh", hh).groupBy(*keys, "hh")
           .agg(F.avg(value).alias(value),
                *[F.max(c).alias(c) for c in flags],
                F.count(value).alias("n_source_readings")))
    return out.where("n_source_readings > 0").withColumn("ts", slot_start("hh"))


def series_grid(df: DataFrame, keys=KEYS) -> DataFrame:
    """Every slot from the first to the last of each series."""
    ends = df.groupBy(*keys).agg(F.min("hh").alias("_lo"), F.max("hh").alias("_hi"))
    return ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("hh"))


def continuous_grid(df: DataFrame, keys=KEYS, zero_columns: list[str] = ()) -> DataFrame:
    """Gap-free half-hour grid; inserted rows have null values and zero flags."""
    out = series_grid(df, keys).join(df.drop("ts"), [*keys, "hh"], "left")
    return out.withColumns({"ts": slot_start("hh"),
                            **{c: F.coalesce(F.col(c), F.lit(0)) for c in zero_columns}})


def interpolate_grid(points: DataFrame, keys=KEYS, columns: list[str] = (), limit: int | None = 2,
                     minutes: int = STEP_MINUTES, extra_steps: int = 0, edges: bool = False) -> DataFrame:
    """Points on slots -> full grid, linear in time.

    Per column, only the first ``limit`` nulls of a run are filled (all when
    None), a trailing run repeats the last value, leading nulls stay null unless
    ``edges``. Each known point emits its own fill rows towards its successor.
    """
    ends = points.groupBy(*keys).agg(F.min("hh").alias("_lo"), (F.max("hh") + extra_steps).alias("_hi"))
    grid = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("hh"))
    out = grid
    for c in columns:
        known = points.where(F.col(c).isNotNull()).select(*keys, "hh", F.col(c).alias("_v"))
        linked = with_neighbour(known, keys, "hh", floor_div("hh", CHUNK), {"_h2": "hh", "_v2": "_v"}, forward=False)
        linked = linked.join(ends, keys)
        reach = F.coalesce(F.col("_h2") - 1, F.col("_hi"))
        if limit is not None:
            reach = F.least(reach, F.col("hh") + limit)
        part = (F.col("_s") - F.col("hh")) / (F.col("_h2") - F.col("hh"))
        line = F.coalesce(F.col("_v") + (F.col("_v2") - F.col("_v")) * part, F.col("_v"))
        filled = (linked.select(*keys, "hh", "_v", "_h2", "_v2", F.explode(F.sequence("hh", reach)).alias("_s"))
                  .select(*keys, F.col("_s").alias("hh"), line.alias(c)))
        if edges:
            first = known.groupBy(*keys).agg(F.min("hh").alias("_h1"), F.min_by("_v", "hh").alias(c))
            lead = (first.join(ends, keys).where("_h1 > _lo")
                    .select(*keys, F.explode(F.sequence(F.col("_lo"), F.col("_h1") - 1)).alias("hh"), c))
            filled = filled.unionByName(lead)
        out = out.join(filled, [*keys, "hh"], "left")
    return out.withColumn("ts", slot_start("hh", minutes))


def carry_one(df: DataFrame, keys, column: str) -> DataFrame:
    """Forward fill by at most one slot, as a self-join on the slot before."""
    prev = df.select(*keys, (F.col("hh") + 1).alias("hh"), F.col(column).alias("_p"))
    return (df.join(prev, [*keys, "hh"], "left")
            .withColumn(column, F.coalesce(column, "_p")).drop("_p"))


def recent_model_series(df: DataFrame, keys=KEYS, value="y", last_n: int = 1440) -> DataFrame:
    """Last N known readings of each series on a regular grid, all holes interpolated.

    The cut is found from per-day counts carried backwards, so the long history
    is never ranked row by row.
    """
    from pyspark.sql import Window as W
    known = df.where(F.col(value).isNotNull())
    daily = known.withColumn("_d", floor_div("hh", 48)).groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n"))
    later = W.partitionBy(*keys).orderBy(F.col("_d").desc()).rowsBetween(W.unboundedPreceding, -1)
    daily = daily.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    tail = (known.withColumn("_d", floor_div("hh", 48)).join(daily.drop("_n"), [*keys, "_d"])
            .where(F.col("_after") < last_n))
    w = W.partitionBy(*keys, "_d").orderBy(F.col("hh").desc())
    tail = tail.withColumn("_r", F.row_number().over(w) + F.col("_after")).where(F.col("_r") <= last_n)
    return interpolate_grid(tail.select(*keys, "hh", value), keys, [value], limit=None, edges=True)
