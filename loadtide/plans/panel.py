"""Origins, folds and panels: history with the target hidden from each origin on."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.config import DAY, LAGS
from loadtide.functions.clock import floor_div, horizon_end, month_start, slot, slot_start

KEYS = ["region"]


def rolling_window(df: DataFrame, origin: str, months: int = 4) -> DataFrame:
    """Current month and the next ones, year ends included."""
    first = F.to_date(month_start(origin))
    return df.withColumns({
        "anchor_start": first.cast("timestamp_ntz"),
        "horizon_end": horizon_end(month_start(origin), months),
        "rolling_window": F.array_join(F.transform(
            F.sequence(F.lit(0), F.lit(months - 1)),
            lambda k: F.date_format(F.add_months(first, k), "yyyy-MM")), "|")})


def analogue_origins(spans: DataFrame, anchor: str, start: str, end: str, keys=KEYS, max_origins: int = 3,
                     min_train_days: int = 240, months: int = 4) -> DataFrame:
    """The anchor's month in earlier years with enough history and a complete window, newest first."""
    years = F.sequence(F.year(start), F.year(anchor) - 1)
    first = F.make_date(F.col("_y"), F.month(anchor), F.lit(1)).cast("timestamp_ntz")
    cand = (spans.where(F.year(start) <= F.year(anchor) - 1)
            .select(*keys, anchor, start, end, F.explode(years).alias("_y"))
            .withColumn("origin", first).withColumn("horizon_end", horizon_end("origin", months)))
    ok = cand.where((F.col("origin") > F.col(start))
                    & (F.timestamp_diff("DAY", F.col(start), F.col("origin")) >= min_train_days)
                    & (F.col("horizon_end") <= F.col(end)))
    w = W.partitionBy(*keys, anchor).orderBy(F.col("origin").desc())
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_origins).drop("_y")


def walk_forward_folds(df: DataFrame, folds: int, test_len: int, keys=KEYS, value="y") -> DataFrame:
    """The last ``folds`` windows of ``test_len`` known rows; fold 1 is the oldest.

    The position from the end comes from per-day counts carried backwards.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("_d", floor_div("hh", DAY))
    daily = known.groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n"))
    later = W.partitionBy(*keys).orderBy(F.col("_d").desc()).rowsBetween(W.unboundedPreceding, -1)
    daily = daily.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    near = known.join(daily.where(F.col("_after") < folds * test_len), [*keys, "_d"])
    w = W.partitionBy(*keys, "_d").orderBy(F.col("hh").desc())
    back = F.row_number().over(w) + F.col("_after") - 1
    return (near.withColumn("_back", back).where(F.col("_back") < folds * test_len)
            .withColumn("fold", (folds - F.floor(F.col("_back") / test_len)).cast("int"))
            .drop("_back", "_after", "_d"))


def fold_table(df: DataFrame, folds: int, test_len: int, keys=KEYS, value="y") -> DataFrame:
    rows = walk_forward_folds(df, folds, test_len, keys, value)
    return rows.groupBy(*keys, "fold").agg(F.min("hh").alias("origin_hh"), F.max("hh").alias("end_hh"),
                                           F.count(F.lit(1)).alias("test_rows"))


def build_panel(df: DataFrame, origins: DataFrame, keys=KEYS, value="y") -> DataFrame:
    """Grid from the start of history to each origin's horizon end.

    ``origins`` has (keys, origin_hh, end_hh). ``y`` is null from the origin on;
    ``actual`` keeps what is known, for scoring only.
    """
    first = df.groupBy(*keys).agg(F.min("hh").alias("_lo"))
    frame = (origins.join(first, keys)
             .select(*keys, "origin_hh", "end_hh", F.explode(F.sequence("_lo", "end_hh")).alias("hh")))
    seen = df.select(*keys, "hh", F.col(value).alias("actual"))
    return (frame.join(seen, [*keys, "hh"], "left")
            .withColumns({"y": F.when(F.col("hh") < F.col("origin_hh"), F.col("actual")),
                          "is_horizon": (F.col("hh") >= F.col("origin_hh")).cast("int"),
                          "ts": slot_start("hh")}))


def horizon_rows(origins: DataFrame, keys=KEYS) -> DataFrame:
    return (origins.select(*keys, "origin_hh", "end_hh", F.explode(F.sequence("origin_hh", "end_hh")).alias("hh"))
            .withColumns({"step": F.col("hh") - F.col("origin_hh") + 1, "ts": slot_start("hh")}))


def lag_sources(horizon: DataFrame, starts: DataFrame, keys=KEYS) -> DataFrame:
    """Where each lag of a horizon row comes from; integer comparison only."""
    out = horizon.join(starts, keys)
    names = []
    for k in LAGS.values():
        ref = F.col("hh") - k
        name = f"lag{k}_source"
        names.append(name)
        out = out.withColumn(name, F.when(ref < F.col("start_hh"), "MISSING")
                             .when(ref < F.col("origin_hh"), "ACTUAL_HISTORY").otherwise("RECURSIVE_FORECAST"))
    used = F.greatest(*[(F.col(n) != "ACTUAL_HISTORY").cast("int") for n in names])
    return out.withColumn("recursive_input_used", used).drop("start_hh")


def series_starts(df: DataFrame, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("hh").alias("start_hh"))


def at_slot(text: str) -> Column:
    return slot(F.lit(text).cast("timestamp_ntz"))


def block_provenance(origins: DataFrame, history: DataFrame, lookback: int, keys=KEYS, value="y") -> DataFrame:
    """Per day block: encoder steps read from actuals, from predictions, and gap-filled.

    Gap counts come from a half-hour null flag summed over each block's reach.
    """
    blocks = (origins.select(*keys, "origin_hh", F.explode(F.sequence(
        F.col("origin_hh"), F.col("end_hh"), F.lit(DAY).cast("long"))).alias("block_start")))
    lo = F.col("block_start") - lookback
    predicted = F.greatest(F.col("block_start") - F.greatest(lo, F.col("origin_hh")), F.lit(0))
    blocks = blocks.withColumns({"predicted_steps": predicted, "actual_steps": F.lit(lookback) - predicted})
    reach = (blocks.select(*keys, "origin_hh", "block_start",
                           F.explode(F.sequence(lo, F.col("block_start") - 1)).alias("hh"))
             .where(F.col("hh") < F.col("origin_hh")))
    gaps = (reach.join(history.select(*keys, "hh", value), [*keys, "hh"], "left")
            .groupBy(*keys, "origin_hh", "block_start")
            .agg(F.count_if(F.col(value).isNull()).alias("gap_filled_steps")))
    return (blocks.join(gaps, [*keys, "origin_hh", "block_start"], "left")
            .fillna(0, ["gap_filled_steps"]))
