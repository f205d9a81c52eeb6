"""Encoder/decoder windows and the chronological split."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.config import DAY, WARMUP
from loadtide.functions.clock import floor_div
from loadtide.operators.ordered import CHUNK, require_keys, with_row_number

KEYS = ["region"]


def _dealt(df: DataFrame, limits: DataFrame, lookback: int, stride: int, keys, value, columns) -> DataFrame:
    """Known rows dealt to the blocks that hold them: keys, _h0, _j, _p (place in the block, from -lookback to 47), ``columns``.

    Block j starts at slot _h0 + first + j * stride. A row lies in (lookback + 48) / stride blocks; blocks that no origin sees are left out.
    """
    first = max(lookback, WARMUP)
    rows = require_keys(df, list(keys)).join(limits, list(keys)).where(F.col(value).isNotNull() & (F.col("hh") < F.col("_last")))
    at = F.col("hh") - F.col("_h0") - first
    low = F.greatest(-floor_div(F.lit(DAY - 1) - at, stride), F.lit(0).cast("long"))
    high = F.least(floor_div(at + lookback, stride), floor_div(F.col("_last") - F.col("_h0") - first - DAY, stride))
    blocks = F.explode(F.when(low <= high, F.sequence(low, high)))
    return rows.withColumn("_at", at).select(*keys, "_h0", "_at", *columns, blocks.alias("_j")).withColumn("_p", F.col("_at") - F.col("_j") * stride).drop("_at")


def _limits(df: DataFrame, origins: DataFrame, keys) -> DataFrame:
    ends = require_keys(origins, list(keys)).groupBy(*keys).agg(F.max("origin_hh").alias("_last"))
    return df.groupBy(*keys).agg(F.min("hh").alias("_h0")).join(ends, list(keys))


def window_starts(df: DataFrame, origins: DataFrame, lookback: int = 336, stride: int = DAY, keys=KEYS, value="y") -> DataFrame:
    """keys, pos, start_hh of every block with a full encoder and target before the last origin: counts only, no array is built."""
    dealt = _dealt(df, _limits(df, origins, keys), lookback, stride, keys, value, [])
    full = dealt.groupBy(*keys, "_h0", "_j").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == lookback + DAY)
    pos = F.lit(max(lookback, WARMUP)) + F.col("_j") * stride
    return full.select(*keys, pos.alias("pos"), (F.col("_h0") + pos).alias("start_hh"))


def sequence_blocks(df: DataFrame, origins: DataFrame, lookback: int = 336, stride: int = DAY, encoder: list[str] = (), decoder: list[str] = (), keys=KEYS,
                    value="y") -> DataFrame:
    """keys, pos, start_hh, encoder, target, encoder_<column> and decoder_<column>: the arrays of every full block before the last origin.

    ``encoder`` names columns given for the steps before the start (as the target's own past is), ``decoder`` columns known ahead, given for the 48 steps from it on.
    Arrays are collected by block, ``lookback`` + 48 rows each, and only for blocks that are full: work is in proportion to the blocks kept.
    """
    limits = _limits(df, origins, keys)
    extra = list(dict.fromkeys([*encoder, *decoder]))
    kept = window_starts(df, origins, lookback, stride, keys, value)
    first = max(lookback, WARMUP)
    dealt = _dealt(df, limits, lookback, stride, keys, value, [value, *extra]).withColumn("pos", F.lit(first) + F.col("_j") * stride)
    whole = dealt.join(kept, [*keys, "pos"], "left_semi").groupBy(*keys, "_h0", "pos").agg(F.array_sort(F.collect_list(F.struct("_p", value, *extra))).alias("_r"))

    def past(c):
        return F.transform(F.slice("_r", 1, lookback), lambda r: r[c])

    def ahead(c):
        return F.transform(F.slice("_r", lookback + 1, DAY), lambda r: r[c])

    return whole.select(*keys, "pos", (F.col("_h0") + F.col("pos")).alias("start_hh"), past(value).alias("encoder"), ahead(value).alias("target"),
                        *[past(c).alias(f"encoder_{c}") for c in encoder], *[ahead(c).alias(f"decoder_{c}") for c in decoder])


def before_origins(blocks: DataFrame, origins: DataFrame, keys=KEYS) -> DataFrame:
    """``blocks`` with each origin that sees all of a block. Give it starts rather than arrays where there are many origins."""
    return blocks.join(origins.select(*keys, "origin_hh").distinct(), list(keys)).where(F.col("start_hh") + DAY <= F.col("origin_hh"))


def training_windows(df: DataFrame, origins: DataFrame, lookback: int = 336, stride: int = DAY,
                     keys=KEYS, value="y") -> DataFrame:
    """Block starts with a full encoder [s-L, s) and target [s, s+48) before the origin, as arrays."""
    blocks = before_origins(sequence_blocks(df, origins, lookback, stride, keys=keys, value=value), origins, keys)
    return blocks.select(*keys, "origin_hh", "pos", "start_hh", "encoder", "target")


def chronological_split(starts: DataFrame, days: int = 56, min_valid: int = 10, min_train: int = 100,
                        keys=KEYS) -> DataFrame:
    """Train blocks end before the validation days; a short history gives its last 10% instead.

    The short-history cut is an exact rank: numbers within chunks plus the counts of the chunks before.
    """
    val = F.col("origin_hh") - days * DAY
    tagged = starts.withColumns({"_tr": F.col("start_hh") + DAY <= val, "_va": F.col("start_hh") >= val})
    sizes = tagged.groupBy(*keys, "origin_hh").agg(
        F.count_if("_tr").alias("_ntr"), F.count_if("_va").alias("_nva"), F.count(F.lit(1)).alias("_n"))
    numbered = with_row_number(tagged, [*keys, "origin_hh"], ["start_hh"], floor_div("start_hh", CHUNK), "_k")
    j = numbered.join(sizes, [*keys, "origin_hh"])
    short = (F.col("_nva") < min_valid) | (F.col("_ntr") < min_train)
    part = (F.when(short, F.when(F.col("_k") < F.floor(F.col("_n") * 0.9), "train").otherwise("validation"))
            .when(F.col("_tr"), "train").when(F.col("_va"), "validation"))
    return j.withColumn("part", part).where("part is not null").drop("_tr", "_va", "_ntr", "_nva", "_n", "_k")
