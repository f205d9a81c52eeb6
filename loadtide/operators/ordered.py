"""Ordered work in bounded pieces.

A window over a whole series puts that series in one task. Here every window is
keyed by (series, chunk): fixed frames read a small halo copied from the next
chunk over, and open-ended steps (previous row, running count) carry a one-row
summary per chunk. A task then holds one chunk plus its halo, whatever the
length or share of the series.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.functions.clock import floor_div

CHUNK = 48 * 366          # a year of half-hours
CHUNK_COL, HOME_COL = "_chunk", "_home"


def with_halo(df: DataFrame, pos: str, back: int = 0, ahead: int = 0,
              chunk: int = CHUNK) -> DataFrame:
    """Copy rows near a chunk edge into the chunk that will look at them."""
    if max(back, ahead) > chunk:
        raise ValueError("halo is wider than the chunk")
    c = floor_div(pos, chunk)
    offset = F.pmod(F.col(pos), F.lit(chunk))

    def place(which, home):
        return F.struct(which.alias(CHUNK_COL), F.lit(home).alias(HOME_COL))

    copies = [place(c, True)]
    if back:
        copies.append(F.when(offset >= chunk - back, place(c + 1, False)))
    if ahead:
        copies.append(F.when(offset < ahead, place(c - 1, False)))
    return df.select("*", F.inline(F.array_compact(F.array(*copies))))


def framed(df: DataFrame, keys: list[str], pos: str, build, back: int = 0, ahead: int = 0,
           chunk: int = CHUNK) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` / ``ahead`` positions.

    ``build(w)`` gets the ordered window and returns {name: column}.
    """
    w = W.partitionBy(*keys, CHUNK_COL).orderBy(pos)
    return (with_halo(df, pos, back, ahead, chunk).withColumns(build(w))
            .where(F.col(HOME_COL)).drop(CHUNK_COL, HOME_COL))


def _edge_table(rows: DataFrame, keys, is_edge: Column, payload: Column, forward: bool):
    w = W.partitionBy(*keys).orderBy(CHUNK_COL)
    edge = rows.where(is_edge).select(*keys, CHUNK_COL, payload.alias("_edge"))
    move = F.lag if forward else F.lead
    return edge.select(*keys, CHUNK_COL, move("_edge").over(w).alias("_carried"))


def with_neighbour(df: DataFrame, keys: list[str], order: str, chunk: Column,
                   columns: dict, forward: bool = True) -> DataFrame:
    """Columns of the previous (or next) row, exact across chunk borders.

    ``chunk`` must grow with ``order``. ``columns`` maps new names to source names.
    """
    w = W.partitionBy(*keys, CHUNK_COL).orderBy(order)
    payload = F.struct(*[F.col(s).alias(n) for n, s in columns.items()])
    here, other = (F.lag, F.lead) if forward else (F.lead, F.lag)
    rows = (df.withColumn(CHUNK_COL, chunk)
            .withColumns({"_near": here(payload).over(w),
                          "_at_edge": other(F.lit(1)).over(w).isNull()}))
    edges = _edge_table(rows, keys, F.col("_at_edge"), payload, forward)
    joined = rows.join(edges, [*keys, CHUNK_COL], "left")
    best = F.coalesce("_near", "_carried")
    return (joined.withColumns({n: best[n] for n in columns})
            .drop(CHUNK_COL, "_near", "_at_edge", "_carried"))


def require_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """A NULL key raises: an equi-join would drop its rows without a word."""
    return df.withColumns({k: F.coalesce(F.col(k), F.raise_error(F.lit(f"NULL in key column {k}")).cast(df.schema[k].dataType)) for k in keys})


def with_row_number(df: DataFrame, keys: list[str], order: list, chunk: Column,
                    name: str = "pos") -> DataFrame:
    """Zero-based row number per series: number within the chunk plus a carried offset."""
    rows = require_keys(df, keys).withColumn(CHUNK_COL, chunk)
    inner = W.partitionBy(*keys, CHUNK_COL).orderBy(*order)
    before = W.partitionBy(*keys).orderBy(CHUNK_COL).rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, CHUNK_COL).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*keys, CHUNK_COL,
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (rows.withColumn("_inner", F.row_number().over(inner) - 1)
            .join(offsets, [*keys, CHUNK_COL])
            .withColumn(name, (F.col("_inner") + F.col("_offset")).cast("long"))
            .drop(CHUNK_COL, "_inner", "_offset"))


def keep_one(df: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """First or last row per key by ``order``, as an aggregate.

    Partial aggregation collapses the copies of a hot key before the shuffle,
    where a ``row_number`` window would bring them all to one task.
    """
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(*[pick(F.col(c), F.col(order)).alias(c) for c in rest])
            .select(*df.columns))
