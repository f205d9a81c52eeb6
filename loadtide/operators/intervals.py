"""Statistics of all rows before each of many origins, with every row read once.

Between two origins of a series lies an interval. Rows are summed up per interval, and what an origin sees is the sum of the
intervals before it. History is never copied per origin: the work is rows plus, for each cell of a statistic, its intervals.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadtide.operators.ordered import require_keys


def origin_lists(origins: DataFrame, keys: list[str], origin: str = "origin_hh") -> DataFrame:
    """keys, _o: the sorted origins of a series."""
    return require_keys(origins, list(keys)).groupBy(*keys).agg(F.array_sort(F.collect_set(origin)).alias("_o"))


def until_origin(df: DataFrame, origins: DataFrame, keys: list[str], pos: str = "hh", origin: str = "origin_hh") -> DataFrame:
    """``df`` with _until, the first origin after the row; rows that no origin of their series sees leave.

    A NULL in a key column raises, as in every grouped operator. Series without an origin have no rows.
    """
    listed = origin_lists(origins, keys, origin)
    first = F.element_at(F.filter("_o", lambda o: o > F.col(pos)), 1)
    seen = require_keys(df, list(keys)).join(listed, list(keys)).where(F.element_at("_o", -1) > F.col(pos))
    return seen.withColumn("_until", first).drop("_o")


def at_origins(states: DataFrame, origins: DataFrame, keys: list[str], cell: list[str], merged: dict[str, str], origin: str = "origin_hh") -> DataFrame:
    """keys, origin, cell and merged columns, a row for each origin that a cell has rows before.

    ``states`` has keys, cell, _until and the columns to merge: {column: "sum" | "min" | "max" | "list"}. A cell's states, one an
    interval at most, come together in one row, and each origin merges those before it. A NULL in a cell column is a cell of its own.
    """
    kinds = dict(states.dtypes)
    groups = states.groupBy(*keys, *cell).agg(F.collect_list(F.struct("_until", *merged)).alias("_s"))
    each = (groups.join(origin_lists(origins, keys, origin), list(keys)).select(*keys, *cell, "_s", F.explode("_o").alias(origin))
            .withColumn("_s", F.filter("_s", lambda s: s["_until"] <= F.col(origin))).where(F.size("_s") > 0))

    def fold(name: str, how: str) -> Column:
        values = F.transform("_s", lambda s: s[name])
        if how == "list":
            return F.flatten(values)
        if how in ("min", "max"):
            return (F.array_min if how == "min" else F.array_max)(values)
        return F.aggregate(F.array_compact(values), F.lit(0).cast(kinds[name]), lambda a, x: a + x)

    return each.select(*keys, origin, *cell, *[fold(n, how).alias(n) for n, how in merged.items()])
