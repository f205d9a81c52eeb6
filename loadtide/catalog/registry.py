"""Registry of named queries, each with the SQL that checks it."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.catalog.check_views import CTES

QUERIES: dict = {}
SQL: dict = {}
RAW_SQL: dict = {}                                                   # bodies before the shared views are put in front


def published(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, doubles at six digits, dates as midnight timestamps.

    The tiny offset moves exact halves off the rounding edge, so both engines agree.
    """
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "boolean"):
            c = c.cast("long")
        elif kind == "date":
            c = c.cast("timestamp_ntz")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double") + F.lit(1e-9), 6)
        out.append(c.alias(name))
    return df.select(*out)


def check_sql(body: str, nums: str = "", ints: str = "") -> str:
    """Prefix the shared views the body names and apply the same publication rules."""
    fixes = [f"round(CAST({c} AS DOUBLE) + 1e-9, 6) AS {c}" for c in nums.split()]
    fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    tail = f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({body})" if fixes else body
    return with_views(tail)


def with_views(sql: str) -> str:
    import re
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + sql


def query(key: str, sql: str | None = None, nums: str = "", ints: str = ""):
    """Register fn(spark, folder) -> DataFrame under ``key``."""
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"{key} registered twice")

        def run(spark, folder):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return published(fn(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql:
            SQL[key] = check_sql(sql, nums, ints)
            RAW_SQL[key] = sql
        return fn
    return wrap
