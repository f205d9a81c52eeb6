"""Helpers shared by the text operators."""
import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadtide.session import cut_lineage, forget, scratch_path  # noqa: F401

#: Rows in one Arrow batch. Texts are long, so a batch stays a few megabytes.
BATCH_ROWS = 256


def ship(module: str) -> None:
    """Send the module's functions to the executors by value, so that these need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batch) -> dict of lists`` over small Arrow batches, no shuffle."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kinds = spark.createDataFrame([], schema).schema
    arrow = to_arrow(kinds)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kinds)


def held(key: str, make):
    """An object that a Python worker makes once and keeps for its later tasks (tables of a tokenizer, say)."""
    store = sys.modules.setdefault("loadtide_held", types.ModuleType("loadtide_held")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def whole_text(column: str = "text"):
    """A missing text is an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


ship(__name__)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
