"""Streaming counterparts of resampling, de-duplication and forecast scoring."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadtide.functions.clock import slot
from loadtide.session import scratch_path


def file_stream(spark: SparkSession, folder: str, name: str, files_a_batch: int | None = None) -> DataFrame:
    """Stream of the files in ``folder`` matching ``name``, with the table's own schema, oldest first."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def _event_time(ts="ts"):
    return F.col(ts).cast("timestamp")


def stream_half_hour_mean(readings: DataFrame, delay: str = "1 hour", keys=("region",), right: bool = False) -> DataFrame:
    """Half-hour mean per series with late data; right-closed bins shift by one microsecond."""
    shift = F.expr("interval 1 microsecond") if right else F.expr("interval 0 microsecond")
    timed = readings.withColumn("_t", _event_time() - shift).withWatermark("_t", delay)
    edge = "end" if right else "start"
    return (timed.groupBy(*keys, F.window("_t", "30 minutes").alias("_w"))
            .agg(F.avg("y").alias("y"), F.count("y").alias("n_source_readings"))
            .select(*keys, F.col(f"_w.{edge}").cast("timestamp_ntz").alias("ts"), "y", "n_source_readings"))


def stream_dedupe(readings: DataFrame, delay: str = "1 hour", keys=("region",)) -> DataFrame:
    """First copy of each (series, timestamp) within the watermark."""
    return (readings.withColumn("_t", _event_time()).withWatermark("_t", delay)
            .dropDuplicatesWithinWatermark([*keys, "_t"]).drop("_t"))


def stream_keep_last(readings: DataFrame, delay: str = "1 hour", keys=("region",), order: str = "seq") -> DataFrame:
    """Last copy by ``order`` of each (series, timestamp), as the batch rule has it, emitted once when the watermark has passed the timestamp.

    State holds one row per key and timestamp within ``delay``. A copy that comes later than that is dropped, whatever its order.
    """
    rest = [c for c in readings.columns if c not in (*keys, "ts")]
    timed = readings.withColumn("_t", _event_time()).withWatermark("_t", delay)
    last = timed.groupBy(*keys, "_t").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*keys, F.col("_t").cast("timestamp_ntz").alias("ts"), *[F.col(f"_last.{c}").alias(c) for c in rest])


def stream_forecast_error(readings: DataFrame, frozen: DataFrame, delay: str = "1 hour", keys=("region",)) -> DataFrame:
    """Stream against a static forecast table: daily MAE and bias per series."""
    rows = readings.withColumns({"_t": _event_time(), "hh": slot("ts")}).withWatermark("_t", delay)
    j = rows.join(frozen.select(*keys, "hh", "forecast").where("forecast is not null"), [*keys, "hh"])
    err = F.col("forecast") - F.col("y")
    return (j.groupBy(*keys, F.window("_t", "1 day").alias("_w"))
            .agg(F.count(F.lit(1)).alias("readings"), F.avg(F.abs(err)).alias("MAE"), F.avg(err).alias("Bias"))
            .select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("day"), "readings", "MAE", "Bias"))


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there now into Parquet in the shared folder and read it back."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = (stream.writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


