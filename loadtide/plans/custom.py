"""User-supplied forecasters: a function from a history frame and target slots to values."""
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["region"]


def run_forecaster(df: DataFrame, origins: DataFrame, forecaster, history_steps: int, name: str,
                   keys=KEYS, value="y") -> DataFrame:
    """Run ``forecaster(history, slots) -> values`` per (series, origin).

    Only the last ``history_steps`` slots before the origin reach the function,
    so a group never exceeds history plus horizon.
    """
    asked = (origins.select(*keys, "origin_hh", "end_hh",
                            F.explode(F.sequence(F.col("origin_hh") - history_steps, F.col("end_hh"))).alias("hh")))
    rows = asked.join(df.select(*keys, "hh", F.col(value).alias("_v")), [*keys, "hh"], "left")
    rows = rows.withColumn("_v", F.when(F.col("hh") < F.col("origin_hh"), F.col("_v")))
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", origin_hh long, hh long, forecast double, model string"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("hh")
        origin = int(frame["origin_hh"].iloc[0])
        past, ahead = frame[frame["hh"] < origin], frame[frame["hh"] >= origin]
        values = forecaster(past.set_index("hh")["_v"], ahead["hh"].to_numpy())
        out = {k: frame[k].iloc[0] for k in keys}
        return pd.DataFrame({**out, "origin_hh": origin, "hh": ahead["hh"].to_numpy(),
                             "forecast": values, "model": name})

    return rows.groupBy(*keys, "origin_hh").applyInPandas(run, schema)


def clock_mean(steps_per_day: int = 48):
    """Forecaster: mean of each half-hour over the history it is given.

    Made by a function, so it travels to the workers by value.
    """
    def forecaster(history, slots):
        by_clock = history.groupby(history.index % steps_per_day).mean()
        return [by_clock.get(int(h) % steps_per_day) for h in slots]
    return forecaster
