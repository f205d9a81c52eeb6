"""Error metrics and the evidence tables built on them."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.config import LEAD_BANDS
from loadtide.functions.numeric import error_columns, percent_of, safe_corr
from loadtide.operators.quantiles import exact_median


def score_rows(df: DataFrame, actual="actual", forecast="forecast") -> DataFrame:
    """Finite pairs with their error columns."""
    ok = F.col(actual).isNotNull() & F.col(forecast).isNotNull()
    return df.where(ok).withColumns(error_columns(actual, forecast))


def metric_columns(actual="actual", median: bool = True) -> list[Column]:
    out = [F.count(F.lit(1)).alias("matched_intervals"),
           F.avg("absolute_error").alias("MAE"),
           F.sqrt(F.avg("squared_error")).alias("RMSE"),
           F.avg("smape_component").alias("sMAPE"),
           F.avg("error").alias("Bias"),
           F.count_if(F.col("smape_component").isNull()).alias("smape_excluded_intervals"),
           percent_of(F.avg("absolute_error"), F.avg(actual)).alias("nMAE_pct")]
    return out + [F.median("absolute_error").alias("MedAE")] if median else out


def error_metrics(df: DataFrame, keys: list[str], actual="actual", forecast="forecast",
                  bounded_groups: bool = True, extra: list[Column] = ()) -> DataFrame:
    """MAE, RMSE, sMAPE, bias, median error and counts per key.

    ``bounded_groups`` says the clock bounds a group (a day, a month, one
    horizon). Otherwise the median is taken by the bracketed exact method.
    """
    rows = score_rows(df, actual, forecast)
    if bounded_groups:
        return rows.groupBy(*keys).agg(*metric_columns(actual), *extra)
    med = exact_median(rows, keys, "absolute_error", "MedAE")
    return rows.groupBy(*keys).agg(*metric_columns(actual, median=False), *extra).join(med, keys)


def lead_band(step) -> Column:
    """Band of a zero-based horizon step."""
    step = F.col(step) if isinstance(step, str) else step
    out = None
    for name, lo, hi in LEAD_BANDS:
        test = step >= lo if hi is None else (step >= lo) & (step < hi)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def with_skill(scores: DataFrame, naive: list[str], keys=("region", "origin")) -> DataFrame:
    """Baseline (best naive MAE of the fold) and percentage skill against it."""
    w = W.partitionBy(*keys)
    base = F.min(F.when(F.col("model").isin(naive), F.col("MAE"))).over(w)
    return scores.withColumns({
        "baseline_MAE": base,
        "skill_vs_naive_pct": F.when(base > 0, F.lit(100.0) * (base - F.col("MAE")) / base)})


def source_consistency(df: DataFrame, keys: list[str], left: str, right: str, ts="ts") -> DataFrame:
    """How two sources of one quantity relate; ``left`` minus ``right``."""
    d = F.col(left) - F.col(right)
    return (df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("matched_intervals"),
                 F.min(ts).alias("window_start"), F.max(ts).alias("window_end"),
                 F.avg(F.abs(d)).alias("MAE_between_sources_MW"),
                 F.sqrt(F.avg(d * d)).alias("RMSE_between_sources_MW"),
                 F.avg(d).alias("Bias_between_sources_MW"),
                 safe_corr(left, right).alias("correlation")))


def monthly_forecast_summary(fc: DataFrame, keys: list[str], hours: float = 0.5) -> DataFrame:
    """Month statistics, first peak time, energy (MW x hours) and recursive share."""
    rows = fc.where("forecast is not null").withColumn("month", F.date_format("ts", "yyyy-MM"))
    out = rows.groupBy(*keys, "month").agg(
        F.avg("forecast").alias("mean_forecast_MW"), F.median("forecast").alias("median_forecast_MW"),
        F.min("forecast").alias("minimum_forecast_MW"), F.max("forecast").alias("maximum_forecast_MW"),
        F.max(F.struct(F.col("forecast").alias("v"), (-F.col("hh")).alias("t"))).alias("_peak"),
        F.count(F.lit(1)).alias("number_of_intervals"),
        (F.sum("forecast") * hours).alias("forecast_energy_MWh"),
        (F.avg("recursive_input_used") * 100.0).alias("recursive_input_share_pct"))
    from loadtide.functions.clock import slot_start
    return out.withColumn("peak_timestamp", slot_start(-F.col("_peak.t"))).drop("_peak")


def revision_table(frozen: DataFrame, live: DataFrame, keys=("region", "hh")) -> DataFrame:
    """Live minus frozen on the same target intervals."""
    a = frozen.select(*keys, F.col("forecast").alias("frozen_forecast_MW"))
    b = live.select(*keys, F.col("forecast").alias("current_forecast_MW"))
    j = a.join(b, list(keys)).dropna(subset=["frozen_forecast_MW", "current_forecast_MW"])
    rev = F.col("current_forecast_MW") - F.col("frozen_forecast_MW")
    return j.withColumns({"revision_MW": rev, "absolute_revision_MW": F.abs(rev),
                          "revision_pct": percent_of(rev, "frozen_forecast_MW")})


def learning_curves(history: DataFrame, keys: list[str], epoch_limit: int) -> DataFrame:
    """Best epoch, generalisation gap and a verdict per training run, in one aggregate."""
    agg = history.groupBy(*keys).agg(
        F.max("epoch").alias("epochs_run"), F.min("val_loss").alias("min_val_loss"),
        F.min(F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch", "loss"))).alias("_best"),
        F.max_by("val_loss", "epoch").alias("final_val_loss"),
        F.max_by("loss", "epoch").alias("final_loss"))
    out = agg.withColumns({"best_epoch": F.col("_best.epoch"), "train_loss_at_best": F.col("_best.loss")})
    limit = (F.col("best_epoch") == F.col("epochs_run")) & (F.col("epochs_run") == epoch_limit)
    worse = ((F.col("final_val_loss") > 1.10 * F.col("min_val_loss"))
             & (F.col("final_loss") < F.col("train_loss_at_best")))
    # The three verdict words.
    return out.drop("_best").withColumns({
        "generalisation_gap": F.col("min_val_loss") - F.col("train_loss_at_best"),
        "verdict": F.when(limit, "EPOCH_LIMIT_REACHED").when(worse, "OVERFITTING_SIGNAL").otherwise("CONVERGED")})


def worst_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Row with the largest ``value`` per key; the smallest name wins ties."""
    w = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    return (df.groupBy(*keys).agg(w.alias("_w"))
            .select(*keys, F.col("_w.n").alias(f"worst_{name}"), (-F.col("_w.v")).alias(f"worst_{value}")))
