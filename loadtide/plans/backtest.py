"""Backtests of naive and fitted models over many origins: interval detail, scores and status, each written once."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.config import LEAD_BANDS, NAIVE_LAG
from loadtide.operators import least_squares as lsq
from loadtide.operators.evaluate import error_metrics
from loadtide.operators.ordered import require_keys
from loadtide.plans import models, trees
from loadtide.plans.forecast import seasonal_naive
from loadtide.session import cut_lineage


def fitted_model(kind: str, train: DataFrame, origins: DataFrame, keys: list[str], features: list[str], min_rows: int, **settings):
    """(predictor, status) of one kind of model for every series and origin: one plan, whatever their number.

    ``train`` has keys, hh, y, the features and, where they depend on it, origin_hh. Status: keys, origin_hh, train_rows, status, detail for groups with any complete row.
    """
    group = [*keys, "origin_hh"]
    if kind == "linear":
        if "origin_hh" in train.columns:
            fits = lsq.fit_all(train, group, "y", features)
        else:
            fits = lsq.fit_all(train, keys, "y", features, origins)
        good = (F.col("n") >= min_rows) & F.col("status").isin("OK", "RANK_DEFICIENT")
        fits = cut_lineage(fits, "linear")
        status = fits.select(*group, F.col("n").alias("train_rows"),
                             F.when(good & (F.col("status") == "OK"), "MODEL_READY").when(good, "MODEL_READY_WITH_WARNING").otherwise("MODEL_FAILED").alias("status"),
                             F.when(~good, "too few complete training rows").when(F.col("status") != "OK", "features depend on each other").otherwise("").alias("detail"))
        usable = fits.where(good)
        return (lambda rows: lsq.predict(rows, usable, group, features)), status
    past = train if "origin_hh" in train.columns else train.join(origins.select(*group), keys).where(F.col("hh") < F.col("origin_hh"))
    fit = {"forest": trees.fit_forest, "boost": trees.fit_boost}[kind]
    made, groups, status = fit(past, group, features, min_rows=min_rows, **settings)
    forests = cut_lineage(trees.packed(made, groups, group, features, kind == "forest"), "packed")
    return (lambda rows: trees.predict(rows, forests, group, features)), status


def backtest(grid: DataFrame, train: DataFrame, known: DataFrame, origins: DataFrame, keys: list[str], fitted: dict, naive: list[str] = tuple(NAIVE_LAG),
             min_rows: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(detail, status) of every model over every (series, origin).

    ``grid`` has keys, hh, y; ``train`` keys, hh, y and features without a look beyond hh, for each origin where they depend on it; ``known`` the features known
    on the horizons; ``origins`` keys, origin_hh, end_hh. ``fitted`` names models: {name: {"kind": "linear" | "forest" | "boost", "features": [...], other settings}}; each is
    fitted for all series and origins at once on the rows before them. A NULL key raises. Detail: keys, model, origin_hh, hh, step, forecast, y, status, a row for
    each asked slot. Status: a row per model, series and origin.
    """
    group = [*keys, "origin_hh"]
    origins = cut_lineage(require_keys(origins, list(keys)), "asked")
    asked = origins.select(*group).distinct()
    parts, rows = [], []
    for name in naive:
        f = seasonal_naive(grid, origins, NAIVE_LAG[name])
        parts.append(f.select(*group, "hh", F.col("forecast").cast("double").alias("forecast"), F.lit(name).alias("model"),
                              F.when(F.col("forecast").isNull(), "NO_HISTORY").otherwise("OK").alias("status")))
        rows.append(asked.select(*group, F.lit(name).alias("model"), F.lit(None).cast("long").alias("train_rows"), F.lit("MODEL_READY").alias("status"), F.lit("").alias("detail")))
    past = train if "origin_hh" in train.columns else train.join(asked, keys).where(F.col("hh") < F.col("origin_hh"))
    for name, spec in fitted.items():
        spec = dict(spec)
        kind, features = spec.pop("kind"), spec.pop("features")
        predict, status = fitted_model(kind, train, origins, keys, features, min_rows, **spec)
        medians = cut_lineage(models.training_medians(past, group, features), "medians")
        out = models.recursive_forecast(grid, known, medians, keys, features, predict, origins)
        parts.append(out.select(*group, "hh", "forecast", F.lit(name).alias("model"), "status"))
        rows.append(asked.join(status, group, "left").select(*group, F.lit(name).alias("model"), F.coalesce("train_rows", F.lit(0)).cast("long").alias("train_rows"),
                                                             F.coalesce("status", F.lit("MODEL_FAILED")).alias("status"),
                                                             F.coalesce("detail", F.lit("too few complete training rows")).alias("detail")))
    detail, status = parts[0], rows[0]
    for p in parts[1:]:
        detail = detail.unionByName(p)
    for r in rows[1:]:
        status = status.unionByName(r)
    detail = detail.withColumn("step", F.col("hh") - F.col("origin_hh")).join(grid.select(*keys, "hh", "y"), [*keys, "hh"], "left")
    return cut_lineage(detail.select(*keys, "model", "origin_hh", "hh", "step", "forecast", "y", "status"), "detail"), status


def backtest_scores(detail: DataFrame, keys: list[str]) -> DataFrame:
    """Error metrics per series, model and origin, with the mean absolute error of each lead band."""
    group = [*keys, "model", "origin_hh"]
    error = F.abs(F.col("forecast") - F.col("y"))
    bands = [F.avg(F.when((F.col("step") >= lo) & (F.col("step") < (hi if hi is not None else 1 << 40)), error)).alias(f"MAE_{name}") for name, lo, hi in LEAD_BANDS]
    return error_metrics(detail.withColumnRenamed("y", "actual"), group).join(detail.groupBy(*group).agg(*bands), group, "left")
