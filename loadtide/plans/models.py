"""Tree and linear models on the feature frame, and the day-block recursion."""
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadtide.config import DAY, LAGS, SEED
from loadtide.operators.features import demand_features
from loadtide.operators.ordered import require_keys
from loadtide.operators.quantiles import exact_median
from loadtide.session import cut_lineage

def estimator(kind: str, features: list[str], target: str = "y", quick: bool = False, **override):
    """Random forest, boosted trees or a linear model behind one assembler."""
    # Tree settings of the full and the quick run.
    settings = {
        "forest": {"numTrees": 40 if quick else 150, "maxDepth": 12 if quick else 18,
                   "minInstancesPerNode": 5 if quick else 2, "featureSubsetStrategy": "sqrt", "seed": SEED},
        "boost": {"maxIter": 300 if quick else 700, "maxDepth": 6 if quick else 8,
                  "stepSize": 0.08 if quick else 0.05, "subsamplingRate": 0.8, "seed": SEED},
        "linear": {"solver": "normal"},
    }[kind] | override
    regressor = {"forest": RandomForestRegressor, "boost": GBTRegressor, "linear": LinearRegression}[kind]
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"),
        regressor(featuresCol="features", labelCol=target, predictionCol="prediction", **settings)])


def _of_group(keys: list[str], group: tuple):
    """Rows of one group; a NULL key is a value like any other."""
    same = F.lit(True)
    for k, v in zip(keys, group):
        same = same & F.col(k).eqNullSafe(F.lit(v))
    return same


def fit_groups(train: DataFrame, keys: list[str], groups: list[tuple], kind: str, features: list[str],
               min_rows: int = 2000, parallel: int = 4, **settings) -> tuple[dict, list[dict]]:
    """One model per named group; independent fits share the cluster from a small thread pool.

    The training frame is written once, laid out by group, so the passes of each fit read its own files only. Returns the models and
    one status row per group: groups without enough rows, or whose data a fit refuses, have no model. Other errors rise.
    """
    full = cut_lineage(train.dropna(subset=[*features, "y"]).select("y", *features, *keys), "train", by=keys)
    sizes = {tuple(r[k] for k in keys): r["n"] for r in full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}

    def fit(group):
        n = sizes.get(tuple(group), 0)
        status = {**dict(zip(keys, group)), "train_rows": n}
        if n < min_rows:
            return None, {**status, "status": "MODEL_FAILED", "detail": "too few complete training rows"}
        try:
            return estimator(kind, features, **settings).fit(full.where(_of_group(keys, group))), {**status, "status": "MODEL_READY", "detail": ""}
        except IllegalArgumentException as exc:                      # the data don't suit the model: a row of the run table
            return None, {**status, "status": "MODEL_FAILED", "detail": str(exc)}

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(fit, groups))
    return {g: m for g, (m, _) in zip(groups, done) if m is not None}, [s for _, s in done]


def predict_groups(models: dict, keys: list[str]):
    """Block predictor over all groups: (features) -> the same rows with ``prediction``, NULL where a group has no model."""
    def predict(rows: DataFrame) -> DataFrame:
        known = F.lit(False)
        for group in models:
            known = known | _of_group(keys, group)
        out = rows.where(~known).withColumn("prediction", F.lit(None).cast("double"))
        for group, model in models.items():
            out = out.unionByName(model.transform(rows.where(_of_group(keys, group))).drop("features"))
        return out
    return predict


def predict_linear(models: dict, keys: list[str], features: list[str]):
    """The same for linear models in one pass: the coefficients are a table joined by group, so the plan doesn't grow with the groups."""
    table = [(*group, c["intercept"], [c[f] for f in features]) for group, m in models.items() for c in [linear_coefficients(m, features)]]

    def predict(rows: DataFrame) -> DataFrame:
        kinds = T.StructType([T.StructField(f"_{k}", rows.schema[k].dataType) for k in keys]
                             + [T.StructField("_intercept", T.DoubleType()), T.StructField("_slopes", T.ArrayType(T.DoubleType()))])
        slopes = rows.sparkSession.createDataFrame(table, kinds)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        terms = sum((F.col(f) * F.col("_slopes")[i] for i, f in enumerate(features)), F.col("_intercept"))
        return rows.join(slopes, same, "left").withColumn("prediction", terms).drop(*[f"_{k}" for k in keys], "_intercept", "_slopes")
    return predict


def training_medians(train: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Per-series fill values, fixed before the horizon is touched."""
    cells = F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("double").alias("_v")) for f in features])
    long = exact_median(train.select(*keys, F.inline(cells)), [*keys, "_f"], "_v", "_m")
    return long.groupBy(*keys).pivot("_f", list(features)).agg(F.first("_m")).select(*keys, *[F.col(f"`{f}`").alias(f"med_{f}") for f in features])


def recursive_forecast(state: DataFrame, known: DataFrame, medians: DataFrame, keys: list[str],
                       features: list[str], predict, origins: DataFrame) -> DataFrame:
    """Day-block recursion for all series and origins at once: keys, origin_hh, hh, forecast, filled_cells, status.

    ``origins`` has (keys, origin_hh, end_hh), one row per forecast asked for. ``state`` has (keys, hh, y), ``known`` the other features on
    the horizons and ``medians`` fill values; the last two may depend on origin_hh too. Every demand feature looks back
    at least 48 steps, so a whole day is predicted together from actuals and earlier blocks. Only the last 14 days
    feed a block, and each block is written to the shared folder, so the plan stays short and a lost executor re-reads
    files. Every asked slot comes back; without a model its forecast is NULL and its status NO_MODEL. A NULL key in ``origins`` raises.
    """
    demand = [f for f in features if f in {*LAGS, "previous_day_mean", "previous_day_peak", "previous_day_min",
                                           "same_half_hour_7day_mean", "same_half_hour_14day_mean",
                                           "rolling_mean_24h_at_t_minus_48", "rolling_std_24h_at_t_minus_48"}]
    given = [f for f in features if f not in demand]
    group = [*keys, "origin_hh"]
    spans = cut_lineage(require_keys(origins, list(keys)).select(*group, "end_hh").distinct(), "origins")
    days = (spans.agg(F.max(F.col("end_hh") - F.col("origin_hh"))).first()[0] or -DAY) // DAY + 1

    def on(frame):
        return group if "origin_hh" in frame.columns else keys

    asked = spans.select(*group, F.explode(F.sequence("origin_hh", "end_hh")).alias("hh"))
    horizon = asked.join(known.select(*on(known), "hh", *given), [*on(known), "hh"], "left").join(medians, on(medians), "left")
    horizon = cut_lineage(horizon.withColumn("_day", F.floor((F.col("hh") - F.col("origin_hh")) / DAY)), "known", by=["_day"])
    actual = cut_lineage(state.select(*keys, "hh", "y").join(spans.select(*group), keys)
                         .where(F.col("hh").between(F.col("origin_hh") - 14 * DAY, F.col("origin_hh") - 1)), "state")
    blocks = []
    for d in range(days):
        block = horizon.where(F.col("_day") == d).drop("_day")
        window = block.select(*group, "hh", F.lit(None).cast("double").alias("y"))
        if d < 14:
            window = window.unionByName(actual.where(F.col("hh") >= F.col("origin_hh") + (d - 14) * DAY).select(*group, "hh", "y"))
        for b in blocks[-14:]:
            window = window.unionByName(b.select(*group, "hh", F.col("forecast").alias("y")))
        made = (demand_features(window, group, skip_nulls=False)
                .where(F.col("hh") >= F.col("origin_hh") + d * DAY).select(*group, "hh", *demand))
        rows = block.join(made, [*group, "hh"])
        missing = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0))
        rows = (rows.withColumn("filled_cells", missing)
                .withColumns({f: F.coalesce(F.col(f).cast("double"), F.col(f"med_{f}"), F.lit(0.0)) for f in features}))
        out = predict(rows.select(*group, "hh", "filled_cells", *features)).select(
            *group, "hh", F.col("prediction").alias("forecast"), "filled_cells", F.when(F.col("prediction").isNull(), "NO_MODEL").otherwise("OK").alias("status"))
        blocks.append(cut_lineage(out, "block"))
    if not blocks:
        return spans.limit(0).select(*group, F.col("end_hh").alias("hh"), F.lit(0.0).alias("forecast"), F.lit(0).alias("filled_cells"), F.lit("").alias("status"))
    result = blocks[0]
    for b in blocks[1:]:
        result = result.unionByName(b)
    return result


def importance_table(spark, models: dict, keys: list[str], features: list[str]) -> DataFrame:
    """Feature importance per group, a models x features table."""
    rows = [(*group, f, float(v)) for group, m in models.items()
            for f, v in zip(features, m.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + ", feature string, importance double")


def linear_coefficients(model, features: list[str]) -> dict:
    reg = model.stages[-1]
    return dict(zip(["intercept", *features], [float(reg.intercept), *map(float, reg.coefficients)]))


