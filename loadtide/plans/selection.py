"""Model screening, choice and family comparison from a score table."""
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadtide.config import COMPLEXITY, MODEL_ORDER, NAIVE_LAG, TIE_TOLERANCE
from loadtide.functions.clock import lookup

RANK = {m: i for i, m in enumerate(MODEL_ORDER)}


def fold_winners(scores: DataFrame, keys=("region",), fold="origin") -> DataFrame:
    """Lowest MAE per fold; model order settles ties. An aggregate, not a sort."""
    best = F.min(F.struct(F.col("MAE").alias("m"), lookup("model", RANK).alias("r"), F.col("model").alias("name")))
    return (scores.where("MAE is not null").groupBy(*keys, fold).agg(best.alias("_b"))
            .select(*keys, fold, F.col("_b.name").alias("winner"), F.col("_b.m").alias("winner_MAE")))


def win_rates(scores: DataFrame, keys=("region",), fold="origin") -> DataFrame:
    wins = (fold_winners(scores, keys, fold).groupBy(*keys, F.col("winner").alias("model"))
            .agg(F.count(F.lit(1)).alias("wins")))
    folds = scores.where("MAE is not null").groupBy(*keys).agg(F.count_distinct(fold).alias("folds"))
    models = scores.where("MAE is not null").select(*keys, "model").distinct()
    return (models.join(folds, list(keys)).join(wins, [*keys, "model"], "left")
            .withColumns({"wins": F.coalesce("wins", F.lit(0)),
                          "win_rate_pct": F.coalesce("wins", F.lit(0)) / F.col("folds") * 100.0}))


def screen(scores: DataFrame, keys=("region",), factor: float = 2.0) -> DataFrame:
    """Drop a non-naive model above ``factor`` times the best mean MAE; if none is left, keep all."""
    mean = scores.where("MAE is not null").groupBy(*keys, "model").agg(F.avg("MAE").alias("mean_MAE"))
    w = W.partitionBy(*keys)
    naive = F.col("model").isin(list(NAIVE_LAG))
    ok = naive | (F.col("mean_MAE") <= factor * F.min("mean_MAE").over(w))
    mean = mean.withColumn("_ok", ok)
    left = F.max(F.when(~naive, F.col("_ok").cast("int"))).over(w)
    return (mean.withColumn("keep", (F.col("_ok") | (F.coalesce(left, F.lit(0)) == 0)).cast("int"))
            .drop("_ok"))


def aggregate_scores(scores: DataFrame, keys=("region",), fold="origin") -> DataFrame:
    """Per model over folds: mean, median and spread of MAE, other means, skill, win rate.

    Rows are READY ones, or WARNING ones where a region has no READY row.
    """
    ok = scores.where("MAE is not null and status in ('MODEL_READY', 'MODEL_READY_WITH_WARNING')")
    w = W.partitionBy(*keys)
    ready = F.max((F.col("status") == "MODEL_READY").cast("int")).over(w)
    used = (ok.withColumn("_r", ready)
            .where((F.col("status") == "MODEL_READY") | (F.col("_r") == 0)).drop("_r"))
    agg = used.groupBy(*keys, "model").agg(
        F.avg("MAE").alias("mean_backtest_MAE"), F.median("MAE").alias("median_backtest_MAE"),
        F.avg("RMSE").alias("mean_RMSE"), F.avg("sMAPE").alias("mean_sMAPE"), F.avg("Bias").alias("mean_Bias"),
        F.stddev_samp("MAE").alias("mae_spread"), F.count_distinct(fold).alias("origins"),
        F.avg("skill_vs_naive_pct").alias("skill_vs_naive_pct"),
        F.max("status").alias("model_status"))
    return agg.join(win_rates(used, keys, fold).drop("wins", "folds"), [*keys, "model"])


def choose(agg: DataFrame, keys=("region",), tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Within tolerance of the best mean MAE: simplest, then lowest MAE, then steadiest."""
    w = W.partitionBy(*keys)
    near = (agg.withColumn("_best", F.min("mean_backtest_MAE").over(w))
            .where(F.col("mean_backtest_MAE") <= F.col("_best") * (1 + tolerance))
            .withColumn("complexity", F.coalesce(lookup("model", COMPLEXITY), F.lit(9))))
    order = W.partitionBy(*keys).orderBy(
        "complexity", "mean_backtest_MAE", F.col("mae_spread").asc_nulls_last(), lookup("model", RANK))
    return (near.withColumn("_r", F.row_number().over(order)).where("_r = 1")
            .drop("_r", "_best").withColumnRenamed("model", "selected_model"))


def family_champions(scores: DataFrame, families: dict, keys=("region",), fold="origin") -> DataFrame:
    """Best model of each family, families being disjoint sets of model names."""
    names = {m: fam for fam, models in families.items() for m in models}
    tagged = (scores.where(F.col("model").isin(list(names)))
              .withColumn("family", lookup("model", names)))
    return choose(aggregate_scores(tagged, [*keys, "family"], fold), [*keys, "family"])


def compare_families(champions: DataFrame, keys=("region",)) -> DataFrame:
    """A and B champions side by side with the skill of B over A."""
    def side(fam, tag):
        return F.max(F.when(F.col("family") == fam, F.col(tag)))
    out = champions.groupBy(*keys).agg(
        side("MODEL_A", "selected_model").alias("best_model_A"), side("MODEL_B", "selected_model").alias("best_model_B"),
        side("MODEL_A", "mean_backtest_MAE").alias("model_A_mean_MAE"),
        side("MODEL_B", "mean_backtest_MAE").alias("model_B_mean_MAE"),
        side("MODEL_A", "win_rate_pct").alias("model_A_win_rate_pct"),
        side("MODEL_B", "win_rate_pct").alias("model_B_win_rate_pct"))
    a, b = F.col("model_A_mean_MAE"), F.col("model_B_mean_MAE")
    return (out.where("best_model_A is not null and best_model_B is not null")
            .withColumn("weather_skill_vs_A_pct", F.when(a > 0, F.lit(100.0) * (a - b) / a)))


def wins_by(metrics: DataFrame, keys: list[str], unit: list[str]) -> DataFrame:
    """How many units (months, origins) each family wins on MAE, and near-ties."""
    pair = metrics.groupBy(*keys, *unit).agg(
        F.avg(F.when(F.col("family") == "MODEL_A", F.col("MAE"))).alias("a"),
        F.avg(F.when(F.col("family") == "MODEL_B", F.col("MAE"))).alias("b")).dropna()
    close = F.abs(F.col("a") - F.col("b")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("b")
    return pair.groupBy(*keys).agg(F.count_if(F.col("a") < F.col("b")).alias("model_A_wins"),
                                   F.count_if(F.col("b") < F.col("a")).alias("model_B_wins"),
                                   F.count_if(close).alias("ties"), F.count(F.lit(1)).alias("units"))
