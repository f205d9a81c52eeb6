"""Checks as data: a table of rules becomes one aggregate per source, and one row per series and rule.

A rule counts offences. ``bad`` is a condition on a row of its source, ``total`` an aggregate that gives the number itself. A rule passes with no offence; else
its result is its severity. NULL conditions are no offences, so a rule on a column that may be missing says so itself.
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str = "FAIL"
    bad: str | None = None
    total: str | None = None

    def count(self):
        return F.count_if(F.expr(self.bad)) if self.bad else F.coalesce(F.expr(self.total).cast("long"), F.lit(0))


def evaluate(source: DataFrame, rules: list[Rule], keys=("region",)) -> DataFrame:
    """keys, check, result, offences, rows: every rule over ``source`` in one pass. A NULL key is a series like any other."""
    counted = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[r.count().cast("long").alias(f"_r{i}") for i, r in enumerate(rules)])
    unfolded = F.array(*[F.struct(F.lit(r.name).alias("check"), F.when(F.col(f"_r{i}") == 0, "PASS").otherwise(r.severity).alias("result"), F.col(f"_r{i}").alias("offences"))
                         for i, r in enumerate(rules)])
    return counted.select(*keys, F.inline(unfolded), F.col("_rows").alias("rows"))


def evaluate_all(sources: dict[str, DataFrame], rules: dict[str, list[Rule]], keys=("region",)) -> DataFrame:
    """The same over several named sources."""
    parts = [evaluate(sources[name], rules[name], keys).withColumn("source", F.lit(name)) for name in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: On forecast rows (origin_hh, end_hh, hh, forecast) with gap and jump to the row before, the series' largest step so far and its label convention.
FORECAST = [
    Rule("value_missing", bad="forecast IS NULL"),
    Rule("value_not_finite", bad="isnan(forecast) OR abs(forecast) = double('infinity')"),
    Rule("slot_repeated", total="count(*) - count(DISTINCT hh)"),
    Rule("step_irregular", bad="gap <> 1"),
    Rule("start_off", "WARNING", total="CASE WHEN min(hh) = max(origin_hh) THEN 0 ELSE 1 END"),
    Rule("end_off", "WARNING", total="CASE WHEN max(hh) = max(end_hh) THEN 0 ELSE 1 END"),
    Rule("slots_missing", "WARNING", total="abs(count(*) - (max(end_hh) - max(origin_hh) + 1))"),
    Rule("jump_beyond_history", "WARNING", bad="jump > largest_step"),
    Rule("value_negative", "WARNING", bad="forecast < 0"),
    Rule("label_at_interval_end", "WARNING", bad="label = 'ending'"),
]

#: On what was used to make forecasts: nothing may lie at or behind ``origin_hh``.
LEAKAGE = {
    "panel": [Rule("target_seen_behind_origin", bad="hh >= origin_hh AND y IS NOT NULL")],
    "profiles": [Rule("profile_of_later_rows", bad="history_end >= origin_hh")],
    "history": [Rule("history_ends_late", bad="history_end >= origin_hh"), Rule("no_history_before_origin", "WARNING", bad="history_rows = 0")],
    "scaler": [Rule("scaler_fitted_late", bad="fitted_until_hh >= origin_hh")],
    "lags": [Rule(f"lag_{k}_claims_history", bad=f"lag{k}_source = 'ACTUAL_HISTORY' AND hh - {k} >= origin_hh") for k in (48, 96, 336)],
    "horizon": [Rule("demand_known_ahead", bad="lag_48 IS NOT NULL OR previous_day_mean IS NOT NULL"), Rule("horizon_starts_early", bad="hh < origin_hh")],
    "predictors": [Rule("unsafe_predictor", bad="unsafe")],
    "verification": [Rule("verified_on_training_rows", bad="hh < origin_hh")],
}


def unsafe_name(name, patterns: list[str]):
    """Does a feature name match any of the patterns, whatever its case?"""
    return F.lower(name).rlike("|".join(f"({p})" for p in patterns))
