"""Null-safe numeric expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from loadtide.config import SMAPE_FLOOR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """Text to DOUBLE, bad text and NaN to NULL."""
    value = _col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def positive(x) -> Column:
    """max(x, 0) that keeps NULL, where ``greatest`` would skip it."""
    x = _col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def safe_corr(x, y) -> Column:
    """Correlation over jointly complete rows; NULL when a side never varies."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def percent_of(part, whole) -> Column:
    """100 * part / whole, NULL at a zero denominator."""
    whole = _col(whole)
    return F.when(F.abs(whole) > 0, F.lit(100.0) * _col(part) / whole)


def skill_percent(model, baseline) -> Column:
    baseline = _col(baseline)
    return F.when(baseline > 0, F.lit(100.0) * (baseline - _col(model)) / baseline)


def error_columns(actual="actual", forecast="forecast", floor: float = SMAPE_FLOOR) -> dict:
    """Row-level error parts; error is forecast minus actual."""
    a, f = _col(actual), _col(forecast)
    err = f - a
    size = F.abs(f) + F.abs(a)
    return {
        "error": err,
        "absolute_error": F.abs(err),
        "squared_error": err * err,
        "smape_component": F.when(size >= floor, F.lit(200.0) * F.abs(err) / size),
    }
