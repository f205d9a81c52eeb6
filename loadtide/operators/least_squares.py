"""Least squares of many groups at once from sums of products."""
import functools
import operator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.operators.intervals import until_origin
from loadtide.operators.ordered import framed, require_keys

FIT = "n long, params int, mse double, r2 double, adjusted_r2 double, AIC double, BIC double, status string, coefficients array<struct<term:string,coefficient:double>>"


def lagged(df: DataFrame, keys: list[str], pos: str, lags: dict[str, list[int]]) -> DataFrame:
    """Columns <name>_lag<k>: the value k positions before, null where that position is missing. Positions may have gaps; none may repeat."""
    reach = max((k for ks in lags.values() for k in ks), default=0)

    def build(w):
        # A frame of the one position asked for: what stands there, if anything does.
        return {f"{c}_lag{k}": F.first(c).over(w.rangeBetween(-k, -k)) for c, ks in lags.items() for k in ks}

    return framed(df, keys, pos, build, back=reach)


def cycles(df: DataFrame, pos: str, frequencies: dict[str, float]) -> DataFrame:
    """Columns cos_<name> and sin_<name> of each frequency, in cycles a position."""
    out = {}
    for name, f in frequencies.items():
        angle = F.lit(2 * np.pi * f) * F.col(pos)
        out |= {f"cos_{name}": F.cos(angle), f"sin_{name}": F.sin(angle)}
    return df.withColumns(out)


def fit_all(df: DataFrame, keys: list[str], target: str, terms: list[str], origins: DataFrame | None = None, pos: str = "hh", origin: str = "origin_hh") -> DataFrame:
    """Least squares of ``target`` on ``terms`` with an intercept, for every group of ``keys`` in one plan.

    With ``origins`` (keys, origin) one fit a series and origin, on the rows before it: sums of products are taken per interval between origins and
    added up, so no row is copied. Returns keys, origin, n (complete rows), params, mse (RSS / n), r2, adjusted_r2, AIC, BIC, status and coefficients.
    Rows with a null in target or terms are left out. With no more rows than parameters the status is TOO_FEW_ROWS and nothing is fitted; where the
    terms depend on each other it is RANK_DEFICIENT and the coefficients are the shortest that fit as well. A NULL key raises.
    """
    names, by = [*terms, target], [*keys, *([origin] if origins is not None else [])]
    origin = origin if origins is not None else "_origin"
    # One condition a column: a joint one would be rewritten for every set of renamed columns when the plan is optimised.
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in names])
    complete = require_keys(df, list(keys)).where(known)
    complete = complete.select(*keys, *([pos] if origins is not None else []), *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(names)])
    # Shifted by a mean of the series, so that squares of large values keep their digits; the shift cancels out.
    shifts = complete.groupBy(*keys).agg(F.array(*[F.avg(f"_z{i}") for i in range(len(names))]).alias("_shift"))
    rows = complete.join(shifts, list(keys)).withColumns({f"_z{i}": F.col(f"_z{i}") - F.col("_shift")[i] for i in range(len(names))})
    rows = until_origin(rows, origins, keys, pos, origin) if origins is not None else rows.withColumn("_until", F.lit(0))
    z = [F.col(f"_z{i}") for i in range(len(names))]
    sums = rows.groupBy(*keys, "_shift", "_until").agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(c) for c in z]).alias("_s"),
        F.array(*[F.sum(a * b) for i, a in enumerate(z) for b in z[i:]]).alias("_p"))
    upper, p = np.triu_indices(len(names)), len(terms)

    def solve(states: pd.DataFrame) -> pd.DataFrame:
        states = states.sort_values("_until")
        shift, out = np.array(states["_shift"].iloc[0]), []
        totals = (np.cumsum(np.stack(states[c].to_list()), axis=0) for c in ("_s", "_p"))
        for until, n, s, products in zip(states["_until"], states["_n"].cumsum(), *totals):
            row = {k: states[k].iloc[0] for k in keys} | {origin: until, "n": n, "params": p + 1}
            if n <= p + 1:
                out.append(row | {"status": "TOO_FEW_ROWS", "coefficients": None})
                continue
            full = np.zeros((p + 1, p + 1))
            full[upper] = products
            full = full + full.T - np.diag(np.diag(full)) - np.outer(s, s) / n
            a, b, yy = full[:p, :p], full[:p, p], full[p, p]
            scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
            slopes, _, rank, _ = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-11)
            slopes = slopes / scale
            rss = max(yy - slopes @ b, 0.0)
            means = s / n + shift
            base = n * (np.log(2 * np.pi) + np.log(rss / n) + 1) if rss > 0 else None
            r2 = 1 - rss / yy if yy > 0 else None
            values = [means[p] - slopes @ means[:p], *slopes]
            out.append(row | {"mse": rss / n, "r2": r2, "adjusted_r2": None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - p - 1),
                              "AIC": None if base is None else base + 2 * (p + 2), "BIC": None if base is None else base + np.log(n) * (p + 2),
                              "status": "OK" if rank == p else "RANK_DEFICIENT",
                              "coefficients": [{"term": t, "coefficient": float(v)} for t, v in zip(["intercept", *terms], values)]})
        return pd.DataFrame(out, columns=[*keys, origin, "n", "params", "mse", "r2", "adjusted_r2", "AIC", "BIC", "status", "coefficients"])

    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{origin}` {kinds['_until']}", FIT])
    # An interval is one row of sums, so a group holds as many rows as a series has origins.
    fitted = sums.groupBy(*keys).applyInPandas(solve, schema) if keys else sums.groupBy(F.lit(0)).applyInPandas(solve, schema)
    return fitted.select(*by, *[c for c in fitted.columns if c not in by and c != origin])


def coefficient_rows(fits: DataFrame, keep: list[str]) -> DataFrame:
    """keep, term, coefficient."""
    return fits.select(*keep, F.inline("coefficients"))


def predict(df: DataFrame, fits: DataFrame, on: list[str], terms: list[str]) -> DataFrame:
    """``df`` with prediction: the fitted value where its group has coefficients and all terms are known, else null."""
    slopes = fits.select(*[F.col(k).alias(f"_{k}") for k in on], F.transform("coefficients", lambda c: c["coefficient"]).alias("_b"))
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    value = sum((F.col("_b")[i + 1] * F.col(t) for i, t in enumerate(terms)), F.col("_b")[0])
    return df.join(slopes, same, "left").withColumn("prediction", value).drop("_b", *[f"_{k}" for k in on])
