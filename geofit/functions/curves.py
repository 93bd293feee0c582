"""Preference curves: an indicator value to a desirability in [0, 1].

Monotone curves read the percentile; band and point curves read the raw value. A missing
input stays missing. An unusable definition raises when a row reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONOTONE = ("higher_better", "lower_better")
RAW_VALUED = ("ideal_band", "ideal_point")
CURVES = MONOTONE + RAW_VALUED

PARAM_FIELDS = ("lo", "hi", "shoulder", "shoulder_lo", "shoulder_hi", "target", "tol")
PARAMS_TYPE = "struct<" + ",".join(f"{f}:double" for f in PARAM_FIELDS) + ">"


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def no_params() -> Column:
    return F.lit(None).cast(PARAMS_TYPE)


def params(**values) -> Column:
    """A curve_params struct from keyword values; fields not given are null."""
    return F.struct(
        *[
            (values[f] if isinstance(values.get(f), Column) else F.lit(values.get(f))).cast("double").alias(f)
            for f in PARAM_FIELDS
        ]
    )


def higher_better(percentile: Column) -> Column:
    return F.when(percentile.isNotNull(), clamp01(percentile))


def lower_better(percentile: Column) -> Column:
    return F.when(percentile.isNotNull(), clamp01(1.0 - percentile))


def ideal_band(value: Column, p: Column) -> Column:
    below = F.coalesce(p["shoulder_lo"], p["shoulder"])
    above = F.coalesce(p["shoulder_hi"], p["shoulder"])
    bad = p["lo"].isNull() | p["hi"].isNull() | (p["lo"] >= p["hi"])
    bad_shoulder = below.isNull() | above.isNull() | (below <= 0) | (above <= 0)
    return (
        F.when(value.isNull(), None)
        .when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("ideal_band needs lo < hi")).cast("double"))
        .when(bad_shoulder, F.raise_error(F.lit("ideal_band shoulders must be positive")).cast("double"))
        .when(value.between(p["lo"], p["hi"]), 1.0)
        .when(value < p["lo"], clamp01(1.0 - (p["lo"] - value) / below))
        .otherwise(clamp01(1.0 - (value - p["hi"]) / above))
    )


def ideal_point(value: Column, p: Column) -> Column:
    bad = p["target"].isNull() | p["tol"].isNull() | (p["tol"] <= 0)
    off = (value - p["target"]) / p["tol"]
    return (
        F.when(value.isNull(), None)
        .when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("ideal_point tol must be positive")).cast("double"))
        .otherwise(clamp01(F.exp(-(off * off))))
    )


def desirability(curve="curve", value="value", percentile="percentile", curve_params="params") -> Column:
    """The curve named on the row, applied to the row."""
    c, v, pct, p = (F.col(x) if isinstance(x, str) else x for x in (curve, value, percentile, curve_params))
    return (
        F.when(c == "higher_better", higher_better(pct))
        .when(c == "lower_better", lower_better(pct))
        .when(c == "ideal_band", ideal_band(v, p))
        .when(c == "ideal_point", ideal_point(v, p))
        .otherwise(F.raise_error(F.concat(F.lit("unknown curve "), F.coalesce(c, F.lit("null")))).cast("double"))
    )
