"""Small numeric expressions that Spark has no single built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den where the denominator is positive, else null."""
    return F.when(den > 0, num / den)


def binomial_tail(successes: Column, trials: Column) -> Column:
    """Exact P(X >= successes) for a fair coin, capped at 1; no trials gives 1.

    ln C(n, k) comes from one walk up the recurrence C(n, k) = C(n, k-1) * (n-k+1) / k, which
    visits every k once and adds up the terms at or past the count.
    """
    n, s = trials.cast("double"), successes.cast("double")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest(trials, F.lit(1)).cast("int")),
        F.struct(
            (-n * F.log(F.lit(2.0))).alias("ln_term"),
            F.when(s <= 0, F.exp(-n * F.log(F.lit(2.0)))).otherwise(F.lit(0.0)).alias("total"),
        ),
        lambda acc, k: F.struct(
            (acc["ln_term"] + F.log((n - k + 1) / k)).alias("ln_term"),
            (
                acc["total"]
                + F.when(k >= s, F.exp(acc["ln_term"] + F.log((n - k + 1) / k))).otherwise(F.lit(0.0))
            ).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(trials <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), walk))


def round_sig(value: Column, figures: int) -> Column:
    """Rounded to significant figures, ties to even on the stored value."""
    pattern = "0." + "0" * (figures - 1) + "E0" if figures > 1 else "0E0"
    return F.when(value.isNotNull(), F.call_function("format_number", value, F.lit(pattern)).cast("double"))
