"""Window statistics as native aggregate expressions.

Every function maps a column to an aggregate column that Spark can combine map-side, so one hot
window costs one partial row per task. Divisors are guarded because ANSI mode raises on zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Statistic = Callable[[Column], Column]


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def peak_to_peak(x: Column) -> Column:
    return F.max(x) - F.min(x)


def adjusted_skewness(x: Column) -> Column:
    """Bias-adjusted sample skewness: null below three values, zero for constant values."""
    n = F.count(x).cast("double")
    adjusted = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None)).when(F.min(x) == F.max(x), 0.0).otherwise(adjusted)


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis: null below four values, zero for constant values."""
    n = F.count(x).cast("double")
    factor = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    adjusted = factor * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n < 4, F.lit(None)).when(F.min(x) == F.max(x), 0.0).otherwise(adjusted)


def population_skewness(x: Column) -> Column:
    """Third standardised moment; zero for constant values, null without values."""
    return F.when(F.min(x) == F.max(x), 0.0).otherwise(F.skewness(x))


def population_kurtosis(x: Column) -> Column:
    """Fourth standardised moment (not excess); zero for constant values, null without values."""
    return F.when(F.min(x) == F.max(x), 0.0).otherwise(F.kurtosis(x) + 3)


def crest_factor(x: Column) -> Column:
    return F.max(F.abs(x)) / F.nullif(rms(x), F.lit(0.0))


def energy(x: Column) -> Column:
    return F.sum(x * x)


# The statistics of every feature table, in column order.
STANDARD: dict[str, Statistic] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "rms": rms,
    "peak_to_peak": peak_to_peak,
    "skewness": adjusted_skewness,
    "kurtosis": adjusted_kurtosis,
}

# Statistics a caller can ask for by name besides the standard ones.
OPTIONAL: dict[str, Statistic] = {
    "crest_factor": crest_factor,
    "variance": F.var_pop,
    "energy": energy,
    "population_skewness": population_skewness,
    "population_kurtosis": population_kurtosis,
}


def register_statistic(name: str, statistic: Statistic) -> None:
    """Make a custom aggregate available to feature extraction under ``name``."""
    if name in STANDARD:
        raise ValueError(f"{name} is a standard statistic")
    OPTIONAL[name] = statistic


def statistic(name: str) -> Statistic:
    found = STANDARD.get(name) or OPTIONAL.get(name)
    if found is None:
        raise ValueError(f"unknown statistic: {name}")
    return found


def majority(label: Column, labels=None) -> Column:
    """Most frequent value, the smallest one on ties, null if there is none; nulls do not vote.

    With the ``labels`` known the vote is a handful of counters (plain hash aggregation). A value
    outside them raises rather than being left out. Without them Spark's ``mode`` is used.
    """
    if labels is None:
        return F.mode(label, deterministic=True)
    ordered = sorted(labels)
    votes = {name: F.count_if(label == name) for name in ordered}
    top = F.greatest(*votes.values()) if len(ordered) > 1 else votes[ordered[0]]
    winner = F.coalesce(*[F.when(votes[name] == top, F.lit(name)) for name in ordered])
    stray = F.count_if(~label.isin(ordered))
    return (
        F.when(stray > 0, F.raise_error(F.lit(f"label outside {ordered}")).cast("string"))
        .when(top > 0, winner)
    )
