"""The standard window statistics over an array of readings, for short batches held in one row.

They equal the aggregates of :mod:`.statistics` and stay inside the JVM, so a streaming query can
score a batch without a Python function.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mean_of(values: Column, term) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))
    return total / F.nullif(F.size(values).cast("double"), F.lit(0.0))


def _statistics(values: Column, mean: Column, powers: list[Column]) -> dict[str, Column]:
    second, third, fourth = powers
    n = F.size(values).cast("double")
    low, high = F.array_min(values), F.array_max(values)
    spread = F.nullif(second, F.lit(0.0))
    skewness = third / (spread * F.sqrt(spread)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    excess = fourth / (spread * spread) - 3
    kurtosis = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * excess + 6)
    constant = low == high
    return {
        "mean": mean,
        "std": F.when(constant, 0.0).otherwise(F.sqrt(second)),
        "min": low,
        "max": high,
        "rms": F.sqrt(second + mean * mean),
        "peak_to_peak": high - low,
        "skewness": F.when(n < 3, F.lit(None)).when(constant, 0.0).otherwise(skewness),
        "kurtosis": F.when(n < 4, F.lit(None)).when(constant, 0.0).otherwise(kurtosis),
    }


def with_array_statistics(df: DataFrame, arrays: Mapping[str, str]) -> DataFrame:
    """Add ``{sensor}_{statistic}`` for each sensor whose non-null doubles are in the named array column.

    Means, then central moments, are columns of their own, so each is computed once a row.
    """
    means = {f"_mean_{s}": _mean_of(F.col(a), lambda x: x) for s, a in arrays.items()}
    power = lambda s, a, p: _mean_of(F.col(a), lambda x: p(x - F.col(f"_mean_{s}")))
    kinds = (lambda d: d * d, lambda d: d * d * d, lambda d: d * d * d * d)
    moments = {f"_moment{i}_{s}": power(s, a, p) for s, a in arrays.items() for i, p in enumerate(kinds)}
    named = lambda s: [F.col(f"_moment{i}_{s}") for i in range(len(kinds))]
    made = {
        f"{s}_{name}": column
        for s, a in arrays.items()
        for name, column in _statistics(F.col(a), F.col(f"_mean_{s}"), named(s)).items()
    }
    return df.withColumns(means).withColumns(moments).withColumns(made).drop(*means, *moments)
