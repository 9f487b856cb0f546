"""Resampling of readings to a fixed frequency."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import RUN, TIMESTAMP, numeric_columns
from ..functions.timebase import floor_time, frequency_micros
from ..storage import small_side

_DAY = frequency_micros("1d")
_BUCKET = "_bucket"

METHODS = ("mean", "max", "min", "first", "last")


def resample(
    df: DataFrame,
    frequency: str = "1min",
    method: str = "mean",
    time: str = TIMESTAMP,
    key: str | None = None,
    groups: Sequence[str] = (RUN,),
) -> DataFrame:
    """One row per group and time bucket, from the buckets that hold any value.

    Numeric columns are combined by ``method``; all others take their first non-null value.
    ``first`` and ``last`` follow (time, key), so pass a unique ``key`` where times repeat.
    Buckets are anchored at midnight of the group's first day, as they are at the epoch whenever the
    frequency divides a day. Without the time column the table is returned unchanged.
    """
    if time not in df.columns:
        return df
    if method not in METHODS:
        raise ValueError(f"unknown resampling method: {method}")
    groups = [g for g in groups if g in df.columns]
    helpers = {time, *groups, *([key] if key else [])}
    numbers = [c for c in numeric_columns(df.schema) if c not in helpers]
    others = [c for c in df.columns if c not in helpers and c not in numbers]
    order = F.struct(time, key) if key else F.col(time)

    def combined(name: str) -> Column:
        c = F.col(name)
        if name in numbers and method in ("mean", "max", "min"):
            return {"mean": F.avg, "max": F.max, "min": F.min}[method](c).alias(name)
        pick = F.max_by if name in numbers and method == "last" else F.min_by
        return pick(c, F.when(c.isNotNull(), order)).alias(name)

    dated = df.where(F.col(time).isNotNull())
    origin = None
    if _DAY % frequency_micros(frequency):
        first_days = dated.groupBy(*groups).agg(F.date_trunc("day", F.min(time)).alias("_origin"))
        if groups:
            # Null-safe: a run without a label or an id is a group like any other.
            named = first_days.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_origin")
            same = reduce(Column.__and__, [dated[g].eqNullSafe(F.col(f"_of_{g}")) for g in groups])
            dated = dated.join(small_side(named), same).drop(*[f"_of_{g}" for g in groups])
        else:
            dated = dated.withColumn("_origin", F.lit(first_days.first()[0]))
        origin = F.col("_origin")
    values = [*numbers, *others]
    if not values:
        # Nothing but times: the buckets that hold one.
        return dated.select(*groups, floor_time(F.col(time), frequency, origin).alias(time)).distinct()
    return (
        dated.groupBy(*groups, floor_time(F.col(time), frequency, origin).alias(_BUCKET))
        .agg(*[combined(c) for c in values])
        .where(reduce(Column.__or__, [F.col(c).isNotNull() for c in values]))
        .withColumnRenamed(_BUCKET, time)
    )
