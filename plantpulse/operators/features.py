"""Windowed time-domain features: one aggregation per feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import RUN, STATUS, TIMESTAMP, numeric_columns, require_columns
from ..functions.statistics import STANDARD, majority, statistic
from ..functions.timebase import floor_time, frequency_interval
from ..storage import small_side
from .filters import nan_to_null
from .ordering import GROUP_ROWS, large_groups, with_neighbours, with_previous
from .selection import grouped_quantiles

_WINDOW = "_window"
# Statistics that need the third or fourth moment.
MOMENTS = {"skewness", "kurtosis", "population_skewness", "population_kurtosis"}
# Labels that are counted one by one; with more values the labels are counted as rows of their own.
LABELS = 64


def sensor_columns(df: DataFrame, time: str, target: str, exclude: Sequence[str]) -> list[str]:
    return numeric_columns(df.schema, exclude=(time, target, RUN, *exclude))


def feature_aggregates(
    sensors: Sequence[str],
    statistics: Sequence[str],
    target: str | None = None,
    labels: Sequence[str] | None = None,
) -> list[Column]:
    """Aggregate columns of a feature table: statistic by statistic, then the majority label."""
    made = [statistic(s)(F.col(c).cast("double")).alias(f"{c}_{s}") for s in statistics for c in sensors]
    return made + ([majority(F.col(target), labels).alias(target)] if target else [])


def known_labels(df: DataFrame, column: str) -> list[str] | None:
    """The distinct values of a label column, or None where there are more than ``LABELS``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().take(LABELS + 1)
    return sorted(r[0] for r in rows) if 0 < len(rows) <= LABELS else None


def aggregate_windows(
    df: DataFrame,
    keys: Sequence[str],
    sensors: Sequence[str],
    statistics: Sequence[str],
    labels: Mapping[str, Sequence[str] | None],
    count: str | None = None,
    limit: int | None = GROUP_ROWS,
) -> DataFrame:
    """Statistics of the sensors and majority labels per group, and the group's rows as ``count``.

    Moments of many sensors in one aggregation make generated code too large to be compiled. With
    several sensors they are therefore taken over (sensor, value) pairs and brought back into columns by
    a second, small aggregation.

    The partial results of these are many times as wide as the rows, and groups of a few rows have about as many of them. So
    the rows are moved, once, to the task of their group, where both aggregations are made. Only groups of more than
    ``limit`` rows are combined map-side; None says that there are none.
    """
    votes = [majority(F.col(c), known).cast(df.schema[c].dataType).alias(c) for c, known in labels.items()]
    votes += [F.count(F.lit(1)).alias(count)] if count else []
    if len(sensors) < 2 or not set(statistics) & MOMENTS:
        return df.groupBy(*keys).agg(*feature_aggregates(sensors, statistics), *votes)
    # Known labels travel as numbers, which a hash aggregate can hold; text would force a sort.
    places = {c: F.array(*map(F.lit, known)) for c, known in labels.items() if known}
    whole = {c: F.element_at(places[c], F.max(F.array_position(places[c], F.col(c))).cast("int")) for c in places}

    def measured(rows: DataFrame) -> DataFrame:
        values = F.array(*[F.col(c).cast("double") for c in sensors])
        pairs = rows.select(*keys, *labels, F.posexplode(values).alias("_sensor", "_x"))
        single = pairs.groupBy(*keys, "_sensor").agg(
            *[statistic(s)(F.col("_x")).alias(f"_{s}") for s in statistics], *votes
        )
        columns = [
            F.max(F.when(F.col("_sensor") == i, F.col(f"_{s}"))).alias(f"{c}_{s}")
            for s in statistics
            for i, c in enumerate(sensors)
        ]
        kept = [whole.get(c, F.max(c)).alias(c) for c in [*labels, *([count] if count else [])]]
        return single.groupBy(*keys).agg(*columns, *kept)

    rows = df.select(*dict.fromkeys([*keys, *labels, *sensors]))
    large = large_groups(rows, keys, limit) if limit is not None else None
    if large is None:
        return measured(rows.repartition(*keys))
    large = small_side(large.select(*[F.col(k).alias(f"_of_{k}") for k in keys]))
    same = reduce(Column.__and__, [rows[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    few = rows.join(large, same, "left_anti").repartition(*keys)
    return measured(few).unionByName(measured(rows.join(large, same, "left_semi")))


def extract_features(
    df: DataFrame,
    window: str = "10min",
    time: str = TIMESTAMP,
    target: str = STATUS,
    exclude: Sequence[str] = (RUN,),
    statistics: Sequence[str] = tuple(STANDARD),
    labels: Sequence[str] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Statistics of every sensor per tumbling window and run, with the majority target.

    The run is a key when the table has one. Rows without a time or run are left out. ``carry``
    names further label columns to keep by majority. Target values not listed in ``labels`` are
    looked up first, because counting known labels keeps the work in plain hash aggregates.
    """
    require_columns(df, time)
    keys = [RUN] if RUN in df.columns else []
    present = F.col(time).isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    rows = nan_to_null(df.where(present)).withColumn(_WINDOW, floor_time(F.col(time), window))
    return _windowed(rows, keys, time, target, exclude, statistics, labels, carry)


def sliding_features(
    df: DataFrame,
    window: str,
    slide: str,
    time: str = TIMESTAMP,
    target: str = STATUS,
    exclude: Sequence[str] = (RUN,),
    statistics: Sequence[str] = tuple(STANDARD),
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """As :func:`extract_features` over overlapping windows that start every ``slide``."""
    keys = [RUN] if RUN in df.columns else []
    span = F.window(F.col(time), frequency_interval(window), frequency_interval(slide))
    rows = nan_to_null(df).withColumn(_WINDOW, span).withColumn(_WINDOW, F.col(f"{_WINDOW}.start"))
    return _windowed(rows, keys, time, target, exclude, statistics, labels, ())


def _windowed(rows, keys, time, target, exclude, statistics, labels, carry) -> DataFrame:
    sensors = sensor_columns(rows.drop(_WINDOW), time, target, exclude)
    named = {target: labels} if target in rows.columns else {}
    named.update({c: None for c in carry})
    named = {c: known or known_labels(rows, c) for c, known in named.items()}
    # Labels too many to be counted one by one are counted as rows and joined: the same vote, ties and type.
    many = [c for c, known in named.items() if known is None]
    table = aggregate_windows(rows, [_WINDOW, *keys], sensors, statistics, {c: k for c, k in named.items() if k is not None})
    for c in many:
        votes = majority_labels(rows, [_WINDOW, *keys], c).withColumnsRenamed({k: f"_of_{k}" for k in (_WINDOW, *keys)})
        same = reduce(Column.__and__, [table[k].eqNullSafe(F.col(f"_of_{k}")) for k in (_WINDOW, *keys)])
        table = table.join(votes, same, "left").drop(*[f"_of_{k}" for k in (_WINDOW, *keys)])
    if many:
        own = [c for c in table.columns if c not in named]
        table = table.select(*own, *[c for c in named])
    return table.withColumnRenamed(_WINDOW, time)


def majority_labels(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label per group without knowing the labels: counts are combined map-side."""
    votes = df.groupBy(*keys, label).count()
    score = F.when(F.col(label).isNotNull(), F.struct((-F.col("count")).alias("votes"), F.col(label).alias("label")))
    return votes.groupBy(*keys).agg(F.min(score).alias("_best")).select(*keys, F.col("_best.label").alias(label))


def window_percentiles(
    df: DataFrame, window: str, sensor: str, fractions: Sequence[float], time: str = TIMESTAMP, limit: int = GROUP_ROWS
) -> DataFrame:
    """Exact percentiles of one sensor per (window, run), hot windows included."""
    bucketed = df.where(F.col(time).isNotNull()).withColumn(_WINDOW, floor_time(F.col(time), window))
    table = grouped_quantiles(bucketed, [_WINDOW, RUN], sensor, fractions, limit)
    columns = [F.col("quantiles")[i].alias(f"{sensor}_p{fraction * 100:g}") for i, fraction in enumerate(fractions)]
    return table.select(F.col(_WINDOW).alias(time), RUN, *columns)


def zero_crossings(
    df: DataFrame, window: str, sensor: str, key: str, time: str = TIMESTAMP, limit: int = GROUP_ROWS
) -> DataFrame:
    """How often a sensor crosses its window mean, per (window, run); a value on the mean is not a side."""
    rows = df.where(F.col(time).isNotNull() & F.col(sensor).isNotNull()).select(
        floor_time(F.col(time), window).alias(_WINDOW), RUN, time, key, sensor
    )
    means = rows.groupBy(_WINDOW, RUN).agg(F.avg(sensor).alias("_mean"))
    sides = rows.join(means, [_WINDOW, RUN]).withColumn("_side", F.signum(F.col(sensor) - F.col("_mean")))
    paired = with_previous(sides, [_WINDOW, RUN], [time, key], {"_before": F.col("_side")}, limit)
    crossed = F.count_if(F.col("_side") * F.col("_before") < 0).alias(f"{sensor}_zero_crossings")
    return paired.groupBy(_WINDOW, RUN).agg(crossed).withColumnRenamed(_WINDOW, time)


def peak_counts(
    df: DataFrame, window: str, sensor: str, key: str, time: str = TIMESTAMP, limit: int = GROUP_ROWS
) -> DataFrame:
    """Number of values above both neighbours, per (window, run)."""
    rows = df.where(F.col(time).isNotNull() & F.col(sensor).isNotNull()).select(
        floor_time(F.col(time), window).alias(_WINDOW), RUN, time, key, sensor
    )
    groups, order, x = [_WINDOW, RUN], [time, key], F.col(sensor)
    paired = with_neighbours(rows, groups, order, {"_before": x}, {"_after": x}, limit)
    peaks = F.count_if((x > F.col("_before")) & (x > F.col("_after"))).alias(f"{sensor}_peaks")
    return paired.groupBy(_WINDOW, RUN).agg(peaks).withColumnRenamed(_WINDOW, time)
