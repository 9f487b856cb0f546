"""Data-quality checks. Every check returns a DataFrame of plain rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import RUN, TIMESTAMP, numeric_columns
from ..storage import small_side, stage
from .filters import nan_to_null
from .ordering import GROUP_ROWS, with_previous
from .selection import column_quantiles, grouped_quantiles

# A value this many interquartile ranges outside the quartiles is an outlier.
OUTLIER_RANGES = 3
# A gap is an interval longer than this many median intervals.
GAP_MEDIANS = 3


def _melt(row: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """One row with columns ``{measure}_{name}`` to one row per name."""
    parts = [F.struct(F.lit(n).alias("column"), *[F.col(f"{m}_{n}").alias(m) for m in measures]) for n in names]
    return row.select(F.inline(F.array(*parts)))


def _missing_counts(df: DataFrame) -> list[Column]:
    absent = {f.name: F.col(f.name).isNull() | F.isnan(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f.name).isNull() for f in df.schema}
    return [F.count_if(a).alias(f"missing_{c}") for c, a in absent.items()]


def _missing_rows(counted: DataFrame, names: list[str]) -> DataFrame:
    total = reduce(Column.__add__, [F.col(f"missing_{c}") for c in names])
    per_column = _melt(counted.withColumn("missing_*", total), [*names, "*"], ["missing"])
    return per_column.where((F.col("missing") > 0) | (F.col("column") == "*"))


def check_missing(df: DataFrame) -> DataFrame:
    """(column, missing) for each column with nulls, and the total under ``*``; NaN is missing too."""
    return _missing_rows(df.agg(*_missing_counts(df)), df.columns)


def check_duplicates(df: DataFrame, time: str = TIMESTAMP) -> DataFrame:
    """Rows beyond the first of each timestamp; null timestamps equal each other."""
    if time not in df.columns:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicates"))
    sizes = df.groupBy(time).count()
    return sizes.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def _previous_times(df: DataFrame, order: Sequence[str], groups: list[str], time: str, limit: int) -> DataFrame:
    """Rows with the previous row's time in row order."""
    narrow = df.select(*dict.fromkeys([*groups, *order, time]))
    before = {"_before": F.struct(F.col(time).alias("t"))}
    return with_previous(narrow, groups, order, before, limit)


def _step(time: str) -> Column:
    return F.unix_micros(time) - F.unix_micros("_before.t")


def check_sorted(df: DataFrame, order: Sequence[str], groups=(RUN,), time: str = TIMESTAMP, limit: int = GROUP_ROWS) -> DataFrame:
    """Whether times never decrease in row order, per group; a null time makes it false.

    ``order`` names the columns that give the row order and must end in a unique one.
    """
    groups = list(groups)
    paired = _previous_times(df, order, groups, time, limit)
    fault = F.col(time).isNull() | (F.coalesce(_step(time), F.lit(0)) < 0)
    return paired.groupBy(*groups).agg((F.count_if(fault) == 0).alias("is_sorted"))


def check_gaps(df: DataFrame, order: Sequence[str], groups=(RUN,), time: str = TIMESTAMP, limit: int = GROUP_ROWS) -> DataFrame:
    """Median and largest interval between consecutive rows, and how many exceed three medians.

    Intervals are in microseconds. With ``groups`` empty the rows of all runs form one sequence in
    the given ``order``.
    """
    groups = list(groups)
    paired = _previous_times(df, order, groups, time, limit)
    # Written once: the intervals are read for the median and again for the gaps.
    steps = stage(paired.select(*groups, _step(time).alias("step")), "steps")
    medians = grouped_quantiles(steps, groups, "step", [0.5], limit).select(
        *groups, F.col("quantiles")[0].alias("median_interval")
    )
    if groups:
        joined = steps.join(small_side(medians), groups, "left")
    else:
        found = medians.first()
        joined = steps.withColumn("median_interval", F.lit(found[0] if found else None).cast("double"))
    return joined.groupBy(*groups).agg(
        F.count_if(F.col("step") > GAP_MEDIANS * F.col("median_interval")).alias("gaps"),
        F.max("median_interval").alias("median_interval"),
        F.max("step").alias("max_gap"),
    )


_RANGES = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}


def _range_measures(df: DataFrame) -> list[Column]:
    return [f(F.col(c).cast("double")).alias(f"{m}_{c}") for c in numeric_columns(df.schema) for m, f in _RANGES.items()]


def check_ranges(df: DataFrame) -> DataFrame:
    """(column, min, max, mean, std) of each numeric column, with the sample standard deviation."""
    return _melt(df.agg(*_range_measures(df)), numeric_columns(df.schema), list(_RANGES))


def check_outliers(df: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """(column, outliers) of each numeric column with values far outside its quartiles; NaN is read as null."""
    return _outliers(df, df.count() <= limit)


def _outliers(df: DataFrame, small: bool) -> DataFrame:
    df, names = nan_to_null(df), numeric_columns(df.schema)
    if small:
        found = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in names]).first().asDict() if names else {}
    else:
        found = column_quantiles(df, names, [0.25, 0.75])
    bounds = {}
    for name, quartiles in found.items():
        if quartiles:
            low, high = quartiles
            reach = OUTLIER_RANGES * (high - low)
            bounds[name] = (F.col(name) < F.lit(low - reach)) | (F.col(name) > F.lit(high + reach))
    row = df.agg(*[F.count_if(bounds[c] if c in bounds else F.lit(False)).alias(f"outliers_{c}") for c in names])
    return _melt(row, names, ["outliers"]).where("outliers > 0")


def _long(check: str, table: DataFrame, measures: list[str], column: Column) -> DataFrame:
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures]
    spread = table.select(column.alias("_column"), F.inline(F.array(*parts)))
    return spread.select(F.lit(check).alias("check"), F.col("_column").alias("column"), "metric", "value")


def validation_report(df: DataFrame, order: Sequence[str], time: str = TIMESTAMP, limit: int = GROUP_ROWS) -> DataFrame:
    """All checks as rows (check, column, metric, value); ``*`` stands for the whole table.

    Rows, missing values and ranges are one aggregate, whose single row is kept; order and gaps share one ordering of the
    rows, written once.
    """
    every = F.lit("*")
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *_missing_counts(df), *_range_measures(df))
    row = facts.first()
    facts = df.sparkSession.createDataFrame([row], facts.schema)
    parts = [
        _long("rows", facts, ["rows"], every),
        _long("missing", _missing_rows(facts, df.columns), ["missing"], F.col("column")),
        _long("duplicates", check_duplicates(df, time), ["duplicates"], every),
        _long("ranges", _melt(facts, numeric_columns(df.schema), list(_RANGES)), list(_RANGES), F.col("column")),
        _long("outliers", _outliers(df, row["rows"] <= limit), ["outliers"], F.col("column")),
    ]
    if time in df.columns:
        paired = _previous_times(df, order, [], time, limit)
        steps = stage(paired.select(F.col(time).isNull().alias("undated"), _step(time).alias("step")), "steps")
        middle = grouped_quantiles(steps, (), "step", [0.5], limit).first()
        median = F.lit(middle["quantiles"][0] if middle else None).cast("double")
        found = steps.agg(
            (F.count_if(F.col("undated") | (F.coalesce("step", F.lit(0)) < 0)) == 0).cast("int").alias("is_sorted"),
            F.count_if(F.col("step") > GAP_MEDIANS * median).alias("gaps"),
            F.max(median).alias("median_interval"),
            F.max("step").alias("max_gap"),
        )
        kinds = {"is_sorted": "sorted", "gaps": "gaps", "median_interval": "gaps", "max_gap": "gaps"}
        rows = [F.struct(F.lit(k).alias("check"), F.lit("*").alias("column"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m, k in kinds.items()]
        parts.append(found.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def validation_verdict(df: DataFrame, order: Sequence[str], time: str = TIMESTAMP, limit: int = GROUP_ROWS) -> DataFrame:
    """One row: valid means nothing missing, no duplicate times and times in order."""
    missing = check_missing(df).where(F.col("column") == "*").select(F.col("missing").alias("value"))
    facts = {
        "missing": missing,
        "duplicates": check_duplicates(df, time).select(F.col("duplicates").alias("value")),
    }
    if time in df.columns:
        in_order = check_sorted(df, order, (), time, limit)
        facts["unsorted"] = in_order.select((~F.col("is_sorted")).cast("bigint").alias("value"))
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("fact"), "value") for n, t in facts.items()])
    value = {n: F.coalesce(F.max(F.when(F.col("fact") == n, F.col("value"))), F.lit(0)) for n in ("missing", "duplicates", "unsorted")}
    return rows.agg(*[v.alias(n) for n, v in value.items()]).select(
        (F.col("missing") == 0).alias("complete"),
        (F.col("duplicates") == 0).alias("unique_times"),
        (F.col("unsorted") == 0).alias("is_sorted"),
        (F.col("missing") + F.col("duplicates") + F.col("unsorted") == 0).alias("is_valid"),
    )
