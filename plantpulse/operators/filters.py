"""Row filters and column selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import NORMAL, RUN, STATUS, TIMESTAMP, numeric_columns, require_columns
from ..functions.timebase import in_time_range
from ..storage import small_side

# An ``in`` list longer than this becomes a semi join instead of one large expression.
IN_LIST = 1000


def only_normal(df: DataFrame, status: str = STATUS) -> DataFrame:
    return df.where(F.col(status) == NORMAL)


def exclude_normal(df: DataFrame, status: str = STATUS) -> DataFrame:
    """Every row that is not normal; rows without a status stay."""
    return df.where(~F.col(status).eqNullSafe(NORMAL))


def by_condition(df: DataFrame, condition: str, status: str = STATUS) -> DataFrame:
    """``normal`` keeps normal rows, ``abnormal`` the others, anything else keeps all."""
    if condition == "normal":
        return only_normal(df, status)
    if condition == "abnormal":
        return exclude_normal(df, status)
    return df


def configured_filter(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """Filter given as data: ``==``, ``!=`` (keeps nulls) or ``in`` with a list of values."""
    require_columns(df, column)
    if operator == "==":
        return df.where(F.col(column) == value)
    if operator == "!=":
        return df.where(~F.col(column).eqNullSafe(value))
    if operator == "in":
        # Values of one Python type are cast to the column's type, whatever their number; a null is in no list.
        kind, values = df.schema[column].dataType, [v for v in dict.fromkeys(value) if v is not None]
        if not values:
            return df.where(F.lit(False))
        if len(values) <= IN_LIST:
            return df.where(F.col(column).isin([F.lit(v).cast(kind) for v in values]))
        wanted = df.sparkSession.createDataFrame([(v,) for v in values], [column]).select(F.col(column).cast(kind))
        return df.join(small_side(wanted), column, "left_semi")
    raise ValueError(f"unknown filter operator: {operator}")


def is_complete(df: DataFrame) -> Column:
    """True where no column is null and no text is blank."""

    def filled(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            return column.isNotNull() & column.rlike(r"(?U)\S")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return column.isNotNull() & ~F.isnan(column)
        return column.isNotNull()

    return F.coalesce(reduce(Column.__and__, [filled(f) for f in df.schema]), F.lit(False))


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.where(is_complete(df))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column; aggregates skip null but not NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def last_time_range(df: DataFrame, length: str, time: str = TIMESTAMP, end: Column | None = None) -> DataFrame:
    """Rows of the last ``length`` before ``end``, by default before the latest reading."""
    if end is None:
        end = F.lit(df.agg(F.max(time)).first()[0])
    return df.where(in_time_range(F.col(time), end, length))


def between_times(df: DataFrame, start, stop, time: str = TIMESTAMP) -> DataFrame:
    return df.where(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")))


def latest_status(df: DataFrame, key: str, run: str = RUN, time: str = TIMESTAMP, status: str = STATUS) -> DataFrame:
    """The newest reading's time and status per run; the key decides between equal times.

    The newest times come from a hash aggregate of two columns; only rows at those times are then
    compared by key.
    """
    ends = df.where(F.col(run).isNotNull()).groupBy(run).agg(F.max(time).alias(time)).where(F.col(time).isNotNull())
    last = df.select(run, time, key, status).join(small_side(ends), [run, time])
    return last.groupBy(run, time).agg(F.max_by(status, key).alias(status))


def feature_names(df: DataFrame, target: str = STATUS) -> list[str]:
    """Numeric columns that are neither keys nor the target, in table order."""
    require_columns(df, target)
    return numeric_columns(df.schema, exclude=(TIMESTAMP, STATUS, RUN, target))


def prepare_matrix(df: DataFrame, target: str = STATUS) -> DataFrame:
    """Model features followed by the target."""
    return df.select(*feature_names(df, target), target)


def align_features(df: DataFrame, wanted: list[str], lenient: bool = False) -> DataFrame:
    """The features a model knows, in its order; absent ones raise unless ``lenient`` skips them."""
    if not lenient:
        require_columns(df, *wanted)
    return df.select(*[name for name in wanted if name in df.columns])


def translate_columns(df: DataFrame, translation: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in translation.items() if old in df.columns})
