"""Readings as time-series points: measurement, tags, numeric fields, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import FAULT_TYPE, STATUS, STATUS_CODES, TIMESTAMP
from ..functions.status import status_code


def as_number(column: Column) -> Column:
    """The value as a double, null where it is no number."""
    # Casting also takes the suffixes of Java's literals, such as 12f, which are no numbers here.
    text = F.trim(column.cast("string"))
    value = F.when(~text.rlike("(?i)[0-9.][fd]$"), column.try_cast("double"))
    return F.when(~F.isnan(value), value)


def _without_nulls(entries: Column) -> Column:
    return F.map_filter(entries, lambda _, value: value.isNotNull())


def to_points(df: DataFrame, measurement: str, codes: dict[str, int] = STATUS_CODES, time: str = TIMESTAMP) -> DataFrame:
    """One point per row.

    Status and fault type become tags, the status also a numeric field; every other column that
    reads as a number becomes a field. Nulls make neither.
    """
    special = (time, STATUS, FAULT_TYPE)
    plain = (T.NumericType, T.StringType, T.BooleanType)
    fields = [
        part
        for f in df.schema
        if f.name not in special and isinstance(f.dataType, plain)
        for part in (F.lit(f.name), as_number(F.col(f.name)))
    ]
    tags = []
    if STATUS in df.columns:
        tags += [F.lit(STATUS), F.col(STATUS)]
        fields += [F.lit(f"{STATUS}_code"), status_code(F.col(STATUS), codes).cast("double")]
    if FAULT_TYPE in df.columns:
        tags += [F.lit(FAULT_TYPE), F.col(FAULT_TYPE)]
    text_map, number_map = "map<string,string>", "map<string,double>"
    return df.select(
        F.lit(measurement).alias("measurement"),
        (_without_nulls(F.create_map(*tags)) if tags else F.create_map().cast(text_map)).alias("tags"),
        (_without_nulls(F.create_map(*fields)) if fields else F.create_map().cast(number_map)).alias("fields"),
        F.col(time).alias("time"),
    )
