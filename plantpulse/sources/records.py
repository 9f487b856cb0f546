"""Readings from records and generated readings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import SENSOR_RANGES, SENSORS, TIMESTAMP
from ..functions.timebase import frequency_micros

_RECORD_SCHEMA = T.StructType(
    [T.StructField(TIMESTAMP, T.TimestampType())] + [T.StructField(n, T.DoubleType()) for n in SENSORS]
)
STEP = "10min"


def readings_from_records(spark: SparkSession, records, timestamps=None) -> DataFrame:
    """A few hand-written readings (one mapping or a list) as a table with the columns in file order.

    Every record needs all sensors. Times are made up ten minutes apart when not given; one time
    is used for all records; a list must match the records.
    """
    rows = [records] if isinstance(records, Mapping) else list(records)
    for i, row in enumerate(rows):
        absent = [name for name in SENSORS if name not in row]
        if absent:
            raise ValueError(f"record {i} lacks {', '.join(absent)}")
    as_time = lambda t: dt.datetime.fromisoformat(t) if isinstance(t, str) else t
    if timestamps is None:
        now, step = dt.datetime.now(), dt.timedelta(microseconds=frequency_micros(STEP))
        times = [now + i * step for i in range(len(rows))]
    elif isinstance(timestamps, (str, dt.datetime)):
        times = [as_time(timestamps)] * len(rows)
    else:
        times = [as_time(t) for t in timestamps]
    if len(times) != len(rows):
        raise ValueError("one timestamp is needed per record")
    return spark.createDataFrame([(t, *[float(r[n]) for n in SENSORS]) for t, r in zip(times, rows)], _RECORD_SCHEMA)


def missing_readings(df: DataFrame, readings: str, required: Sequence[str] = SENSORS) -> DataFrame:
    """(sensor, rows) for each required sensor that some row's reading map has no entry for."""
    counts = [F.count_if(~F.map_contains_key(readings, name)).alias(name) for name in required]
    parts = [F.struct(F.lit(n).alias("sensor"), F.col(n).alias("rows")) for n in required]
    return df.agg(*counts).select(F.inline(F.array(*parts))).where("rows > 0")


def readings_from_maps(df: DataFrame, readings: str, required: Sequence[str] = SENSORS) -> DataFrame:
    """Reading maps spread into one column per required sensor; a map without one raises."""
    value = lambda name: F.when(F.map_contains_key(readings, name), F.try_element_at(readings, F.lit(name))).otherwise(
        F.raise_error(F.lit(f"reading lacks {name}")).cast("double")
    )
    kept = [c for c in df.columns if c != readings]
    return df.select(*kept, *[value(n).alias(n) for n in required])


def hash_fraction(key: Column, salt: str) -> Column:
    """Reproducible uniform number in [0, 1) per key, from the first 32 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(salt), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)


def generate_readings(
    ids: DataFrame,
    key: str,
    start: str = "2024-01-01",
    step: str = STEP,
    ranges: Mapping[str, tuple[float, float]] = SENSOR_RANGES,
    seed: int = 42,
) -> DataFrame:
    """One sample reading per id: times ``step`` apart, each sensor uniform in its range."""
    first = F.unix_micros(F.lit(start).cast("timestamp"))
    time = F.timestamp_micros(first + F.col(key) * F.lit(frequency_micros(step)))
    sensors = [
        (F.lit(low) + hash_fraction(F.col(key), f"{seed}|{name}") * F.lit(high - low)).alias(name)
        for name, (low, high) in ranges.items()
    ]
    return ids.select(key, time.alias(TIMESTAMP), *sensors)


def sample_readings(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` generated readings."""
    return generate_readings(spark.range(n), "id", seed=seed).drop("id")
