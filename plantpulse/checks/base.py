"""What a check is, the table bindings in Spark and SQL, and the shared rendering of results.

Doubles are compared after ``round(x + 1.37e-7, 6)`` on both sides: the offset keeps exact decimal
ties away from the rounding edge. Times are compared as text with microseconds.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import FAILURE_TYPES, WARNING_TYPES

Query = Callable[[SparkSession, str], DataFrame]


class Check(NamedTuple):
    query: Query
    sql: str | None


def registry() -> tuple[dict[str, Check], Callable]:
    """A dictionary of checks and the decorator that fills it."""
    checks: dict[str, Check] = {}

    def check(name: str, sql: str | None = None):
        def keep(query: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return tidy(query(spark, folder))

            checks[name] = Check(run, sql)
            return query

        return keep

    return checks, check


def tidy(df: DataFrame) -> DataFrame:
    """Comparable columns: rounded doubles, times as text, whole numbers as bigint."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + F.lit(1.37e-7), 6)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.IntegralType, T.DecimalType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def num(sql: str) -> str:
    return f"round(({sql}) + 1.37e-7, 6)"


def text(sql: str) -> str:
    return f"strftime({sql}, '%Y-%m-%d %H:%M:%S.%f')"


def whole(sql: str) -> str:
    return f"CAST({sql} AS BIGINT)"


def floor_sql(column: str, micros: int) -> str:
    return f"make_timestamp(epoch_us({column}) - epoch_us({column}) % {micros})"


DAY = 86_400_000_000
HOUR = 3_600_000_000
MINUTE = 60_000_000

# --- Bindings: sensor readings as views of the given tables. ---

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp"
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with zoned times: a declared schema keeps time filters in the parquet scan."""
    return spark.read.schema(_EVENTS).parquet(f"{folder}/events.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Narrow readings: one sensor, unique ``event_id``, ten runs."""
    status = F.when(F.col("event_type") == "error", "Failure").when(F.col("event_type") == "signup", "Warning")
    return events(spark, folder).select(
        "event_id",
        (F.col("user_id") % 10).alias("run_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("sensor_value"),
        status.otherwise("Normal").alias("health_status"),
    )


READINGS = """readings AS (
  SELECT event_id, user_id % 10 AS run_id, ts AS timestamp, value AS sensor_value,
         CASE event_type WHEN 'error' THEN 'Failure' WHEN 'signup' THEN 'Warning' ELSE 'Normal' END AS health_status
  FROM events)"""


def readings_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Four sensors, one run per supplier; no unique key, so only for order-free aggregates."""
    status = F.when(F.col("l_returnflag") == "N", "Normal").when(F.col("l_returnflag") == "A", "Warning")
    return spark.read.schema(_LINES).parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_shipdate").alias("timestamp"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        status.otherwise("Failure").alias("health_status"),
    )


READINGS_WIDE = """readings_wide AS (
  SELECT l_suppkey AS run_id, l_shipdate AS timestamp, l_quantity, l_extendedprice, l_discount, l_tax,
         CASE l_returnflag WHEN 'N' THEN 'Normal' WHEN 'A' THEN 'Warning' ELSE 'Failure' END AS health_status
  FROM lineitem)"""
WIDE_SENSORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def patchy(spark: SparkSession, folder: str) -> DataFrame:
    """Readings with holes: missing status, time, value and blank text, by event type and value."""
    kind, value = F.col("event_type"), F.col("value")
    return events(spark, folder).select(
        "event_id",
        (F.col("user_id") % 10).alias("run_id"),
        F.when(~((kind == "purchase") & (value > 100)), F.col("ts")).alias("timestamp"),
        F.when(~(value < 5), value).alias("sensor_value"),
        F.when(kind == "error", "Failure").when(kind == "signup", "Warning").when(kind != "view", "Normal").alias("health_status"),
        F.when((kind == "click") & (value > 50), " \t").otherwise(kind).alias("note"),
    )


PATCHY = """patchy AS (
  SELECT event_id, user_id % 10 AS run_id,
         CASE WHEN NOT (event_type = 'purchase' AND value > 100) THEN ts END AS timestamp,
         CASE WHEN NOT value < 5 THEN value END AS sensor_value,
         CASE WHEN event_type = 'error' THEN 'Failure' WHEN event_type = 'signup' THEN 'Warning'
              WHEN event_type <> 'view' THEN 'Normal' END AS health_status,
         CASE WHEN event_type = 'click' AND value > 50 THEN ' ' || chr(9) ELSE event_type END AS note
  FROM events)"""

# Run files in the order of their run ids.
RUN_FILES = (
    ["normal_3months_30sec_interval-1.csv"]
    + [f"failure_{i}_{name}.csv" for i, name in enumerate(FAILURE_TYPES, 1)]
    + [f"warning_{i}_{name}.csv" for i, name in enumerate(WARNING_TYPES, 1)]
)


def run_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with the path of the run file it stands for."""
    paths = F.array(*[F.lit(f"/plant/{name}") for name in RUN_FILES])
    path = F.element_at(paths, (F.col("user_id") % len(RUN_FILES) + 1).cast("int"))
    return events(spark, folder).select("event_id", path.alias("path"))


_LIST = ", ".join(f"'/plant/{name}'" for name in RUN_FILES)
RUN_PATHS = f"""run_paths AS (
  SELECT event_id, list_extract([{_LIST}], CAST(user_id % {len(RUN_FILES)} + 1 AS BIGINT)) AS path FROM events)"""
