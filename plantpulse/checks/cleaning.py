"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FAILURE_TYPES, WARNING_TYPES
from ..functions import labels, status, timebase
from ..operators import filters
from ..operators.points import as_number, to_points
from .base import (
    MINUTE, PATCHY, READINGS, READINGS_WIDE, RUN_PATHS, events, floor_sql, num, patchy, readings, readings_wide, registry, run_paths, text, whole,
)

CHECKS, check = registry()

_KEPT = f"event_id, run_id, {num('sensor_value')} AS sensor_value, health_status"
_COLUMNS = ("event_id", "run_id", "sensor_value", "health_status")


@check("filter_only_normal", f"WITH {PATCHY} SELECT {_KEPT} FROM patchy WHERE health_status = 'Normal'")
def filter_only_normal(spark, folder):
    return filters.only_normal(patchy(spark, folder)).select(*_COLUMNS)


@check(
    "filter_exclude_normal",
    f"WITH {PATCHY} SELECT {_KEPT} FROM patchy WHERE health_status IS DISTINCT FROM 'Normal'",
)
def filter_exclude_normal(spark, folder):
    return filters.exclude_normal(patchy(spark, folder)).select(*_COLUMNS)


@check("filter_eq", f"WITH {PATCHY} SELECT {_KEPT} FROM patchy WHERE health_status = 'Warning'")
def filter_eq(spark, folder):
    return filters.configured_filter(patchy(spark, folder), "health_status", "==", "Warning").select(*_COLUMNS)


@check("filter_ne", f"WITH {PATCHY} SELECT {_KEPT} FROM patchy WHERE health_status IS DISTINCT FROM 'Warning'")
def filter_ne(spark, folder):
    return filters.configured_filter(patchy(spark, folder), "health_status", "!=", "Warning").select(*_COLUMNS)


@check("filter_in", f"WITH {PATCHY} SELECT {_KEPT} FROM patchy WHERE health_status IN ('Warning', 'Failure')")
def filter_in(spark, folder):
    wanted = ["Warning", "Failure"]
    return filters.configured_filter(patchy(spark, folder), "health_status", "in", wanted).select(*_COLUMNS)


@check(
    "drop_blank_rows",
    f"""WITH {PATCHY} SELECT {_KEPT}, note FROM patchy
    WHERE timestamp IS NOT NULL AND sensor_value IS NOT NULL AND health_status IS NOT NULL
      AND regexp_matches(note, '[^\\s]')""",
)
def drop_blank_rows(spark, folder):
    return filters.drop_blank_rows(patchy(spark, folder)).select(*_COLUMNS, "note")


_SENSORS_SQL = ", ".join(f"{num(c)} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@check("prepare_matrix", f"WITH {READINGS_WIDE} SELECT {_SENSORS_SQL}, health_status FROM readings_wide")
def prepare_matrix(spark, folder):
    return filters.prepare_matrix(readings_wide(spark, folder))


@check("align_features", f"SELECT {num('l_tax')} AS l_tax, {num('l_quantity')} AS l_quantity FROM lineitem")
def align_features(spark, folder):
    return filters.align_features(readings_wide(spark, folder), ["l_tax", "absent", "l_quantity"], lenient=True)


@check(
    "clean_status",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'Failure' WHEN 'signup' THEN 'Warning'
              WHEN 'view' THEN 'Normal' WHEN 'click' THEN 'Warning sign' END AS health_status
    FROM events""",
)
def clean_status(spark, folder):
    """Cut-off and padded statuses; a label that only begins like one is left alone."""
    kind = F.col("event_type")
    dirty = (
        F.when(kind == "error", " \tFailur ").when(kind == "signup", "Warnin\n").when(kind == "view", "Normal ")
        .when(kind == "click", " Warning sign")
    )
    return events(spark, folder).select("event_id", status.clean_status(dirty).alias("health_status"))


# Layouts by event_id % 10, and how much of the time each keeps.
_LAYOUTS = {
    0: ("MM-dd-yyyy HH:mm", "minute"), 1: ("yyyyMMdd", "day"), 2: ("yyyy/MM/dd", "day"), 3: ("yyyy.MM.dd", "day"), 4: ("MMM d yyyy", "day"),
    5: ("M/d/yyyy h:mm a", "minute"), 6: ("M/d/yyyy H:mm:ss.SSS", "milliseconds"), 7: ("MMM d, yyyy h:mm:ss a", "second"),
    8: ("d MMM yyyy HH:mm:ss", "second"), 9: ("yyyy-MM-dd HH:mm:ss.SSSSSS", "microseconds"),
}
_KEPT = " ".join("WHEN {} THEN {}".format(i, text(f"date_trunc('{part}', ts)")) for i, (_, part) in _LAYOUTS.items())


@check("parse_ts_layouts", f"SELECT event_id, CASE event_id % 10 {_KEPT} END AS timestamp FROM events")
def parse_ts_layouts(spark, folder):
    """Every time in one of ten layouts, month before day."""
    layout = F.col("event_id") % 10
    raw = F.coalesce(*[F.when(layout == i, F.date_format("ts", pattern)) for i, (pattern, _) in _LAYOUTS.items()])
    return events(spark, folder).select("event_id", timebase.parse_timestamp(raw).alias("timestamp"))


@check(
    "parse_ts_mixed",
    f"""SELECT event_id, CASE event_type
             WHEN 'view' THEN {text("date_trunc('second', ts)")}
             WHEN 'click' THEN {text("date_trunc('minute', ts)")}
             WHEN 'signup' THEN {text('ts')}
             WHEN 'error' THEN {text("date_trunc('day', ts)")} END AS timestamp
    FROM events""",
)
def parse_ts_mixed(spark, folder):
    """Times in four layouts, and text that is no time."""
    kind, ts = F.col("event_type"), F.col("ts")
    raw = (
        F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "click", F.date_format(ts, "M/d/yyyy H:mm"))
        .when(kind == "signup", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == "error", F.date_format(ts, "M/d/yyyy"))
        .otherwise("bad")
    )
    return events(spark, folder).select("event_id", timebase.parse_timestamp(raw).alias("timestamp"))


@check(
    "ts_floor",
    f"""SELECT event_id, {text(floor_sql('ts', 10 * MINUTE))} AS ten_minutes,
           {text(floor_sql('ts', 7 * MINUTE))} AS seven_minutes,
           {text("date_trunc('hour', ts)")} AS hour
    FROM events""",
)
def ts_floor(spark, folder):
    ts = F.col("ts")
    floors = {"ten_minutes": "10min", "seven_minutes": "7T", "hour": "1H"}
    return events(spark, folder).select("event_id", *[timebase.floor_time(ts, f).alias(n) for n, f in floors.items()])


@check(
    "status_code",
    f"""WITH {PATCHY} SELECT event_id,
        {whole("CASE coalesce(health_status, note) WHEN 'Normal' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Failure' THEN 2 WHEN 'Error' THEN 2 ELSE -1 END")} AS code
    FROM patchy""",
)
def status_code(spark, folder):
    label = F.coalesce("health_status", "note")
    return patchy(spark, folder).select("event_id", status.status_code(label).alias("code"))


@check(
    "try_float",
    f"SELECT event_id, CASE WHEN event_type <> 'view' THEN {num('value')} END AS number FROM events",
)
def try_float(spark, folder):
    written = F.when(F.col("event_type") == "view", F.concat(F.lit("n/a "), "value")).otherwise(F.col("value").cast("string"))
    return events(spark, folder).select("event_id", as_number(written).alias("number"))


def _label_sql(names) -> str:
    stem = "regexp_extract(path, '([^/]+)\\.csv$', 1)"
    return "CASE " + " ".join(f"WHEN contains({stem}, '{n}') THEN '{n}'" for n in names) + " ELSE 'unknown' END"


def _stems(spark, folder):
    return run_paths(spark, folder).withColumn("stem", labels.file_stem(F.col("path")))


@check("label_warning", f"WITH {RUN_PATHS} SELECT event_id, {_label_sql(WARNING_TYPES)} AS warning_type FROM run_paths")
def label_warning(spark, folder):
    return _stems(spark, folder).select("event_id", labels.warning_label(F.col("stem")).alias("warning_type"))


@check("label_failure", f"WITH {RUN_PATHS} SELECT event_id, {_label_sql(FAILURE_TYPES)} AS failure_type FROM run_paths")
def label_failure(spark, folder):
    return _stems(spark, folder).select("event_id", labels.failure_label(F.col("stem")).alias("failure_type"))


@check(
    "label_hierarchical",
    f"""WITH {RUN_PATHS} SELECT event_id, path,
        CASE WHEN contains(lower(path), 'warning') THEN {_label_sql(WARNING_TYPES)} END AS warning_type,
        CASE WHEN NOT contains(lower(path), 'warning') AND contains(lower(path), 'failure')
             THEN {_label_sql(FAILURE_TYPES)} END AS failure_type
    FROM run_paths""",
)
def label_hierarchical(spark, folder):
    warning, failure = labels.layered_labels(F.col("path"), F.col("stem"))
    return _stems(spark, folder).select("event_id", "path", warning.alias("warning_type"), failure.alias("failure_type"))


@check(
    "fault_type",
    f"""WITH {READINGS} SELECT event_id,
        CASE WHEN health_status = 'Normal' THEN 'none'
             WHEN health_status = 'Failure' AND sensor_value > 40 THEN 'cavitation'
             WHEN sensor_value > 20 THEN 'voltage_drop' END AS fault_type
    FROM readings""",
)
def fault_type(spark, folder):
    value, label = F.col("sensor_value"), F.col("health_status")
    warning = F.when(value > 20, "voltage_drop")
    failure = F.when((label == "Failure") & (value > 40), "cavitation")
    return readings(spark, folder).select("event_id", status.fault_type(label, warning, failure).alias("fault_type"))


@check(
    "time_range",
    f"""WITH {READINGS} SELECT event_id, run_id, {text('timestamp')} AS timestamp, {num('sensor_value')} AS sensor_value
    FROM readings WHERE timestamp >= (SELECT max(timestamp) FROM readings) - INTERVAL 1 HOUR""",
)
def time_range(spark, folder):
    return filters.last_time_range(readings(spark, folder), "1h").drop("health_status")


@check(
    "time_range_custom",
    f"""WITH {READINGS} SELECT event_id, run_id, {text('timestamp')} AS timestamp, {num('sensor_value')} AS sensor_value
    FROM readings WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'""",
)
def time_range_custom(spark, folder):
    return filters.between_times(readings(spark, folder), "2024-01-10 06:00:00", "2024-01-20 18:30:00").drop("health_status")


@check(
    "latest_status",
    f"""WITH {READINGS} SELECT run_id, {text('timestamp')} AS timestamp, health_status FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp DESC, event_id DESC) AS place FROM readings)
    WHERE place = 1""",
)
def latest_status(spark, folder):
    return filters.latest_status(readings(spark, folder), "event_id")


_POINT_SQL = f"""WITH {PATCHY}, entries AS (
    SELECT event_id, timestamp, health_status, note,
           unnest([
             {{'kind': 'tag', 'name': 'health_status', 'word': health_status, 'number': NULL}},
             {{'kind': 'tag', 'name': 'fault_type', 'word': note, 'number': NULL}},
             {{'kind': 'field', 'name': 'health_status_code', 'word': NULL, 'number':
                CAST(CASE health_status WHEN 'Normal' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Failure' THEN 2 ELSE -1 END AS DOUBLE)}},
             {{'kind': 'field', 'name': 'event_id', 'word': NULL, 'number': CAST(event_id AS DOUBLE)}},
             {{'kind': 'field', 'name': 'run_id', 'word': NULL, 'number': CAST(run_id AS DOUBLE)}},
             {{'kind': 'field', 'name': 'sensor_value', 'word': NULL, 'number': sensor_value}}]) AS e
    FROM patchy)
    SELECT 'plant' AS measurement, {text('timestamp')} AS time, event_id AS point, e.kind AS kind, e.name AS name,
           e.word AS word, {num('e.number')} AS number
    FROM entries WHERE e.word IS NOT NULL OR e.number IS NOT NULL"""


def point_entries(points):
    """Points spread into one row per tag or field."""
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    tags = F.transform(
        F.map_entries("tags"),
        lambda e: F.struct(F.lit("tag").alias("kind"), e.key.alias("name"), e.value.alias("word"), none_number.alias("number")),
    )
    fields = F.transform(
        F.map_entries("fields"),
        lambda e: F.struct(F.lit("field").alias("kind"), e.key.alias("name"), none_text.alias("word"), e.value.alias("number")),
    )
    point = F.col("fields")["event_id"].cast("bigint").alias("point")
    return points.select("measurement", "time", point, F.inline(F.concat(tags, fields)))


@check("row_to_point", _POINT_SQL)
def row_to_point(spark, folder):
    table = patchy(spark, folder).withColumnRenamed("note", "fault_type")
    return point_entries(to_points(table, "plant"))
