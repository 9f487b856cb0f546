"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import CSV_OPTIONS, HEADER_TRANSLATION, SENSOR_RANGES
from ..operators import filters, splits
from ..sinks import tables
from ..sources import readings as sources
from ..sources import records
from ..storage import new_folder
from .base import PATCHY, READINGS, WIDE_SENSORS, events, num, patchy, readings, readings_wide, registry, text, whole

CHECKS, check = registry()

_EVENT_TYPES = "event_id bigint, timestamp timestamp, event_type string, value double, props string"


@check(
    "scan_csv",
    f"SELECT event_id, {text('ts')} AS timestamp, event_type, {num('value')} AS value, props FROM events",
)
def scan_csv(spark, folder):
    path = new_folder(spark, "csv")
    table = events(spark, folder).select("event_id", F.col("ts").alias("timestamp"), "event_type", "value", "props")
    table.write.options(**CSV_OPTIONS).csv(path)
    return sources.read_csv(spark, path, _EVENT_TYPES)


@check(
    "scan_csv_inferred",
    f"SELECT event_id, {text('ts')} AS timestamp, event_type, {num('value')} AS value FROM events",
)
def scan_csv_inferred(spark, folder):
    path = new_folder(spark, "csv")
    table = events(spark, folder).select("event_id", F.col("ts").alias("timestamp"), "event_type", "value")
    table.write.options(**CSV_OPTIONS).csv(path)
    return sources.read_csv(spark, path)


@check(
    "scan_validated",
    f"""WITH {PATCHY}
    SELECT event_id, run_id, {text('timestamp')} AS timestamp, {num('sensor_value')} AS sensor_value, health_status
    FROM patchy
    WHERE timestamp IS NOT NULL AND sensor_value IS NOT NULL AND health_status IS NOT NULL""",
)
def scan_validated(spark, folder):
    path = new_folder(spark, "csv")
    patchy(spark, folder).drop("note").write.options(**CSV_OPTIONS).csv(path)
    schema = "event_id bigint, run_id bigint, timestamp timestamp, sensor_value double, health_status string"
    return sources.read_validated(spark, path, schema)


@check(
    "multi_run_union",
    f"""WITH {READINGS}
    SELECT CASE health_status WHEN 'Normal' THEN 1 WHEN 'Failure' THEN 2 ELSE 3 END AS run_id,
           {text('timestamp')} AS timestamp, {num('sensor_value')} AS bearing_temp_c,
           CASE health_status WHEN 'Failure' THEN {num('sensor_value * 2')} END AS oil_temp_c,
           health_status,
           CASE health_status WHEN 'Warning' THEN 'axial_vibration_increase' END AS warning_type,
           CASE health_status WHEN 'Failure' THEN 'cavitation' END AS failure_type
    FROM readings""",
)
def multi_run_union(spark, folder):
    """Three run files with different columns, one per status; statuses arrive cut short."""
    base = new_folder(spark, "runs")
    table = readings(spark, folder)
    names = {"Normal": "normal_run-1.csv", "Failure": "failure_4_cavitation.csv", "Warning": "warning_2_axial_vibration_increase.csv"}
    for status, name in names.items():
        cut = F.expr("left(health_status, 6)")
        run = table.where(F.col("health_status") == status).select(
            "timestamp", F.col("sensor_value").alias("bearing_temp_c"), cut.alias("health_status")
        )
        if status == "Failure":
            run = run.select("timestamp", (F.col("bearing_temp_c") * 2).alias("oil_temp_c"), "health_status", "bearing_temp_c")
        run.write.options(**CSV_OPTIONS).csv(f"{base}/{name}")
    loaded = sources.load_runs(spark, [f"{base}/{n}" for n in names.values()], labels=True)
    return loaded.select("run_id", "timestamp", "bearing_temp_c", "oil_temp_c", "health_status", "warning_type", "failure_type")


# Run files by status: their ids, warning and failure types as the SQL of the query below has them.
_THREE = {"Normal": "normal_run-1.csv", "Failure": "failure_4_cavitation.csv", "Warning": "warning_2_axial_vibration_increase.csv"}


@check(
    "load_runs_7min",
    f"""WITH {READINGS}, runs AS (
        SELECT *, CASE health_status WHEN 'Normal' THEN 1 WHEN 'Failure' THEN 2 ELSE 3 END AS run FROM readings),
    days AS (SELECT run, date_trunc('day', min(timestamp)) AS origin FROM runs GROUP BY run),
    placed AS (SELECT run, health_status, sensor_value,
                      make_timestamp(epoch_us(timestamp) - (epoch_us(timestamp) - epoch_us(origin)) % 420000000) AS bucket
               FROM runs JOIN days USING (run))
    SELECT run AS run_id, {text('bucket')} AS timestamp, {num('avg(sensor_value)')} AS bearing_temp_c, any_value(health_status) AS health_status,
           CASE run WHEN 3 THEN 'axial_vibration_increase' END AS warning_type, CASE run WHEN 2 THEN 'cavitation' END AS failure_type
    FROM placed GROUP BY run, bucket""",
)
def load_runs_7min(spark, folder):
    """A frequency that does not divide a day, over runs without a warning or a failure type."""
    base = new_folder(spark, "runs")
    for status, name in _THREE.items():
        run = readings(spark, folder).where(F.col("health_status") == status)
        run.select("timestamp", F.col("sensor_value").alias("bearing_temp_c"), "health_status").write.options(**CSV_OPTIONS).csv(f"{base}/{name}")
    loaded = sources.load_runs(spark, [f"{base}/{n}" for n in _THREE.values()], labels=True, frequency="7min")
    return loaded.select("run_id", "timestamp", "bearing_temp_c", "health_status", "warning_type", "failure_type")


@check(
    "load_runs_mixed_headers",
    f"""WITH {READINGS}
    SELECT 1 AS run_id, {text('timestamp')} AS timestamp, {num('sensor_value')} AS bearing_temp_c, {num('sensor_value * 3')} AS oil_temp_c, health_status
    FROM readings""",
)
def load_runs_mixed_headers(spark, folder):
    """One run whose parts have their columns in different orders."""
    path = f"{new_folder(spark, 'runs')}/normal_run-1.csv"
    table = readings(spark, folder).select(
        "event_id", "timestamp", F.col("sensor_value").alias("bearing_temp_c"), (F.col("sensor_value") * 3).alias("oil_temp_c"), "health_status"
    )
    orders = (["timestamp", "bearing_temp_c", "oil_temp_c", "health_status"], ["oil_temp_c", "health_status", "timestamp", "bearing_temp_c"])
    for i, names in enumerate(orders):
        table.where(F.col("event_id") % 2 == i).select(*names).write.mode("append").options(**CSV_OPTIONS).csv(path)
    loaded = sources.load_runs(spark, [path])
    return loaded.select("run_id", "timestamp", "bearing_temp_c", "oil_temp_c", "health_status")


_WHOLE_RUN_CUT = "(SELECT min(run_id) FROM (SELECT DISTINCT run_id FROM readings ORDER BY run_id DESC LIMIT 2))"


@check(
    "load_processed_filtered",
    f"""WITH {READINGS}
    SELECT CASE WHEN run_id >= {_WHOLE_RUN_CUT} THEN 'test' ELSE 'train' END AS part,
           event_id, run_id, {num('sensor_value')} AS sensor_value, health_status
    FROM readings WHERE health_status = 'Warning'""",
)
def load_processed_filtered(spark, folder):
    base = new_folder(spark, "processed")
    table = splits.split_whole_runs(readings(spark, folder))
    tables.export_split(table, base, "csv")
    train, test = sources.load_split(spark, f"{base}/train.csv", f"{base}/test.csv", ("health_status", "==", "Warning"))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.select("part", "event_id", "run_id", "sensor_value", "health_status")


@check(
    "export_roundtrip",
    f"""WITH {READINGS}
    SELECT CASE WHEN run_id >= {_WHOLE_RUN_CUT} THEN 'test' ELSE 'train' END AS split,
           event_id, run_id, {text('timestamp')} AS timestamp, {num('sensor_value')} AS sensor_value, health_status
    FROM readings""",
)
def export_roundtrip(spark, folder):
    base = new_folder(spark, "export")
    tables.export_split(splits.split_whole_runs(readings(spark, folder)), base)
    return spark.read.parquet(base)


_HEADERS = {name: old for old, name in HEADER_TRANSLATION.items()}


@check(
    "translate_columns",
    f"""SELECT {text('ts')} AS timestamp, {num('value')} AS bearing_temp_c, {num('value / 2')} AS oil_temp_c,
           CASE event_type WHEN 'error' THEN 'Failure' WHEN 'signup' THEN 'Warning' ELSE 'Normal' END AS health_status
    FROM events""",
)
def translate_columns(spark, folder):
    """A file with Persian headers, rewritten under translated headers and a new name."""
    base = new_folder(spark, "renamed")
    raw = readings(spark, folder).select(
        F.col("timestamp").alias(_HEADERS["timestamp"]),
        F.col("sensor_value").alias(_HEADERS["bearing_temp_c"]),
        (F.col("sensor_value") / 2).alias(_HEADERS["oil_temp_c"]),
        F.col("health_status").alias(_HEADERS["health_status"]),
    )
    raw.write.options(**CSV_OPTIONS).csv(f"{base}/raw/run.csv")
    tables.translate_files(spark, f"{base}/raw", f"{base}/new", {"run.csv": "renamed.csv"})
    schema = "timestamp timestamp, bearing_temp_c double, oil_temp_c double, health_status string"
    return sources.read_csv(spark, f"{base}/new/renamed.csv", schema)


def _uniform_sql(name: str, low: float, high: float) -> str:
    digits = f"substr(md5('42|{name}|' || CAST(event_id AS VARCHAR)), 1, 8)"
    return f"{low} + CAST('0x' || {digits} AS UBIGINT) / 4294967296.0 * ({high} - {low})"


@check(
    "gen_readings",
    "SELECT event_id, "
    + text("TIMESTAMP '2024-01-01' + to_minutes(10 * event_id)")
    + " AS timestamp, "
    + ", ".join(f"{num(_uniform_sql(n, *r))} AS {n}" for n, r in SENSOR_RANGES.items())
    + " FROM events",
)
def gen_readings(spark, folder):
    return records.generate_readings(events(spark, folder).select("event_id"), "event_id")


def _reading_maps(spark, folder):
    """Lines as sensor-to-value maps; a zero discount or tax makes no entry."""
    entries = [x for s in WIDE_SENSORS for x in (F.lit(s), F.col(s))]
    kept = F.map_filter(F.create_map(*entries), lambda _, v: v > 0)
    return readings_wide(spark, folder).select("run_id", "health_status", kept.alias("readings"))


@check(
    "required_columns",
    """SELECT 'l_discount' AS sensor, count(*) AS rows FROM lineitem WHERE l_discount = 0
    UNION ALL SELECT 'l_tax', count(*) FROM lineitem WHERE l_tax = 0""",
)
def required_columns(spark, folder):
    return records.missing_readings(_reading_maps(spark, folder), "readings", WIDE_SENSORS)


@check(
    "readings_from_maps",
    f"""SELECT l_suppkey AS run_id, {num('l_quantity')} AS l_quantity, {num('l_extendedprice')} AS l_extendedprice
    FROM lineitem""",
)
def readings_from_maps(spark, folder):
    maps = _reading_maps(spark, folder).select("run_id", "readings")
    return records.readings_from_maps(maps, "readings", ["l_quantity", "l_extendedprice"])


@check(
    "union_by_name",
    f"""WITH {READINGS}
    SELECT event_id, {num('sensor_value')} AS sensor_value, NULL AS warning_type, health_status
    FROM readings WHERE health_status = 'Normal'
    UNION ALL
    SELECT event_id, {num('sensor_value')}, 'oil_temp_increase', health_status FROM readings WHERE health_status = 'Warning'
    UNION ALL
    SELECT event_id, NULL, NULL, health_status FROM readings WHERE health_status = 'Failure'""",
)
def union_by_name(spark, folder):
    table = readings(spark, folder)
    normal = table.where("health_status = 'Normal'").select("event_id", "sensor_value", "health_status")
    warned = table.where("health_status = 'Warning'").select("health_status", F.lit("oil_temp_increase").alias("warning_type"), "sensor_value", "event_id")
    failed = table.where("health_status = 'Failure'").select("health_status", "event_id")
    return sources.union_by_name([normal, warned, failed])


@check(
    "by_condition",
    f"""WITH {PATCHY} SELECT CASE WHEN health_status = 'Normal' THEN 'normal' ELSE 'abnormal' END AS condition, event_id FROM patchy WHERE health_status IS NOT NULL
    UNION ALL SELECT 'unknown', event_id FROM patchy""",
)
def by_condition(spark, folder):
    """The three conditions that a prediction over files may ask for, side by side."""
    given = patchy(spark, folder).where("health_status is not null"), patchy(spark, folder)
    parts = [filters.by_condition(given[c == "unknown"], c).select(F.lit(c).alias("condition"), "event_id") for c in ("normal", "abnormal", "unknown")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
