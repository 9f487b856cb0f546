"""Window features, resampling and class counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import STATUSES
from ..functions.timebase import floor_time
from ..operators import features, resample, splits, weights
from .base import (
    DAY, HOUR, MINUTE, PATCHY, READINGS, READINGS_WIDE, WIDE_SENSORS, floor_sql, num, patchy, readings, readings_wide, registry, text,
)

CHECKS, check = registry()

# The standard statistics in SQL, written from their definitions.
_STATISTICS = {
    "mean": "avg({x})",
    "std": "stddev_pop({x})",
    "min": "min({x})",
    "max": "max({x})",
    "rms": "sqrt(avg({x} * {x}))",
    "peak_to_peak": "max({x}) - min({x})",
    "skewness": "CASE WHEN count({x}) < 3 THEN NULL WHEN min({x}) = max({x}) THEN 0 ELSE skewness({x}) END",
    "kurtosis": "CASE WHEN count({x}) < 4 THEN NULL WHEN min({x}) = max({x}) THEN 0 ELSE kurtosis({x}) END",
}


def statistics_sql(sensors, names=tuple(_STATISTICS)) -> str:
    return ", ".join(f"{num(_STATISTICS[s].format(x=c))} AS {c}_{s}" for s in names for c in sensors)


def features_sql(source: str, table: str, sensors, step: int, run: bool = True, names=tuple(_STATISTICS)) -> str:
    """Feature table with the majority label, smallest label first among equals."""
    keys = "win, run_id" if run else "win"
    shown = f"{text('f.win')} AS timestamp" + (", f.run_id" if run else "")
    same = "f.win = v.win" + (" AND f.run_id = v.run_id" if run else "")
    return f"""WITH {source},
    placed AS (SELECT *, {floor_sql('timestamp', step)} AS win FROM {table}),
    stats AS (SELECT {keys}, {statistics_sql(sensors, names)} FROM placed GROUP BY {keys}),
    votes AS (SELECT {keys}, health_status, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, health_status) AS place
              FROM placed GROUP BY {keys}, health_status)
    SELECT {shown}, f.* EXCLUDE ({keys}), v.health_status
    FROM stats f JOIN votes v ON {same} AND v.place = 1"""


@check("window_features", features_sql(READINGS_WIDE, "readings_wide", WIDE_SENSORS, 30 * DAY))
def window_features(spark, folder):
    return features.extract_features(readings_wide(spark, folder), "30d", labels=STATUSES)


@check("window_features_narrow", features_sql(READINGS, "readings", ["sensor_value"], DAY))
def window_features_narrow(spark, folder):
    return features.extract_features(readings(spark, folder), "1d", exclude=("run_id", "event_id"), labels=STATUSES)


@check("window_features_no_run", features_sql(READINGS, "readings", ["sensor_value"], HOUR, run=False))
def window_features_no_run(spark, folder):
    table = readings(spark, folder).drop("run_id", "event_id")
    return features.extract_features(table, "1H", labels=STATUSES)


@check(
    "window_features_unlisted_labels",
    features_sql(READINGS, "readings", ["sensor_value"], 10 * MINUTE, names=("mean", "std", "kurtosis")),
)
def window_features_unlisted_labels(spark, folder):
    """Ten-minute windows, labels not known beforehand."""
    table = readings(spark, folder).drop("event_id")
    return features.extract_features(table, "10min", statistics=("mean", "std", "kurtosis"))


def _one_statistic(name: str):
    sql = f"""WITH {READINGS_WIDE}
    SELECT {text(floor_sql('timestamp', 30 * DAY))} AS timestamp, run_id, {statistics_sql(WIDE_SENSORS, (name,))}
    FROM readings_wide GROUP BY {floor_sql('timestamp', 30 * DAY)}, run_id"""

    @check(f"feature_{name}", sql)
    def query(spark, folder):
        return features.extract_features(readings_wide(spark, folder).drop("health_status"), "30d", statistics=(name,))

    return query


for _name in ("rms", "skewness", "kurtosis"):
    _one_statistic(_name)


@check(
    "feature_crest",
    f"""WITH {READINGS} SELECT {text(floor_sql('timestamp', DAY))} AS timestamp, run_id,
        {num('max(abs(sensor_value)) / nullif(sqrt(avg(sensor_value * sensor_value)), 0)')} AS sensor_value_crest_factor
    FROM readings GROUP BY {floor_sql('timestamp', DAY)}, run_id""",
)
def feature_crest(spark, folder):
    table = readings(spark, folder).select("run_id", "timestamp", "sensor_value")
    return features.extract_features(table, "1d", statistics=("crest_factor",))


@check(
    "feature_variance",
    f"""WITH {READINGS} SELECT {text(floor_sql('timestamp', DAY))} AS timestamp, run_id,
        {num('var_pop(sensor_value)')} AS sensor_value_variance
    FROM readings GROUP BY {floor_sql('timestamp', DAY)}, run_id""",
)
def feature_variance(spark, folder):
    table = readings(spark, folder).select("run_id", "timestamp", "sensor_value")
    return features.extract_features(table, "1d", statistics=("variance",))


@check(
    "feature_energy",
    f"""WITH {READINGS} SELECT {text(floor_sql('timestamp', DAY))} AS timestamp, run_id,
        {num('sum(sensor_value * sensor_value)')} AS sensor_value_energy
    FROM readings GROUP BY {floor_sql('timestamp', DAY)}, run_id""",
)
def feature_energy(spark, folder):
    table = readings(spark, folder).select("run_id", "timestamp", "sensor_value")
    return features.extract_features(table, "1d", statistics=("energy",))


@check(
    "feature_percentiles",
    f"""WITH {READINGS} SELECT {text(floor_sql('timestamp', DAY))} AS timestamp, run_id,
        {num('quantile_cont(sensor_value, 0.25)')} AS sensor_value_p25,
        {num('quantile_cont(sensor_value, 0.5)')} AS sensor_value_p50,
        {num('quantile_cont(sensor_value, 0.75)')} AS sensor_value_p75
    FROM readings GROUP BY {floor_sql('timestamp', DAY)}, run_id""",
)
def feature_percentiles(spark, folder):
    return features.window_percentiles(readings(spark, folder), "1d", "sensor_value", (0.25, 0.5, 0.75))


_IN_ORDER = f"""WITH {READINGS},
    placed AS (SELECT *, {floor_sql('timestamp', DAY)} AS win FROM readings),"""


@check(
    "feature_zero_crossings",
    f"""{_IN_ORDER}
    means AS (SELECT win, run_id, avg(sensor_value) AS m FROM placed GROUP BY win, run_id),
    sides AS (SELECT p.*, sign(p.sensor_value - m.m) AS side FROM placed p JOIN means m USING (win, run_id)),
    pairs AS (SELECT *, lag(side) OVER (PARTITION BY win, run_id ORDER BY timestamp, event_id) AS before FROM sides)
    SELECT {text('win')} AS timestamp, run_id, count(*) FILTER (WHERE side * before < 0) AS sensor_value_zero_crossings
    FROM pairs GROUP BY win, run_id""",
)
def feature_zero_crossings(spark, folder):
    return features.zero_crossings(readings(spark, folder), "1d", "sensor_value", "event_id")


@check(
    "feature_peaks",
    f"""{_IN_ORDER}
    trios AS (SELECT *, lag(sensor_value) OVER w AS before, lead(sensor_value) OVER w AS after FROM placed
              WINDOW w AS (PARTITION BY win, run_id ORDER BY timestamp, event_id))
    SELECT {text('win')} AS timestamp, run_id,
           count(*) FILTER (WHERE sensor_value > before AND sensor_value > after) AS sensor_value_peaks
    FROM trios GROUP BY win, run_id""",
)
def feature_peaks(spark, folder):
    return features.peak_counts(readings(spark, folder), "1d", "sensor_value", "event_id")


@check(
    "window_features_sliding",
    f"""WITH {READINGS},
    placed AS (SELECT r.*, {floor_sql('timestamp', HOUR)} - to_hours(CAST(k AS BIGINT)) AS win
               FROM readings r, generate_series(0, 5) AS g(k))
    SELECT {text('win')} AS timestamp, run_id, {statistics_sql(['sensor_value'], ('mean', 'std', 'max'))}
    FROM placed GROUP BY win, run_id""",
)
def window_features_sliding(spark, folder):
    table = readings(spark, folder).drop("event_id", "health_status")
    return features.sliding_features(table, "6h", "1h", statistics=("mean", "std", "max"))


@check(
    "majority_label",
    f"""WITH {PATCHY},
    votes AS (SELECT {floor_sql('timestamp', HOUR)} AS win, run_id, health_status, count(*) AS n FROM patchy
              WHERE timestamp IS NOT NULL GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY win, run_id
                 ORDER BY (health_status IS NULL)::INT, n DESC, health_status) AS place FROM votes)
    SELECT {text('win')} AS timestamp, run_id, health_status FROM ranked WHERE place = 1""",
)
def majority_label(spark, folder):
    table = patchy(spark, folder).where(F.col("timestamp").isNotNull())
    hourly = table.withColumn("timestamp", floor_time(F.col("timestamp"), "1H"))
    return features.majority_labels(hourly, ["timestamp", "run_id"], "health_status")


@check(
    "population_moments",
    f"""WITH {READINGS},
    placed AS (SELECT *, {floor_sql('timestamp', HOUR)} AS win FROM readings),
    base AS (SELECT win, run_id, avg(sensor_value) AS m, stddev_pop(sensor_value) AS s,
                    min(sensor_value) = max(sensor_value) AS flat FROM placed GROUP BY win, run_id)
    SELECT {text('p.win')} AS timestamp, p.run_id,
           {num("avg(CASE WHEN flat THEN 0 ELSE power((sensor_value - m) / nullif(s, 0), 3) END)")} AS sensor_value_population_skewness,
           {num("avg(CASE WHEN flat THEN 0 ELSE power((sensor_value - m) / nullif(s, 0), 4) END)")} AS sensor_value_population_kurtosis
    FROM placed p JOIN base b ON p.win = b.win AND p.run_id = b.run_id GROUP BY p.win, p.run_id""",
)
def population_moments(spark, folder):
    table = readings(spark, folder).select("run_id", "timestamp", "sensor_value")
    return features.extract_features(table, "1h", statistics=("population_skewness", "population_kurtosis"))


@check(
    "class_distribution",
    f"WITH {PATCHY} SELECT health_status, count(*) AS rows FROM patchy WHERE health_status IS NOT NULL GROUP BY 1",
)
def class_distribution(spark, folder):
    return weights.class_distribution(patchy(spark, folder))


@check(
    "bucket_class_pivot",
    f"""WITH {PATCHY} SELECT {text(floor_sql('timestamp', HOUR))} AS bucket,
        count(*) FILTER (WHERE health_status = 'Normal') AS "Normal",
        count(*) FILTER (WHERE health_status = 'Warning') AS "Warning",
        count(*) FILTER (WHERE health_status = 'Failure') AS "Failure"
    FROM patchy WHERE timestamp IS NOT NULL GROUP BY 1""",
)
def bucket_class_pivot(spark, folder):
    return splits.bucket_class_counts(patchy(spark, folder), "1H", STATUSES)


@check(
    "balanced_weights",
    f"""WITH {PATCHY}, sizes AS (SELECT health_status, count(*) AS n FROM patchy WHERE health_status IS NOT NULL GROUP BY 1),
    weighed AS (SELECT health_status, (SELECT sum(n) FROM sizes) / ((SELECT count(*) FROM sizes) * n) AS w FROM sizes)
    SELECT event_id, p.health_status, {num('w')} AS weight FROM patchy p LEFT JOIN weighed USING (health_status)""",
)
def balanced_weights(spark, folder):
    return weights.with_balanced_weights(patchy(spark, folder)).select("event_id", "health_status", "weight")


@check(
    "explicit_weights",
    f"""WITH {PATCHY} SELECT event_id, health_status,
        {num("CASE health_status WHEN 'Normal' THEN 1 WHEN 'Warning' THEN 28 WHEN 'Failure' THEN 62 END")} AS weight
    FROM patchy""",
)
def explicit_weights(spark, folder):
    table = patchy(spark, folder).select("event_id", "health_status")
    return weights.with_explicit_weights(table, [1, 28, 62], STATUSES)


@check(
    "label_encode",
    f"""WITH {PATCHY}, codes AS (SELECT health_status, dense_rank() OVER (ORDER BY health_status) - 1 AS code
                               FROM (SELECT DISTINCT health_status FROM patchy WHERE health_status IS NOT NULL))
    SELECT event_id, p.health_status, code, p.health_status AS decoded FROM patchy p LEFT JOIN codes USING (health_status)""",
)
def label_encode(spark, folder):
    table = patchy(spark, folder).select("event_id", "health_status")
    encoded = weights.encode_labels(table)
    codes = weights.label_codes(table).withColumnRenamed("health_status", "decoded")
    return weights.decode_labels(encoded, codes, "decoded")


# Resampling to 20 minutes. Buckets in which every value is missing are dropped.
_PICKS = {
    "mean": "avg(sensor_value)",
    "max": "max(sensor_value)",
    "min": "min(sensor_value)",
    "first": "arg_min(sensor_value, place) FILTER (WHERE sensor_value IS NOT NULL)",
    "last": "arg_max(sensor_value, place) FILTER (WHERE sensor_value IS NOT NULL)",
}


def _resampling(method: str):
    sql = f"""WITH {PATCHY},
    placed AS (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS place FROM patchy
               WHERE timestamp IS NOT NULL),
    made AS (SELECT {floor_sql('timestamp', 20 * MINUTE)} AS bucket, run_id, {_PICKS[method]} AS v,
                    arg_min(health_status, place) FILTER (WHERE health_status IS NOT NULL) AS s
             FROM placed GROUP BY 1, 2)
    SELECT {text('bucket')} AS timestamp, run_id, {num('v')} AS sensor_value, s AS health_status
    FROM made WHERE v IS NOT NULL OR s IS NOT NULL"""

    @check(f"resample_{method}", sql)
    def query(spark, folder):
        table = patchy(spark, folder).drop("note")
        return resample.resample(table, "20min", method, key="event_id")

    return query


for _method in resample.METHODS:
    _resampling(_method)


@check(
    "resample_categorical",
    f"""WITH {PATCHY},
    placed AS (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS place FROM patchy WHERE timestamp IS NOT NULL)
    SELECT {text(floor_sql('timestamp', HOUR))} AS timestamp, run_id,
           arg_min(health_status, place) FILTER (WHERE health_status IS NOT NULL) AS health_status,
           arg_min(note, place) AS note
    FROM placed GROUP BY {floor_sql('timestamp', HOUR)}, run_id""",
)
def resample_categorical(spark, folder):
    return resample.resample(patchy(spark, folder).drop("sensor_value"), "1H", key="event_id")


@check(
    "resample_then_features",
    features_sql(
        f"""{READINGS}, minutes AS (SELECT {floor_sql('timestamp', HOUR)} AS timestamp, run_id, avg(sensor_value) AS sensor_value,
            arg_min(health_status, row(timestamp, event_id)) AS health_status FROM readings GROUP BY 1, 2)""",
        "minutes", ["sensor_value"], DAY, names=("mean", "min", "max", "rms"),
    ),
)
def resample_then_features(spark, folder):
    hourly = resample.resample(readings(spark, folder), "1H", key="event_id")
    return features.extract_features(hourly, "1d", statistics=("mean", "min", "max", "rms"), labels=STATUSES)
