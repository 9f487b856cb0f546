"""Data-quality checks and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import CSV_OPTIONS
from ..operators import evaluate, quality
from ..sinks import tables
from ..storage import new_folder, stage
from .base import PATCHY, READINGS, READINGS_WIDE, num, patchy, readings, readings_wide, registry, whole

CHECKS, check = registry()

_PATCHY_COLUMNS = ("event_id", "run_id", "timestamp", "sensor_value", "health_status", "note")
_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM patchy" for c in _PATCHY_COLUMNS
)


@check(
    "check_missing",
    f"""WITH {PATCHY}, per AS ({_MISSING_SQL})
    SELECT "column", {whole('missing')} AS missing FROM per WHERE missing > 0
    UNION ALL SELECT '*', {whole('sum(missing)')} FROM per""",
)
def check_missing(spark, folder):
    return quality.check_missing(patchy(spark, folder))


@check(
    "check_missing_nan",
    f"""WITH {READINGS}, holes AS (SELECT count(*) FILTER (WHERE sensor_value > 100) AS n FROM readings)
    SELECT 'sensor_value' AS "column", {whole('n')} AS missing FROM holes WHERE n > 0 UNION ALL SELECT '*', {whole('n')} FROM holes""",
)
def check_missing_nan(spark, folder):
    """NaN readings count as missing."""
    value = F.when(F.col("sensor_value") > 100, F.lit(float("nan"))).otherwise(F.col("sensor_value"))
    return quality.check_missing(readings(spark, folder).withColumn("sensor_value", value))


_DUPLICATES = "count(*) - count(DISTINCT timestamp) - CASE WHEN count(*) > count(timestamp) THEN 1 ELSE 0 END"


@check("check_duplicates", f"WITH {PATCHY} SELECT {whole(_DUPLICATES)} AS duplicates FROM patchy")
def check_duplicates(spark, folder):
    return quality.check_duplicates(patchy(spark, folder))


_RANGES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {num(f'min({c})')} AS min, {num(f'max({c})')} AS max, {num(f'avg({c})')} AS mean, "
    f"{num(f'stddev_samp({c})')} AS std FROM readings_wide"
    for c in ("run_id", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@check("check_ranges", f"WITH {READINGS_WIDE} {_RANGES}")
def check_ranges(spark, folder):
    return quality.check_ranges(readings_wide(spark, folder))


def _outliers_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS outliers FROM {table},
            (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) AS b
            WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1) HAVING count(*) > 0"""
        for c in columns
    )


@check("check_outliers", f"WITH {READINGS} {_outliers_sql('readings', ('event_id', 'run_id', 'sensor_value'))}")
def check_outliers(spark, folder):
    return quality.check_outliers(readings(spark, folder))


# Row order follows the value here, so times go up and down.
def _steps(source: str, table: str, order: str, groups: str = "") -> str:
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""WITH {source},
    steps AS (SELECT *, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER ({part} ORDER BY {order})) AS step FROM {table})"""


@check(
    "check_sorted",
    f"""{_steps(PATCHY, 'patchy', 'event_id', 'run_id')}
    SELECT run_id, count(*) FILTER (WHERE step < 0 OR timestamp IS NULL) = 0 AS is_sorted FROM steps GROUP BY run_id""",
)
def check_sorted(spark, folder):
    return quality.check_sorted(patchy(spark, folder), ["event_id"])


@check(
    "check_sorted_by_value",
    f"""{_steps(READINGS, 'readings', 'sensor_value, event_id', 'run_id')}
    SELECT run_id, count(*) FILTER (WHERE step < 0) = 0 AS is_sorted FROM steps GROUP BY run_id""",
)
def check_sorted_by_value(spark, folder):
    return quality.check_sorted(readings(spark, folder), ["sensor_value", "event_id"])


def _gaps_sql(groups: str = "") -> str:
    keys = f"{groups}, " if groups else ""
    group = f"GROUP BY {groups}" if groups else ""
    join = f"JOIN medians USING ({groups})" if groups else ", medians"
    return f""", medians AS (SELECT {keys} quantile_cont(step, 0.5) AS median FROM steps {group})
    SELECT {keys} count(*) FILTER (WHERE step > 3 * median) AS gaps, {num('max(median)')} AS median_interval,
           {whole('max(step)')} AS max_gap
    FROM steps {join} {group}"""


@check("check_gaps", _steps(PATCHY, "patchy", "event_id", "run_id") + _gaps_sql("run_id"))
def check_gaps(spark, folder):
    return quality.check_gaps(patchy(spark, folder), ["event_id"])


@check("check_gaps_global", _steps(READINGS, "readings", "run_id, event_id") + _gaps_sql())
def check_gaps_global(spark, folder):
    return quality.check_gaps(readings(spark, folder), ["run_id", "event_id"], groups=())


@check(
    "validation_verdict",
    f"""{_steps(READINGS, 'readings', 'event_id')},
    facts AS (SELECT count(*) FILTER (WHERE timestamp IS NULL OR sensor_value IS NULL OR health_status IS NULL) = 0 AS complete,
                     ({_DUPLICATES}) = 0 AS unique_times, count(*) FILTER (WHERE step < 0) = 0 AS is_sorted FROM steps)
    SELECT *, complete AND unique_times AND is_sorted AS is_valid FROM facts""",
)
def validation_verdict(spark, folder):
    return quality.validation_verdict(readings(spark, folder), ["event_id"])


@check(
    "validation_verdict_patchy",
    f"""{_steps(PATCHY, 'patchy', 'event_id')},
    facts AS (SELECT count(*) FILTER (WHERE timestamp IS NULL OR sensor_value IS NULL OR health_status IS NULL OR note IS NULL) = 0 AS complete,
                     ({_DUPLICATES}) = 0 AS unique_times,
                     count(*) FILTER (WHERE step < 0 OR timestamp IS NULL) = 0 AS is_sorted FROM steps)
    SELECT *, complete AND unique_times AND is_sorted AS is_valid FROM facts""",
)
def validation_verdict_patchy(spark, folder):
    return quality.validation_verdict(patchy(spark, folder), ["event_id"])


def _report_sql() -> str:
    numeric = ("event_id", "run_id", "sensor_value")
    rows = [f"SELECT 'rows' AS \"check\", '*' AS \"column\", 'rows' AS metric, count(*)::DOUBLE AS value FROM patchy"]
    per = " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) - count({c}) AS missing FROM patchy" for c in _PATCHY_COLUMNS)
    rows.append(f"SELECT 'missing', c, 'missing', missing FROM ({per}) WHERE missing > 0")
    rows.append(f"SELECT 'missing', '*', 'missing', sum(missing) FROM ({per})")
    rows.append(f"SELECT 'duplicates', '*', 'duplicates', {_DUPLICATES} FROM patchy")
    for c in numeric:
        for metric, f in {"min": "min", "max": "max", "mean": "avg", "std": "stddev_samp"}.items():
            rows.append(f"SELECT 'ranges', '{c}', '{metric}', {num(f'{f}({c})')} FROM patchy")
    rows.append(f"SELECT 'outliers', \"column\", 'outliers', outliers FROM ({_outliers_sql('patchy', numeric)})")
    rows.append("SELECT 'sorted', '*', 'is_sorted', (count(*) FILTER (WHERE step < 0 OR timestamp IS NULL) = 0)::INT FROM steps")
    median = "(SELECT quantile_cont(step, 0.5) FROM steps)"
    rows.append(f"SELECT 'gaps', '*', 'gaps', count(*) FROM steps WHERE step > 3 * {median}")
    rows.append(f"SELECT 'gaps', '*', 'median_interval', {median}")
    rows.append("SELECT 'gaps', '*', 'max_gap', max(step) FROM steps")
    body = " UNION ALL ".join(rows)
    return f"""{_steps(PATCHY, 'patchy', 'event_id')}
    SELECT "check", "column", metric, {num('value')} AS value FROM ({body})"""


@check("validation_report", _report_sql())
def validation_report(spark, folder):
    return quality.validation_report(patchy(spark, folder), ["event_id"])


# Predictions: a rule on the value stands in for a model.
_PREDICTIONS = f"""WITH {READINGS}, predictions AS (
    SELECT health_status AS label,
           CASE WHEN sensor_value > 100 THEN 'Failure' WHEN sensor_value > 60 THEN 'Warning' ELSE 'Normal' END AS prediction
    FROM readings)"""


def predictions(spark, folder):
    value = F.col("sensor_value")
    rule = F.when(value > 100, "Failure").when(value > 60, "Warning").otherwise("Normal")
    return readings(spark, folder).select(F.col("health_status").alias("label"), rule.alias("prediction"))


_PER_CLASS = f"""{_PREDICTIONS},
    classes AS (SELECT label AS class FROM predictions UNION SELECT prediction FROM predictions),
    raw AS (SELECT class, count(*) FILTER (WHERE label = class) AS support,
                   count(*) FILTER (WHERE prediction = class) AS predicted,
                   count(*) FILTER (WHERE label = class AND prediction = class) AS hits
            FROM classes, predictions GROUP BY class),
    per AS (SELECT class, support, hits, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
                   CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM raw),
    scored AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per)"""


@check("eval_confusion", f"{_PREDICTIONS} SELECT label, prediction, count(*) AS rows FROM predictions GROUP BY 1, 2")
def eval_confusion(spark, folder):
    return evaluate.confusion(predictions(spark, folder))


@check(
    "eval_weighted",
    f"""{_PER_CLASS} SELECT {num('sum(hits) / sum(support)')} AS accuracy,
        {num('sum(precision * support) / sum(support)')} AS precision,
        {num('sum(recall * support) / sum(support)')} AS recall, {num('sum(f1 * support) / sum(support)')} AS f1_score
    FROM scored""",
)
def eval_weighted(spark, folder):
    return evaluate.weighted_metrics(evaluate.confusion(predictions(spark, folder)))


_REPORT_SQL = (
    f"""{_PER_CLASS}
    SELECT class, {num('precision')} AS precision, {num('recall')} AS recall, {num('f1')} AS f1_score, support FROM scored
    UNION ALL SELECT 'accuracy', {num('sum(hits) / sum(support)')}, {num('sum(hits) / sum(support)')},
                     {num('sum(hits) / sum(support)')}, {whole('sum(support)')} FROM scored
    UNION ALL SELECT 'macro avg', {num('avg(precision)')}, {num('avg(recall)')}, {num('avg(f1)')}, {whole('sum(support)')} FROM scored
    UNION ALL SELECT 'weighted avg', {num('sum(precision * support) / sum(support)')}, {num('sum(recall * support) / sum(support)')},
                     {num('sum(f1 * support) / sum(support)')}, {whole('sum(support)')} FROM scored"""
)


@check("eval_report", _REPORT_SQL)
def eval_report(spark, folder):
    return evaluate.classification_report(evaluate.confusion(predictions(spark, folder)))


@check("metrics_json", _REPORT_SQL)
def metrics_json(spark, folder):
    """The per-class report as it is read back from the metrics files."""
    counts = stage(evaluate.confusion(predictions(spark, folder)), "confusion")
    path = new_folder(spark, "metrics")
    tables.write_metrics(evaluate.weighted_metrics(counts), evaluate.classification_report(counts), path)
    assert spark.read.json(f"{path}/metrics").count() == 1
    return spark.read.json(f"{path}/report").select("class", "precision", "recall", "f1_score", "support")


@check("predictions_csv", f"{_PREDICTIONS} SELECT label, prediction, count(*) AS rows FROM predictions GROUP BY 1, 2")
def predictions_csv(spark, folder):
    """Predictions written next to their source, read back and counted."""
    path = tables.write_predictions(predictions(spark, folder), f"{new_folder(spark, 'source')}.csv")
    return evaluate.confusion(spark.read.options(**CSV_OPTIONS).csv(path))
