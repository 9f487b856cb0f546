"""Row order: ordinals, slices, shuffles, count windows and the carried status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, ordering, selection, splits
from .base import HOUR, MINUTE, PATCHY, READINGS, floor_sql, num, patchy, readings, registry, text

CHECKS, check = registry()

_ROW = f"event_id, run_id, {text('timestamp')} AS timestamp, {num('sensor_value')} AS sensor_value, health_status"


@check("sort_ts", f"WITH {READINGS} SELECT {_ROW} FROM readings ORDER BY timestamp, event_id")
def sort_ts(spark, folder):
    return ordering.sort_by_time(readings(spark, folder), "timestamp", "event_id")


@check(
    "row_ordinal",
    f"""WITH {READINGS} SELECT event_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY timestamp, event_id) AS ordinal
    FROM readings""",
)
def row_ordinal(spark, folder):
    return ordering.with_ordinal(readings(spark, folder), ["run_id"], ["timestamp", "event_id"]).select("event_id", "run_id", "ordinal")


@check(
    "seeded_shuffle",
    f"""WITH {READINGS} SELECT event_id, {num('sensor_value')} AS sensor_value,
        row_number() OVER (ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id) AS position
    FROM readings""",
)
def seeded_shuffle(spark, folder):
    """The shuffled rows with their position, which the order-free comparison can see."""
    table = readings(spark, folder).select("event_id", "sensor_value")
    shuffled = table.withColumn("digest", ordering.seeded_digest("event_id", 42))
    return ordering.with_ordinal(shuffled, [], ["digest", "event_id"], "position").drop("digest")


@check("tail_n", f"WITH {READINGS} SELECT {_ROW} FROM readings ORDER BY timestamp DESC, event_id DESC LIMIT 10")
def tail_n(spark, folder):
    return ordering.last_rows(readings(spark, folder), "timestamp", "event_id", 10)


@check(
    "slice_rows",
    f"""WITH {READINGS} SELECT {_ROW} FROM (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS place FROM readings)
    WHERE place > 1200 AND place <= 4700""",
)
def slice_rows(spark, folder):
    return selection.slice_rows(readings(spark, folder), "timestamp", "event_id", 1200, 4700)


@check(
    "fill_window",
    f"""WITH {READINGS},
    placed AS (SELECT *, {floor_sql('timestamp', HOUR)} AS win FROM readings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY win, run_id ORDER BY timestamp, event_id) AS place,
                      count(*) OVER (PARTITION BY win, run_id) AS n FROM placed)
    SELECT event_id, run_id, {text('win')} AS win, CAST(k * n + place AS BIGINT) AS position
    FROM ranked, generate_series(0, 5) AS g(k) WHERE n < 5 AND k * n + place <= 5
    UNION ALL SELECT event_id, run_id, {text('win')}, NULL FROM ranked WHERE n >= 5""",
)
def fill_window(spark, folder):
    from ..functions.timebase import floor_time

    table = readings(spark, folder).withColumn("win", floor_time(F.col("timestamp"), "1H"))
    filled = ordering.fill_window(table, ["win", "run_id"], ["timestamp", "event_id"], 5)
    return filled.select("event_id", "run_id", "win", "position")


VALID_SQL = f"""WITH {PATCHY},
    counted AS (SELECT *, timestamp IS NOT NULL AND sensor_value IS NOT NULL AND health_status IS NOT NULL
                          AND regexp_matches(note, '[^\\s]') AS valid FROM patchy),
    ranked AS (SELECT *, sum(valid::INT) OVER (PARTITION BY run_id ORDER BY timestamp NULLS FIRST, event_id
                                               ROWS UNBOUNDED PRECEDING) AS upto FROM counted),
    batched AS (SELECT *, CASE WHEN valid THEN CAST((upto - 1) // 5 AS BIGINT) END AS batch,
                       CASE WHEN upto >= 5 THEN CAST(upto // 5 - 1 AS BIGINT) END AS ruling_batch FROM ranked)"""


@check("count_window_5", f"{VALID_SQL} SELECT event_id, run_id, batch, ruling_batch FROM batched")
def count_window_5(spark, folder):
    return batches.with_batches(patchy(spark, folder), "event_id").select("event_id", "run_id", "batch", "ruling_batch")


# Each full batch is scored on the rows in its first ten-minute window.
_SCORED = f"""{VALID_SQL},
    windows AS (SELECT *, {floor_sql('timestamp', 10 * MINUTE)} AS win FROM batched WHERE valid),
    starts AS (SELECT run_id, batch, min(win) AS win FROM windows GROUP BY 1, 2 HAVING count(*) = 5),
    scores AS (SELECT w.run_id, w.batch, w.win, max(sensor_value) AS top, min(sensor_value) AS low, count(*) AS members
               FROM windows w JOIN starts USING (run_id, batch, win) GROUP BY 1, 2, 3),
    verdicts AS (SELECT *, CASE WHEN top > 100 THEN 'Failure' WHEN top > 60 THEN 'Warning' ELSE 'Normal' END AS status,
                        CASE WHEN top > 100 THEN CASE WHEN low > 50 THEN 'cavitation' ELSE 'bearing_fault' END
                             WHEN top > 60 THEN CASE WHEN low > 50 THEN 'voltage_drop' ELSE 'power_increase' END
                             ELSE 'none' END AS fault FROM scores)"""
CARRIED_SQL = f"""{_SCORED} SELECT b.event_id, b.run_id, coalesce(v.status, 'Normal') AS health_status,
    coalesce(v.fault, 'none') AS fault_type
    FROM batched b LEFT JOIN verdicts v ON b.run_id = v.run_id AND b.ruling_batch = v.batch"""


class RuleModel:
    """Stands in for a trained model: classes with a score each, the first best one wins."""

    def __init__(self, scores: dict):
        self.scores = scores

    def predict(self, df, label, probabilities):
        p = F.array(*self.scores.values())
        names = F.array(*map(F.lit, self.scores))
        best = F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
        return df.select("*", best.alias(label), p.alias(probabilities))


def rule_models(sensor: str = "sensor_value"):
    """Status, warning and failure models that are rules on the window's maximum and minimum."""
    top, low = F.col(f"{sensor}_max"), F.col(f"{sensor}_min")
    score = lambda condition, p: F.when(condition, p).otherwise(0.0)
    status = RuleModel({
        "Failure": score(top > 100, 0.8),
        "Normal": score(top <= 60, 0.9),
        "Warning": score((top > 60) & (top <= 100), 0.7),
    })
    warning = RuleModel({"power_increase": score(~(low > 50), 1.0), "voltage_drop": score(low > 50, 1.0)})
    failure = RuleModel({"bearing_fault": score(~(low > 50), 1.0), "cavitation": score(low > 50, 1.0)})
    return status, warning, failure


def rule_score(df):
    from ..operators.hierarchy import predict_hierarchy

    return predict_hierarchy(df, *rule_models())


@check("carry_forward_status", CARRIED_SQL)
def carry_forward_status(spark, folder):
    carried = batches.score_and_carry(patchy(spark, folder), "event_id", rule_score)
    return carried.select("event_id", "run_id", "health_status", "fault_type")


@check(
    "batch_first_result",
    f"""{_SCORED} SELECT run_id, batch, {text('win')} AS timestamp, {num('top')} AS sensor_value_max,
        status AS health_status FROM verdicts""",
)
def batch_first_result(spark, folder):
    batched = batches.with_batches(patchy(spark, folder), "event_id")
    scored = rule_score(batches.batch_features(batched, exclude=("event_id",)))
    return scored.select("run_id", "batch", "timestamp", "sensor_value_max", "health_status")


@check(
    "reverse_cum_class",
    f"""WITH {READINGS},
    counts AS (SELECT {floor_sql('timestamp', HOUR)} AS bucket, count(*) FILTER (WHERE health_status = 'Normal') AS n,
                      count(*) FILTER (WHERE health_status = 'Warning') AS w, count(*) FILTER (WHERE health_status = 'Failure') AS f
               FROM readings GROUP BY 1)
    SELECT {text('bucket')} AS bucket, {', '.join(f'CAST(sum({c}) OVER later AS BIGINT) AS "{name}_after"'
      for c, name in (('n', 'Normal'), ('w', 'Warning'), ('f', 'Failure')))}
    FROM counts WINDOW later AS (ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)""",
)
def reverse_cum_class(spark, folder):
    classes = ["Normal", "Warning", "Failure"]
    table = splits.bucket_class_counts(readings(spark, folder), "1H", classes)
    totals = splits.reverse_cumulative(table, "bucket", "1H", classes)
    return totals.select("bucket", *[f"{c}_after" for c in classes])
