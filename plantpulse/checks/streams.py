"""Streams, run over the whole table with an available-now trigger and compared as batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import STATUSES
from ..operators import sessions
from ..storage import new_folder
from ..streaming import flows, scoring
from .aggregates import features_sql
from .base import DAY, HOUR, READINGS, events, num, patchy, readings, registry, text
from .cleaning import _POINT_SQL, point_entries
from .ordering import CARRIED_SQL, rule_score

CHECKS, check = registry()


def _replayed(spark, table):
    """A batch table as a stream: written to a folder and replayed."""
    path = new_folder(spark, "replay")
    table.write.parquet(path)
    return flows.replay(spark, path, table.schema)


def in_batches(spark, table, time: str, batches: int = 3, files: int = 4, most: int = 1_000_000):
    """A batch table as a stream of several micro-batches that follow each other in time, each of about ``most`` rows at most."""
    batches = max(batches, -(-table.count() // most))
    micros = F.unix_micros(time)
    cuts = table.select(F.percentile_approx(micros, [i / batches for i in range(1, batches)])).first()[0] or []
    block = F.size(F.filter(F.array(*map(F.lit, sorted(cuts))), lambda cut: F.coalesce(micros > cut, F.lit(False)))) if cuts else F.lit(0)
    # Dealt once, so that each delivery reads its own rows only.
    path = new_folder(spark, "blocks")
    table.withColumn("_block", block).write.partitionBy("_block").parquet(path)
    dealt = spark.read.schema(T.StructType([*table.schema.fields, T.StructField("_block", T.IntegerType())])).parquet(path)
    return _delivered(spark, [dealt.where(F.col("_block") == i).drop("_block") for i in range(batches)], files)


def _delivered(spark, parts, files: int = 4):
    """Tables as the micro-batches of a stream, written one after the other: a stream takes the oldest files first."""
    path = new_folder(spark, "replay")
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return flows.replay(spark, path, parts[0].schema, files_per_trigger=files)


def _finish(spark, query, path: str):
    query.awaitTermination()
    return spark.read.parquet(path)


def _outputs(spark):
    return new_folder(spark, "stream"), new_folder(spark, "progress")


@check(
    "stream_source",
    f"SELECT event_id, {text('ts')} AS ts, user_id, event_type, {num('value')} AS value, props FROM events",
)
def stream_source(spark, folder):
    path, progress = _outputs(spark)
    stream = flows.replay(spark, folder, events(spark, folder).schema, pattern="events.parquet")
    return _finish(spark, flows.write_batches(stream, path, progress), path).drop("batch")


@check("stream_window_features", features_sql(READINGS, "readings", ["sensor_value"], DAY))
def stream_window_features(spark, folder):
    """Update mode emits every window, open ones included; the last state of each is the result."""
    path, progress = _outputs(spark)
    stream = _replayed(spark, readings(spark, folder).drop("event_id"))
    made = flows.stream_features(stream, "1d", delay="1h", labels=STATUSES)
    table = _finish(spark, flows.write_batches(made, path, progress, mode="update"), path)
    values = [c for c in table.columns if c not in ("timestamp", "run_id", "batch")]
    newest = F.max_by(F.struct(*values), "batch").alias("newest")
    return table.groupBy("timestamp", "run_id").agg(newest).select("timestamp", "run_id", "newest.*")


@check("stream_points_sink", _POINT_SQL)
def stream_points_sink(spark, folder):
    path, progress = _outputs(spark)
    stream = _replayed(spark, patchy(spark, folder).withColumnRenamed("note", "fault_type"))
    return point_entries(_finish(spark, flows.write_points(stream, "plant", path, progress), path))


@check("stream_count_window", CARRIED_SQL)
def stream_count_window(spark, folder):
    """Batches of five valid rows per run, scored, with the status carried over the stream."""
    path, progress = _outputs(spark)
    stream = in_batches(spark, patchy(spark, folder), "timestamp")
    scored = scoring.score_stream(stream, "event_id", rule_score)
    table = _finish(spark, flows.write_batches(scored, path, progress), path)
    return table.select("event_id", "run_id", "health_status", "fault_type")


_SCORED_POINTS_SQL = f"""WITH carried AS ({CARRIED_SQL}), source AS (
        SELECT event_id, CASE WHEN NOT (event_type = 'purchase' AND value > 100) THEN ts END AS timestamp,
               CASE WHEN NOT value < 5 THEN value END AS sensor_value FROM events),
    entries AS (SELECT c.event_id, s.timestamp, unnest([
          {{'kind': 'tag', 'name': 'health_status', 'word': c.health_status, 'number': NULL}},
          {{'kind': 'tag', 'name': 'fault_type', 'word': c.fault_type, 'number': NULL}},
          {{'kind': 'field', 'name': 'health_status_code', 'word': NULL, 'number':
             CAST(CASE c.health_status WHEN 'Normal' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END AS DOUBLE)}},
          {{'kind': 'field', 'name': 'event_id', 'word': NULL, 'number': CAST(c.event_id AS DOUBLE)}},
          {{'kind': 'field', 'name': 'run_id', 'word': NULL, 'number': CAST(c.run_id AS DOUBLE)}},
          {{'kind': 'field', 'name': 'sensor_value', 'word': NULL, 'number': s.sensor_value}}]) AS e
      FROM carried c JOIN source s USING (event_id))
    SELECT 'plant' AS measurement, {text('timestamp')} AS time, event_id AS point, e.kind AS kind, e.name AS name,
           e.word AS word, {num('e.number')} AS number
    FROM entries WHERE e.word IS NOT NULL OR e.number IS NOT NULL"""


@check("stream_scored_points", _SCORED_POINTS_SQL)
def stream_scored_points(spark, folder):
    """The whole scoring stream: validate, batch, score, carry, tag, write."""
    path, progress = _outputs(spark)
    stream = in_batches(spark, patchy(spark, folder), "timestamp")
    query = scoring.write_scored_points(stream, "event_id", "plant", path, progress, rule_score)
    return point_entries(_finish(spark, query, path))


def sessions_sql(gap: int, number: str = "") -> str:
    """Sessions of ``readings`` by a gap in microseconds: a row begins one where the row before is further away."""
    return f"""paused AS (SELECT *, coalesce(epoch_us(timestamp) - epoch_us(lag(timestamp) OVER own) > {gap}, true) AS begins
                FROM readings WINDOW own AS (PARTITION BY run_id ORDER BY timestamp, event_id)),
    numbered AS (SELECT *, CAST(sum(begins::INT) OVER (PARTITION BY run_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM paused)
    SELECT run_id, {number} {text('min(timestamp)')} AS session_start, {text('max(timestamp)')} AS session_end, count(*) AS rows,
           {num('min(sensor_value)')} AS sensor_value_min, {num('max(sensor_value)')} AS sensor_value_max, {num('avg(sensor_value)')} AS sensor_value_mean
    FROM numbered GROUP BY run_id, session"""


@check("sessions", f"WITH {READINGS}, {sessions_sql(4 * HOUR, 'session,')}")
def batch_sessions(spark, folder):
    return sessions.sessions(readings(spark, folder).drop("event_id"), "4H")


_DEAL = f"""WITH {READINGS}, span AS (SELECT min(epoch_us(timestamp)) AS low, max(epoch_us(timestamp)) AS high FROM readings),
    placed AS (SELECT event_id, run_id, epoch_us(timestamp) AS t, (epoch_us(timestamp) - low) * 3 // (high - low + 1) AS block FROM readings, span),
    dealt AS (SELECT *, block = 0 AND event_id % 20 = 3 AS delayed FROM placed),
    late AS (SELECT max(t) // 1000 * 1000 - {HOUR} AS mark FROM dealt WHERE block = 0 AND NOT delayed)"""
_LATE_SQL = f"""{_DEAL}
    SELECT 'reading' AS kind, event_id, 1 AS n FROM dealt, late WHERE NOT (delayed AND t <= mark)
    UNION ALL SELECT 'late', NULL, count(*) FROM dealt, late WHERE delayed AND t <= mark"""


@check("stream_late_readings", _LATE_SQL)
def stream_late_readings(spark, folder):
    """Three micro-batches with repeated and late readings: what is kept, once each, and how many came too late.

    One reading in ten is sent again, in the next micro-batch too; one in twenty of the first third arrives with the last.
    """
    table = readings(spark, folder)
    low, high = table.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    block = F.expr(f"(unix_micros(timestamp) - {low}) * 3 div ({high} - {low} + 1)")
    delayed = (block == 0) & (F.col("event_id") % 20 == 3)
    again = F.col("event_id") % 10 == 1
    parts = []
    for i in range(3):
        own, sent = table.where((block == i) & ~delayed), table.where((block == i - 1) & again)
        parts.append(own.unionByName(own.where(again)).unionByName(sent))
    parts[2] = parts[2].unionByName(table.where(delayed))
    path, progress = _outputs(spark)
    query = flows.write_batches(flows.unique_readings(_delivered(spark, parts), ["event_id"], delay="1h"), path, progress)
    kept = _finish(spark, query, path).select(F.lit("reading").alias("kind"), "event_id", F.lit(1).cast("bigint").alias("n"))
    return kept.unionByName(spark.createDataFrame([("late", None, flows.late_rows(query))], "kind string, event_id bigint, n bigint"))


@check("stream_sessions", f"WITH {READINGS}, {sessions_sql(4 * HOUR)}")
def stream_sessions(spark, folder):
    """Sessions of a stream over three micro-batches; a reading far ahead in a run of its own closes them all."""
    table = readings(spark, folder).drop("event_id")
    ahead = table.agg((F.max("timestamp") + F.expr("interval 30 days")).alias("timestamp"))
    last = ahead.select(F.lit(-1).cast("bigint").alias("run_id"), "timestamp", F.lit(0.0).alias("sensor_value"), F.lit("Normal").alias("health_status"))
    low, high = table.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    block = F.expr(f"(unix_micros(timestamp) - {low}) * 3 div ({high} - {low} + 1)")
    path, progress = _outputs(spark)
    stream = _delivered(spark, [*[table.where(block == i) for i in range(3)], last])
    found = _finish(spark, flows.write_batches(sessions.stream_sessions(stream, "4H", "1h"), path, progress), path)
    return found.where("run_id >= 0").drop("batch")
