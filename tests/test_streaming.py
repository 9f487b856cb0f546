"""Streams over several micro-batches equal the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantpulse.checks.base import patchy, readings
from plantpulse.checks.ordering import rule_score
from plantpulse.columns import STATUSES
from plantpulse.operators import batches, features, hierarchy, model
from plantpulse.streaming import flows, scoring
from tests.conftest import TINY, same_rows


def chunked(spark, table, folder, files=4):
    """The table as files in time order, replayed one per micro-batch."""
    cuts = table.approxQuantile("event_id", [i / files for i in range(1, files)], 0)
    edges = [-1, *cuts, 10**9]
    for low, high in zip(edges, edges[1:]):
        table.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(folder)
    return flows.replay(spark, folder, table.schema, files_per_trigger=1)


def finish(spark, query, path):
    query.awaitTermination()
    assert query.lastProgress is None or query.exception() is None
    return spark.read.parquet(path).drop("batch")


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / name) for name in ("in", "out", "progress")]


def test_carried_status_over_micro_batches(spark, folders):
    source, out, progress = folders
    table = patchy(spark, TINY).where("timestamp is not null")
    stream = chunked(spark, table, source)
    scored = scoring.score_stream(stream, "event_id", rule_score)
    found = finish(spark, flows.write_batches(scored, out, progress), out)
    expected = batches.score_and_carry(table, "event_id", rule_score)
    columns = ["event_id", "run_id", "health_status", "fault_type"]
    assert same_rows(found.select(*columns), expected.select(*columns))
    assert spark.read.parquet(out).select("batch").distinct().count() == 4


def test_trained_model_scores_a_stream(spark, folders):
    source, out, progress = folders
    table = readings(spark, TINY)
    daily = features.extract_features(table.drop("event_id"), "1d", labels=STATUSES)
    fitted = model.train(daily, features=[c for c in daily.columns if c.startswith("sensor_value_")], trees=3, depth=3)
    score = lambda df: hierarchy.predict_hierarchy(df, fitted)
    stream = scoring.score_stream(chunked(spark, table, source, 2), "event_id", score)
    found = finish(spark, flows.write_batches(stream, out, progress), out)
    expected = batches.score_and_carry(table, "event_id", score)
    assert same_rows(found.select("event_id", "health_status"), expected.select("event_id", "health_status"))


def test_six_rows(spark, folders):
    """Rows one to four wait as normal, the fifth brings the first score."""
    source, out, progress = folders
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(i, 1, at(i), 10.0 * (i + 6), "Normal") for i in range(6)]
    table = spark.createDataFrame(rows, "event_id bigint, run_id bigint, timestamp timestamp, sensor_value double, health_status string")
    scored = scoring.score_stream(chunked(spark, table, source, 3), "event_id", rule_score)
    found = finish(spark, flows.write_batches(scored, out, progress), out).orderBy("event_id").collect()
    assert [(r["health_status"], r["fault_type"]) for r in found] == [("Normal", "none")] * 4 + [("Warning", "voltage_drop")] * 2


def test_window_features_close_with_the_watermark(spark, folders):
    """In append mode the closed windows equal the batch result; the open ones are not out yet."""
    source, out, progress = folders
    table = readings(spark, TINY)
    stream = chunked(spark, table, source).drop("event_id")
    made = flows.stream_features(stream, "1d", delay="1h", labels=STATUSES)
    found = finish(spark, flows.write_batches(made, out, progress), out)
    latest = table.agg(F.max("timestamp")).first()[0] - dt.timedelta(hours=1)
    expected = features.extract_features(table.drop("event_id"), "1d", labels=STATUSES)
    closed = expected.where(F.col("timestamp") + F.expr("interval 1 day") <= F.lit(latest))
    fixed = lambda df: df.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    assert closed.count() > 100 and same_rows(fixed(found), fixed(closed))


def test_late_readings_are_dropped(spark, folders):
    source, out, progress = folders
    schema = "event_id bigint, run_id bigint, timestamp timestamp, x double"
    day = lambda d, i: (i, 1, dt.datetime(2024, 1, d), 1.0)
    for rows in ([day(1, 0), day(5, 1)], [day(6, 2)], [day(1, 3), day(9, 4)], [day(20, 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = flows.replay(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1).drop("event_id")
    made = flows.stream_features(stream, "1d", delay="1h", statistics=("energy",))
    found = finish(spark, flows.write_batches(made, out, progress), out)
    assert {(r["timestamp"].day, r["x_energy"]) for r in found.collect()} >= {(1, 1.0), (5, 1.0)}


def test_points(spark, folders):
    source, out, progress = folders
    table = readings(spark, TINY).withColumn("fault_type", F.lit("none"))
    found = finish(spark, flows.write_points(chunked(spark, table, source, 2), "plant", out, progress), out)
    assert found.count() == table.count()
    assert found.where("tags['fault_type'] != 'none' or fields['event_id'] is null").count() == 0


def test_rows_with_their_batch_leave_in_pieces(monkeypatch):
    """A run of any length in one micro-batch: no piece is large, and rows in any order carry what single rows in order would."""
    import numpy as np
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    n = 2 * scoring.PIECE_ROWS + 13
    at = np.arange(n)
    rows = pd.DataFrame({"t": pd.to_datetime(at, unit="s"), "k": at, "x": at * 0.5, "_micros": at * 1_000_000, "_valid": at % 7 > 0})
    state = State()
    keep = scoring._batch_keeper(["t", "k"], ["x"], 5)
    first, second = rows[:-10].sample(frac=1, random_state=1), rows[-10:]
    pieces = [p for part in (first, second) for p in keep(None, iter([part[: len(part) // 2], part[len(part) // 2 :]]), state)]
    assert max(map(len, pieces)) <= scoring.PIECE_ROWS and len(pieces) == 4
    found = pd.concat(pieces, ignore_index=True)
    assert found["k"].tolist() == at.tolist()
    members = rows["x"][rows["_valid"]].to_numpy()
    full = np.cumsum(rows["_valid"].to_numpy()) // 5
    assert all(v == members[(i - 1) * 5 : i * 5].tolist() for v, i in zip(found["_batch_values"], full) if i)
    assert all(len(v) == 0 for v, i in zip(found["_batch_values"], full) if not i)
    assert [t // 500_000 / 4 for t in found["_batch_times"].iloc[-1]] == found["_batch_values"].iloc[-1]


def test_micro_batches_stay_small(spark, folders):
    """More rows make more micro-batches, still in the order of time, and none is read twice."""
    from plantpulse.checks.streams import in_batches

    _, out, progress = folders
    table = patchy(spark, TINY)
    query = flows.write_batches(in_batches(spark, table, "timestamp", most=100), out, progress)
    query.awaitTermination()
    found = spark.read.parquet(out)
    sizes = found.groupBy("batch").agg(F.count("*").alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).orderBy("batch").collect()
    assert len(sizes) == -(-table.count() // 100) and max(r["n"] for r in sizes) <= 200
    assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]))
    assert same_rows(found.drop("batch"), table)
