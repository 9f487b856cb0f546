"""Sessions, readings that come late or twice, splits by hash, and leave-one-run-out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import folds, model, sessions, splits
from plantpulse.streaming import flows
from tests.conftest import same_rows

START = dt.datetime(2024, 1, 1)
SCHEMA = "run_id long, timestamp timestamp, x double, health_status string"


def at(*minutes, run=1, x=1.0):
    return [(run, START + dt.timedelta(minutes=m), x, "Normal") for m in minutes]


ROWS = [
    *at(0, 10, 40, 70.5, 70.5, 101), *at(0, 31, run=2), (None, START, 1.0, "Normal"), (1, None, 1.0, "Normal"),
    (2, START, None, "Normal"), (2, START, float("nan"), "Normal"), *at(5, run=3, x=7.0),
]


def plain_sessions(rows, gap):
    out, by_run = set(), {}
    for run, t, _, _ in rows:
        if run is not None and t is not None:
            by_run.setdefault(run, []).append(t)
    for run, times in by_run.items():
        number, begin, last, n = 0, None, None, 0
        for t in [*sorted(times), None]:
            if last is None or t is None or t - last > gap:
                if last is not None:
                    out.add((run, number, begin, last, n))
                number, begin, n = number + 1, t, 0
            last, n = t, n + 1
    return out


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_sessions(spark, limit):
    """A pause of exactly the gap does not end a session; repeated rows count; rows without a time or run are left out."""
    found = sessions.sessions(spark.createDataFrame(ROWS, SCHEMA), "30min", limit=limit)
    assert found.columns == ["run_id", "session", "session_start", "session_end", "rows", "x_min", "x_max", "x_mean"]
    assert {tuple(r)[:5] for r in found.collect()} == plain_sessions(ROWS, dt.timedelta(minutes=30))
    first = found.where("run_id = 2 and session = 1").first()
    assert (first["rows"], first["x_min"], first["x_mean"]) == (3, 1.0, 1.0)
    assert sessions.sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_sessions_equal_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    table = spark.createDataFrame(ROWS, SCHEMA)
    closing = spark.createDataFrame(at(100_000, run=9), SCHEMA)
    for part in (table, closing):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = sessions.stream_sessions(flows.replay(spark, source, table.schema, files_per_trigger=1), "30min", "10min")
    flows.write_batches(stream, out, progress).awaitTermination()
    found = spark.read.parquet(out).where("run_id < 9").drop("batch")
    assert same_rows(found, sessions.sessions(table, "30min").drop("session"))


def test_repeats_and_late_readings(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first, second, third = at(0, 0, 1), at(1, 600, run=1), [*at(600, 601), *at(2)]
    for part in (first, second, third, at(602), at(3)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = flows.unique_readings(flows.replay(spark, source, SCHEMA, files_per_trigger=1), ["run_id", "timestamp"], delay="5min")
    query = flows.write_batches(stream, out, progress)
    query.awaitTermination()
    kept = sorted((r["timestamp"] - START).total_seconds() / 60 for r in spark.read.parquet(out).collect())
    # Minute 2 is behind by less than the watermark of the micro-batch before its own; minute 3 is late.
    assert kept == [0, 1, 2, 600, 601, 602] and flows.late_rows(query) == 1


def test_hash_split_stands_still(spark, tmp_path):
    table = spark.range(5_000).withColumn("x", F.lit(1))
    split = splits.split_by_hash(table, "id", 0.3, seed=7)
    assert 0.27 < split.where("split = 'test'").count() / 5_000 < 0.33
    more = splits.split_by_hash(spark.range(10_000).withColumn("x", F.lit(1)), "id", 0.3, seed=7)
    assert same_rows(more.where("id < 5000"), split)
    table.write.parquet(str(tmp_path / "in"))
    stream = splits.split_by_hash(flows.replay(spark, str(tmp_path / "in"), table.schema), "id", 0.3, seed=7)
    flows.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert same_rows(spark.read.parquet(str(tmp_path / "out")).drop("batch"), split)
    with pytest.raises(ValueError):
        splits.split_by_hash(table, "id", 1.0)


FOLD_ROWS = [(run, float(10 * c + run % 3), None if c == 1 and run == 2 else 5.0, "abc"[c]) for run in range(4) for c in range(3) for _ in range(3)]
FOLD_SCHEMA = "run_id long, x double, flat double, health_status string"


def plain_folds(rows):
    out = []
    for run, *_ in {r[0]: 0 for r in rows}.items():
        train = [r for r in rows if r[0] != run]
        mean = lambda v: sum(v) / len(v)
        xs = [r[1] for r in train]
        spread = mean([x * x for x in xs]) - mean(xs) ** 2
        centre = {c: mean([r[1] for r in train if r[3] == c]) for c in sorted({r[3] for r in train})}
        out += [(*r, min(centre, key=lambda c: ((r[1] - centre[c]) ** 2 / spread, c))) for r in rows if r[0] == run]
    return out


def test_centroid_folds(spark):
    rows = [*FOLD_ROWS, (9, 21.0, None, "c"), (9, 0.5, 1.0, "d")]
    given = spark.createDataFrame([*rows, (None, 1.0, 1.0, "a"), (1, 1.0, 1.0, None)], FOLD_SCHEMA).withColumn("prediction_note", F.lit("x"))
    found = folds.centroid_folds(given.drop("flat"), ["x"])
    expected = spark.createDataFrame([(r[0], r[1], r[3], "x", r[4]) for r in plain_folds(rows)], "run_id long, x double, health_status string, prediction_note string, prediction string")
    assert same_rows(found, expected)
    assert folds.centroid_folds(given, ["x", "flat"]).count() == len(rows)  # a feature with gaps that hardly varies
    assert folds.centroid_folds(given.limit(0), ["x"]).count() == 0


class Majority:
    """Says the most frequent class it was fitted on."""

    def __init__(self, rows):
        self.said = rows.groupBy("health_status").count().orderBy(F.desc("count"), "health_status").first()[0]

    def predict(self, df, label, probabilities):
        return df.withColumn(label, F.lit(self.said)).withColumn(probabilities, F.array(F.lit(1.0)))


def test_folds_of_any_model(spark):
    rows = [(1, 1.0, 1.0, "a"), (1, 1.0, 1.0, "a"), (2, 1.0, 1.0, "b"), (2, 1.0, 1.0, "b"), (3, 1.0, 1.0, "b")]
    given = spark.createDataFrame(rows, FOLD_SCHEMA)
    scored = folds.score_folds(given, Majority)
    assert {(r["run_id"], r["prediction"]) for r in scored.collect()} == {(1, "b"), (2, "a"), (3, "a")}
    report = {(r["run_id"], r["class"]): (r["support"], r["predicted"], r["hits"]) for r in folds.fold_report(scored).collect()}
    assert report == {(1, "a"): (2, 0, 0), (1, "b"): (0, 2, 0), (2, "b"): (2, 0, 0), (2, "a"): (0, 2, 0), (3, "b"): (1, 0, 0), (3, "a"): (0, 1, 0)}
    with pytest.raises(ValueError):
        folds.score_folds(given, Majority, most=2)
    with pytest.raises(ValueError):
        folds.score_folds(given.where("run_id = 1"), Majority)


def test_folds_of_a_trained_model(spark):
    given = spark.createDataFrame(FOLD_ROWS, FOLD_SCHEMA)
    scored = folds.score_folds(given, lambda rows: model.train(rows, features=["x"], trees=3, depth=3))
    assert scored.where("prediction <> health_status").isEmpty() and scored.count() == len(FOLD_ROWS)
