"""Readers and writers on hand-made files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantpulse.columns import HEADER_TRANSLATION, SENSOR_RANGES, SENSORS
from plantpulse.operators import splits
from plantpulse.sinks import tables
from plantpulse.sources import readings, records

READING = {name: low for name, (low, high) in SENSOR_RANGES.items()}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_runs_of_different_layout(spark, tmp_path):
    normal = write(tmp_path / "normal run+1.csv", "timestamp,bearing_temp_c,health_status\n2024-01-01 00:00:10,60,Normal\n2024-01-01 00:00:40,62,Normal\nbad,99,Normal\n")
    warning = write(tmp_path / "warning_4_oil_temp_increase.csv", "timestamp,health_status,oil_temp_c,extra\n01/02/2024 3:04,Warnin ,55,7\n01/02/2024 3:04,Normal,57,9\n")
    part = tmp_path / "failure_8_seal_failure.csv"
    write(part / "part-0.csv", "timestamp,bearing_temp_c,health_status\n2024-01-03 00:00:00,70,Failur\n")
    write(part / "part-1.csv", "timestamp,bearing_temp_c,health_status\n2024-01-03 00:01:00,72,Failur\n")
    df = readings.load_runs(spark, [normal, warning, str(part)], start_run_id=5, labels=True, frequency="1min")
    rows = {(r["run_id"], r["timestamp"]): r for r in df.collect()}
    assert len(rows) == 4
    first = rows[5, dt.datetime(2024, 1, 1)]
    assert (first["bearing_temp_c"], first["oil_temp_c"], first["warning_type"], first["failure_type"]) == (61.0, None, None, None)
    second = rows[6, dt.datetime(2024, 1, 2, 3, 4)]
    assert (second["oil_temp_c"], second["extra"], second["health_status"]) == (56.0, 8.0, "Warning")
    assert (second["warning_type"], second["failure_type"]) == ("oil_temp_increase", None)
    assert {rows[7, dt.datetime(2024, 1, 3, 0, m)]["failure_type"] for m in (0, 1)} == {"seal_failure"}


def test_no_runs_and_repeated_runs(spark, tmp_path):
    assert readings.load_runs(spark, []).count() == 0
    path = write(tmp_path / "a.csv", "timestamp,oil_temp_c\n2024-01-01,1\n")
    with pytest.raises(ValueError):
        readings.load_runs(spark, [path, path])


def test_validated_read(spark, tmp_path):
    path = write(tmp_path / "v.csv", "timestamp,x\n2024-01-01 00:00:00,1\n2024-01-01 00:01:00,\n")
    assert readings.read_validated(spark, path).count() == 1
    with pytest.raises(ValueError):
        readings.read_validated(spark, write(tmp_path / "w.csv", "time,x\n2024-01-01,1\n"))


def test_file_lists():
    assert readings.run_files("datasets\\renamed", ["a.csv"]) == ["datasets/renamed/a.csv"]
    assert readings.run_files("d", None) == []


def test_records(spark):
    df = readings_of = records.readings_from_records(spark, [READING, READING], ["2024-01-01", "2024-01-02"])
    assert readings_of.columns == ["timestamp", *SENSORS] and df.count() == 2
    assert records.readings_from_records(spark, READING, "2024-01-01").count() == 1
    spaced = records.readings_from_records(spark, [READING] * 2).orderBy("timestamp").collect()
    assert spaced[1]["timestamp"] - spaced[0]["timestamp"] == dt.timedelta(minutes=10)
    with pytest.raises(ValueError):
        records.readings_from_records(spark, {"oil_temp_c": 1.0})
    with pytest.raises(ValueError):
        records.readings_from_records(spark, [READING], ["2024-01-01", "2024-01-02"])


def test_reading_map_without_a_sensor_raises(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 1.0},)], "m map<string,double>")
    assert records.missing_readings(df, "m", ["a", "b"]).collect() == [("b", 1)]
    with pytest.raises(Exception, match="reading lacks b"):
        records.readings_from_maps(df, "m", ["a", "b"]).collect()


def test_generated_readings_stay_in_range(spark):
    df = records.sample_readings(spark, 200)
    assert df.count() == 200
    for name, (low, high) in SENSOR_RANGES.items():
        assert df.where(~F.col(name).between(low, high)).count() == 0
    assert df.select(F.max("timestamp")).first()[0] == dt.datetime(2024, 1, 1) + dt.timedelta(minutes=1990)


def test_translate_files(spark, tmp_path):
    header = ",".join(HEADER_TRANSLATION)
    write(tmp_path / "raw" / "old.csv", header + "\n" + ",".join(["2024-01-01 00:00:00"] + ["1.5"] * 15 + ["Normal"]) + "\n")
    tables.translate_files(spark, str(tmp_path / "raw"), str(tmp_path / "new"), {"old.csv": "new.csv"})
    assert readings.read_csv(spark, str(tmp_path / "new" / "new.csv")).columns == ["timestamp", *SENSORS, "health_status"]


def test_exports(spark, tmp_path):
    df = splits.split_whole_runs(spark.range(10).withColumn("run_id", F.col("id") % 5))
    tables.export_split(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'test'").count() == 2
    tables.export_split(df, str(tmp_path / "c"), "csv")
    train, test = readings.load_split(spark, str(tmp_path / "c" / "train.csv"), str(tmp_path / "c" / "test.csv"))
    assert (train.count(), test.count()) == (8, 2)
    with pytest.raises(ValueError):
        tables.export_split(df, str(tmp_path / "x"), "xlsx")
    path = tables.write_predictions(df, str(tmp_path / "data.csv"))
    assert path.endswith("data_predictions.csv") and readings.read_csv(spark, path).count() == 10


def test_headers_of_many_parts_are_one_look_up(spark, tmp_path):
    """A thousand small parts of three headers, an empty file and names with blanks: one job for the lines, one for each header."""
    from plantpulse.sources import readings as source

    headers = ["timestamp,a", "timestamp,b", '"timestamp","a b"']
    for i in range(1_000):
        (tmp_path / f"run {i % 7}.csv").mkdir(exist_ok=True)
        (tmp_path / f"run {i % 7}.csv" / f"part-{i:04}.csv").write_text(f"{headers[i % 3]}\n2024-01-01 00:00:00,{i}\n" * (1 if i != 5 else 20_000))
    (tmp_path / "run 0.csv" / "part-none.csv").write_text("")
    parts = sorted(str(p) for p in tmp_path.glob("*/part-*.csv"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "look-up")
    found = dict(zip(parts, source._headers(spark, parts)))
    names = [("timestamp", "a"), ("timestamp", "b"), ("timestamp", "a b")]
    for path, columns in found.items():
        number = path.rpartition("part-")[2].removesuffix(".csv")
        assert columns == (() if number == "none" else names[int(number) % 3])
    assert len(tracker.getJobIdsForGroup("headers")) <= 1 + 4
    loaded = source.load_runs(spark, sorted(str(p) for p in tmp_path.glob("run *.csv")))
    assert loaded.count() == 999 + 39_999 and set(loaded.columns) == {"timestamp", "a", "b", "a b", "run_id"}
