"""Hand-made edge cases of the column functions and small operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from plantpulse.columns import STATUSES
from plantpulse.functions import labels, statistics, status, timebase
from plantpulse.functions.arrays import with_array_statistics
from plantpulse.operators import evaluate, features, filters, ordering, points, quality, resample, splits, weights

NAN = float("nan")


def stat(spark, name, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(statistics.statistic(name)(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "name, values, expected",
    [
        ("skewness", [1, 2, 4, 8, 9], 0.2717687582352618),
        ("kurtosis", [1, 2, 4, 8, 9], -2.6802653605307),
        ("std", [5, 5, 5, 5], 0.0),
        ("skewness", [5, 5, 5, 5], 0.0),
        ("kurtosis", [5, 5, 5, 5], 0.0),
        ("skewness", [1, 2], None),
        ("kurtosis", [1, 2, 4], None),
        ("std", [3], 0.0),
        ("rms", [-3], 3.0),
        ("peak_to_peak", [3], 0.0),
        ("population_kurtosis", [1, 1], 0.0),
        ("crest_factor", [0, 0], None),
        ("crest_factor", [3, -4], 4 / math.sqrt(12.5)),
    ],
)
def test_statistics(spark, name, values, expected):
    found = stat(spark, name, [float(v) for v in values])
    assert found is None if expected is None else found == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("values", [[1, 2, 4, 8, 9], [5, 5, 5, 5], [1, 2], [7.5], [400.0, 400.01, 399.99, 400.02]])
def test_array_statistics_equal_aggregates(spark, values):
    values = [float(v) for v in values]
    df = spark.createDataFrame([(values,)], "a array<double>")
    row = with_array_statistics(df, {"x": "a"}).first()
    for name in statistics.STANDARD:
        expected = stat(spark, name, values)
        found = row[f"x_{name}"]
        assert found is None if expected is None else found == pytest.approx(expected, rel=1e-6, abs=1e-9)


def test_moments_of_a_narrow_signal_far_from_zero(spark):
    """A small spread on a large mean keeps its moments."""
    values = [400 + d / 1e4 for d in (1, 2, 4, 8, 9)]
    assert stat(spark, "kurtosis", values) == pytest.approx(-2.6802653605307, rel=1e-5)


def test_custom_statistic(spark):
    statistics.register_statistic("spread", lambda x: F.max(x) - F.min(x) + 1)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 1), 4.0)], "timestamp timestamp, x double")
    assert features.extract_features(df, statistics=("spread",)).first()["x_spread"] == 4.0
    with pytest.raises(ValueError):
        statistics.register_statistic("mean", F.avg)
    with pytest.raises(ValueError):
        statistics.statistic("absent")


@pytest.mark.parametrize("known", [None, ["a", "b"]])
def test_majority(spark, known):
    vote = lambda rows: spark.createDataFrame([(r,) for r in rows], "l string").agg(statistics.majority(F.col("l"), known)).first()[0]
    assert vote(["b", "a", None, "b", "a"]) == "a"
    assert vote(["b", "a", "b"]) == "b"
    assert vote([None, None]) is None


def test_majority_refuses_unlisted_labels(spark):
    df = spark.createDataFrame([("a",), ("z",)], "l string").agg(statistics.majority(F.col("l"), ["a", "b"]))
    with pytest.raises(Exception, match="label outside"):
        df.collect()


def test_majority_labels(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, "b"), (1, "a"), (2, None)], "k int, l string")
    assert {tuple(r) for r in features.majority_labels(df, ["k"], "l").collect()} == {(1, "a"), (2, None)}


@pytest.mark.parametrize(
    "text, micros", [("10min", 600_000_000), ("1H", 3_600_000_000), ("1T", 60_000_000), ("30sec", 30_000_000), ("2 hours", 7_200_000_000), ("D", 86_400_000_000)]
)
def test_frequency(text, micros):
    assert timebase.frequency_micros(text) == micros


@pytest.mark.parametrize("text", ["", "ten min", "5 parsecs", "0min"])
def test_bad_frequency(text):
    with pytest.raises(ValueError):
        timebase.frequency_micros(text)


def test_floor_before_the_epoch(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59),)], "t timestamp")
    assert df.select(timebase.floor_time(F.col("t"), "10min")).first()[0] == dt.datetime(1969, 12, 31, 23, 50)


def test_mixed_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 00:08",), ("01/02/2024 3:04",), ("bad",), (None,)], "t string")
    found = [r[0] for r in df.select(timebase.parse_timestamp(F.col("t"))).collect()]
    assert found == [dt.datetime(2024, 1, 1, 0, 8), dt.datetime(2024, 1, 2, 3, 4), None, None]


def test_status_cleaning_and_codes(spark):
    df = spark.createDataFrame([(" \tWarnin ",), ("Failur",), ("Normal",), ("Foo",), (None,), ("Error",)], "s string")
    rows = df.select(status.clean_status(F.col("s")).alias("s")).select("s", status.status_code(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("Warning", 1), ("Failure", 2), ("Normal", 0), ("Foo", -1), (None, -1), ("Error", 2)]


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/data/Warning_files/run_3_bearing_temp_increase.csv", ("bearing_temp_increase", None)),
        ("warning_13_outlet_fluid_temp_increase.csv", ("outlet_fluid_temp_increase", None)),
        ("x/failure_7_voltage_drop.csv", (None, "voltage_drop")),
        ("x/failure_of_something.csv", (None, "unknown")),
        ("x/normal_3months.csv", (None, None)),
        ("C:\\data\\failure_4_cavitation.csv", (None, "cavitation")),
        ("warning_dir/cavitation/file.csv", ("unknown", None)),
    ],
)
def test_labels(spark, path, expected):
    warning, failure = labels.layered_labels(F.lit(path))
    assert tuple(spark.range(1).select(warning, failure).first()) == expected


def test_exclude_normal_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("Normal",), ("Warning",)], "health_status string")
    assert [r[0] for r in filters.exclude_normal(df).collect()] == [None, "Warning"]
    assert filters.by_condition(df, "unknown").count() == 3
    assert filters.by_condition(df, "normal").count() == 1


def test_configured_filter_errors_and_long_list(spark):
    df = spark.range(5).withColumn("c", F.col("id").cast("string"))
    assert filters.configured_filter(df, "c", "in", [str(i) for i in range(3, 3000)]).count() == 2
    with pytest.raises(ValueError):
        filters.configured_filter(df, "absent", "==", 1)
    with pytest.raises(ValueError):
        filters.configured_filter(df, "c", ">", 1)


def test_align_features(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert filters.align_features(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError):
        filters.align_features(df, ["b", "c"])
    with pytest.raises(ValueError):
        filters.prepare_matrix(df, "target")


def test_duplicates_count_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t,), (t,), (None,), (None,)], "timestamp timestamp")
    assert quality.check_duplicates(df).first()[0] == 2


def test_empty_report(spark):
    df = spark.createDataFrame([], "timestamp timestamp, run_id bigint, x double")
    verdict = quality.validation_verdict(df, ["timestamp"]).first()
    assert verdict["is_valid"]


def test_resample_seven_minutes(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(1), 1.0, None), (at(8), None, "q"), (None, 9.0, "z"), (at(30), 4.0, None)]
    df = spark.createDataFrame(rows, "timestamp timestamp, x double, c string")
    found = resample.resample(df, "7min", "mean").orderBy("timestamp").collect()
    assert [tuple(r) for r in found] == [(at(0), 1.0, None), (at(7), None, "q"), (at(28), 4.0, None)]
    with pytest.raises(ValueError):
        resample.resample(df, "7min", "median")
    assert resample.resample(df.drop("timestamp"), "7min") is not None


def test_single_row_run_trains(spark):
    df = spark.createDataFrame([(1, 1, "Normal")], "event_id int, run_id int, health_status string")
    assert splits.split_by_run(df, "event_id").first()["split"] == "train"


@pytest.mark.parametrize("share", [0.1, 0.2, 0.37, 0.5])
def test_split_sizes(spark, share):
    """Every run gives ceil(n * share) rows to test and each class its proportional part."""
    df = spark.range(500).select("id", (F.col("id") % 7 * F.col("id") % 4).alias("run_id"), F.when(F.col("id") % 9 == 0, "Failure").otherwise("Normal").alias("health_status"))
    split = splits.split_by_run(df, "id", share)
    assert split.count() == 500
    for row in split.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert row["t"] == math.ceil(row["n"] * share)
    by_class = split.groupBy("run_id", "health_status").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    for row in by_class.collect():
        assert abs(row["t"] - row["n"] * share) <= 1.5


@pytest.mark.parametrize("share", [0.0, 1.0, -1])
def test_split_size_must_be_a_share(spark, share):
    with pytest.raises(ValueError):
        splits.split_stratified_time(spark.range(1).withColumn("timestamp", F.current_timestamp()), share)


def test_stratified_time_split_that_never_has_enough(spark):
    """The only early failure forces every bucket into test."""
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(at(1), "Failure"), (at(2), "Normal"), (at(3), "Normal"), (None, "Normal"), (at(4), None)]
    df = spark.createDataFrame(rows, "timestamp timestamp, health_status string")
    found = {(r[0], r[1]): r[2] for r in splits.split_stratified_time(df, 0.2).collect()}
    assert found == {(at(1), "Failure"): "test", (at(2), "Normal"): "test", (at(3), "Normal"): "test", (None, "Normal"): "train", (at(4), None): "train"}


def test_fold_split(spark):
    df = spark.range(10).withColumn("run_id", F.col("id") % 3)
    folds = splits.run_folds(df).collect()
    assert [(r["run_id"], r["test_rows"], r["train_rows"]) for r in folds] == [(0, 4, 6), (1, 3, 7), (2, 3, 7)]
    assert splits.fold_split(df, 1).where("split = 'test'").count() == 3


def test_shuffle_is_reproducible(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    once = [r[0] for r in ordering.seeded_shuffle(df, "k", 7).collect()]
    assert once == [r[0] for r in ordering.seeded_shuffle(df.repartition(5), "k", 7).collect()]
    assert sorted(once) == list(range(50)) and once != sorted(once)
    assert once != [r[0] for r in ordering.seeded_shuffle(df, "k", 8).collect()]


def test_explicit_weights(spark):
    df = spark.createDataFrame([("Normal",), ("Failure",), ("Other",)], "health_status string")
    rows = weights.with_explicit_weights(df, [1, 28, 62], STATUSES).collect()
    assert [r["weight"] for r in rows] == [1.0, 62.0, None]
    with pytest.raises(ValueError):
        weights.with_explicit_weights(df, [1, 2], STATUSES)


def test_metrics_agree_with_spark(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    pairs = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 3 + [(2.0, 0.0)] + [(2.0, 2.0)] * 4
    df = spark.createDataFrame(pairs, "label double, prediction double")
    ours = evaluate.weighted_metrics(evaluate.confusion(df)).first()
    for name, theirs in {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall", "f1_score": "f1"}.items():
        assert ours[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))


def test_class_never_predicted_scores_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    found = {r["class"]: tuple(r)[1:5] for r in evaluate.per_class(evaluate.confusion(df)).collect()}
    assert found["b"] == (0.0, 0.0, 0.0, 1)


def test_point(spark):
    row = (dt.datetime(2024, 1, 1), 1.0, None, "x", "2.5", "Foo", None)
    df = spark.createDataFrame([row], "timestamp timestamp, a double, b double, c string, d string, health_status string, fault_type string")
    point = points.to_points(df, "m").first()
    assert point["fields"] == {"a": 1.0, "d": 2.5, "health_status_code": -1.0}
    assert point["tags"] == {"health_status": "Foo"} and point["measurement"] == "m"


def test_fill_window_repeats_in_order(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21), (2, 22), (2, 23), (2, 24)], "g int, k int")
    found = ordering.fill_window(df, ["g"], ["k"], 5)
    assert [r["k"] for r in found.where("g = 1").orderBy("position").collect()] == [10, 11, 10, 11, 10]
    assert found.where("g = 2").count() == 5


def test_drop_blank_rows_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "b"), (2.0, " "), (None, "c")], "x double, s string")
    assert [r["s"] for r in filters.drop_blank_rows(df).collect()] == ["a"]
    assert filters.nan_to_null(df).where("x is null").count() == 2


def test_gap_rows(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(i, 1, at(m)) for i, m in enumerate([0, 1, 2, 3, 20, 19])], "k int, run_id int, timestamp timestamp")
    row = quality.check_gaps(df, ["k"]).first()
    assert (row["gaps"], row["median_interval"], row["max_gap"]) == (1, 60e6, 17 * 60_000_000)
    assert not quality.check_sorted(df, ["k"]).first()["is_sorted"]
