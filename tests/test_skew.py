"""The ways for large groups give the same rows as the plain ones, with a hot run and a hot time."""

import pytest
from pyspark.sql import functions as F

from plantpulse.checks.base import DAY, patchy, readings  # noqa: F401
from plantpulse.checks.ordering import rule_score
from plantpulse.operators import batches, features, ordering, quality, selection, splits
from tests.conftest import TINY, same_rows

GROUPS, ORDER = ["run_id"], ["timestamp", "event_id"]


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in run 0, a third at one time, some nulls in both."""
    table = patchy(spark, TINY)
    run = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 50 == 1, None).otherwise(F.col("run_id"))
    time = F.when(F.col("event_id") % 3 == 1, F.lit("2024-01-15 12:00:00").cast("timestamp")).otherwise(F.col("timestamp"))
    return table.withColumn("run_id", run.cast("bigint")).withColumn("timestamp", time).cache()


def test_ordinal(hot):
    plain = ordering.with_ordinal(hot, GROUPS, ORDER)
    assert same_rows(plain, ordering.with_ordinal(hot, GROUPS, ORDER, limit=10))
    assert plain.agg(F.max("ordinal")).first()[0] >= hot.count() // 3


def test_ordinal_of_whole_table(hot):
    assert same_rows(ordering.with_ordinal(hot, [], ORDER), ordering.with_ordinal(hot, [], ORDER, limit=10))


@pytest.mark.parametrize("move", [ordering.with_previous, ordering.with_next])
def test_neighbours(hot, move):
    values = {"t": F.col("timestamp"), "x": F.col("sensor_value")}
    assert same_rows(move(hot, GROUPS, ORDER, values), move(hot, GROUPS, ORDER, values, limit=10))


def test_running_totals(hot):
    totals = {"seen": F.col("sensor_value").isNotNull().cast("bigint"), "all": F.lit(1).cast("bigint")}
    plain = ordering.with_running_totals(hot, GROUPS, ORDER, totals)
    assert same_rows(plain, ordering.with_running_totals(hot, GROUPS, ORDER, totals, limit=10))


@pytest.mark.parametrize("keys, value", [(["run_id"], "sensor_value"), (["run_id"], "repeated"), ([], "event_id"), ([], "repeated")])
def test_quantiles(hot, keys, value):
    table = hot.withColumn("repeated", F.when(F.col("event_id") % 3 == 0, 7.0).otherwise(F.col("sensor_value")))
    fractions = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    flat = lambda df: df.select(*keys, "n", F.posexplode("quantiles")).withColumn("col", F.round("col", 9))
    plain = selection.grouped_quantiles(table, keys, value, fractions)
    assert same_rows(flat(plain), flat(selection.grouped_quantiles(table, keys, value, fractions, limit=10, final_rows=5)))


@pytest.mark.parametrize("n", [0, 10, 500, 990, 5000])
def test_first_rows(hot, n):
    ranked = ordering.with_ordinal(hot.withColumn("late", F.col("timestamp").isNull()), [], ["late", *ORDER])
    expected = ranked.where(F.col("ordinal") <= n).select("event_id")
    for final_rows in (100_000, 5):
        chosen = hot.where(selection.first_rows_condition(hot, "timestamp", "event_id", n, final_rows))
        assert same_rows(expected, chosen.select("event_id"))


def test_split_by_run(hot):
    assert same_rows(splits.split_by_run(hot, "event_id"), splits.split_by_run(hot, "event_id", limit=10))


def test_split_stratified(hot):
    assert same_rows(splits.split_stratified(hot, "event_id", 0.3), splits.split_stratified(hot, "event_id", 0.3, limit=10))


def test_chronological_split(hot):
    plain = splits.split_chronological(hot, "event_id")
    assert same_rows(plain, splits.split_chronological(hot, "event_id", final_rows=5))
    assert plain.where("split = 'train'").count() == int(hot.count() * 0.8)


def test_gaps_and_order(hot):
    for groups in (["run_id"], []):
        order = ["event_id"] if groups else ["run_id", "event_id"]
        plain = quality.check_gaps(hot, order, groups)
        assert same_rows(plain, quality.check_gaps(hot, order, groups, limit=10))
        plain = quality.check_sorted(hot, order, groups)
        assert same_rows(plain, quality.check_sorted(hot, order, groups, limit=10))


def test_outliers(hot):
    spread = hot.withColumn("sensor_value", F.when(F.col("event_id") % 40 == 0, 1e5).otherwise(F.col("sensor_value")))
    plain = quality.check_outliers(spread)
    assert plain.count() > 0
    assert same_rows(plain, quality.check_outliers(spread, limit=10))


@pytest.mark.parametrize("final_rows", [3, 100_000])
def test_column_quantiles(spark, hot, final_rows):
    odd = hot.select(
        F.col("sensor_value").alias("a"),
        F.when(F.col("event_id") % 3 == 0, 7.0).when(F.col("event_id") % 3 == 1, 8.0).otherwise(F.col("event_id")).alias("ties"),
        F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(F.col("event_id") % 2).cast("double").alias("half"),
        F.lit(None).cast("double").alias("none"),
        F.col("event_id").alias("whole"),
    )
    fractions = [0.25, 0.75, 1.0]
    got = selection.column_quantiles(odd, odd.columns, fractions, final_rows)
    exact = odd.toPandas().astype(float).quantile(fractions)
    assert set(got) == {"a", "ties", "half", "whole"}
    for name, values in got.items():
        assert values == pytest.approx(exact[name].tolist())
    assert selection.column_quantiles(odd.limit(0), odd.columns, fractions, final_rows) == {}


def test_report_in_few_jobs(spark, hot):
    spark.sparkContext.setJobGroup("report", "report")
    plain = quality.validation_report(hot, ["event_id"])
    rows = plain.collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("report"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 25 and {r["check"] for r in rows} >= {"rows", "missing", "duplicates", "ranges", "sorted", "gaps"}
    rounded = lambda df: df.withColumn("value", F.round("value", 6))
    assert same_rows(rounded(plain), rounded(quality.validation_report(hot, ["event_id"], limit=10)))
    print("jobs", jobs)


def test_carried_status(hot):
    rows = hot.where("run_id is not null")
    plain = batches.score_and_carry(rows, "event_id", rule_score)
    assert same_rows(plain, batches.score_and_carry(rows, "event_id", rule_score, limit=10))


def test_crossings_peaks_percentiles(hot):
    rows = hot.where("run_id is not null and timestamp is not null")
    for made in (features.zero_crossings, features.peak_counts):
        plain = made(rows, "1d", "sensor_value", "event_id")
        assert same_rows(plain, made(rows, "1d", "sensor_value", "event_id", limit=10))
    percentiles = lambda limit: features.window_percentiles(rows, "1d", "sensor_value", (0.25, 0.5), limit=limit)
    rounded = lambda df: df.select("timestamp", "run_id", F.round("sensor_value_p25", 9).alias("a"), F.round("sensor_value_p50", 9).alias("b"))
    assert same_rows(rounded(percentiles(1_000_000)), rounded(percentiles(10)))


def test_features_of_several_sensors(hot):
    """Rows are moved once, to the task of their window; windows too large for that, and only those, are combined map-side."""
    rows = hot.withColumns({"day": F.date_trunc("day", "timestamp"), "other": F.col("sensor_value") * F.col("event_id")})
    keys, sensors, labels = ["day", "run_id"], ["sensor_value", "other"], {"health_status": ["Failure", "Normal", "Warning"]}
    made = lambda **more: features.aggregate_windows(rows, keys, sensors, ("mean", "skewness", "kurtosis"), labels, count="n", **more)
    rounded = lambda df: df.select(*keys, "health_status", "n", *[F.round(c, 6).alias(c) for c in df.columns if c.startswith(("sensor_", "other_"))])
    assert made().agg(F.max("n"), F.sum("n")).first()[:] == (made(limit=10).agg(F.max("n")).first()[0], rows.count())
    assert same_rows(rounded(made()), rounded(made(limit=10)))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(made()) == exchanges(made(limit=None)) == 1


def test_large_groups(spark, hot):
    found = ordering.large_groups(hot, ["run_id"], 300)
    assert same_rows(found, hot.groupBy("run_id").count().where("count > 300").select("run_id")) and found.count() == 1
    assert ordering.large_groups(hot, ["event_id"], 1) is None and ordering.large_groups(hot.limit(0), ["run_id"], 1) is None


@pytest.mark.parametrize("partitions", ["1", "4", "32"])
def test_result_does_not_depend_on_partitions(spark, hot, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = splits.split_by_run(hot, "event_id")
        total = table.groupBy("split").agg(F.sum("event_id").alias("ids")).collect()
        ordinal = ordering.with_ordinal(hot, GROUPS, ORDER, limit=10).agg(F.sum(F.col("ordinal") * F.col("event_id"))).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    seen = (sorted((r["split"], r["ids"]) for r in total), ordinal)
    test_result_does_not_depend_on_partitions.seen = getattr(test_result_does_not_depend_on_partitions, "seen", seen)
    assert test_result_does_not_depend_on_partitions.seen == seen
