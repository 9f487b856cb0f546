"""Plans that matter at scale: pruned scans, pushed filters, no Python, no cross joins."""

import re

import pytest
from pyspark.sql import functions as F

from plantpulse.checks import CHECKS
from plantpulse.checks.base import readings, readings_wide
from plantpulse.columns import STATUSES
from plantpulse.operators import features, filters, splits
from plantpulse.storage import shared_folder, small_side
from tests.conftest import TINY

BATCH_QUERIES = sorted(n for n, c in CHECKS.items() if c.sql and not n.startswith(("stream_", "run_", "train_")))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(CHECKS[name].query(spark, TINY))
    assert not re.search(r"CartesianProduct|NestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas", text)


def test_features_use_hash_aggregates(spark):
    for labels in (STATUSES, None):
        text = plan(features.extract_features(readings_wide(spark, TINY), "30d", labels=labels))
        assert "HashAggregate" in text and not re.search(r"ObjectHashAggregate|SortAggregate", text)
        assert "l_comment" not in text and "l_orderkey" not in text


def test_filters_reach_the_scan(spark):
    text = plan(filters.between_times(readings(spark, TINY), "2024-01-10", "2024-01-11").select("sensor_value"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", text)
    assert re.search(r"ReadSchema: struct<ts:timestamp,value:double>", text)


def test_seeded_split_moves_no_rows(spark):
    """The final pass over the rows is a scan, a broadcast join and a projection."""
    text = plan(splits.split_by_run(readings(spark, TINY), "event_id"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Window" not in text
    assert not re.search(r"Exchange hashpartitioning", text)


def test_training_reads_a_written_split(spark):
    """Every pass of training is a scan, however many strata there are."""
    from plantpulse.checks.learning import _training_table

    text = plan(splits.part(_training_table(spark, TINY), "train"))
    assert "Scan parquet" in text and not re.search(r"Join|Exchange|Aggregate", text)


def test_chronological_split_is_a_filter(spark):
    assert "Exchange" not in plan(splits.split_chronological(readings(spark, TINY), "event_id"))


def test_large_side_is_not_broadcast(spark):
    small, large = small_side(spark.range(5), limit=10), small_side(spark.range(50), limit=10)
    joined = lambda side: plan(spark.range(3).withColumnRenamed("id", "k").join(side, F.col("k") == F.col("id")))
    assert "BroadcastHashJoin" in joined(small)
    assert large.count() == 50


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
