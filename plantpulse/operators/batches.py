"""Count windows: consecutive valid rows of a run in batches of five, scored as one, and the
latest score carried forward over every row until the next full batch.

The carry is no scan over the run: the count of valid rows up to a row names the batch that rules
it, so the scores come back through an equi-join on (run, batch).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import FAILURE_TYPE, FAULT_TYPE, NORMAL, RUN, STATUS, TIMESTAMP, WARNING_TYPE
from ..functions.statistics import STANDARD
from ..functions.status import fault_type
from ..functions.timebase import floor_time
from ..storage import stage
from .features import aggregate_windows, sensor_columns
from .filters import is_complete
from .ordering import GROUP_ROWS, with_running_totals

BATCH_ROWS = 5
BATCH, RULING = "batch", "ruling_batch"

# Maps features to the same rows with health_status, warning_type and failure_type added.
Scorer = Callable[[DataFrame], DataFrame]


def with_batches(
    df: DataFrame, key: str, size: int = BATCH_ROWS, run: str = RUN, time: str = TIMESTAMP, limit: int = GROUP_ROWS
) -> DataFrame:
    """Add ``batch`` (null on rows with a missing value) and ``ruling_batch`` (null before the first
    full batch). The row that fills a batch is already ruled by it."""
    valid = is_complete(df).cast("bigint")
    counted = with_running_totals(df.withColumn("_valid", valid), [run], [time, key], {"_upto": F.col("_valid")}, limit)
    full = F.floor(F.col("_upto") / size)
    return counted.select(
        *df.columns,
        F.when(F.col("_valid") == 1, F.floor((F.col("_upto") - 1) / size)).alias(BATCH),
        F.when(full > 0, full - 1).alias(RULING),
    )


def batch_features(
    batched: DataFrame,
    window: str = "10min",
    size: int = BATCH_ROWS,
    run: str = RUN,
    time: str = TIMESTAMP,
    exclude=(),
    statistics=tuple(STANDARD),
) -> DataFrame:
    """Features of the first time window of every full batch; that window stands for the batch."""
    sensors = sensor_columns(batched, time, STATUS, (run, BATCH, RULING, *exclude))
    names = [f"{c}_{s}" for s in statistics for c in sensors]
    members = batched.where(F.col(BATCH).isNotNull()).withColumn("_window", floor_time(F.col(time), window))
    windows = aggregate_windows(members, [run, BATCH, "_window"], sensors, statistics, {}, count="_rows", limit=None)
    first = F.min_by(F.struct("_window", *names), "_window").alias("_first")
    full = windows.groupBy(run, BATCH).agg(first, F.sum("_rows").alias("_rows")).where(F.col("_rows") == size)
    return full.select(run, BATCH, F.col("_first._window").alias(time), *[F.col("_first")[n].alias(n) for n in names])


def with_carried_status(batched: DataFrame, scored: DataFrame, run: str = RUN) -> DataFrame:
    """Every row with the status and fault type of its ruling batch, ``Normal``/``none`` before one.

    ``scored`` holds (run, batch, health_status, warning_type, failure_type).
    """
    fault = fault_type(F.col(STATUS), F.col(WARNING_TYPE), F.col(FAILURE_TYPE))
    verdicts = scored.select(
        F.col(run).alias("_run"),
        F.col(BATCH).alias("_batch"),
        F.col(STATUS).alias("_status"),
        F.struct(fault.alias("type")).alias("_fault"),
    )
    joined = batched.join(verdicts, (F.col(run) == F.col("_run")) & (F.col(RULING) == F.col("_batch")), "left")
    kept = [c for c in batched.columns if c not in (STATUS, FAULT_TYPE, BATCH, RULING)]
    return joined.select(
        *kept,
        F.coalesce("_status", F.lit(NORMAL)).alias(STATUS),
        F.when(F.col("_fault").isNull(), "none").otherwise(F.col("_fault.type")).alias(FAULT_TYPE),
    )


def score_and_carry(
    df: DataFrame, key: str, score: Scorer, window: str = "10min", size: int = BATCH_ROWS, limit: int = GROUP_ROWS
) -> DataFrame:
    """Batch form of the scoring stream: rows with the carried status and fault type."""
    # Written once: the rows are read for the features and again for the carry.
    batched = stage(with_batches(df, key, size, limit=limit), "batches")
    return with_carried_status(batched, score(batch_features(batched, window, size, exclude=(key,))))
