"""Stateful scoring of a stream in batches of five valid rows per run.

A model cannot be called inside a state function, so the state carries readings, not verdicts: each
row leaves with the sensor values of the latest full batch of its run, and the features and scores
are ordinary columns computed downstream. Scoring is deterministic, so all rows ruled by the same
batch get the same status, as if the status itself had been carried.

The state of a run is at most two batches. A run's rows of one micro-batch are sorted in one task,
which the trigger bounds (``files_per_trigger``); they leave it in pieces, since the readings of its batch make a row
many times as large. Order across micro-batches is arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..columns import FAILURE_TYPE, FAULT_TYPE, NORMAL, RUN, STATUS, TIMESTAMP, WARNING_TYPE
from ..functions.arrays import with_array_statistics
from ..functions.status import fault_type
from ..functions.timebase import floor_time
from ..operators.batches import BATCH_ROWS, Scorer
from ..operators.features import sensor_columns
from ..operators.filters import is_complete
from .flows import write_points

_VALID, _TIMES, _VALUES = "_valid", "_batch_times", "_batch_values"
# Rows that carry their batch's readings at the same time.
PIECE_ROWS = 10_000
_STATE = T.StructType(
    [
        T.StructField("open_times", T.ArrayType(T.LongType())),
        T.StructField("open_values", T.ArrayType(T.DoubleType())),
        T.StructField("full_times", T.ArrayType(T.LongType())),
        T.StructField("full_values", T.ArrayType(T.DoubleType())),
    ]
)


def _batch_keeper(order: list[str], sensors: list[str], size: int):
    """State function: append to each row the times and values of its run's latest full batch."""
    width = len(sensors)

    def step(_, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [])
        rows = pd.concat(list(chunks), ignore_index=True)
        place = rows[order].sort_values(order, na_position="first").index.to_numpy()
        valid = rows[_VALID].to_numpy()[place]
        fresh = rows[["_micros", *sensors]].iloc[place[valid]]
        times = np.concatenate([np.asarray(held[0], "int64"), fresh["_micros"].to_numpy("int64")])
        values = np.concatenate(
            [np.asarray(held[1], "float64").reshape(-1, width), fresh[sensors].to_numpy("float64")]
        )
        # Number of batches that are full at each row; zero leaves the batch kept from before.
        full = (len(held[0]) + np.cumsum(valid)) // size
        last = len(times) // size

        def done(kept, x, i: int) -> list:
            return x[(i - 1) * size : i * size].ravel().tolist() if i else list(kept)

        as_list = lambda kind, x: [kind(v) for v in np.ravel(x)]
        state.update(
            (
                as_list(int, times[last * size :]),
                as_list(float, values[last * size :]),
                as_list(int, done(held[2], times, last)),
                as_list(float, done(held[3], values, last)),
            )
        )
        for start in range(0, len(place), PIECE_ROWS):
            own = full[start : start + PIECE_ROWS]
            piece = rows.iloc[place[start : start + PIECE_ROWS]].reset_index(drop=True)
            # Rows of one batch share its lists.
            for name, kept, x in ((_TIMES, held[2], times), (_VALUES, held[3], values)):
                shared = {i: done(kept, x, i) for i in np.unique(own).tolist()}
                piece[name] = [shared[i] for i in own.tolist()]
            yield piece

    return step


def with_latest_batch(df: DataFrame, key: str, size: int = BATCH_ROWS, run: str = RUN, time: str = TIMESTAMP) -> DataFrame:
    """Rows of a stream with the readings of their ruling batch (empty before the first one)."""
    sensors = sensor_columns(df, time, STATUS, (run, key))
    marked = df.withColumn(_VALID, is_complete(df)).withColumn("_micros", F.unix_micros(time))
    extra = [T.StructField(_TIMES, T.ArrayType(T.LongType())), T.StructField(_VALUES, T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*marked.schema.fields, *extra])
    kept = marked.groupBy(run).applyInPandasWithState(
        _batch_keeper([time, key], sensors, size), schema, _STATE, "append", GroupStateTimeout.NoTimeout
    )
    return kept.drop(_VALID, "_micros")


def latest_batch_features(df: DataFrame, sensors: list[str], window: str = "10min") -> DataFrame:
    """Feature columns from the carried readings: the rows in the batch's first time window."""
    starts = F.transform(_TIMES, lambda t: F.unix_micros(floor_time(F.timestamp_micros(t), window)))
    width = len(sensors)
    spread = df.withColumn("_starts", starts).withColumn("_start", F.array_min("_starts"))
    columns = {}
    for i, sensor in enumerate(sensors):
        pick = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size("_starts") - 1),
                lambda j: F.when(
                    F.get("_starts", j) == F.col("_start"), F.get(_VALUES, j * width + i)
                ),
            ),
            lambda x: x.isNotNull(),
        )
        columns[f"_x_{sensor}"] = F.when(F.size("_starts") > 0, pick)
    made = with_array_statistics(spread.withColumns(columns), {s: f"_x_{s}" for s in sensors})
    return made.drop("_starts", *columns)


def score_stream(df: DataFrame, key: str, score: Scorer, window: str = "10min", size: int = BATCH_ROWS) -> DataFrame:
    """Rows of a stream with carried status and fault type, ``Normal``/``none`` before a full batch."""
    sensors = sensor_columns(df, TIMESTAMP, STATUS, (RUN, key))
    features = latest_batch_features(with_latest_batch(df, key, size).drop(STATUS), sensors, window)
    scored = score(features)
    waiting = F.col("_start").isNull()
    fault = fault_type(F.col(STATUS), F.col(WARNING_TYPE), F.col(FAILURE_TYPE))
    kept = [c for c in df.columns if c not in (STATUS, FAULT_TYPE)]
    return scored.select(
        *kept,
        F.when(waiting, NORMAL).otherwise(F.col(STATUS)).alias(STATUS),
        F.when(waiting, "none").otherwise(fault).alias(FAULT_TYPE),
    )


def write_scored_points(
    df: DataFrame,
    key: str,
    measurement: str,
    folder: str,
    checkpoint: str,
    score: Scorer | None = None,
    once: bool = True,
) -> StreamingQuery:
    """The scoring stream as points: score in batches, carry the status, tag and write every row.

    Without ``score`` the status that came with the rows is passed through. Errors stop the query,
    which resumes from its checkpoint.
    """
    rows = df if score is None else score_stream(df, key, score)
    return write_points(rows, measurement, folder, checkpoint, once)
