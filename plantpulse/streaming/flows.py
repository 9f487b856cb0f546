"""Stream sources, windowed features and the point sink."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..columns import RUN, STATUS, TIMESTAMP
from ..functions.statistics import STANDARD
from ..functions.timebase import frequency_interval
from ..operators.features import feature_aggregates, sensor_columns
from ..operators.points import to_points

# Files that one micro-batch takes at most, unless the caller says otherwise.
FILES_PER_TRIGGER = 64


def replay(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    kind: str = "parquet",
    files_per_trigger: int = FILES_PER_TRIGGER,
    pattern: str | None = None,
) -> DataFrame:
    """Files of a folder as a stream, oldest first; ``files_per_trigger`` sets the pace and so bounds every micro-batch."""
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def stream_features(
    df: DataFrame,
    window: str = "10min",
    delay: str = "10min",
    time: str = TIMESTAMP,
    target: str = STATUS,
    exclude: Sequence[str] = (RUN,),
    statistics: Sequence[str] = tuple(STANDARD),
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Window features of a stream, the same aggregates as in batch.

    The watermark bounds the state: in append mode a window is final, and emitted, once readings
    ``delay`` later have arrived, and rows that come after that are dropped by Spark.
    """
    keys = [RUN] if RUN in df.columns else []
    sensors = sensor_columns(df, time, target, exclude)
    span = F.window(F.col(time), frequency_interval(window)).alias("_window")
    made = feature_aggregates(sensors, statistics, target if target in df.columns else None, labels)
    features = df.withWatermark(time, frequency_interval(delay)).groupBy(span, *keys).agg(*made)
    return features.select(F.col("_window.start").alias(time), *[c for c in features.columns if c != "_window"])


def unique_readings(df: DataFrame, keys: Sequence[str], time: str = TIMESTAMP, delay: str = "10min") -> DataFrame:
    """A stream without repeats: of readings with equal ``keys`` that arrive within ``delay`` of each other, the first.

    State is one row per key and leaves when the watermark passes its time, so it does not grow with the stream. A reading more
    than ``delay`` behind the watermark is late: Spark drops it and counts it (:func:`late_rows`).
    """
    return df.withWatermark(time, frequency_interval(delay)).dropDuplicatesWithinWatermark(list(keys))


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped as late, over the progress reports that Spark holds.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` reports; read it from time to time on a long query.
    """
    reports = [json.loads(p.json) if hasattr(p, "json") and not isinstance(p, dict) else p for p in query.recentProgress]
    return sum(state.get("numRowsDroppedByWatermark", 0) for report in reports for state in report["stateOperators"])


def write_batches(df: DataFrame, folder: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Write each micro-batch into its own sub-folder, so a repeated batch replaces itself.

    With ``once`` the query takes what is there and stops; else it keeps running.
    """

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.start()


def write_points(df: DataFrame, measurement: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Turn the rows of a stream into points and append them to a folder."""
    return write_batches(to_points(df, measurement), folder, checkpoint, once=once)
