"""Scoring with stored layers: up to three saved models, loaded once and applied to files or to a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..columns import FAILURE_TYPE, READING_SCHEMA, RUN, STATUS, TIMESTAMP, WARNING_TYPE
from ..functions.timebase import parse_timestamp
from ..operators import features, filters
from ..operators.hierarchy import CONFIDENCE, predict_hierarchy
from ..operators.model import Classifier
from ..sources.readings import load_runs
from ..streaming.flows import FILES_PER_TRIGGER, replay, write_points
from ..streaming.scoring import score_stream

VERDICT = (STATUS, CONFIDENCE, WARNING_TYPE, FAILURE_TYPE)
_KEY = "_row_digest"


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether something lies at ``path``, in any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class SavedLayers:
    """The first layer and, where there is one, the models of warning and failure types."""

    status: Classifier
    warning: Classifier | None = None
    failure: Classifier | None = None

    @classmethod
    def load(cls, spark: SparkSession, status: str, warning: str | None = None, failure: str | None = None) -> SavedLayers:
        """Models from their folders. A second layer that is not named, or not stored yet, is left out; the first must be there."""
        if not is_stored(spark, status):
            raise ValueError(f"no stored model at {status}")
        second = [Classifier.load(path, spark) if path and is_stored(spark, path) else None for path in (warning, failure)]
        return cls(Classifier.load(status, spark), *second)

    @property
    def needed(self) -> list[str]:
        """Feature columns that the layers read, each once."""
        return list(dict.fromkeys(f for m in (self.status, self.warning, self.failure) if m for f in m.layout.features))

    def score(self, table: DataFrame) -> DataFrame:
        """Feature rows with health status, its confidence and the type of a warning or failure; also on a stream."""
        return predict_hierarchy(table, self.status, self.warning, self.failure)


def score_files(
    spark: SparkSession,
    layers: SavedLayers,
    paths: list[str],
    condition: str = "unknown",
    window: str = "10min",
    frequency: str | None = "1min",
) -> DataFrame:
    """A verdict per run and window of run files: loaded, resampled, windowed, scored by every layer.

    ``condition`` keeps normal or abnormal rows only. The files' own labels are not looked at otherwise.
    """
    readings = filters.by_condition(load_runs(spark, paths, frequency=frequency), condition)
    table = features.extract_features(readings.drop(STATUS, WARNING_TYPE, FAILURE_TYPE), window)
    return layers.score(table).select(TIMESTAMP, RUN, *VERDICT)


def _run_name(path: Column) -> Column:
    """The file a reading comes from, or the folder whose part it comes from, without ``.csv``."""
    parts = F.split(path, "/")
    name, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    return F.regexp_replace(F.when(name.startswith("part-"), folder).otherwise(name), r"\.csv$", "")


def reading_stream(
    spark: SparkSession, folder: str, sensors: list[str], files_per_trigger: int = FILES_PER_TRIGGER, drop_incomplete: bool = True
) -> DataFrame:
    """CSV readings that arrive in a folder, as a stream with a run per file and parsed times.

    Columns are ``timestamp``, ``sensors`` and the status, in the order of the files' header, which must be the data model's.
    Rows with a missing value are left out as in a validated read, unless ``drop_incomplete`` is off.
    """
    known = {f.name: f for f in READING_SCHEMA}
    fields = [T.StructField(TIMESTAMP, T.StringType()), *[known.get(s, T.StructField(s, T.DoubleType())) for s in sensors], known[STATUS]]
    rows = replay(spark, folder, T.StructType(fields), "csv", files_per_trigger)
    named = filters.nan_to_null(rows.withColumn(RUN, _run_name(F.col("_metadata.file_path"))))
    named = named.withColumn(TIMESTAMP, parse_timestamp(F.col(TIMESTAMP)))
    return named.na.drop("any") if drop_incomplete else named


def stream_verdicts(readings: DataFrame, layers: SavedLayers, window: str = "10min", key: str | None = None) -> DataFrame:
    """Rows of a stream scored in fives per run, the verdict carried until the next five.

    Without a unique ``key`` rows of one time are ordered by a digest of their values; equal rows may stand for each other.
    """
    if key:
        return score_stream(readings, key, layers.score, window)
    keyed = readings.withColumn(_KEY, F.xxhash64(*readings.columns))
    return score_stream(keyed, _KEY, layers.score, window).drop(_KEY)


def run_stream(
    spark: SparkSession,
    layers: SavedLayers,
    folder: str,
    out: str,
    checkpoint: str,
    sensors: list[str],
    measurement: str = "sensor_measurements",
    once: bool = True,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> StreamingQuery:
    """The streaming job: validated CSV readings, scored in fives by the stored layers, written as tagged points.

    A run that stopped goes on from ``checkpoint``: what it has written is not written again, and the open five of a run
    is kept in its state.
    """
    rows = reading_stream(spark, folder, sensors, files_per_trigger)
    return write_points(stream_verdicts(rows, layers), measurement, out, checkpoint, once)
