"""Table sinks. Errors are raised, never swallowed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..columns import CSV_OPTIONS, HEADER_TRANSLATION
from ..operators.filters import translate_columns
from ..operators.splits import SPLIT, TEST, TRAIN, part


def export_split(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Write a split table: parquet partitioned by split, or ``train.csv`` and ``test.csv`` folders."""
    if kind == "parquet":
        df.write.mode("overwrite").partitionBy(SPLIT).parquet(folder)
    elif kind == "csv":
        for which in (TRAIN, TEST):
            part(df, which).write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{folder}/{which}.csv")
    else:
        raise ValueError(f"unknown table format: {kind}")


def predictions_path(source: str) -> str:
    return f"{source.removesuffix('.csv')}_predictions.csv"


def write_predictions(df: DataFrame, source: str) -> str:
    """Write predictions next to the file they were made from; returns the folder."""
    path = predictions_path(source)
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def write_metrics(metrics: DataFrame, report: DataFrame, path: str) -> None:
    """The overall metrics and the per-class report as JSON rows."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    report.write.mode("overwrite").json(f"{path}/report")


def translate_files(
    spark: SparkSession,
    source: str,
    target: str,
    names: Mapping[str, str],
    columns: Mapping[str, str] = HEADER_TRANSLATION,
) -> None:
    """Rewrite each CSV ``source/<old name>`` as ``target/<new name>`` with translated headers."""
    for old, new in names.items():
        df = spark.read.options(**CSV_OPTIONS).csv(f"{source}/{old}")
        translate_columns(df, dict(columns)).write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{target}/{new}")
