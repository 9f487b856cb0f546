"""The training job of one layer and scoring with its model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import CSV_OPTIONS, FAILURE_TYPE, RUN, STATUS, TIMESTAMP, WARNING_TYPE
from ..operators import features as feature_ops
from ..operators import filters, model, quality, splits
from ..operators.ordering import seeded_shuffle
from ..sinks.tables import export_split, write_metrics, write_predictions
from ..sources.readings import load_runs, read_csv, union_by_name
from ..sources.records import readings_from_records
from ..storage import stage
from .spec import LayerSpec

KEY = "row_key"


def load_readings(spark: SparkSession, spec: LayerSpec) -> DataFrame:
    """Normal rows of the normal runs and the other rows of the abnormal runs, resampled.

    The status filter comes after resampling: a bucket's status is its first one.
    """
    tables = []
    if spec.normal_paths:
        runs = load_runs(spark, spec.normal_paths, 1, spec.labels, spec.frequency, spec.method)
        tables.append(filters.only_normal(runs))
    if spec.abnormal_paths:
        start = len(spec.normal_paths) + 1
        runs = load_runs(spark, spec.abnormal_paths, start, spec.labels, spec.frequency, spec.method)
        tables.append(filters.exclude_normal(runs))
    if not tables:
        raise ValueError(f"layer {spec.name} lists no files")
    return union_by_name(tables)


def make_features(readings: DataFrame, spec: LayerSpec) -> DataFrame:
    """Feature table under the layer's filter, with a unique row key.

    A window's labels are majorities, so a layer on warning or failure types also keeps the window's
    own health status.
    """
    if spec.extract:
        labels = (STATUS, WARNING_TYPE, FAILURE_TYPE)
        carry = [c for c in labels if c in readings.columns and c != spec.target]
        table = feature_ops.extract_features(
            readings, spec.window, spec.time, spec.target, (*spec.exclude, *labels), carry=carry
        )
    else:
        table = readings
    if spec.condition:
        table = filters.configured_filter(table, spec.condition.column, spec.condition.operator, spec.condition.value)
    key = F.concat_ws("@", F.col(RUN).cast("string"), F.unix_micros(spec.time).cast("string"))
    return table.where(F.col(spec.target).isNotNull()).withColumn(KEY, key)


def split_features(table: DataFrame, spec: LayerSpec, test_size: float | None = None) -> DataFrame:
    """By run by default; stratified on the target, chronological, or both, where the layer says so."""
    size = test_size or spec.test_size
    if spec.by_time and spec.stratified:
        return splits.split_stratified_time(table, size, time=spec.time, stratum=spec.target)
    if spec.by_time:
        # One row per run and window start, so the run decides between equal times.
        return splits.split_chronological(table, RUN, size, spec.time)
    if spec.stratified:
        return splits.split_stratified(table, KEY, size, spec.seed, spec.target)
    return splits.split_by_run(table, KEY, size, spec.seed)


def preprocess(spark: SparkSession, spec: LayerSpec) -> tuple[DataFrame, DataFrame]:
    """(split feature table, validation report). The features are written once and then read."""
    readings = stage(load_readings(spark, spec), "readings")
    report = quality.validation_report(readings, [RUN, spec.time], spec.time)
    table = stage(make_features(readings, spec), "features")
    split = split_features(table, spec)
    return seeded_shuffle(split, KEY, spec.seed), report


def train_layer(split: DataFrame, spec: LayerSpec, kind: str = "forest") -> model.Classifier:
    """Fit on the training part with the layer's hyperparameters.

    Explicit class weights are used when given as a map or as one number per class; otherwise the
    classes are balanced. A validation share of the training part allows early stopping.
    """
    given = spec.hyperparameters
    rows = splits.part(split, splits.TRAIN)
    validation = None
    if spec.validation_size and kind == "boosted":
        # Written once: training reads it in several passes.
        held = stage(split_features(rows, spec, spec.validation_size), "validation")
        rows, validation = splits.part(held, splits.TRAIN), splits.part(held, splits.TEST)
    return model.train(
        rows,
        spec.target,
        kind=kind,
        trees=given.get("n_estimators", 500),
        depth=given.get("max_depth", 6),
        rate=given.get("learning_rate", 0.1),
        seed=given.get("random_state", 42),
        class_weights=given.get("scale_pos_weight"),
        classes=spec.classes,
        validation=validation,
        patience=given.get("early_stopping_rounds") if validation is not None else None,
        metric=given.get("eval_metric") or model.JOINT_LOSS,
    )


def run_layer(spark: SparkSession, spec: LayerSpec, kind: str = "forest") -> tuple[model.Classifier, DataFrame, DataFrame]:
    """Preprocess, export, train, evaluate and save a layer: (model, metrics, report).

    The validation losses of boosting lie beside the metrics; where the layer names a place for predictions, those of its
    test part are written there.
    """
    split, quality_report = preprocess(spark, spec)
    quality_report.write.mode("overwrite").json(f"{spec.metrics_path}/validation")
    folder = f"{spec.output_dir}/{spec.name}"
    export_split(split, folder)
    exported = spark.read.parquet(folder)
    fitted = train_layer(exported, spec, kind)
    fitted.save(spec.model_path, spark)
    test = splits.part(exported, splits.TEST)
    metrics, report = model.evaluate_classifier(fitted, test, spec.target)
    write_metrics(metrics, report, spec.metrics_path)
    if fitted.history:
        fitted.history_table(spark).write.mode("overwrite").json(f"{spec.metrics_path}/rounds")
    if spec.predictions_path:
        predicted = fitted.predict_table(test, [RUN, spec.time])
        predicted.write.mode("overwrite").options(**CSV_OPTIONS).csv(spec.predictions_path)
    return fitted, metrics, report


def predict_readings(fitted: model.Classifier, readings: DataFrame, window: str = "10min", exclude=(RUN,)) -> DataFrame:
    """Features of raw readings, then predictions with probabilities per window."""
    table = feature_ops.extract_features(readings.drop(STATUS), window, exclude=exclude)
    return fitted.predict_table(table, [TIMESTAMP, *([RUN] if RUN in table.columns else [])])


def predict_files(
    spark: SparkSession, fitted: model.Classifier, paths: list[str], condition: str = "unknown", window: str = "10min"
) -> DataFrame:
    """Load and resample files, keep normal or abnormal rows if asked, and predict."""
    readings = load_runs(spark, paths, frequency="1min")
    return predict_readings(fitted, filters.by_condition(readings, condition), window)


def predict_record(spark: SparkSession, fitted: model.Classifier, record: dict, timestamp=None, window: str = "10min") -> DataFrame:
    """One hand-written reading: predicted status, probability per class, confidence and time."""
    reading = readings_from_records(spark, record, timestamp)
    table = feature_ops.extract_features(reading, window)
    scored = model.confidence(fitted.predict(table), fitted.classes)
    return scored.select("predicted_status", "probability_map", "confidence", TIMESTAMP)


def predict_and_write(spark: SparkSession, fitted: model.Classifier, path: str, window: str = "10min") -> str:
    """Predictions for a CSV of readings, written next to it; returns where."""
    return write_predictions(predict_readings(fitted, read_csv(spark, path), window), path)
