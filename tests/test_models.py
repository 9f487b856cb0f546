"""Models, the hierarchy and configured layers."""

import datetime as dt

import pytest
import yaml
from pyspark.sql import functions as F

from plantpulse.checks.learning import _layer_spec, _write_run_files
from plantpulse.operators import hierarchy, model, splits
from plantpulse.operators.features import extract_features
from plantpulse.operators.ordering import fill_window
from plantpulse.plans import layer
from plantpulse.plans.spec import LayerSpec
from plantpulse.sources.records import sample_readings
from tests.conftest import TINY, same_rows


@pytest.fixture(scope="module")
def table(spark):
    """Three classes that the features tell apart, one of them rare, some features null."""
    x = F.col("id") % 20
    label = F.when(x < 14, "Normal").when(x < 19, "Warning").otherwise("Failure")
    noise = F.pmod(F.hash("id"), F.lit(100)) / 400
    return spark.range(400).select(
        "id", (F.col("id") % 4).alias("run_id"), (x.cast("double") + noise).alias("a"),
        F.when(F.col("id") % 3 > 0, noise).alias("b"), label.alias("health_status"),
    ).cache()


@pytest.fixture(scope="module")
def forest(table):
    return model.train(table, features=["a", "b"], trees=8, depth=4)


def accuracy(fitted, table):
    return model.evaluate_classifier(fitted, table)[0].first()["accuracy"]


def test_forest_learns_and_survives_saving(spark, table, forest, tmp_path):
    assert accuracy(forest, table) > 0.97 and forest.classes == ["Failure", "Normal", "Warning"]
    forest.save(str(tmp_path / "m"), spark)
    loaded = model.Classifier.load(str(tmp_path / "m"), spark)
    assert same_rows(forest.predict_table(table, ["id"]), loaded.predict_table(table, ["id"]))


def test_probabilities(table, forest):
    scored = forest.predict_table(table, ["id"])
    assert scored.columns == ["id", "predicted_health_status", "prob_Failure", "prob_Normal", "prob_Warning"]
    total = F.col("prob_Failure") + F.col("prob_Normal") + F.col("prob_Warning")
    assert scored.where(F.abs(total - 1) > 1e-9).count() == 0
    top = model.confidence(forest.predict(table), forest.classes).first()
    assert top["confidence"] == max(top["probability_map"].values())


def test_boosted_learns_and_stops_early(table):
    settings = {"kind": "boosted", "trees": 12, "depth": 3, "rate": 0.5}
    assert accuracy(model.train(table, features=["a"], **settings), table) > 0.97
    noisy = table.withColumn("health_status", F.when(F.hash("id", "a") % 2 == 0, "Normal").otherwise("Warning"))
    split = splits.split_stratified(noisy, "id", 0.25)
    fitted = model.train(splits.part(split, "train"), features=["a"], validation=splits.part(split, "test"), **settings)
    assert min(stage.getNumTrees for stage in fitted.pipeline.stages) < 12


def test_training_errors(table):
    with pytest.raises(ValueError):
        model.train(table.where("health_status = 'Normal'"), features=["a"])
    with pytest.raises(ValueError):
        model.train(table, features=["a"], kind="neural")


def test_prediction_needs_all_features(table, forest):
    with pytest.raises(ValueError):
        forest.predict(table.drop("b"))


def test_hierarchy_routes_rows(table, forest):
    typed = table.withColumn("warning_type", F.when(F.col("a") > 16, "x").otherwise("y"))
    warning = model.train(typed, "warning_type", features=["a"], trees=3, depth=3)
    plain = hierarchy.predict_hierarchy(table, forest, warning)
    assert same_rows(plain, hierarchy.predict_hierarchy(table, forest, warning, route=True))
    assert plain.where("(health_status = 'Warning') != (warning_type is not null)").count() == 0
    assert plain.where("failure_type is not null").count() == 0


@pytest.mark.parametrize("by_time, stratified", [(False, False), (False, True), (True, False), (True, True)])
def test_layer_split_choices(spark, by_time, stratified):
    spec = LayerSpec("n", "health_status", (), (), (), "o", "m", "p", by_time=by_time, stratified=stratified)
    rows = sample_readings(spark, 300).withColumn("run_id", F.lit(1)).withColumn("row_key", F.monotonically_increasing_id())
    rows = rows.withColumn("health_status", F.when(F.minute("timestamp") == 0, "Warning").otherwise("Normal"))
    split = layer.split_features(rows, spec)
    test = split.where("split = 'test'").count()
    assert split.count() == 300 and 60 <= test <= 70


def test_layer_from_yaml(spark, tmp_path):
    """A first layer over files, then scoring of files with its saved model."""
    base = str(tmp_path)
    _write_run_files(spark, TINY, base)
    spec = _layer_spec(base, "health_status")
    text = {"model": {
        "name": "l1", "type": "boosted", "task": "classification", "description": "", "data_filter": None,
        "hyperparameters": {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.1, "random_state": 1, "scale_pos_weight": [1, 28, 62]},
        "target": {"column": "health_status", "classes": ["Normal", "Warning", "Failure"], "type": "multiclass"},
        "features": {"window_size": "1D", "extract_features": True, "feature_types": ["time_domain"]},
        "dataset": {
            "datasets_dir": f"{base}/files", "output_dir": f"{base}/out", "use_timeseries_split": False, "use_stratification": False,
            "test_size": 0.2, "validation_size": None, "random_state": 42, "resample_freq": "1min", "resample_method": "mean",
            "normal_files": [p.split("/")[-1] for p in spec.normal_paths], "warning_files": None,
            "failure_files": [p.split("/")[-1] for p in spec.abnormal_paths],
        },
        "output": {"model_path": f"{base}/m", "metrics_path": f"{base}/metrics", "predictions_path": f"{base}/p"},
    }}
    (tmp_path / "l1.yaml").write_text(yaml.safe_dump(text))
    read = LayerSpec.from_yaml(str(tmp_path / "l1.yaml"))
    assert read.normal_paths == spec.normal_paths and read.abnormal_paths == spec.abnormal_paths and read.labels
    _, metrics, report = layer.run_layer(spark, read)
    assert 0 <= metrics.first()["accuracy"] <= 1 and report.where("class = 'weighted avg'").count() == 1
    assert spark.read.json(f"{base}/metrics/report").count() == report.count()
    exported = spark.read.parquet(f"{base}/out/l1")
    assert {"train", "test"} == {r[0] for r in exported.select("split").distinct().collect()}
    loaded = model.Classifier.load(f"{base}/m", spark)
    scored = layer.predict_files(spark, loaded, list(read.abnormal_paths[:2]), "abnormal", "1D")
    assert scored.count() > 0 and "prob_Normal" in scored.columns


# Hand-written readings with fixed values.
CUSTOM_READING = {
    "accelerometer_g": 0.35, "vibration_velocity_mm_s": 3.8, "shaft_displacement_um": 42.5, "bearing_temp_c": 68.2,
    "oil_temp_c": 57.1, "casing_temp_c": 62.8, "inlet_fluid_temp_c": 46.5, "outlet_fluid_temp_c": 56.3,
    "inlet_pressure_bar": 2.7, "outlet_pressure_bar": 6.8, "flow_rate_m3_h": 92.1, "motor_current_a": 41.5,
    "supply_voltage_v": 402.3, "power_consumption_kw": 20.8, "sound_intensity_db": 77.2,
}


@pytest.fixture(scope="module")
def sensor_model(spark):
    """A model on all 120 features of generated readings; hot bearings are warnings."""
    rows = sample_readings(spark, 400)
    labelled = rows.withColumn("health_status", F.when(F.col("bearing_temp_c") > 66, "Warning").otherwise("Normal"))
    return model.train(extract_features(labelled), trees=10, depth=4)


def test_single_reading(spark, sensor_model):
    row = layer.predict_record(spark, sensor_model, CUSTOM_READING, "2024-01-01 00:03:00").first()
    assert row["predicted_status"] == "Warning" and row["timestamp"] == dt.datetime(2024, 1, 1)
    assert row["confidence"] == row["probability_map"]["Warning"] > 0.5


def test_predictions_next_to_a_file(spark, sensor_model, tmp_path):
    sample_readings(spark, 50).coalesce(1).write.option("header", True).csv(str(tmp_path / "plant.csv"))
    path = layer.predict_and_write(spark, sensor_model, str(tmp_path / "plant.csv"))
    assert path.endswith("plant_predictions.csv") and spark.read.option("header", True).csv(path).count() == 50


def test_short_list_of_readings_fills_a_window(spark, sensor_model):
    """Three readings are repeated to ten before features are taken."""
    rows = sample_readings(spark, 3).withColumn("run_id", F.lit(1)).withColumn("k", F.unix_micros("timestamp"))
    filled = fill_window(rows, ["run_id"], ["k"], 10)
    assert filled.count() == 10
    timed = filled.withColumn("timestamp", F.timestamp_seconds(F.col("position") * 600)).drop("k", "position", "run_id")
    assert layer.predict_readings(sensor_model, timed).count() == 10
