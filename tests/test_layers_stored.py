"""Stored layers on files and streams, the command line, and boosting that stops by patience."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from plantpulse.__main__ import arguments, main
from plantpulse.columns import CSV_OPTIONS
from plantpulse.operators import batches, model, splits
from plantpulse.operators.features import extract_features
from plantpulse.plans import saved
from tests.conftest import same_rows

SENSORS = ["bearing_temp_c", "flow_rate_m3_h"]


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Two runs of 300 readings as CSV folders: warm readings warn, hot ones fail."""
    folder = str(tmp_path_factory.mktemp("runs"))
    x = F.col("id") % 100
    rows = spark.range(600).select(
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 60_000_000).alias("timestamp"),
        x.cast("double").alias("bearing_temp_c"),
        (F.col("id") % 7).cast("double").alias("flow_rate_m3_h"),
        F.when(x > 70, "Failure").when(x > 40, "Warning").otherwise("Normal").alias("health_status"),
        F.when(F.col("id") < 300, "normal_a.csv").otherwise("failure_1_cavitation.csv").alias("file"),
    )
    for name in ("normal_a.csv", "failure_1_cavitation.csv"):
        rows.where(F.col("file") == name).drop("file").coalesce(2).write.options(**CSV_OPTIONS).csv(f"{folder}/{name}")
    return folder


@pytest.fixture(scope="module")
def stored(spark, runs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    table = extract_features(saved.load_runs(spark, [f"{runs}/normal_a.csv", f"{runs}/failure_1_cavitation.csv"]), "10min")
    table = table.withColumn("warning_type", F.when(F.col("flow_rate_m3_h_min") > 0, "x").otherwise("y")).withColumn("failure_type", F.col("warning_type"))
    for target in ("health_status", "warning_type", "failure_type"):
        model.train(table, target, features=["bearing_temp_c_mean", "flow_rate_m3_h_min"], trees=5, depth=4).save(f"{folder}/{target}", spark)
    return folder


def test_absent_layers_are_left_out(spark, runs, stored):
    layers = saved.SavedLayers.load(spark, f"{stored}/health_status", f"{stored}/not-there")
    assert layers.warning is None and layers.failure is None
    assert layers.needed == ["bearing_temp_c_mean", "flow_rate_m3_h_min"]
    found = saved.score_files(spark, layers, [f"{runs}/normal_a.csv"])
    assert found.count() == 31 and found.where("warning_type is not null or failure_type is not null").isEmpty()
    with pytest.raises(ValueError):
        saved.SavedLayers.load(spark, f"{stored}/not-there")


def test_files_are_scored_like_their_features(spark, runs, stored):
    layers = saved.SavedLayers.load(spark, *(f"{stored}/{t}" for t in ("health_status", "warning_type", "failure_type")))
    paths = [f"{runs}/normal_a.csv", f"{runs}/failure_1_cavitation.csv"]
    found = saved.score_files(spark, layers, paths)
    assert found.columns == ["timestamp", "run_id", *saved.VERDICT]
    expected = layers.score(extract_features(saved.load_runs(spark, paths).drop("health_status"), "10min"))
    assert same_rows(found, expected.select(*found.columns))
    abnormal = saved.score_files(spark, layers, paths, "abnormal")
    assert 0 < abnormal.count() < found.count()


def test_command_line(spark, runs, stored, tmp_path):
    assert arguments(["layer.yaml", "boosted"]).command == "train" and arguments(["train", "x.yml"]).kind == "forest"
    with pytest.raises(SystemExit):
        arguments(["predict", "a.csv"])
    out = str(tmp_path / "verdicts")
    main(spark, ["predict", "--status", f"{stored}/health_status", "--out", out, f"{runs}/normal_a.csv"])
    written = spark.read.options(**CSV_OPTIONS).csv(out)
    assert written.count() == 31 and set(saved.VERDICT) < set(written.columns)


def test_streaming_job_goes_on_where_it_stopped(spark, runs, stored, tmp_path):
    """Files arrive in two goes; the open five of a run is kept between them, and no row is written twice."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = spark.read.options(**CSV_OPTIONS).schema("timestamp timestamp, bearing_temp_c double, flow_rate_m3_h double, health_status string").csv(f"{runs}/normal_a.csv")
    rows = rows.where("flow_rate_m3_h <> 3")
    given = ["stream", "--status", f"{stored}/health_status", "--warning", f"{stored}/warning_type", "--failure", f"{stored}/failure_type"]
    given += ["--out", out, "--checkpoint", progress, "--sensors", *SENSORS, "--", source]
    cut = F.col("timestamp") < F.timestamp_micros(F.lit(1_700_000_000_000_000 + 133 * 60_000_000))
    for now in (rows.where(cut), rows.where(~cut)):
        now.coalesce(1).write.mode("append").options(**CSV_OPTIONS).csv(f"{source}/run_a.csv")
        main(spark, [*given[:-1], f"{source}/run_a.csv"])
    points = spark.read.parquet(out)
    assert points.count() == rows.count() and points.select("batch").distinct().count() == 2
    layers = saved.SavedLayers.load(spark, *(f"{stored}/{t}" for t in ("health_status", "warning_type", "failure_type")))
    keyed = rows.withColumn("run_id", F.lit("run_a")).withColumn("key", F.unix_micros("timestamp"))
    expected = batches.score_and_carry(keyed, "key", layers.score).select("timestamp", "health_status", "fault_type")
    found = points.select(F.col("time").alias("timestamp"), F.col("tags")["health_status"].alias("health_status"), F.col("tags")["fault_type"].alias("fault_type"))
    assert same_rows(found, expected)


def test_run_names(spark):
    paths = ["file:/a/run_1.csv/part-0001.csv", "file:/a/run_2.csv", "s3://b/run_3.csv/part-7.csv"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select(saved._run_name(F.col("p")))
    assert [r[0] for r in found.collect()] == ["run_1", "run_2", "run_3"]


@pytest.mark.parametrize(
    "losses, patience, kept",
    [([3, 2, 1], 5, 3), ([3, 1, 2, 2, 0], 2, 2), ([3, 1, 2, 2, 0], 3, 5), ([1, 1, 1], 1, 1), ([2], 1, 1)],
)
def test_best_round(losses, patience, kept):
    assert model.best_round(losses, patience) == kept


def test_boosting_is_cut_by_patience(spark, tmp_path):
    x = F.col("id") % 20
    noise = F.pmod(F.hash("id"), F.lit(3)) == 0
    b = F.pmod(F.hash("id", F.lit(1)), F.lit(97)).cast("double").alias("b")  # tells nothing, so trees soon learn what does not last
    table = spark.range(600).select("id", x.cast("double").alias("a"), b, F.when(noise, "Warning").when(x < 10, "Normal").otherwise("Failure").alias("health_status"))
    split = splits.split_by_hash(table, "id", 0.3)
    fit = lambda **more: model.train(splits.part(split, "train"), features=["a", "b"], kind="boosted", depth=5, rate=0.8, validation=splits.part(split, "test"), **more)
    fitted = fit(trees=12, patience=2)
    assert len(set(fitted.rounds.values())) == 1 and len(fitted.history) == 3 * 12
    joint = fitted.history_table(spark).groupBy("round").agg(F.sum("loss").alias("loss")).orderBy("round").collect()
    assert next(iter(fitted.rounds.values())) == model.best_round([r["loss"] for r in joint], 2) < 12
    own = fit(trees=12, patience=2, metric="logloss")
    for c, rounds in own.rounds.items():
        assert rounds == model.best_round([loss for name, _, loss in own.history if name == c], 2)
    # The model is the sum of its kept trees, also when saved and loaded.
    stage = fitted.pipeline.stages[0]
    assert len(stage.trees) == len(stage.treeWeights) == fitted.rounds["Failure"] and stage.numFeatures == 2
    for v in (Vectors.dense(3.0, 50.0), Vectors.dense(12.0, 9.0)):
        margin = sum(w * t.predict(v) for t, w in zip(stage.trees, stage.treeWeights))
        assert stage.predictRaw(v)[1] == pytest.approx(margin)
    fitted.save(str(tmp_path / "m"), spark)
    loaded = model.Classifier.load(str(tmp_path / "m"), spark)
    assert loaded.rounds == fitted.rounds
    assert same_rows(loaded.predict(table), fitted.predict(table))
    for wrong in ({"metric": "merror"}, {"patience": 0}):
        with pytest.raises(ValueError):
            fit(trees=2, **wrong)


def test_layer_settings_reach_boosting(spark, tmp_path):
    from plantpulse.checks.learning import _layer_spec, _write_run_files
    from plantpulse.plans import layer
    from tests.conftest import TINY

    base = str(tmp_path)
    _write_run_files(spark, TINY, base)
    spec = _layer_spec(base, "health_status")
    settings = {"n_estimators": 4, "max_depth": 3, "early_stopping_rounds": 1, "eval_metric": "logloss"}
    spec = type(spec)(**{**spec.__dict__, "hyperparameters": settings, "validation_size": 0.25, "predictions_path": f"{base}/predictions"})
    fitted, _, report = layer.run_layer(spark, spec, "boosted")
    for c, rounds in fitted.rounds.items():
        assert rounds == model.best_round([loss for name, _, loss in fitted.history if name == c], 1)
    assert spark.read.json(f"{base}/metrics_health_status/rounds").count() == len(fitted.history) > 0
    support = report.where("class = 'accuracy'").first()["support"]
    assert spark.read.options(**CSV_OPTIONS).csv(f"{base}/predictions").count() == support


@pytest.mark.parametrize("absent", [False, True])
def test_stored_layers_train_on_long_windows(spark, tmp_path, absent):
    """So many readings in every window that the commonest status leads in all of them and all means lie above 50."""
    from plantpulse.checks import CHECKS

    kind = F.when(F.col("id") % 10 == 0, "error").when(F.col("id") % 10 == 1, "signup").otherwise("view")
    spark.range(20_000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 10_000_000).alias("ts"),
        (F.col("id") % 7).alias("user_id"), kind.alias("event_type"), (F.col("id") % 101 + 60.0).alias("value"), F.lit("").alias("props"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    found = CHECKS["score_saved_layers_partial" if absent else "score_saved_layers"].query(spark, str(tmp_path))
    assert found.count() > 100 and found.where("not known" if absent else "not (known and typed and sure)").isEmpty()
