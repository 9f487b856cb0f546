"""Models: training, prediction, the two-layer hierarchy and configured layers.

Trained trees have no SQL counterpart. Their queries return, for every test window, what must hold of a prediction whatever
the trees are; SQL redoes windows, majorities and split. The hierarchy and the confidence map are also checked in
SQL with rules in place of models, and the values of predictions by tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import CSV_OPTIONS, FAILURE, STATUSES, WARNING
from ..operators import batches, features, hierarchy, model, splits
from ..plans import layer, saved
from ..plans.spec import LayerSpec
from ..storage import new_folder, stage
from ..streaming import flows
from .base import DAY, HOUR, READINGS, READINGS_WIDE, RUN_FILES, WIDE_SENSORS, events, floor_sql, num, patchy, readings, readings_wide, registry, text
from .ordering import VALID_SQL, rule_models
from .partitions import quota_split_sql
from .streams import in_batches

CHECKS, check = registry()

_DAILY = f"""WITH {READINGS}, daily AS (
    SELECT {floor_sql('timestamp', DAY)} AS win, run_id, max(sensor_value) AS top, min(sensor_value) AS low
    FROM readings GROUP BY 1, 2)"""
_STATUS = "CASE WHEN top > 250 THEN 'Failure' WHEN top <= 150 THEN 'Normal' ELSE 'Warning' END"


def _daily(spark, folder):
    table = readings(spark, folder).select("run_id", "timestamp", "sensor_value")
    return features.extract_features(table, "1d", statistics=("min", "max"))


@check(
    "hier_predict",
    f"""WITH {READINGS}, hourly AS (
        SELECT {floor_sql('timestamp', 3_600_000_000)} AS win, run_id, max(sensor_value) AS top, min(sensor_value) AS low
        FROM readings GROUP BY 1, 2),
    scored AS (SELECT *, CASE WHEN top > 100 THEN 'Failure' WHEN top > 60 THEN 'Warning' ELSE 'Normal' END AS s FROM hourly)
    SELECT {text('win')} AS timestamp, run_id, s AS health_status,
           {num("CASE s WHEN 'Failure' THEN 0.8 WHEN 'Warning' THEN 0.7 ELSE 0.9 END")} AS health_confidence,
           CASE WHEN s = 'Warning' THEN CASE WHEN low > 50 THEN 'voltage_drop' ELSE 'power_increase' END END AS warning_type,
           CASE WHEN s = 'Failure' THEN CASE WHEN low > 50 THEN 'cavitation' ELSE 'bearing_fault' END END AS failure_type
    FROM scored""",
)
def hier_predict(spark, folder):
    table = readings(spark, folder).select("run_id", "timestamp", "sensor_value")
    hourly = features.extract_features(table, "1h", statistics=("min", "max"))
    scored = hierarchy.predict_hierarchy(hourly, *rule_models())
    return scored.select("timestamp", "run_id", "health_status", "health_confidence", "warning_type", "failure_type")


@check(
    "hier_predict_status_only",
    f"""WITH {READINGS}, hourly AS (
        SELECT {floor_sql('timestamp', 3_600_000_000)} AS win, run_id, max(sensor_value) AS top FROM readings GROUP BY 1, 2)
    SELECT {text('win')} AS timestamp, run_id,
           CASE WHEN top > 100 THEN 'Failure' WHEN top > 60 THEN 'Warning' ELSE 'Normal' END AS health_status,
           NULL AS warning_type, NULL AS failure_type
    FROM hourly""",
)
def hier_predict_status_only(spark, folder):
    table = readings(spark, folder).select("run_id", "timestamp", "sensor_value")
    hourly = features.extract_features(table, "1h", statistics=("min", "max"))
    scored = hierarchy.predict_hierarchy(hourly, rule_models()[0])
    return scored.select("timestamp", "run_id", "health_status", "warning_type", "failure_type")


@check(
    "confidence_map",
    f"""{_DAILY}, shares AS (SELECT *, top / (top + low + 100) AS a, low / (top + low + 100) AS b, 100 / (top + low + 100) AS c FROM daily)
    SELECT {text('win')} AS timestamp, run_id, unnest(['Normal', 'Warning', 'Failure']) AS class,
           unnest([{num('a')}, {num('b')}, {num('c')}]) AS probability, {num('greatest(a, b, c)')} AS confidence,
           CASE WHEN a >= b AND a >= c THEN 'Normal' WHEN b >= c THEN 'Warning' ELSE 'Failure' END AS predicted_status
    FROM shares""",
)
def confidence_map(spark, folder):
    top, low = F.col("sensor_value_max"), F.col("sensor_value_min")
    total = top + low + 100
    given = _daily(spark, folder).withColumn("probabilities", F.array(top / total, low / total, F.lit(100) / total))
    scored = model.confidence(given, STATUSES)
    spread = F.explode("probability_map").alias("class", "probability")
    return scored.select("timestamp", "run_id", spread, "confidence", "predicted_status")


def _training_table(spark, folder):
    """Split monthly features per supplier, written once before the split and once after it, because split and training read them often.

    With more strata than may be broadcast the split moves the rows; training would do so again in each of its passes.
    """
    table = features.extract_features(readings_wide(spark, folder), "30d", labels=STATUSES)
    key = F.concat_ws("@", F.col("run_id").cast("string"), F.unix_micros("timestamp").cast("string"))
    return stage(splits.split_by_run(stage(table.withColumn("row_key", key), "training"), "row_key"), "split")


# The windows of the training table with their majority status and row key, split in SQL as in Spark.
_WINDOWS = f"""{READINGS_WIDE},
    votes AS (SELECT {floor_sql('timestamp', 30 * DAY)} AS win, run_id, health_status,
                     row_number() OVER (PARTITION BY {floor_sql('timestamp', 30 * DAY)}, run_id ORDER BY count(*) DESC, health_status) AS place
              FROM readings_wide GROUP BY 1, 2, 3),
    windows AS (SELECT win, run_id, health_status, CAST(run_id AS VARCHAR) || '@' || CAST(epoch_us(win) AS VARCHAR) AS row_key
                FROM votes WHERE place = 1)"""
_TEST_WINDOWS = f"""WITH chosen AS ({quota_split_sql("windows", _WINDOWS, "run_id", "health_status", "row_key", ", win")}),
    test AS (SELECT {text('win')} AS timestamp, run_id, health_status FROM chosen WHERE split = 'test')"""
_FACTS_SQL = f"{_TEST_WINDOWS} SELECT timestamp, run_id, true AS known, true AS whole, true AS best"


def _facts(scored, classes):
    """Of a prediction ``label`` with probabilities ``p``: a known class, probabilities that make one, the likeliest class."""
    p, label = F.col("p"), F.col("label")
    own = F.element_at("p", F.array_position(F.array(*map(F.lit, classes)), label).cast("int"))
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    return scored.select(
        "timestamp", "run_id", label.isin(*STATUSES).alias("known"), (F.abs(total - 1) < 1e-9).alias("whole"),
        (own == F.array_max(p)).alias("best"), *[c for c in scored.columns if c == "reload_agrees"],
    )


@check("train_predict_forest", f"{_FACTS_SQL}, true AS reload_agrees FROM test")
def train_predict_forest(spark, folder):
    """Every test window scored by a forest and by the same forest saved and reloaded."""
    table = _training_table(spark, folder)
    fitted = model.train(splits.part(table, "train"), kind="forest", trees=10, depth=5)
    path = new_folder(spark, "model")
    fitted.save(path, spark)
    loaded = model.Classifier.load(path, spark)
    both = loaded.predict(fitted.predict(splits.part(table, "test"), "label", "p"), "again", "q")
    agree = (F.col("label") == F.col("again")) & (F.col("p") == F.col("q"))
    return _facts(both.withColumn("reload_agrees", agree), fitted.classes)


@check("train_predict_boosted", f"{_FACTS_SQL} FROM test")
def train_predict_boosted(spark, folder):
    """Boosted trees that stop early on a validation part."""
    table = _training_table(spark, folder)
    rows = stage(splits.split_by_run(splits.part(table, "train"), "row_key", 0.25), "validation")
    fitted = model.train(
        splits.part(rows, "train"), kind="boosted", trees=5, depth=3, rate=0.3, validation=splits.part(rows, "test")
    )
    return _facts(fitted.predict(splits.part(table, "test"), "label", "p"), fitted.classes)


_EARLY_SQL = f"""WITH chosen AS ({quota_split_sql("windows", _WINDOWS, "run_id", "health_status", "row_key", ", win")}),
    train AS (SELECT run_id FROM chosen WHERE split = 'train'),
    runs AS (SELECT run_id, row_number() OVER (ORDER BY run_id DESC) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT run_id FROM train)),
    held AS (SELECT count(*) AS n FROM train JOIN runs USING (run_id) WHERE place <= greatest(1, CAST(floor(runs.n * 0.2) AS BIGINT)))
    SELECT unnest(['Failure', 'Normal', 'Warning']) AS class, n AS validation_rows, true AS cut, true AS least, true AS together FROM held"""


@check("boosted_early_stopping", _EARLY_SQL)
def boosted_early_stopping(spark, folder):
    """Boosting cut by patience on whole held-out runs: per class, what must hold of the rounds whatever the trees are.

    The kept rounds are those of the least joint loss before patience ended, and the same for every class.
    """
    table = splits.part(_training_table(spark, folder), "train")
    rows = splits.split_whole_runs(table)
    held, trees, patience = stage(splits.part(rows, "test"), "held"), 8, 3
    fitted = model.train(splits.part(rows, "train"), kind="boosted", trees=trees, depth=3, rate=0.5, validation=held, patience=patience)
    # The rounds are a property of the model: a few numbers per class.
    joint = {}
    for _, number, loss in fitted.history:
        joint[number] = joint.get(number, 0.0) + loss
    facts = []
    for c, rounds in fitted.rounds.items():
        before = [loss for number, loss in joint.items() if number < rounds]
        after = [loss for number, loss in joint.items() if rounds < number <= rounds + patience]
        least = joint[rounds] < min(before, default=joint[rounds] + 1) and joint[rounds] <= min(after, default=joint[rounds])
        own = {number for name, number, _ in fitted.history if name == c}
        facts.append((c, 1 <= rounds <= trees and own == set(range(1, trees + 1)), least, len(set(fitted.rounds.values())) == 1))
    rows = F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("class", "cut", "least", "together"), f)]) for f in facts]))
    return held.agg(F.count("*").alias("validation_rows")).select("validation_rows", rows)


@check(
    "train_evaluate",
    f"""{_TEST_WINDOWS}
    SELECT health_status AS class, count(*) AS support, true AS in_range FROM test GROUP BY 1
    UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), count(*), true FROM test""",
)
def train_evaluate(spark, folder):
    """Supports of a trained model's per-class report on the test part; every score lies between 0 and 1."""
    table = _training_table(spark, folder)
    fitted = model.train(splits.part(table, "train"), trees=10, depth=5, class_weights=[1, 28, 62], classes=STATUSES)
    report = model.evaluate_classifier(fitted, splits.part(table, "test"))[1]
    in_range = F.least("precision", "recall", "f1_score").between(0, 1) & F.greatest("precision", "recall", "f1_score").between(0, 1)
    # A class that is only ever predicted has no support, and the trees decide whether there is one.
    return report.where("support > 0").select("class", "support", in_range.alias("in_range"))


@check("hier_predict_trained", f"{_TEST_WINDOWS} SELECT timestamp, run_id, true AS known, true AS typed, true AS sure FROM test")
def hier_predict_trained(spark, folder):
    """Three trained layers, each scoring its own rows: a type is given exactly where the status asks for one."""
    table = _training_table(spark, folder)
    kind = F.when(F.col("l_quantity_mean") > 25, "power_increase").otherwise("voltage_drop")
    fault = F.when(F.col("l_tax_mean") > 0.04, "cavitation").otherwise("bearing_fault")
    table = table.withColumn("warning_type", kind).withColumn("failure_type", fault)
    train = splits.part(table, "train")
    names = [f"{s}_{m}" for m in ("mean", "std", "max") for s in WIDE_SENSORS]
    settings = {"features": names, "trees": 5, "depth": 4}
    status = model.train(train, **settings)
    warning = model.train(train.where(F.col("health_status") == WARNING), "warning_type", **settings)
    failure = model.train(train.where(F.col("health_status") == FAILURE), "failure_type", **settings)
    scored = hierarchy.predict_hierarchy(splits.part(table, "test"), status, warning, failure, route=True)
    warned, failed = (F.col("health_status") == s for s in (WARNING, FAILURE))
    typed = (F.col("warning_type").isNotNull() == warned) & (F.col("failure_type").isNotNull() == failed)
    sure = F.col("health_confidence").between(1 / 3 - 1e-9, 1)
    return scored.select("timestamp", "run_id", F.col("health_status").isin(*STATUSES).alias("known"), typed.alias("typed"), sure.alias("sure"))


def _layer_spec(base: str, target: str, condition=None, kinds=("normal", "failure", "warning")) -> LayerSpec:
    files = {kind: [f"file={n}" for n in RUN_FILES if n.startswith(kind)] for kind in ("normal", "failure", "warning")}
    return LayerSpec.from_mapping({"model": {
        "name": f"layer_{target}", "hyperparameters": {"n_estimators": 3, "max_depth": 4, "random_state": 42},
        "target": {"column": target, "classes": list(STATUSES), "type": "multiclass"}, "data_filter": condition,
        "features": {"window_size": "12H", "extract_features": True, "feature_types": ["time_domain"]},
        "dataset": {
            "datasets_dir": f"{base}/files", "output_dir": f"{base}/out", "use_timeseries_split": False,
            "use_stratification": target != "health_status", "test_size": 0.2, "validation_size": None, "random_state": 42,
            "resample_freq": "1min", "resample_method": "mean", "add_hierarchical_labels": True,
            **{f"{kind}_files": files[kind] if kind in kinds else None for kind in files},
        },
        "output": {"model_path": f"{base}/model_{target}", "metrics_path": f"{base}/metrics_{target}", "predictions_path": None},
    }})


def _write_run_files(spark, folder, base: str) -> None:
    """All events as 25 runs, each a folder of CSV parts named after its run file."""
    name = F.element_at(F.array(*map(F.lit, RUN_FILES)), (F.col("event_id") % len(RUN_FILES) + 1).cast("int"))
    kind = F.col("event_type")
    table = events(spark, folder).select(
        F.col("ts").alias("timestamp"),
        F.col("value").alias("bearing_temp_c"),
        F.sqrt("value").alias("flow_rate_m3_h"),
        F.when(kind == "error", "Failur").when(kind == "signup", "Warnin").otherwise("Normal").alias("health_status"),
        name.alias("file"),
    )
    table.write.options(**CSV_OPTIONS).partitionBy("file").csv(f"{base}/files")


@check("run_layer_status")
def run_layer_status(spark, folder):
    """The whole first layer: files, resampling, features, split, training, metrics."""
    base = new_folder(spark, "layer")
    _write_run_files(spark, folder, base)
    return layer.run_layer(spark, _layer_spec(base, "health_status"))[2]


@check("run_layer_failure_type")
def run_layer_failure_type(spark, folder):
    """A second layer: only failures, the target read off the file names."""
    base = new_folder(spark, "layer")
    _write_run_files(spark, folder, base)
    condition = {"column": "health_status", "operator": "==", "value": "Failure"}
    return layer.run_layer(spark, _layer_spec(base, "failure_type", condition, ("failure",)))[2]


def _stored_layers(spark, table, status, low: str, high: str) -> list[str]:
    """Three small layers trained on a feature table, each saved: the status, and types by a rule on a feature."""
    names = features.sensor_columns(table, "timestamp", status, ("run_id", "batch"))
    kinds = {"warning_type": ("power_increase", "voltage_drop"), "failure_type": ("cavitation", "bearing_fault")}
    table = table.withColumns({c: F.when(F.col(low) > F.lit(high), a).otherwise(b) for c, (a, b) in kinds.items()})
    paths = []
    for target in (status, *kinds):
        paths.append(new_folder(spark, f"layer-{target}"))
        model.train(table, target, features=names, trees=4, depth=4).save(paths[-1], spark)
    return paths


def _status_runs(table):
    """Feature windows to train on, one run per status as in the plant's files: mixed runs have one majority, the commonest status, in all long windows."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("health_status"))
    own = table.withColumn("run_id", F.col("run_id") * len(STATUSES) + place)
    return features.extract_features(own, "12H", labels=STATUSES)


def _scored_runs(spark, folder, absent: bool):
    """Every run file windowed and scored by layers that were stored before; with ``absent``, one was never stored."""
    base = new_folder(spark, "runs")
    _write_run_files(spark, folder, base)
    paths = [f"{base}/files/file={name}" for name in RUN_FILES]
    given = readings(spark, folder).select("run_id", "timestamp", F.col("sensor_value").alias("bearing_temp_c"), F.sqrt("sensor_value").alias("flow_rate_m3_h"), "health_status")
    table = stage(_status_runs(given), "features")
    # Types on either side of the mean: both occur, however close to each other the windows are.
    middle = table.agg(F.avg("bearing_temp_c_mean")).first()[0]
    stored = _stored_layers(spark, table, "health_status", "bearing_temp_c_mean", middle)
    layers = saved.SavedLayers.load(spark, *stored[:2], f"{base}/never-stored" if absent else stored[2])
    return saved.score_files(spark, layers, paths, window="12H")


_RUN_WINDOWS = f"SELECT DISTINCT {text(floor_sql('ts', 12 * HOUR))} AS timestamp, event_id % {len(RUN_FILES)} + 1 AS run_id FROM events"


@check("score_saved_layers", f"SELECT timestamp, run_id, true AS known, true AS typed, true AS sure FROM ({_RUN_WINDOWS})")
def score_saved_layers(spark, folder):
    """Verdicts of all run files by three stored layers: a type is given exactly where the status asks for one."""
    scored = _scored_runs(spark, folder, absent=False)
    status = F.col("health_status")
    typed = (F.col("warning_type").isNotNull() == (status == WARNING)) & (F.col("failure_type").isNotNull() == (status == FAILURE))
    return scored.select("timestamp", "run_id", status.isin(*STATUSES).alias("known"), typed.alias("typed"), F.col("health_confidence").between(1 / 3 - 1e-9, 1).alias("sure"))


@check("score_saved_layers_partial", f"SELECT timestamp, run_id, true AS known, NULL AS failure_type FROM ({_RUN_WINDOWS})")
def score_saved_layers_partial(spark, folder):
    """The same with the failure layer absent: its type is null everywhere, the rest is scored."""
    scored = _scored_runs(spark, folder, absent=True)
    warned = F.col("warning_type").isNotNull() == (F.col("health_status") == WARNING)
    return scored.select("timestamp", "run_id", (F.col("health_status").isin(*STATUSES) & warned).alias("known"), "failure_type")


@check("stream_saved_layers", f"{VALID_SQL} SELECT event_id, run_id, ruling_batch IS NULL AS waiting, true AS agrees FROM batched")
def stream_saved_layers(spark, folder):
    """A stream scored in fives by stored layers: rows before the first five wait, the others agree with the batch form."""
    given = patchy(spark, folder)
    batched = stage(batches.with_batches(given, "event_id"), "batches")
    table = stage(batches.batch_features(batched, exclude=("event_id",)), "features")
    rule = F.when(F.col("sensor_value_max") > 100, "Failure").when(F.col("sensor_value_max") > 60, "Warning").otherwise("Normal")
    layers = saved.SavedLayers.load(spark, *_stored_layers(spark, table.withColumn("health_status", rule), "health_status", "sensor_value_min", 50.0))
    out, progress = (new_folder(spark, label) for label in ("stream", "progress"))
    query = flows.write_batches(saved.stream_verdicts(in_batches(spark, given, "timestamp"), layers, key="event_id"), out, progress)
    query.awaitTermination()
    live = spark.read.parquet(out).select("event_id", "run_id", "health_status", "fault_type")
    expected = batches.with_carried_status(batched, layers.score(table)).select("event_id", F.col("health_status").alias("_s"), F.col("fault_type").alias("_f"))
    rulings = batched.select("event_id", F.col("ruling_batch").isNull().alias("waiting"))
    agrees = F.col("health_status").eqNullSafe(F.col("_s")) & F.col("fault_type").eqNullSafe(F.col("_f"))
    return live.join(expected, "event_id").join(rulings, "event_id").select("event_id", "run_id", "waiting", agrees.alias("agrees"))
