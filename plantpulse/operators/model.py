"""Tree classifiers on ``pyspark.ml``: train, predict with probabilities, save and load.

``forest`` is a multiclass random forest. ``boosted`` is one gradient-boosted model per class, each
a plain pipeline stage, so both kinds also score a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import STATUS, require_columns
from ..storage import stage
from . import evaluate, filters, weights

_VECTOR, _CODE, _HELD, _IS = "_vector", "_code", "_held", "_is"
# Measures that stop boosting: over all classes together, with one number of rounds, or each class by itself.
JOINT_LOSS, OWN_LOSS = "mlogloss", "logloss"
# Classes that are boosted at the same time.
_SIDE_BY_SIDE = 4


@dataclass(frozen=True)
class Layout:
    """What a stored model knows: its feature order, its classes (alphabetical) and its kind."""

    kind: str
    features: list[str]
    classes: list[str]


def _vector(features: Sequence[str]) -> Column:
    """Short windows have no skewness or kurtosis; trees take no null, so those count as zero."""
    return array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))


def _argmax_label(probabilities: Column, classes: Sequence[str]) -> Column:
    place = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*map(F.lit, classes)), place)


class Classifier:
    """A fitted model. ``history`` has (class, round, validation loss) of boosting that stopped by patience."""

    def __init__(self, pipeline: PipelineModel, layout: Layout, history: Sequence[tuple[str, int, float]] = ()):
        self.pipeline, self.layout, self.history = pipeline, layout, list(history)

    @property
    def classes(self) -> list[str]:
        return self.layout.classes

    @property
    def rounds(self) -> dict[str, int]:
        """Boosting rounds kept per class; empty for a forest."""
        return {} if self.layout.kind == "forest" else {c: s.getNumTrees for c, s in zip(self.classes, self.pipeline.stages)}

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "class string, round int, loss double")

    def _probabilities(self) -> Column:
        if self.layout.kind == "forest":
            return vector_to_array(F.col("_probability"))
        chances = F.array(*[vector_to_array(F.col(f"_chance_{i}"))[1] for i in range(len(self.classes))])
        total = F.aggregate(chances, F.lit(0.0), lambda acc, x: acc + x)
        return F.transform(chances, lambda x: x / total)

    def predict(self, df: DataFrame, label: str = "prediction", probabilities: str = "probabilities") -> DataFrame:
        """The rows with the predicted class and the class probabilities as an array in class order."""
        require_columns(df, *self.layout.features)
        scored = self.pipeline.transform(df.withColumn(_VECTOR, _vector(self.layout.features)))
        named = scored.withColumn(probabilities, self._probabilities())
        return named.select(
            *df.columns, _argmax_label(F.col(probabilities), self.classes).alias(label), probabilities
        )

    def predict_table(self, df: DataFrame, keys: Sequence[str] = ("timestamp",)) -> DataFrame:
        """Keys, ``predicted_health_status`` and one ``prob_<class>`` column per class."""
        scored = self.predict(df, "_label", "_p")
        columns = [F.col("_p")[i].alias(f"prob_{c}") for i, c in enumerate(self.classes)]
        return scored.select(*keys, F.col("_label").alias("predicted_health_status"), *columns)

    def save(self, path: str, spark: SparkSession) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        layout = spark.createDataFrame([asdict(self.layout)], "kind string, features array<string>, classes array<string>")
        layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Classifier:
        row = spark.read.schema("kind string, features array<string>, classes array<string>").json(f"{path}/layout").first()
        return cls(PipelineModel.load(f"{path}/pipeline"), Layout(**row.asDict()))


def confidence(df: DataFrame, classes: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """Add ``predicted_status``, the class-to-probability map and the highest probability."""
    p = F.col(probabilities)
    return df.select(
        *[c for c in df.columns if c != probabilities],
        _argmax_label(p, classes).alias("predicted_status"),
        F.map_from_arrays(F.array(*map(F.lit, classes)), p).alias("probability_map"),
        F.array_max(p).alias("confidence"),
    )


def best_round(losses: Sequence[float], patience: int) -> int:
    """Rounds up to the least loss, looking no further than ``patience`` rounds without a lesser one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(fitted: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model as it was after ``rounds`` rounds."""
    own, context = fitted._java_obj, SparkContext.getOrCreate()
    jvm, new_array = context._jvm, context._gateway.new_array
    trees = new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = new_array(jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(own.trees()[:rounds], fitted.treeWeights)):
        trees[i], weights[i] = tree, float(weight)
    cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), trees, weights, own.numFeatures(), 2))
    cut._resetUid(own.uid())
    return fitted._copyValues(cut)


def _boosted(data: DataFrame, known: Sequence[str], settings: dict, patience: int | None, metric: str) -> tuple[list, list]:
    """One boosted model per class and the history of their losses; classes are fitted side by side on written data."""
    data = stage(data, "boosting")
    fitting, held = data, None
    if _HELD in data.columns and patience is None:
        settings = settings | {"validationIndicatorCol": _HELD}
    elif _HELD in data.columns:
        fitting, held = data.where(~F.col(_HELD)), data.where(_HELD)

    def fit(i: int):
        learner = GBTClassifier(labelCol=_IS, predictionCol=f"_is_{i}", **settings)
        learner.setRawPredictionCol(f"_margin_{i}").setProbabilityCol(f"_chance_{i}")
        one = lambda table: table.withColumn(_IS, (F.col(_CODE) == i).cast("double"))
        fitted = learner.fit(one(fitting))
        return fitted, fitted.evaluateEachIteration(one(held)) if held is not None else []

    with ThreadPoolExecutor(_SIDE_BY_SIDE) as pool:
        stages, losses = map(list, zip(*pool.map(fit, range(len(known)))))
    if held is None:
        return stages, []
    if metric == JOINT_LOSS:
        together = [sum(row) for row in zip(*losses)]
        rounds = [best_round(together, patience)] * len(known)
    else:
        rounds = [best_round(own, patience) for own in losses]
    history = [(c, i + 1, loss) for c, own in zip(known, losses) for i, loss in enumerate(own)]
    return [first_trees(s, n) for s, n in zip(stages, rounds)], history


def train(
    df: DataFrame,
    target: str = STATUS,
    features: Sequence[str] | None = None,
    kind: str = "forest",
    trees: int = 100,
    depth: int = 6,
    rate: float = 0.1,
    seed: int = 42,
    class_weights: Mapping[str, float] | Sequence[float] | None = None,
    classes: Sequence[str] | None = None,
    validation: DataFrame | None = None,
    patience: int | None = None,
    metric: str = JOINT_LOSS,
) -> Classifier:
    """Fit a class-balanced classifier on a feature table.

    Rows without a target are left out. ``class_weights`` replaces the balanced weights; a list
    follows ``classes``. A ``validation`` table lets a boosted model stop early: with ``patience`` it is cut to the round
    with the least validation loss, after which so many rounds brought no lesser one; else it stops where the gain is small.
    The loss is summed over the classes' models (``mlogloss``, one round for all) or taken of each (``logloss``).
    """
    if metric not in (JOINT_LOSS, OWN_LOSS):
        raise ValueError(f"unknown measure for early stopping: {metric}")
    if patience is not None and patience < 1:
        raise ValueError("patience must be at least one round")
    features = list(features or filters.feature_names(df, target))
    rows = df.where(F.col(target).isNotNull())
    codes = weights.label_codes(rows, target)
    known = [r[target] for r in codes.orderBy("code").collect()]
    if len(known) < 2:
        raise ValueError(f"training needs at least two classes of {target}")
    if class_weights is None:
        weighted = weights.with_balanced_weights(rows, target)
    else:
        weighted = weights.with_explicit_weights(rows, class_weights, classes, target)

    def encoded(table: DataFrame) -> DataFrame:
        code = F.array_position(F.array(*map(F.lit, known)), F.col(target)) - 1
        return table.select(_vector(features).alias(_VECTOR), code.cast("double").alias(_CODE), F.coalesce(weights.WEIGHT, F.lit(1.0)).alias(weights.WEIGHT))

    data, history = encoded(weighted), []
    common = {"featuresCol": _VECTOR, "weightCol": weights.WEIGHT, "maxDepth": depth, "seed": seed}
    if kind == "forest":
        learner = RandomForestClassifier(
            labelCol=_CODE, numTrees=trees, rawPredictionCol="_raw", probabilityCol="_probability",
            predictionCol="_predicted", **common,
        )
        stages = [learner.fit(data)]
    elif kind == "boosted":
        if validation is not None:
            held = validation.where(F.col(target).isin(known)).withColumn(weights.WEIGHT, F.lit(1.0))
            data = data.withColumn(_HELD, F.lit(False)).unionByName(encoded(held).withColumn(_HELD, F.lit(True)))
        stages, history = _boosted(data, known, common | {"maxIter": trees, "stepSize": rate}, patience, metric)
    else:
        raise ValueError(f"unknown model kind: {kind}")
    return Classifier(PipelineModel(stages), Layout(kind, features, known), history)


def evaluate_classifier(model: Classifier, df: DataFrame, target: str = STATUS) -> tuple[DataFrame, DataFrame]:
    """(weighted metrics, per-class report) on the rows that have a target."""
    scored = model.predict(df.where(F.col(target).isNotNull()), "_label", "_p")
    # Written once: the few counts are read for the metrics and again for the report.
    counts = stage(evaluate.confusion(scored, target, "_label"), "confusion")
    return evaluate.weighted_metrics(counts), evaluate.classification_report(counts)
