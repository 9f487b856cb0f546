"""Two-layer prediction: the health status first, then the type of a warning or failure."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import FAILURE, FAILURE_TYPE, STATUS, WARNING, WARNING_TYPE
from ..storage import stage

CONFIDENCE = "health_confidence"


class Predictor(Protocol):
    def predict(self, df: DataFrame, label: str, probabilities: str) -> DataFrame: ...


def _with_type(df: DataFrame, model: Predictor | None, status: str, name: str) -> DataFrame:
    if model is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    scored = model.predict(df, "_type", "_type_p")
    return scored.withColumn(name, F.when(F.col(STATUS) == status, F.col("_type"))).drop("_type", "_type_p")


def predict_hierarchy(
    df: DataFrame,
    status_model: Predictor,
    warning_model: Predictor | None = None,
    failure_model: Predictor | None = None,
    route: bool = False,
) -> DataFrame:
    """Add health status, its confidence, and the warning or failure type where one applies.

    An absent second-layer model leaves its column null. By default every row passes every model,
    which needs no extra pass and works on a stream. With ``route`` the first layer's result is
    written once and each second-layer model then reads its own rows only; use it in batch when the
    second layer is the costly part.
    """
    base = df.drop(STATUS, WARNING_TYPE, FAILURE_TYPE)
    first = status_model.predict(base, STATUS, "_p").withColumn(CONFIDENCE, F.array_max("_p")).drop("_p")
    if not route:
        typed = _with_type(first, warning_model, WARNING, WARNING_TYPE)
        return _with_type(typed, failure_model, FAILURE, FAILURE_TYPE)
    first = stage(first, "layer1")
    plain = first.where(~F.coalesce(F.col(STATUS).isin(WARNING, FAILURE), F.lit(False)))
    warned = _with_type(first.where(F.col(STATUS) == WARNING), warning_model, WARNING, WARNING_TYPE)
    failed = _with_type(first.where(F.col(STATUS) == FAILURE), failure_model, FAILURE, FAILURE_TYPE)
    parts = plain.unionByName(warned, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)
    return parts.select(*first.columns, WARNING_TYPE, FAILURE_TYPE)
