"""Classification metrics from the confusion counts (one small aggregation of the predictions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABEL, PREDICTION = "label", "prediction"


def confusion(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """(label, prediction, rows)."""
    pair = [F.col(label).alias(LABEL), F.col(prediction).alias(PREDICTION)]
    return df.groupBy(*pair).agg(F.count(F.lit(1)).alias("rows"))


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / F.nullif(bottom, F.lit(0)))


def per_class(counts: DataFrame) -> DataFrame:
    """(class, precision, recall, f1_score, support) for every class seen as label or prediction."""
    hit = F.when(F.col(LABEL) == F.col(PREDICTION), F.col("rows")).otherwise(0)
    sides = F.array(
        F.struct(F.col(LABEL).alias("class"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col(PREDICTION).alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("rows").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    sums = counts.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision = _or_zero(F.col("hits"), F.col("predicted"))
    recall = _or_zero(F.col("hits"), F.col("support"))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), "support", "hits").select(
        "class",
        "precision",
        "recall",
        _or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1_score"),
        "support",
        "hits",
    )


def weighted_metrics(counts: DataFrame) -> DataFrame:
    """One row: accuracy and the support-weighted precision, recall and F1."""
    support = F.sum("support")
    mean = lambda name: (F.sum(F.col(name) * F.col("support")) / support).alias(name)
    accuracy = (F.sum("hits") / support).alias("accuracy")
    return per_class(counts).agg(accuracy, mean("precision"), mean("recall"), mean("f1_score"))


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class rows followed by ``accuracy``, ``macro avg`` and ``weighted avg``."""
    table = per_class(counts)
    columns = ["precision", "recall", "f1_score"]
    support = F.sum("support")
    share = F.sum("hits") / support
    macro = F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in columns], support.alias("support"))
    weighted = F.struct(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(c) * F.col("support")) / support).alias(c) for c in columns],
        support.alias("support"),
    )
    overall = F.struct(F.lit("accuracy").alias("class"), *[share.alias(c) for c in columns], support.alias("support"))
    averages = table.agg(F.array(overall, macro, weighted).alias("rows")).select(F.inline("rows"))
    return table.drop("hits").unionByName(averages)
