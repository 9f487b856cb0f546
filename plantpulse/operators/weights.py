"""Class counts, class weights and label codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import STATUS
from ..storage import small_side

WEIGHT = "weight"


def class_distribution(df: DataFrame, label: str = STATUS) -> DataFrame:
    """Rows per class; rows without a class are not counted."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def balanced_class_weights(df: DataFrame, label: str = STATUS) -> DataFrame:
    """(label, weight) with weight = rows / (classes * rows of the class)."""
    whole = Window.partitionBy()
    total, classes = F.sum("rows").over(whole), F.count(F.lit(1)).over(whole)
    return class_distribution(df, label).select(label, (total / (classes * F.col("rows"))).alias(WEIGHT))


def with_balanced_weights(df: DataFrame, label: str = STATUS) -> DataFrame:
    """Add the class weight to every row (null where the row has no class)."""
    return df.join(small_side(balanced_class_weights(df, label)), label, "left").select(*df.columns, WEIGHT)


def with_explicit_weights(df: DataFrame, weights: Mapping[str, float] | Sequence[float], classes=None, label: str = STATUS) -> DataFrame:
    """Add given class weights; a list is matched to ``classes`` in order."""
    if not isinstance(weights, Mapping):
        if classes is None or len(classes) != len(weights):
            raise ValueError("a weight list needs one class per weight")
        weights = dict(zip(classes, weights))
    pairs = [F.lit(x) for name, w in weights.items() for x in (name, float(w))]
    return df.withColumn(WEIGHT, F.try_element_at(F.create_map(*pairs), F.col(label)))


def label_codes(df: DataFrame, label: str = STATUS) -> DataFrame:
    """(label, code): classes in alphabetical order, numbered from 0. Classes are few."""
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    return classes.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint").alias("code"))


def encode_labels(df: DataFrame, label: str = STATUS, code: str = "code") -> DataFrame:
    codes = small_side(label_codes(df, label).withColumnRenamed("code", code))
    return df.join(codes, label, "left").select(*df.columns, code)


def decode_labels(df: DataFrame, codes: DataFrame, label: str = STATUS, code: str = "code") -> DataFrame:
    return df.join(small_side(codes), code, "left").select(*df.columns, label)
