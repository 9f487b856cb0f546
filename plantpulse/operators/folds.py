"""Leave-one-run-out in full: every row scored by a model that has not seen its run, and metrics per fold.

A row is tested in one fold and trains all others, so rows are never copied per fold. For models made of sums the training
sums of all folds come from one aggregation, as the total less the run's own; the rows of all folds are then scored in one pass.
For any other model, folds are fitted a few at a time, and their scored rows are written as one table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import RUN, STATUS, require_columns
from ..storage import small_side, stage
from .evaluate import PREDICTION
from .features import LABELS, known_labels

# Folds that are fitted one by one, at most, and how many at the same time.
FOLDS, SIDE_BY_SIDE = 200, 4


class Fitted(Protocol):
    def predict(self, df: DataFrame, label: str, probabilities: str) -> DataFrame: ...


def _rows(df: DataFrame, run: str, target: str) -> DataFrame:
    require_columns(df, run, target)
    return df.where(F.col(run).isNotNull() & F.col(target).isNotNull())


def centroid_folds(df: DataFrame, features: Sequence[str], run: str = RUN, target: str = STATUS) -> DataFrame:
    """Rows with the class whose centroid, over all other runs, is nearest, as ``prediction``.

    A feature counts by the variance of the fold's training rows; one that does not vary there, and missing values, count
    nothing. Equal distances go to the first class by name. Null where no other run has a class. Rows without a run or
    class are left out.
    """
    rows = _rows(df, run, target)
    classes = known_labels(rows, target)
    if classes is None:
        if rows.isEmpty():
            return rows.withColumn(PREDICTION, F.lit(None).cast("string"))
        raise ValueError(f"more than {LABELS} classes of {target}")
    value = {f: F.col(f).cast("double") for f in features}
    sums = [g(x).alias(f"{k}_{i}") for i, f in enumerate(features) for k, x, g in (("n", value[f], F.count), ("s", value[f], F.sum), ("q", value[f] * value[f], F.sum))]
    names = [f"{k}_{i}" for i in range(len(features)) for k in "nsq"]
    own = stage(rows.groupBy(run, target).agg(*sums).na.fill(0.0, names), "fold-sums")
    totals = {r[target]: r for r in own.groupBy(target).agg(*[F.sum(n).alias(n) for n in names]).collect()}  # a row per class
    of = F.map_from_entries(F.collect_list(F.struct(target, F.struct(*names))))  # the few classes of a run
    folds = own.groupBy(run).agg(of.alias("_own"))

    def left(c: str, name: str):
        return F.lit(totals[c][name]) - F.coalesce(F.try_element_at("_own", F.lit(c))[name], F.lit(0))

    scales, centres = [], []
    for i in range(len(features)):
        n, s, q = (sum((left(c, f"{k}_{i}") for c in classes), F.lit(0.0)) for k in "nsq")
        spread = q / n - (s / n) * (s / n)
        scales.append(F.when((n > 0) & (spread > 1e-12), spread))
    for c in classes:
        seen = reduce(lambda a, b: a | b, [left(c, f"n_{i}") > 0 for i in range(len(features))])
        centre = F.array(*[left(c, f"s_{i}") / F.nullif(left(c, f"n_{i}"), F.lit(0)) for i in range(len(features))])
        centres.append(F.when(seen, F.struct(F.lit(c).alias("class"), centre.alias("at"))))
    models = folds.select(F.col(run).alias("_fold"), F.array(*scales).alias("_scale"), F.array_compact(F.array(*centres)).alias("_centres"))
    point = F.array(*value.values())

    def distance(centre):
        parts = F.zip_with(F.zip_with(point, centre["at"], lambda x, c: (x - c) * (x - c)), F.col("_scale"), lambda d, v: F.coalesce(d / v, F.lit(0.0)))
        return F.struct(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("distance"), centre["class"].alias("class"))

    joined = rows.join(small_side(models), F.col(run) == F.col("_fold"))
    nearest = F.array_min(F.transform("_centres", distance))["class"]
    return joined.select(*rows.columns, nearest.alias(PREDICTION))


def score_folds(
    df: DataFrame,
    fit: Callable[[DataFrame], Fitted],
    run: str = RUN,
    target: str = STATUS,
    most: int = FOLDS,
    side_by_side: int = SIDE_BY_SIDE,
) -> DataFrame:
    """Rows with the ``prediction`` of a model fitted on all other runs, one fit per run and ``side_by_side`` at a time.

    More than ``most`` runs raise: that many models are not trained unasked. Each fold's rows are written when they are scored.
    """
    rows = _rows(df, run, target)
    runs = [r[0] for r in rows.select(run).distinct().orderBy(run).take(most + 1)]
    if len(runs) > most:
        raise ValueError(f"more than {most} runs to leave out")
    if len(runs) < 2:
        raise ValueError("leaving a run out needs at least two")

    def fold(one) -> DataFrame:
        fitted = fit(rows.where(F.col(run) != F.lit(one)))
        scored = fitted.predict(rows.where(F.col(run) == F.lit(one)), PREDICTION, "_p")
        return stage(scored.select(*rows.columns, PREDICTION), "fold")

    with ThreadPoolExecutor(side_by_side) as pool:
        return reduce(DataFrame.unionByName, pool.map(fold, runs))


def fold_report(scored: DataFrame, run: str = RUN, target: str = STATUS) -> DataFrame:
    """(run, class, support, predicted, hits, precision, recall, f1_score) per fold and class seen in it, all folds in one pass."""
    counts = scored.groupBy(run, F.col(target).alias("_true"), F.col(PREDICTION).alias("_said")).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("_true") == F.col("_said"), F.col("_n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("_true").alias("class"), F.col("_n").alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("_said").alias("class"), zero.alias("support"), F.col("_n").alias("predicted"), zero.alias("hits")),
    )
    sums = counts.select(run, F.inline(sides)).where(F.col("class").isNotNull()).groupBy(run, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    share = lambda top, bottom: F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))
    return sums.withColumns({
        "precision": share(F.col("hits"), F.col("predicted")),
        "recall": share(F.col("hits"), F.col("support")),
        "f1_score": share(2.0 * F.col("hits"), F.col("predicted") + F.col("support")),
    })
