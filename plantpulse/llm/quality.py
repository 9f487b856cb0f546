"""Quality by ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed events of a text serves every grade; ordered thresholds turn the linear score s into
P(grade > k) = sigmoid(s - threshold k). From these come the expected grade and the tail probability that selects.
Events are the byte trigrams of the text, words that repeat the word before them, and lines seen before in the text;
a document is the square root of its events' shares, so that its length does not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import bounded_batches, free_name, labelled_sample

# Rated documents that the model is fitted on, at most; buckets of the hash; passes of the optimiser; weight decay.
SAMPLE_DOCS = 10_000
BUCKETS = 1 << 14
PASSES = 30
DECAY = 1e-4

_MIX = np.uint32(0x9E3779B1)


def events(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: square roots of the events' shares; empty without text."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    # Line breaks stand at both ends, so that short texts have trigrams too.
    wide = np.full(len(raw) + 2, 10, np.uint32)
    wide[1:-1] = raw
    gram = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    counts = np.bincount((gram * _MIX) >> np.uint32(18), minlength=BUCKETS).astype(np.float64)
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    if again:
        counts[zlib.crc32(b"word again") % BUCKETS] += 4.0 * again
    if "\n" in text:
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if len(line) > 8:
                repeated += len(line) * (line in seen)
                seen.add(line)
        counts[zlib.crc32(b"line again") % BUCKETS] += repeated
    at = np.flatnonzero(counts)
    return at.astype(np.int32), np.sqrt(counts[at] / counts[at].sum()).astype(np.float32)


class Model(NamedTuple):
    """``weights`` per bucket and increasing ``thresholds``, one fewer than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade > k) for every threshold k; a text without characters has the linear score 0."""
        at, value = events(text)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - self.weights[at] @ value, -40, 40)))


def _split(theta: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, thresholds and the gaps they come from: the first threshold is free, later ones add exp(gap)."""
    weights, free = theta[: -(grades - 1)], theta[-(grades - 1) :]
    gaps = np.exp(np.clip(free[1:], -8, 8))
    return weights, free[0] + np.concatenate([[0.0], np.cumsum(gaps)]), gaps


def loss_and_gradient(theta: np.ndarray, grades: int, rows, weight_of: np.ndarray) -> np.ndarray:
    """Negative log-likelihood and its gradient, as one vector, over (buckets, values, grade) rows.

    P(grade = k) = sigmoid(t[k] - s) - sigmoid(t[k-1] - s), with the outer thresholds at infinity.
    """
    weights, cuts, gaps = _split(theta, grades)
    total, slope_w, slope_t = 0.0, np.zeros_like(weights), np.zeros(grades - 1)
    for at, value, grade in rows:
        s = weights[at] @ value
        up = 1.0 if grade == grades - 1 else 1.0 / (1.0 + np.exp(np.clip(s - cuts[grade], -40, 40)))
        low = 0.0 if grade == 0 else 1.0 / (1.0 + np.exp(np.clip(s - cuts[grade - 1], -40, 40)))
        p, up_slope, low_slope = max(up - low, 1e-12), up * (1 - up), low * (1 - low)
        weight = weight_of[grade]
        total -= weight * np.log(p)
        slope_w[at] += weight * (up_slope - low_slope) / p * value
        if grade < grades - 1:
            slope_t[grade] -= weight * up_slope / p
        if grade > 0:
            slope_t[grade - 1] += weight * low_slope / p
    later = np.cumsum(slope_t[::-1])[::-1]
    return np.concatenate([[total], slope_w, [later[0]], later[1:] * gaps])


def _descend(value_and_gradient, theta: np.ndarray, passes: int, kept: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking step; each evaluation is one distributed pass."""
    value, slope = value_and_gradient(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(passes):
        way, held = -slope, []
        for move, turn in reversed(pairs):
            a = (move @ way) / (move @ turn)
            held.append(a)
            way = way - a * turn
        if pairs:
            way = way * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]))
        else:
            way = way / max(1.0, np.linalg.norm(slope))
        for (move, turn), a in zip(pairs, reversed(held)):
            way = way + move * (a - (turn @ way) / (move @ turn))
        step = 1.0
        for _ in range(6):
            new_value, new_slope = value_and_gradient(theta + step * way)
            if new_value <= value + 1e-4 * step * (slope @ way):
                break
            step /= 3
        else:
            break
        move, turn = step * way, new_slope - slope
        if move @ turn > 1e-10:
            pairs = [*pairs, (move, turn)][-kept:]
        theta, gain = theta + move, value - new_value
        value, slope = new_value, new_slope
        if gain < 1e-5 * max(1.0, abs(value)):
            break
    return theta


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "grade", key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> Model | None:
    """Fit on at most ``sample`` rated documents outside the held-out fold; grades are whole numbers from 0.

    Hashed events are staged once; every pass of the optimiser is a job that sums one gradient per partition, so the
    driver holds a few vectors of ``BUCKETS`` numbers whatever the data. Rarer grades weigh more. None without
    two different grades in the sample.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def hashed(batches):
        for batch in batches:
            pairs = [events(t) for t in batch[text]]
            yield pd.DataFrame({"at": [a for a, _ in pairs], "value": [v for _, v in pairs], "grade": batch[grade]})

    rows = labelled_sample(docs, ratings, grade, sample, key, text).select(text, grade)
    given = stage(rows.mapInPandas(hashed, "at array<int>, value array<float>, grade int"), "quality-events")
    counts = {r["grade"]: r["count"] for r in given.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return None
    grades = max(counts) + 1
    share = np.array([counts.get(g, 0) for g in range(grades)], float)
    weight_of = np.sqrt(share.sum() / np.maximum(share, 1) / grades)
    total = float((share * weight_of).sum())
    tasks = max(1, min(24, int(share.sum()) // 400))
    given = given.coalesce(tasks)

    def value_and_gradient(theta):
        sent = spark.sparkContext.broadcast(theta)

        def summed(batches):
            own = np.zeros(len(theta) + 1)
            for batch in batches:
                own += loss_and_gradient(sent.value, grades, zip(batch["at"], batch["value"], batch["grade"]), weight_of)
            yield pd.DataFrame({"part": [own.tobytes()]})

        parts = given.mapInPandas(summed, "part binary").collect()  # one vector for each of ``tasks`` tasks
        sent.destroy()
        found = np.sum([np.frombuffer(bytes(r["part"])) for r in parts], axis=0) / total
        plain = theta.copy()
        plain[-(grades - 1) :] = 0.0
        return found[0] + 0.5 * DECAY * (plain @ plain), found[1:] + DECAY * plain

    start = np.zeros(BUCKETS + grades - 1)
    theta = _descend(value_and_gradient, start, PASSES)
    weights, cuts, _ = _split(theta, grades)
    return Model(weights.astype(np.float32), cuts)


def judged(docs: DataFrame, model: Model | None, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out`` of ``expected`` grade and ``tails`` (P(grade > k) for each k).

    Null and empty texts are given the expected grade 0 and tails 0; without a model every text gets nulls.
    Other columns, repeated rows and null keys pass through untouched; where one of them is called ``out``, the struct
    takes the name that ``free_name`` gives.
    """
    out = free_name(docs, out)
    kind = "expected double, tails array<double>"
    if model is None:
        return docs.withColumn(out, F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            tails = [own.tails(t) if t else np.zeros(len(own.thresholds)) for t in texts]
            yield pd.DataFrame({"expected": [float(x.sum()) for x in tails], "tails": [x.tolist() for x in tails]})

    return docs.withColumn(out, judge(F.coalesce(text, F.lit(""))))


def grades_of(labels: DataFrame) -> DataFrame:
    """Ratings from the two given labels: 0 low quality, 1 well written but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
