"""Toxicity by a weighted lexicon: fold, match with Aho-Corasick, skip exceptions, normalise by length, calibrate.

Folding lower-cases a text, turns look-alike letters of other scripts and digits or signs used as letters into the
Latin letters they stand for, and makes everything but letters a space; the same folding is applied where the
lexicon is learned. An entry is a word start or a whole word, weighted by how much likelier it is in toxic documents; an
exception is a pair of words around an entry that is likelier in clean ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import matching
from .common import bounded_batches, checked, labelled_sample

# Labelled documents that the lexicon is learned from, at most.
SAMPLE_DOCS = 20_000
# Word starts tried (letters), and what an entry must show in the sample: toxic documents, how many times likelier it is there,
# and evidence that leaves so many false ones to be expected among all that are tried. Exceptions must show the same of clean documents.
STARTS = (4, 5, 6, 7)
LEAST_DOCS, LEAST_RATIO, BY_CHANCE = 4, 8.0, 0.01
# Strength is the sum of weights over a power of the length, between a plain sum (0) and a density (1); the sample chooses it.
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)
# Words added to a text's length, so that one hit in a very short text does not decide alone.
SHORT = 8

# --- Fixed values: letters of other scripts that look like Latin ones, and digits and signs written for letters. ---
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n", "ԛ": "q", "ս": "u", "ѵ": "v", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
# --- Phrases in which a word of the lexicon is meant otherwise, besides those that are learned. ---
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "stupid simple", "sore loser board", "not stupid", "no idiot", "not worthless")

_LETTERS = re.compile(r"[^\W\d_]+")
# A sign stands for a letter only before or between letters, a digit after letters too; other signs are punctuation.
_SIGNS = re.compile(r"[0134578@$!|€]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$|€]+")
_GLYPHS = str.maketrans({**HOMOGLYPHS, "ſ": "s"} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_GLYPH = re.compile(f"[{''.join(map(chr, _GLYPHS))}]")
_SIGN_OF = str.maketrans(SUBSTITUTES)


@lru_cache(maxsize=100_000)
def _fold_word(word: str) -> str:
    """Letters of a word that has other characters, with signs read as letters; parts between other characters are words."""
    return " ".join(_LETTERS.findall(_SIGNS.sub(lambda m: m.group().translate(_SIGN_OF), word)))


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at both ends; empty without words."""
    if not text:
        return ""
    low = text.lower()
    if not low.isascii() and _GLYPH.search(low):
        low = low.translate(_GLYPHS)
    found = [w if w.isalpha() else _fold_word(w) for w in low.split()]
    line = " ".join(filter(None, found))
    return f" {line} " if line else ""


class Lexicon(NamedTuple):
    """``entries``: pattern (a space, then a word start, or a word and a space) -> weight; ``slope`` and ``offset`` calibrate.

    ``power`` is the one of the length by which the weights are divided.
    """

    entries: dict[str, float]
    slope: float
    offset: float
    exceptions: tuple[str, ...] = EXCEPTIONS
    power: float = 1.0


class Matcher:
    def __init__(self, lexicon: Lexicon):
        patterns = {p: ("entry", w) for p, w in lexicon.entries.items()}
        patterns.update({f" {e} ": ("exception", 0.0) for e in lexicon.exceptions})
        self.automaton, self.slope, self.offset, self.power = matching.automaton(patterns), lexicon.slope, lexicon.offset, lexicon.power

    def weight(self, line: str) -> float:
        """Weights of the words of a folded text that an entry fits, the heaviest entry of each, outside the exceptions."""
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for start, end, (kind, weight) in matching.places(self.automaton, line):
            if kind == "entry":
                best[start] = max(weight, best.get(start, 0.0))
            else:
                spared.append((start, end))
        # Of the exceptions that start no later than a word, the one that ends last decides.
        total, reach, waiting = 0.0, 0, iter([*sorted(spared), (len(line), 0)])
        start, end = next(waiting)
        for at in sorted(best):
            while start <= at:
                reach = max(reach, end - 1)
                start, end = next(waiting)
            total += best[at] if at >= reach else 0.0
        return total

    def pairs(self, line: str) -> set[str]:
        """Two neighbouring words of a folded text, one of which an entry fits."""
        found, last = set(), len(line) - 1
        for at in {start for start, _, (kind, _) in matching.places(self.automaton, line) if kind == "entry"}:
            end = line.index(" ", at + 1)
            if at:
                found.add(line[line.rindex(" ", 0, at) + 1 : end])
            if end < last:
                found.add(line[at + 1 : line.index(" ", end + 1)])
        return found

    def strength(self, text: str | None) -> float:
        """The weight per word of the text, by the power of its length; 0 without words."""
        line = fold(text)
        return self.weight(line) / length_of(line) ** self.power if line else 0.0

    def score(self, text: str | None) -> float:
        z = self.slope * math.log1p(100.0 * self.strength(text)) + self.offset
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def patterns_of(line: str) -> set[str]:
    """Entries that a folded text could give: whole words, and word starts of the lengths in ``STARTS``."""
    found = set()
    for word in set(line.split()):
        if len(word) > 2:
            found.add(f" {word} ")
        for n in STARTS:
            if len(word) > n:
                found.add(f" {word[:n]}")
    return found


def length_of(line: str) -> int:
    """Words of a folded text, and ``SHORT`` more."""
    return line.count(" ") - 1 + SHORT


def _evidence(a: F.Column, b: F.Column, of_a: int, of_b: int) -> F.Column:
    """Log-likelihood ratio that ``a`` of ``of_a`` and ``b`` of ``of_b`` documents have different shares; exp(-it) bounds the chance of more."""
    share = (a + b) / F.lit(of_a + of_b)
    parts = ((a, share * of_a), (b, share * of_b), (of_a - a, (1 - share) * of_a), (of_b - b, (1 - share) * of_b))
    return sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in parts), F.lit(0.0))


def _telling(counted: DataFrame, side: str, sizes: dict[str, int]) -> DataFrame:
    """(p, ratio) of staged (p, bad, good) that are ``LEAST_RATIO`` times likelier in documents of ``side``, beyond chance among all ``counted``."""
    other = "good" if side == "bad" else "bad"
    tests = max(1, counted.count())
    ratio = (F.col(side) / sizes[side]) / ((F.col(other) + 0.5) / sizes[other])
    sure = _evidence(F.col(side), F.col(other), sizes[side], sizes[other]) >= math.log(tests / BY_CHANCE)
    return counted.where(sure & (ratio >= LEAST_RATIO)).select("p", ratio.alias("ratio"))


def _calibrate(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic fit by Newton's method on counts of toxic and clean rows at each x."""
    beta, n = np.array([1.0, -1.0]), toxic + clean
    rows = np.stack([x, np.ones_like(x)], axis=1)
    ridge = np.diag([1e-2, 1e-4]) * max(1.0, n.sum() / 1000)
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ beta, -30, 30)))
        step = np.linalg.solve((rows * (n * p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (toxic - n * p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS) -> Lexicon:
    """Learn a lexicon and its calibration from at most ``sample`` labelled documents outside the held-out fold.

    Entries are counted in the toxic documents, then the surviving ones in all documents of the sample; every one that passes
    the test of ``_telling`` is kept, and so is every exception. The power of the length is the one whose calibrated scores have the least
    log loss on the sample. What reaches the driver is bounded by the sample: entries, exceptions and 1,000 steps of
    strength for each power. Without toxic or clean rows the lexicon is empty and every score is the same value under a half.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = stage(labelled_sample(docs, labels, label, sample, key, text).select(F.col(text).alias("t"), (F.col(label) > 0).alias("y")), "toxic-sample")
    sizes = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return Lexicon({}, 1.0, -1.0)

    def candidates(batches):
        for batch in batches:
            met = Counter(p for t in batch["t"] for p in patterns_of(fold(t)))
            yield pd.DataFrame({"p": list(met), "n": list(met.values())}, columns=["p", "n"])

    of = {"bad": bad, "good": good}
    tried = given.where("y").mapInPandas(candidates, "p string, n int").groupBy("p").agg(F.sum("n").alias("bad"))
    tried = stage(tried.where(F.col("bad") >= LEAST_DOCS), "toxic-candidates")
    # Candidates are met in the clean documents by hashing, while they fit a broadcast, not by a shuffle of all patterns.
    clean = given.where(~F.col("y")).mapInPandas(candidates, "p string, n int").join(checked(tried.select("p")), "p").groupBy("p").agg(F.sum("n").alias("good"))
    counted = stage(tried.join(clean, "p", "left").select("p", "bad", F.coalesce("good", F.lit(0)).alias("good")), "toxic-counted")
    entries = {r["p"]: math.log(r["ratio"]) for r in _telling(counted, "bad", of).orderBy("p").collect()}
    plain = spark.sparkContext.broadcast(Lexicon(entries, 1.0, 0.0))

    def paired(batches):
        own = Matcher(plain.value)
        for batch in batches:
            met = Counter((p, y) for t, y in zip(batch["t"], batch["y"]) for p in own.pairs(fold(t)))
            yield pd.DataFrame([(p, n * y, n * (not y)) for (p, y), n in met.items()], columns=["p", "bad", "good"])

    phrases = given.mapInPandas(paired, "p string, bad int, good int").groupBy("p").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    phrases = stage(phrases.where(F.col("good") >= LEAST_DOCS), "toxic-phrases")
    learned = [r["p"] for r in _telling(phrases, "good", of).orderBy("p").collect()]
    exceptions = tuple(dict.fromkeys([*EXCEPTIONS, *learned]))
    matcher = spark.sparkContext.broadcast(Lexicon(entries, 1.0, 0.0, exceptions))

    def stepped(batches):
        own = Matcher(matcher.value)
        for batch in batches:
            lines = [fold(t) for t in batch["t"]]
            weight, length = np.array([own.weight(t) for t in lines]), np.array([length_of(t) for t in lines], float)
            for i, power in enumerate(POWERS):
                x = np.rint(50 * np.log1p(100.0 * weight / length**power))
                yield pd.DataFrame({"power": i, "x": np.minimum(1000, x).astype("int32"), "y": batch["y"]})

    steps = given.mapInPandas(stepped, "power int, x int, y boolean").groupBy("power", "x").agg(F.count_if("y").alias("bad"), F.count_if(~F.col("y")).alias("good")).toPandas()
    fits = []
    for i, own in steps.groupby("power"):
        x, toxic, calm = own["x"].to_numpy(float) / 50, own["bad"].to_numpy(float), own["good"].to_numpy(float)
        slope, offset = _calibrate(x, toxic, calm)
        z = np.clip(slope * x + offset, -40, 40)
        fits.append((float(toxic @ np.logaddexp(0, -z) + calm @ np.logaddexp(0, z)), POWERS[i], slope, offset))
    _, power, slope, offset = min(fits)
    return Lexicon(entries, slope, offset, exceptions, power)


def score_column(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> F.Column:
    """A column with the score of ``text``; null and empty texts have no hits and score like a clean text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Matcher(shared.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return scored(F.coalesce(text, F.lit("")))
