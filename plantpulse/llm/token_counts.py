"""Token counts by a two-tier look-up: a broadcast table of frequent units, then a worker's own cache.

A sentence-piece BPE model turns spaces into the mark U+2581 and has no piece that goes on after a word
into the next mark, so a text is the sequence of its units (marks, then the rest up to the next mark) and its
count is the sum of the units' counts. Unit lengths of a bounded sample are broadcast; other units are encoded
together, once per batch, and kept in a bounded cache of the worker. No unit is ever shuffled, except
within the sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
# Documents whose units are counted for the broadcast table, and entries of the table.
SAMPLE_DOCS = 2_000
TABLE_ENTRIES = 50_000
# Entries of a worker's cache, and the longest unit kept in it.
CACHE_ENTRIES = 400_000
CACHE_UNIT = 48

_model_of: dict[str, tuple] = {}
_cache_of: dict[str, dict[str, int]] = {}


def _model(path: str):
    """The model and, for each id, whether its piece starts with the mark."""
    if path not in _model_of:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        starts = np.array([model.id_to_piece(i).startswith(MARK) for i in range(model.get_piece_size())])
        _model_of[path] = model, starts
    return _model_of[path]


def separable(path: str) -> bool:
    """Whether counts of units add up: no piece holds a mark after another character, and texts are not rewritten."""
    model, _ = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        return False
    probe = "Ａ ½  x y ́"
    return model.decode(model.encode(probe)) == probe and len(model.encode("")) == 0


def unit_lengths(path: str, units: list[str]) -> list[int]:
    """Tokens of each unit, all given without their mark and free of spaces and marks, by one call of the model."""
    model, starts = _model(path)
    if not units:
        return []
    ids = np.asarray(model.encode(" ".join(units), num_threads=1), dtype=np.int64)
    at = np.flatnonzero(starts[ids])
    if len(at) != len(units):  # cannot happen for separable models; one by one is always right
        return [len(model.encode(u, num_threads=1)) for u in units]
    return np.diff(np.append(at, len(ids))).tolist()


class Counter:
    """Counts tokens of texts with the broadcast table in front of a bounded cache."""

    def __init__(self, path: str, frequent: dict[str, int], split: bool):
        self.path, self.frequent, self.split = path, frequent, split
        self.cache = _cache_of.setdefault(path, {})  # kept from task to task of a worker

    def whole(self, text: str) -> int:
        return len(_model(self.path)[0].encode(text, num_threads=1))

    def counts(self, texts: list[str]) -> list[int]:
        known = self.frequent.get
        totals, missed = [], []
        for t in texts:
            if self.split and t and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " ":
                units = t.split(" ")
                found = list(map(known, units))
                totals.append(sum(filter(None, found)))
                missed.append([u for u, n in zip(units, found) if n is None] if None in found else [])
            else:
                totals.append(self.whole(t))
                missed.append([])
        new = list(set().union(*missed).difference(self.cache))
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            new = list(set().union(*missed))
        cache = self.cache
        cache.update(zip(new, unit_lengths(self.path, new)))
        totals = [n + sum(map(cache.__getitem__, units)) for n, units in zip(totals, missed)]
        for u in new:
            if len(u) > CACHE_UNIT:
                del cache[u]
        return totals


def frequent_units(docs: DataFrame, model: str, text: str = "text", sample: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The most frequent units of the first ``sample`` documents in the order of a hash, with their lengths."""
    chosen = docs.where(F.length(text) > 0).select(F.col(text).alias("t"))
    rate = min(1.0, 2.0 * sample / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < int(rate * 1_000_000))
    unit = F.explode(F.split("t", " ")).alias("unit")
    counted = chosen.limit(sample).select(unit).where((F.length("unit") > 0) & (F.length("unit") <= CACHE_UNIT) & ~F.contains("unit", F.lit(MARK)))
    top = counted.groupBy("unit").count().orderBy(F.desc("count"), "unit").limit(entries)
    units = [r[0] for r in top.collect()]  # at most ``entries`` short units
    return dict(zip(units, unit_lengths(model, units)))


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row (key, n_bytes, n_tokens, over_limit) per row of ``docs``; null texts count as empty, which have no tokens.

    Texts with runs of spaces, outer spaces or literal marks go to the model whole, as does everything when the
    model's units do not add up. Repeated rows and null keys are counted like any other row; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    split = separable(model)
    known = spark.sparkContext.broadcast(frequent_units(docs, model, text) if split else {})

    def counted(batches):
        counter = Counter(model, known.value, split)
        for batch in batches:
            texts = batch["t"].fillna("").tolist()
            yield pd.DataFrame({"k": batch["k"], "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": counter.counts(texts)})

    given = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = given.schema["k"].dataType.simpleString()
    found = given.mapInPandas(counted, f"k {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
