"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

Tokenising runs per partition; long documents are cut into pieces and every piece knows its place among the
pieces of its length in its block. Best fit looks at lengths only, so it runs on the number of pieces of each length
(at most ``capacity`` numbers, whatever the data): equal pieces that meet equal bins are placed together, which gives
exactly the bins of the one-by-one procedure. Pieces find their bins by a join on length and place.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .common import bounded_batches

CAPACITY = 1024
END = 2
# Entries of a worker's cache of encoded units, and the longest unit kept in it.
CACHE_ENTRIES = 150_000
CACHE_UNIT = 40

# Where a space is followed by white space or the end, the tokenizer's pattern does not start a new match at each space.
_UNEVEN = re.compile(r" (?:\s|\Z)")


_encoder_of: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder of a tokenizer file, kept with its cache from task to task."""
    if path not in _encoder_of:
        _encoder_of[path] = Encoder(path)
    return _encoder_of[path]


class Encoder:
    """Ids of whole texts as packed unsigned 32-bit integers, equal to those of the tokenizer file.

    The file's byte-level merges are run by a faster library on the same vocabulary; words between single spaces are kept
    in a bounded cache. A text that holds a special token's string goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        step = spec["pre_tokenizer"]
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.path = path
        plain = spec["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
        self.fast = None
        if plain and model["type"] == "BPE" and not model.get("unk_token") and not model.get("ignore_merges"):
            import public_tokenizers

            bytes_of = _byte_of_letter()
            ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.special}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _unit(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _UNEVEN.search(text):
            return self._unit(text)
        first, *units = text.split(" ")
        cache = self.cache
        found = list(map(cache.get, units))
        if None in found:
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    unit = units[i]
                    found[i] = ids = self._unit(" " + unit)
                    if len(unit) <= CACHE_UNIT:
                        cache[unit] = ids
        return self._unit(first) + b"".join(found)


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity``, the first takes what is left over."""
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32, block, place) of every document; null texts count as empty: the end id alone.

    ``block`` is the task, ``place`` the number of earlier pieces of the same length in it. Repeated rows are documents too.
    """
    bounded_batches(docs.sparkSession)
    last = array("I", [end]).tobytes()

    def cut_up(batches):
        own, block, placed = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                ids = own.encode(t) + last
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    place = placed.get(length, 0)
                    placed[length] = place + 1
                    rows.append((k, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), block, place))
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32", "block", "place"]).astype({"k": batch["k"].dtype})

    given = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    kind = given.schema["k"].dataType.simpleString()
    found = given.mapInPandas(cut_up, f"k {kind}, piece int, start long, length long, ids_crc32 long, block int, place long")
    return found.withColumnRenamed("k", key)


class Bins:
    """Open bins by remaining capacity: a segment tree of counts answers the tightest capacity that still fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, number: int) -> None:
        at = remaining + self.size
        while at:
            self.tree[at] += number
            at //= 2

    def put(self, remaining: int, first: int, number: int, step: int = 1) -> None:
        """Open ``number`` bins with ids from ``first`` on."""
        if number:
            self.groups[remaining].append((first, number, step))
            self._add(remaining, number)

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` that an open bin has."""
        at = length + self.size
        if self.tree[at]:
            return length
        while at > 1:  # up to the first right neighbour that holds a bin, then down to its leftmost
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Remove up to ``most`` bins of one run of ids: (first id, number)."""
        first, number, step = self.groups[remaining].pop()
        used = min(number, most)
        if used < number:
            self.groups[remaining].append((first + used, number - used, step))
        self._add(remaining, -used)
        return first, used


class Placement(NamedTuple):
    """Pieces ``since`` to ``until`` of a length go ``each`` by each into bins from ``bin`` on, from ``offset`` on."""

    length: int
    since: int
    until: int
    each: int
    bin: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Placement]:
    """Best-fit decreasing over ``counts`` pieces of each length. A bin takes equal pieces until it has no room for more."""
    open_bins, placements, next_bin = Bins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            remaining = open_bins.tightest(length)
            fresh = remaining is None
            each = (capacity if fresh else remaining) // length
            left = total - done
            wanted = left // each
            if fresh:
                remaining, first, number = capacity, next_bin, max(1, wanted)
                next_bin += number
            else:
                first, number = open_bins.take(remaining, max(1, wanted))
            into = min(each, left)  # the last bin may get fewer
            placed = number * into
            placements.append(Placement(length, done, done + placed, into, first, capacity - remaining))
            open_bins.put(remaining - into * length, first, number)
            done += placed
    return placements


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (staged ``pieces``) with sequence_id and offset, as many sequences as best-fit decreasing opens.

    The driver sees one count per length; pieces are numbered by adding, per block, how many of their length earlier blocks hold.
    """
    spark = found.sparkSession
    blocks = found.groupBy("length", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("length", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    schema = "length long, since long, until long, each long, bin long, offset long"
    placements = spark.createDataFrame([tuple(p) for p in best_fit(counts, capacity)], schema)
    numbered = found.join(before, ["length", "block"]).withColumn("number", F.col("before") + F.col("place"))
    own = (numbered["length"] == placements["length"]) & (F.col("number") >= F.col("since")) & (F.col("number") < F.col("until"))
    within = F.col("number") - F.col("since")
    joined = numbered.join(F.broadcast(placements), own).drop(placements["length"])
    keep = [c for c in found.columns if c not in ("block", "place")]
    return joined.select(
        *keep,
        (F.col("bin") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (within % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens; an empty table gives no rows."""
    return pack(stage(pieces(docs, tokenizer, key, text, capacity, end), "pieces"), capacity)
