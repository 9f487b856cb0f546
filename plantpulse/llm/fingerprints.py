"""Document fingerprints by content-defined chunking with a gear hash.

A rolling gear hash of the last 32 bytes decides where a chunk may end, so boundaries move with the text when something is
inserted or cut. Chunking is normalised: before the target size a boundary needs more zero bits than after it, so sizes stay
near the target. The fingerprint lists each distinct chunk's digest and length; the share of one text's length whose chunks
are in the other's fingerprint is the containment of the first in the second.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import bounded_batches, checked

# Bytes: least, target and largest chunk; zero bits that a boundary needs before and after the target size.
LEAST, TARGET, MOST = 16, 48, 256
BITS_BEFORE, BITS_AFTER = 7, 4
# Bytes of text in one ordered slot of neighbouring documents.
SLOT_BYTES = 8_000_000

# A gear value per byte: 32 bits of a digest, so no table has to be kept.
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest() for b in range(256)), "<u4").astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of the gear values of the last 32 bytes, shifted left once per later byte."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8, 16):  # doubling: the hash of twice as many bytes from two of half as many
        later = h.copy()
        later[width:] += h[:-width] << np.uint32(width)
        h = later
    return h


def chunk_ends(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = gear(raw)
    high = h >> np.uint32(32 - BITS_BEFORE)
    loose = np.flatnonzero(high >> np.uint32(BITS_BEFORE - BITS_AFTER) == 0) + 1
    strict = high[loose - 1] == 0
    ends, start, i = [], 0, 0
    places, is_strict, total = loose.tolist(), strict.tolist(), len(loose)
    while n - start > LEAST:
        while i < total and places[i] < start + LEAST:
            i += 1
        end, j = min(start + MOST, n), i
        while j < total and places[j] < end:
            if is_strict[j] or places[j] >= start + TARGET:
                end = places[j]
                break
            j += 1
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> str:
    """Distinct chunks in the order of their digests: 12 hex digits and the chunk's bytes, joined by blanks; empty without text."""
    import xxhash

    raw = text.encode("utf-8")
    ends = chunk_ends(np.frombuffer(raw, np.uint8))
    digest, found = xxhash.xxh3_64_hexdigest, {}
    for a, b in zip([0, *ends], ends):
        found[digest(raw[a:b])[:12]] = b - a
    return " ".join(f"{d}{n:x}" for d, n in sorted(found.items()))


def containment(one: str, other: str) -> float:
    """Share of ``one``'s distinct chunks, by length, that ``other`` has; an empty text is contained in an empty one only."""
    if not one:
        return 0.0 if other else 1.0
    own = one.split(" ")
    there = set(other.split(" "))
    shared, total = 0, 0
    for chunk in own:
        size = int(chunk[12:], 16)
        total += size
        shared += size * (chunk in there)
    return shared / total


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first characters of ``following``, or all of them."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) per row of ``docs``; null texts count as empty. Equal texts have equal fingerprints."""
    bounded_batches(docs.sparkSession)

    def marked(batches):
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "fingerprint": [fingerprint(t) for t in batch["t"]]})

    given = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    return given.mapInPandas(marked, f"k {given.schema['k'].dataType.simpleString()}, fingerprint string").withColumnRenamed("k", key)


def _slots(docs: DataFrame, key: str, text: str) -> list[int]:
    """Least keys of the ordered slots but the first, so many that a slot holds about ``SLOT_BYTES`` of text."""
    size = docs.agg(F.sum(F.length(text)).alias("n")).collect()[0]["n"] or 0
    number = max(1, -(-size // SLOT_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    shares = [i / number for i in range(1, number)]
    cuts = docs.agg(F.percentile_approx(key, shares, 10 * number).alias("q")).collect()[0]["q"] if shares else []
    return sorted(set(cuts or []))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how much of the text either its edited form or the next text has.

    The next document is the one with the largest smaller key; after the smallest key comes the largest. Whole keys are expected;
    rows without a key are left out. Rows of equal keys are ordered by text. The documents are shuffled once, into ordered slots; the
    last row of each slot (a bounded table) goes to the following slot as well, where it is the neighbour of the first.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    cuts = _slots(given, "k", "t")
    limits = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def slot_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits.value, keys.to_numpy(np.int64), side="right").astype("int32"))

    # The last key of each slot, and the slot that follows among those that hold rows; after the last comes the first.
    lasts = stage(given.select("k", slot_of("k").alias("slot")).groupBy("slot").agg(F.max("k").alias("k")), "slot-ends")
    ends = sorted((r["slot"], r["k"]) for r in lasts.collect())  # one row per slot
    follows = [(k, ends[(i + 1) % len(ends)][0]) for i, (_, k) in enumerate(ends)]
    after = checked(stage(spark.createDataFrame(follows, "last long, following int"), "slot-neighbours"))
    rows = given.withColumn("slot", slot_of("k")).join(after, F.col("k") == F.col("last"), "left")
    own = F.struct(F.col("slot").alias("slot"), F.lit(1).alias("own"))
    ghost = F.struct(F.col("following").alias("slot"), F.lit(0).alias("own"))
    doubled = rows.select("k", "t", F.explode(F.when(F.col("following").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("in"))
    dealt = doubled.select("in.*", "k", "t").repartitionByRange(max(1, len(ends)), "slot").sortWithinPartitions("slot", "own", "k", "t")

    def compared(batches):
        import xxhash  # noqa: F401  (a missing library should fail here, not for each row)

        before = None  # (text, fingerprint) of the neighbour below
        for batch in batches:
            out = []
            for own_row, k, t in zip(batch["own"], batch["k"], batch["t"]):
                mark = fingerprint(t)
                if own_row:
                    changed = edited(t, before[0])
                    changed_mark = fingerprint(changed)
                    out.append((k, len(t), hashlib.sha256(changed.encode("utf-8")).hexdigest(), mark, changed_mark, containment(mark, changed_mark), containment(mark, before[1])))
                before = (t, mark)
            yield pd.DataFrame(out, columns=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(compared, schema).withColumnRenamed("k", key)
