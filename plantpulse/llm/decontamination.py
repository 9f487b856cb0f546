"""Benchmark decontamination with DataFrame functions only: broadcast n-gram hashes, scan, verify, remove.

Every window of ``WINDOW`` consecutive words of a benchmark item (all of a shorter item) is normalised, hashed and broadcast.
Documents are scanned once: wherever the rarest-looking word of a window stands, the run of words around it is hashed and met
with the broadcast hashes, and a hit counts only after its words have been compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import checked

WINDOW = 10
# Distinct benchmark windows that may be broadcast; beyond it the windows are joined by a shuffle.
BROADCAST_WINDOWS = 2_000_000
# A document of which this share is benchmark text is removed whole, others lose the passages.
WHOLE_SHARE = 0.5

# --- Fixed values: what a word is made of, before and after A-Z are lower-cased. ---
_LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text) -> F.Column:
    """Words of a text with A-Z lower-cased. Splitting is about ten times as fast as collecting the matches."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), f"{_OTHER}+"), "")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows (hash, length, words, items, offset, anchor): the anchor proposes, the hash finds, the words verify. Items without words give none."""
    given = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    given = given.withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    cut = given.select("item", "length", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.col("length")))).alias("words"))
    found = cut.groupBy(F.xxhash64("words").alias("hash"), "length", "words").agg(F.collect_set("item").alias("items"))
    # The longest word, the first of them, is the anchor: long words are rare, so few places of a text need their window hashed.
    sizes = F.transform("words", lambda w: F.length(w))
    return found.withColumn("offset", F.array_position(sizes, F.array_max(sizes)).cast("int") - 1).withColumn("anchor", F.element_at("words", F.col("offset") + 1))


def _text_key(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Contaminated documents only: (key, text_key, spans, n_hit, items).

    ``spans`` are disjoint word intervals (first, end) in order, ``items`` the ids of the items found, as sorted strings.
    Rows are told apart by key and text, so repeated rows give one row here and a null key is a key like any other.
    """
    windows = stage(benchmark_windows(benchmark, item, item_text), "windows")
    anchors = checked(stage(windows.select("anchor", "offset", "length").distinct(), "anchors"), BROADCAST_WINDOWS)
    given = docs.select(F.col(key).alias("doc"), _text_key(F.col(text)).alias("text_key"), words_of(F.col(text)).alias("w"))
    spread = given.select("doc", "text_key", "w", F.posexplode("w").alias("place", "anchor"))
    runs = spread.join(anchors, "anchor").withColumn("at", F.col("place") - F.col("offset")).where((F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.size("w")))
    runs = runs.select("doc", "text_key", "at", "length", F.slice("w", F.greatest(F.col("at") + 1, F.lit(1)), F.col("length")).alias("run")).withColumn("hash", F.xxhash64("run"))
    found = runs.join(checked(windows.select("hash", "length", "words", "items"), BROADCAST_WINDOWS), ["hash", "length"]).where(F.col("run") == F.col("words"))
    each = found.groupBy("doc", "text_key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = F.aggregate(F.slice("spans", F.lit(2), F.greatest(F.size("spans") - 1, F.lit(0))), F.slice("spans", 1, 1), _joined)
    each = each.withColumn("spans", spans)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return each.select(F.col("doc").alias(key), "text_key", "spans", n_hit.alias("n_hit"), "items")


def _joined(spans, span) -> F.Column:
    """Add an interval that starts no earlier than the others: it prolongs the last one or stands alone."""
    last = F.element_at(spans, -1)
    longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
    return F.when(span["first"] <= last["end"], F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(longer))).otherwise(F.concat(spans, F.array(span)))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, n_items, items, contaminated. Null and empty texts have no words."""
    hits = find_hits(docs, benchmark, key, text).withColumnRenamed(key, "hit_key").withColumnRenamed("text_key", "hit_text")
    hits = checked(stage(hits, "hits"))
    rows = docs.select(F.col(key), _text_key(F.col(text)).alias("text_key"), F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    both = rows.join(hits, rows[key].eqNullSafe(hits["hit_key"]) & (rows["text_key"] == hits["hit_text"]), "left")
    return both.select(
        rows[key],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _without(text, spans) -> F.Column:
    """The text without the words in ``spans`` and without what stands before each of them."""
    pieces = F.split(text, f"(?<={_LETTER})(?={_OTHER})")  # each word with what stands before it, then the rest
    return F.array_join(F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (i >= s["first"]) & (i < s["end"]))), "")


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without benchmark passages; its columns stay as they are but for the text.

    A document that is benchmark text by ``WHOLE_SHARE`` or more of its words goes. In others the passages are cut out; what then
    meets could be a passage again, so changed documents are scanned again until none has hits; every round shortens them.
    Clean rows, null texts included, pass unchanged. The documents are not shuffled while the hits fit a broadcast.
    """
    columns = docs.columns
    clean, changed = [], docs
    while True:
        hits = stage(find_hits(changed, benchmark, key, text).select(F.col(key).alias("__key"), F.col("text_key").alias("__text"), F.col("spans").alias("__spans"), F.col("n_hit").alias("__hit")), "hits")
        if not hits.head(1):
            break
        same = changed[key].eqNullSafe(F.col("__key")) & (_text_key(changed[text]) == F.col("__text"))
        both = changed.join(checked(hits), same, "left")
        clean.append(both.where(F.col("__hit").isNull()).select(*columns))
        cut = both.where(F.col("__hit") < WHOLE_SHARE * F.size(words_of(F.col(text))))
        changed = stage(cut.withColumn(text, _without(F.col(text), F.col("__spans"))).select(*columns), "cut")
    for part in clean:
        changed = changed.unionByName(part)
    return changed
