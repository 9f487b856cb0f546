"""What the text operators share: bounded Arrow batches, labelled samples and checked broadcasts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage

# Rows of whole text that one Python worker holds at a time.
TEXT_ROWS = 256
# Narrow tables of at most so many rows may be broadcast; beyond it the join shuffles.
BROADCAST_LIMIT = 500_000


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most ``TEXT_ROWS`` rows, so long texts fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 8_192):
    """For what is written inside: batches of ``rows`` narrow rows, where small ones would cost more than the work."""
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        bounded_batches(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df``, which is staged and so cheap to count, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def held_out(key) -> F.Column:
    """True where crc32 of the key as text leaves no remainder by 5: rows that no fit may see."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, target) of at most ``rows`` labelled documents outside the held-out fold, one for each of the first keys by a hash.

    The bounded label table is broadcast, so the documents are scanned once; rows of a sampled key meet map-side, and the text
    of the least hash stays. A key with several labels takes the largest; null keys, null labels and null texts are left out.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(target).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias(key))
        .agg(F.max(target).cast("int").alias(target))
        .orderBy(F.xxhash64(key), key)
        .limit(rows)
    )
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.col(text).alias(text))
    told = texts.join(F.broadcast(stage(chosen, "labels")), key)
    one = told.groupBy(key, target).agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"))).alias("least"))
    return one.select(key, F.col("least.t").alias(text), target)
