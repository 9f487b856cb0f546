"""Train/test splits. Each returns the input rows with a ``split`` column: ``train`` or ``test``.

Random splits order rows by a seeded digest of their unique key, so the same seed always picks the
same rows. No split sorts the table or puts a whole run into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import RUN, STATUS, TIMESTAMP, require_columns
from ..functions.timebase import floor_time, frequency_micros
from ..storage import small_side, stage
from .ordering import GROUP_ROWS, seeded_digest
from .selection import FINAL_ROWS, first_rows_condition

SPLIT, TRAIN, TEST = "split", "train", "test"

# Leading digits of the digest that make a bucket of a large stratum: 16**4 buckets. The digest is
# uniform, so the bucket with the cut, the only one that is ranked, holds 1/65536 of the stratum.
_DIGITS = 4
# Time buckets summed up in one first-level group of a running total.
_BUCKETS_PER_GROUP = 1024


def _label(is_test: Column) -> Column:
    return F.when(is_test, TEST).otherwise(TRAIN).alias(SPLIT)


def _check_fraction(test_size: float) -> None:
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be between 0 and 1")


def part(df: DataFrame, which: str) -> DataFrame:
    """The ``train`` or ``test`` rows of a split table, without the split column."""
    return df.where(F.col(SPLIT) == which).drop(SPLIT)


def test_quotas(sizes: DataFrame, groups: Sequence[str], stratum: str | None, test_size: float) -> DataFrame:
    """Test rows per stratum: ceil(n * test_size) per group, shared in proportion to the strata.

    Training rows go to the strata by largest remainder, ties by stratum name; the rest is test. A
    group with a single row trains.
    """
    whole = Window.partitionBy(*groups)
    total = F.sum("n").over(whole)
    to_test = F.when(total == 1, 0).otherwise(F.ceil(total.cast("double") * F.lit(test_size))).cast("decimal(19,0)")
    table = sizes.withColumn("_total", total.cast("decimal(19,0)")).withColumn("_train", F.col("_total") - to_test)
    product = F.col("n").cast("decimal(19,0)") * F.col("_train")
    table = table.withColumn("_rest", product % F.col("_total"))
    table = table.withColumn("_share", ((product - F.col("_rest")) / F.col("_total")).cast("bigint"))
    by_rest = whole.orderBy(F.desc("_rest"), *([stratum] if stratum else []))
    spare = F.col("_train").cast("bigint") - F.sum("_share").over(whole)
    extra = (F.row_number().over(by_rest) <= spare).cast("bigint")
    return table.withColumn("quota", F.col("n") - F.col("_share") - extra).drop("_total", "_train", "_rest", "_share")


def _take_first_by_digest(
    df: DataFrame, groups: list[str], stratum: str | None, test_size: float, key: str, seed: int, limit: int
) -> DataFrame:
    """Mark as test the rows with the smallest digests of each stratum, as many as its quota.

    The last chosen (digest, key) of each stratum is found first, from narrow columns; the rows are
    then labelled in one pass without being moved.
    """
    strata = [*groups, *([stratum] if stratum else [])]
    named = {s: f"_k_{s}" for s in strata}
    match = [F.col(s).eqNullSafe(F.col(k)) for s, k in named.items()]
    digest = seeded_digest(key, seed)
    narrow = df.select(*dict.fromkeys([*strata, key]), digest.alias("_digest"))

    sizes = stage(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")), "strata")
    digits = 0 if (sizes.agg(F.max("n")).first()[0] or 0) <= limit else _DIGITS
    quotas = test_quotas(sizes, groups, stratum, test_size).where(F.col("quota") > 0)
    quotas = quotas.select(*[F.col(s).alias(k) for s, k in named.items()], "quota")
    narrow = narrow.withColumn("_bucket", F.substring("_digest", 1, digits))
    if digits:
        counts = narrow.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = sizes.select(*strata, F.lit("").alias("_bucket"), F.col("n").alias("_n"))
    upto = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .join(small_side(quotas), match)
        .where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(
            *named.values(),
            F.col("_bucket").alias("_cut"),
            (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"),
        )
    )
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_digest", key))
    border = narrow.join(small_side(cut), [*match, F.col("_bucket") == F.col("_cut")])
    last = (
        border.withColumn("_place", place)
        .where(F.col("_place") == F.col("_need"))
        .select(*named.values(), F.col("_digest").alias("_last_digest"), F.col(key).alias("_last_key"))
    )
    # A stratum with quota zero has no last row and stays in training.
    marked = df.withColumn("_digest", digest).join(small_side(last), match, "left")
    same = (F.col("_digest") == F.col("_last_digest")) & (F.col(key) <= F.col("_last_key"))
    is_test = F.coalesce((F.col("_digest") < F.col("_last_digest")) | same, F.lit(False))
    return marked.select(*df.columns, _label(is_test))


def split_by_run(
    df: DataFrame,
    key: str,
    test_size: float = 0.2,
    seed: int = 42,
    run: str = RUN,
    stratum: str | None = STATUS,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Send ceil(n * test_size) rows of every run to test, in proportion to the run's statuses."""
    _check_fraction(test_size)
    require_columns(df, run, key)
    stratum = stratum if stratum in df.columns else None
    return _take_first_by_digest(df, [run], stratum, test_size, key, seed, limit)


def split_stratified(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, stratum: str = STATUS, limit: int = GROUP_ROWS
) -> DataFrame:
    """Random split of the whole table in proportion to the classes of ``stratum``."""
    _check_fraction(test_size)
    require_columns(df, stratum, key)
    return _take_first_by_digest(df, [], stratum, test_size, key, seed, limit)


def split_by_hash(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Send a row to test where the first 32 bits of its key's seeded digest lie below ``test_size``.

    The share is met on average only, but a row's side depends on nothing but its own key: it stays when rows are added,
    needs no count, and works on a stream. Rows with a null key all go to one side.
    """
    _check_fraction(test_size)
    require_columns(df, key)
    # Hexadecimal digits of one length sort like the numbers they write.
    below = f"{int(test_size * 2**32):08x}"
    digest = seeded_digest(key, seed)
    return df.withColumn(SPLIT, _label(F.substring(digest, 1, 8) < F.lit(below)))


def split_whole_runs(df: DataFrame, test_size: float = 0.2, run: str = RUN) -> DataFrame:
    """The last max(1, int(runs * test_size)) run ids are test, so no run is on both sides."""
    require_columns(df, run)
    runs = df.select(run).where(F.col(run).isNotNull()).distinct()
    n_test = max(1, int(runs.count() * test_size))
    cut = runs.orderBy(F.desc(run)).limit(n_test).agg(F.min(run)).first()[0]
    return df.withColumn(SPLIT, _label(F.coalesce(F.col(run) >= F.lit(cut), F.lit(False))))


def split_chronological(
    df: DataFrame, key: str, test_size: float = 0.2, time: str = TIMESTAMP, final_rows: int = FINAL_ROWS
) -> DataFrame:
    """The first int(n * (1 - test_size)) rows by time train, the rest tests."""
    _check_fraction(test_size)
    n_train = int(df.count() * (1 - test_size))
    return df.withColumn(SPLIT, _label(~first_rows_condition(df, time, key, n_train, final_rows)))


def bucket_class_counts(df: DataFrame, window: str, classes: Sequence[str], time: str = TIMESTAMP, stratum: str = STATUS) -> DataFrame:
    """Rows per time bucket and class, one column per class, zero where there are none."""
    bucket = floor_time(F.col(time), window).alias("bucket")
    table = df.where(F.col(time).isNotNull()).groupBy(bucket).pivot(stratum, list(classes)).agg(F.count(F.lit(1)))
    return table.na.fill(0, list(classes))


def reverse_cumulative(table: DataFrame, bucket: str, window: str, measures: Sequence[str]) -> DataFrame:
    """Add ``{measure}_after``: sums from the latest bucket back to and including each row's.

    Buckets are summed in groups of consecutive ones first, so no task holds all of them.
    """
    span = _BUCKETS_PER_GROUP * frequency_micros(window)
    grouped = table.withColumn("_group", F.floor(F.unix_micros(bucket) / F.lit(span)))
    inside = Window.partitionBy("_group").orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(F.desc("_group")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        grouped.groupBy("_group")
        .agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
        .select("_group", *[F.coalesce(F.sum(f"_s_{m}").over(later), F.lit(0)).alias(f"_o_{m}") for m in measures])
    )
    summed = grouped.select("*", *[F.sum(m).over(inside).alias(f"_i_{m}") for m in measures])
    return summed.join(small_side(offsets), "_group").select(
        *table.columns, *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"{m}_after") for m in measures]
    )


def split_stratified_time(
    df: DataFrame,
    test_size: float = 0.2,
    window: str = "1H",
    time: str = TIMESTAMP,
    stratum: str = STATUS,
) -> DataFrame:
    """Whole time buckets, from the latest back, until test holds enough rows of every class.

    Enough is max(1, int(n * test_size)) per class and in total. If that is never reached every
    bucket is test. A bucket in which no row has a class stays in training, as do rows without a time.
    """
    _check_fraction(test_size)
    require_columns(df, time, stratum)
    sizes = {row[0]: row[1] for row in df.groupBy(stratum).count().collect()}
    n_rows = sum(sizes.values())
    sizes.pop(None, None)
    if not sizes:
        return df.withColumn(SPLIT, F.lit(TRAIN))
    names = {c: f"class_{i}" for i, c in enumerate(sorted(sizes))}
    bucket = floor_time(F.col(time), window)
    counted = (
        df.where(F.col(time).isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(*[F.count_if(F.col(stratum) == c).alias(n) for c, n in names.items()], F.count(F.lit(1)).alias("rows"))
    )
    classed = counted.where(sum((F.col(n) for n in names.values()), F.lit(0)) > 0)
    totals = reverse_cumulative(classed, "bucket", window, [*names.values(), "rows"])
    enough = F.col("rows_after") >= max(1, int(n_rows * test_size))
    for c, n in names.items():
        enough = enough & (F.col(f"{n}_after") >= max(1, int(sizes[c] * test_size)))
    cut, earliest = totals.agg(F.max(F.when(enough, F.col("bucket"))), F.min("bucket")).first()
    start = cut or earliest
    # A bucket without any classed row is never test.
    bare = counted.where(sum((F.col(n) for n in names.values()), F.lit(0)) == 0).select(F.col("bucket").alias("_bare"))
    marked = df.withColumn("_bucket", bucket)
    if not bare.isEmpty():
        marked = marked.join(small_side(bare), F.col("_bucket") == F.col("_bare"), "left")
    else:
        marked = marked.withColumn("_bare", F.lit(None).cast("timestamp"))
    is_test = F.coalesce((F.col("_bucket") >= F.lit(start)) & F.col("_bare").isNull(), F.lit(False))
    return marked.select(*df.columns, _label(is_test))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("rows"))


def leaked_runs(df: DataFrame, run: str = RUN) -> DataFrame:
    """Run ids that have rows on both sides of a split."""
    sides = df.groupBy(run).agg(F.count_if(F.col(SPLIT) == TRAIN).alias("a"), F.count_if(F.col(SPLIT) == TEST).alias("b"))
    return sides.where("a > 0 and b > 0").select(run)


def run_folds(df: DataFrame, run: str = RUN) -> DataFrame:
    """One fold per run, in run order: that run is test, all others train.

    The table lists the folds with their sizes; rows are not copied per fold. Use
    ``df.withColumn('split', ...)`` on the fold's run, or :func:`fold_split`.
    """
    sizes = df.where(F.col(run).isNotNull()).groupBy(run).agg(F.count(F.lit(1)).alias("test_rows"))
    everything = F.sum("test_rows").over(Window.partitionBy())
    return sizes.select(
        F.row_number().over(Window.orderBy(run)).alias("fold"),
        run,
        "test_rows",
        (everything - F.col("test_rows")).alias("train_rows"),
    )


def fold_split(df: DataFrame, test_run, run: str = RUN) -> DataFrame:
    return df.withColumn(SPLIT, _label(F.col(run).eqNullSafe(F.lit(test_run))))
