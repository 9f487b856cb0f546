"""Row order within runs: ordinals, running counts, neighbours, shuffles.

A plain window over ``partitionBy(run)`` puts a whole run into one task, and one run may hold a
third of all rows. Each operator here therefore first counts the largest group. Up to
``GROUP_ROWS`` rows a plain window is used. Beyond, rows are range-partitioned on
(groups, order) - balanced however skewed the runs are, because the order ends in a unique key -
staged once with their block and slot, windowed inside (block, group), and joined with the short
table of block summaries. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_side, stage

# Largest group that one task may sort.
GROUP_ROWS = 1_000_000

# Buckets in which groups are counted together to find out whether any can be large.
_COUNT_BUCKETS = 1 << 16

_BLOCK, _SLOT = "_block", "_slot"


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    sizes = df.groupBy(*groups).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def large_groups(df: DataFrame, groups: Sequence[str], limit: int = GROUP_ROWS) -> DataFrame | None:
    """The groups of more than ``limit`` rows, None if there are none.

    Rows are counted per bucket of groups first, which moves a few numbers per task however many groups there are. Groups
    are counted by themselves only in buckets that hold more than ``limit`` rows.
    """
    placed = df.select(*groups, F.pmod(F.xxhash64(*groups), F.lit(_COUNT_BUCKETS)).alias("_bucket"))
    full = [r[0] for r in placed.groupBy("_bucket").count().where(F.col("count") > limit).collect()]
    if not full:
        return None
    inside = placed.where(F.col("_bucket").isin(full)).groupBy(*groups).count().where(F.col("count") > limit).drop("count")
    found = stage(inside, "large")
    return None if found.isEmpty() else found


def _fits_window(df: DataFrame, groups: Sequence[str], limit: int) -> bool:
    return largest_group(df, groups) <= limit


def _plain_window(groups: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*groups).orderBy(*order)


def _staged_blocks(df: DataFrame, groups: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Rows in (groups, order) with the range block they fell into and their place inside it.

    Blocks are as many as keep one near ``limit`` rows, and no fewer than the session's shuffle partitions.
    """
    keys = [*groups, *order]
    row_id = F.monotonically_increasing_id()
    number = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // limit))
    # The generated id holds the partition number above bit 33 and the row number below.
    placed = (
        df.repartitionByRange(number, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", row_id)
        .select("*", F.shiftright("_id", 33).alias(_BLOCK), F.col("_id").bitwiseAND((1 << 33) - 1).alias(_SLOT))
        .drop("_id")
    )
    return stage(placed, "ordered")


def _join_blocks(df: DataFrame, summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach block summaries; null group values match each other."""
    keys = [_BLOCK, *groups]
    renamed = summary.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[c for c in summary.columns if c not in keys],
    )
    match = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    joined = df.join(small_side(renamed), match, "left")
    return joined.drop(*[f"_s_{k}" for k in keys])


def with_running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add running sums (current row included) of whole-number columns within each group.

    ``order`` must end in a unique key, so that the order is total.
    """
    if _fits_window(df, groups, limit):
        upto = _plain_window(groups, order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(upto).alias(name) for name, c in totals.items()])

    blocks = _staged_blocks(df.select("*", *[c.alias(f"_t_{n}") for n, c in totals.items()]), groups, order, limit)
    within = Window.partitionBy(_BLOCK, *groups).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*groups).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(_BLOCK, *groups)
        .agg(*[F.sum(f"_t_{n}").alias(f"_b_{n}") for n in totals])
        .select(
            _BLOCK,
            *groups,
            *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals],
        )
    )
    summed = blocks.select("*", *[F.sum(f"_t_{n}").over(within).alias(n) for n in totals])
    joined = _join_blocks(summed, offsets, groups)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in totals])


def with_ordinal(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "ordinal", limit: int = GROUP_ROWS
) -> DataFrame:
    """Add the 1-based position of each row within its group (``groups`` empty: within the table)."""
    return with_running_totals(df, groups, order, {name: F.lit(1).cast("bigint")}, limit)


def with_neighbours(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add values of the previous and of the next row of the group (null at its ends), from one ordering of the rows."""
    sides = {side: (shift, edge, dict(values)) for side, shift, edge, values in (
        ("before", F.lag, F.max_by, previous or {}), ("after", F.lead, F.min_by, following or {})
    ) if values}
    if _fits_window(df, groups, limit):
        w = _plain_window(groups, order)
        return df.select("*", *[shift(c).over(w).alias(n) for shift, _, values in sides.values() for n, c in values.items()])

    carried = [F.struct(*[c.alias(n) for n, c in values.items()]).alias(f"_v_{s}") for s, (_, _, values) in sides.items()]
    blocks = _staged_blocks(df.select("*", *carried), groups, order, limit)
    within = Window.partitionBy(_BLOCK, *groups).orderBy(_SLOT)
    between = Window.partitionBy(*groups).orderBy(_BLOCK)
    edges = blocks.groupBy(_BLOCK, *groups).agg(*[edge(f"_v_{s}", _SLOT).alias(f"_e_{s}") for s, (_, edge, _) in sides.items()])
    edges = edges.select(_BLOCK, *groups, *[shift(f"_e_{s}").over(between).alias(f"_o_{s}") for s, (shift, _, _) in sides.items()])
    inside = blocks.select("*", *[shift(f"_v_{s}").over(within).alias(f"_i_{s}") for s, (shift, _, _) in sides.items()])
    joined = _join_blocks(inside, edges, groups)
    found = {s: F.coalesce(f"_i_{s}", f"_o_{s}") for s in sides}
    return joined.select(*df.columns, *[found[s][n].alias(n) for s, (_, _, values) in sides.items() for n in values])


def with_previous(df, groups, order, values: Mapping[str, Column], limit: int = GROUP_ROWS) -> DataFrame:
    """Add values of the previous row of the group (null on its first row)."""
    return with_neighbours(df, groups, order, previous=values, limit=limit)


def with_next(df, groups, order, values: Mapping[str, Column], limit: int = GROUP_ROWS) -> DataFrame:
    """Add values of the next row of the group (null on its last row)."""
    return with_neighbours(df, groups, order, following=values, limit=limit)


def sort_by_time(df: DataFrame, time: str, key: str) -> DataFrame:
    """Chronological order with the key deciding ties (range partitioned by Spark)."""
    return df.orderBy(time, key)


def seeded_digest(key: str, seed: int) -> Column:
    """Pseudo-random but reproducible text per key: the same seed gives the same order anywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in a reproducible random order."""
    return df.withColumn("_digest", seeded_digest(key, seed)).orderBy("_digest", key).drop("_digest")


def last_rows(df: DataFrame, time: str, key: str, n: int = 10) -> DataFrame:
    """The latest ``n`` rows, a top-n without a full sort."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def fill_window(df: DataFrame, groups: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Repeat the rows of every group shorter than ``size`` until it holds ``size`` rows.

    Copies follow each other in row order and the last one is cut. Only groups below ``size`` rows
    are ranked; longer ones pass through. Adds the 1-based ``position`` (null in long groups).
    """
    short = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < size)
    named = short.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_n")
    short = small_side(named)
    # Null-safe: rows without a key are a group too.
    same = reduce(Column.__and__, [df[g].eqNullSafe(F.col(f"_of_{g}")) for g in groups])
    rows = df.join(short, same, "inner")
    place = F.row_number().over(_plain_window(groups, order))
    repeated = (
        rows.withColumn("_place", place)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.lit(size) / F.col("_n")))))
        .withColumn("position", F.col("_copy") * F.col("_n") + F.col("_place"))
        .where(F.col("position") <= size)
        .select(*df.columns, "position")
    )
    rest = df.join(short, same, "left_anti").withColumn("position", F.lit(None).cast("bigint"))
    return repeated.unionByName(rest)
