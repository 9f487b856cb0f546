"""Exact order statistics and quantiles without sorting the table.

Spark's exact ``percentile`` keeps every distinct value of a group in one state, which a hot group
outgrows. Groups of up to ``GROUP_ROWS`` values use it directly. For larger ones the wanted value
is closed in on: each pass over the data counts, exactly, how many values lie below, on and
between two trial values taken from an approximate grid, and keeps the interval with the wanted
rank. An interval shrinks about a hundredfold per pass, whatever the distribution; when at most
``FINAL_ROWS`` values are left in it they are ranked. Only aggregates are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import small_side, stage
from .ordering import GROUP_ROWS

# Values left in an interval that one task may rank.
FINAL_ROWS = 100_000
_GRID = 256
# Constant key under which an ungrouped table is one group.
_ALL = "_all"


def _same(names: Sequence[str]) -> list[Column]:
    return [F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in names]


def _prefixed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"_k_{n}" for n in names})


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, final_rows: int = FINAL_ROWS
) -> DataFrame:
    """The ``rank``-th smallest (1-based) non-null ``value`` for each row (keys, rank) of ``ranks``.

    Returns (keys, rank, value). ``ranks`` must be small and hold ranks that exist.
    """
    kind = df.schema[value].dataType.simpleString()
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    nothing = F.lit(None).cast(kind)
    # Open interval (_lo, _hi), null meaning unbounded; _trial_* are the next two values to test.
    state = ranks.select(
        *keys,
        "rank",
        F.col("rank").alias("_r"),
        nothing.alias("_lo"),
        nothing.alias("_hi"),
        nothing.alias("_trial_lo"),
        nothing.alias("_trial_hi"),
        F.lit(None).cast("bigint").alias("_inside"),
        nothing.alias("_found"),
    )
    names = [*keys, "rank"]
    done = []
    while True:
        state = stage(state, "ranks")
        done.append(state.where(F.col("_found").isNotNull()).select(*names, F.col("_found").alias(value)))
        last = state.where(F.col("_found").isNull() & (F.col("_inside") <= final_rows))
        done.append(_rank_rest(rows, keys, last, value))
        state = state.where(F.col("_found").isNull() & (F.col("_inside").isNull() | (F.col("_inside") > final_rows)))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
        state = _narrow(rows, keys, state, kind)


def _within(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """Rows joined with the open intervals they lie in."""
    side = _prefixed(state, keys)
    x, low, high = F.col("_x"), F.col("_lo"), F.col("_hi")
    inside = (low.isNull() | (x > low)) & (high.isNull() | (x < high))
    return rows.join(small_side(side), [*_same(keys), inside], "inner").drop(
        *[f"_k_{k}" for k in keys]
    )


def _narrow(rows: DataFrame, keys: Sequence[str], state: DataFrame, kind: str) -> DataFrame:
    x, low, high = F.col("_x"), F.col("_trial_lo"), F.col("_trial_hi")
    tried = low.isNotNull()
    middle = ~tried | ((x > low) & (x < high))
    grid = F.percentile_approx(
        F.when(middle, x), [i / _GRID for i in range(_GRID + 1)], F.lit(40 * _GRID)
    )
    carried = ["_r", "_lo", "_hi", "_trial_lo", "_trial_hi"]
    counted = (
        _within(rows, keys, state)
        .groupBy(*keys, "rank", *carried)
        .agg(
            F.count_if(tried & (x < low)).alias("_n_under"),
            F.count_if(tried & (x == low)).alias("_n_low"),
            F.count_if(middle).alias("_n_middle"),
            F.count_if(tried & (x == high) & (high > low)).alias("_n_high"),
            F.count_if(tried & (x > high)).alias("_n_over"),
            grid.alias("_grid"),
        )
    )
    r = F.col("_r")
    under = F.col("_n_under")
    on_low = under + F.col("_n_low")
    in_middle = on_low + F.col("_n_middle")
    on_high = in_middle + F.col("_n_high")
    left, hit_low, mid, hit_high = r <= under, r <= on_low, r <= in_middle, r <= on_high
    nothing = F.lit(None).cast(kind)
    at_low, at_high = (~left) & hit_low, ~hit_low & ~mid & hit_high
    in_mid = ~hit_low & mid
    moved = counted.select(
        *keys,
        "rank",
        F.when(left, r).when(in_mid, r - on_low).otherwise(r - on_high).alias("_r"),
        F.when(left, F.col("_lo")).when(in_mid, F.coalesce(low, F.col("_lo"))).otherwise(high).alias("_lo"),
        F.when(left, low).when(in_mid, F.coalesce(high, F.col("_hi"))).otherwise(F.col("_hi")).alias("_hi"),
        F.when(left, under).when(in_mid, F.col("_n_middle")).otherwise(F.col("_n_over")).alias("_inside"),
        F.when(at_low, low).when(at_high, high).otherwise(nothing).alias("_found"),
        F.when(in_mid, F.col("_grid")).alias("_grid"),
    )
    # One grid step of slack on both sides covers the error of the approximate grid.
    cell = F.floor(F.try_divide(F.col("_r") * _GRID, "_inside")).cast("int")
    pick = lambda i: F.try_element_at("_grid", F.least(F.lit(_GRID + 1), F.greatest(F.lit(1), i)))
    return moved.select(
        *keys,
        "rank",
        "_r",
        "_lo",
        "_hi",
        pick(cell).alias("_trial_lo"),
        pick(cell + 3).alias("_trial_hi"),
        "_inside",
        "_found",
    )


def _rank_rest(rows: DataFrame, keys: Sequence[str], state: DataFrame, value: str) -> DataFrame:
    """Rank the few values left in each interval."""
    w = Window.partitionBy(*keys, "rank").orderBy("_x")
    ranked = _within(rows, keys, state).withColumn("_place", F.row_number().over(w))
    return ranked.where(F.col("_place") == F.col("_r")).select(*keys, "rank", F.col("_x").alias(value))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    limit: int = GROUP_ROWS,
    final_rows: int = FINAL_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group: (keys, n, quantiles array).

    Groups without a non-null value are left out.
    """
    if not keys:
        whole = grouped_quantiles(df.withColumn(_ALL, F.lit(0)), [_ALL], value, fractions, limit, final_rows)
        return whole.drop(_ALL)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    direct = [F.count(value).alias("n"), F.percentile(value, F.array(*map(F.lit, fractions))).alias("quantiles")]
    if largest <= limit:
        return rows.groupBy(*keys).agg(*direct).where("n > 0")

    hot = stage(sizes.where(F.col("n") > limit), "hot")
    near = small_side(_prefixed(hot, keys))
    is_hot = _same(keys)
    cool = rows.join(near, is_hot, "left_anti").groupBy(*keys).agg(*direct).where("n > 0")

    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(f) * (F.col("n") - 1)).alias("at")) for i, f in enumerate(fractions)])
    wanted = hot.select(*keys, "n", F.inline(spots))
    ranks = wanted.select(*keys, F.explode(F.array(F.floor("at") + 1, F.ceil("at") + 1)).alias("rank")).distinct()
    values = order_statistics(rows.join(near, is_hot, "left_semi"), keys, value, stage(ranks, "ranks"), final_rows)
    values = values.withColumnRenamed(value, "_v")
    table = _prefixed(values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_at")), keys)
    joined = wanted.join(table, _same(keys), "inner")
    low, high = F.floor("at") + 1, F.ceil("at") + 1
    below, above = F.col("_at")[low].cast("double"), F.col("_at")[high].cast("double")
    part = F.col("at") - F.floor("at")
    quantile = F.when(low == high, below).otherwise(below * (1 - part) + above * part)
    hot_result = (
        joined.select(*keys, "n", "i", quantile.alias("q"))
        .groupBy(*keys, "n")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda e: e["q"]).alias("quantiles"))
    )
    return cool.unionByName(hot_result.select(*keys, "n", "quantiles"))


def column_quantiles(
    df: DataFrame, names: Sequence[str], fractions: Sequence[float], final_rows: int = FINAL_ROWS
) -> dict[str, list[float]]:
    """Exact linear-interpolated quantiles of whole columns, as numbers; columns without a value are left out.

    All columns are closed in on together, one aggregate over the unmoved rows a pass, with the trial values as literals.
    Values are compared as doubles; nulls and NaN are no values.
    """
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in names}
    sizes = df.agg(*[F.count(x[c]).alias(c) for c in names]).first() if names else {}
    spots = {c: [f * (sizes[c] - 1) for f in fractions] for c in names if sizes[c]}
    wanted = {(c, rank) for c, places in spots.items() for at in places for rank in (math.floor(at) + 1, math.ceil(at) + 1)}
    # (rank inside, low, high) of each wanted (column, rank): an interval whose ends belong to it.
    state = {k: (k[1], -math.inf, math.inf) for k in sorted(wanted)}
    found: dict[tuple[str, int], float] = {}
    points = F.array(*[F.lit(j / _GRID) for j in range(_GRID + 1)])
    while state:
        # Ranks of a column that are still in one interval share its counts.
        spans = {s: i for i, s in enumerate(sorted({(c, low, high) for (c, _), (_, low, high) in state.items()}))}
        row = df.agg(*[a for (c, low, high), i in spans.items() for a in _interval(x[c], low, high, i, points)]).first()
        moved, few = {}, {}
        for k, (r, low, high) in state.items():
            i = spans[(k[0], low, high)]
            under, on_low, between, grid = (row[f"{part}_{i}"] for part in ("under", "low", "between", "grid"))
            r -= under
            if r <= on_low:
                found[k] = low
            elif r > on_low + between:
                found[k] = high
            elif between <= final_rows:
                few[k] = (r - on_low, low, high)
            else:
                # The grid's error is a fortieth of a step; the whole rank is asked for in the next pass, over all rows.
                cell = (r - on_low) * _GRID // between
                moved[k] = (k[1], grid[max(0, cell - 1)], grid[min(_GRID, cell + 2)])
        found |= _ranked_inside(df, x, few)
        state = moved
    at = lambda c, spot: (found[c, math.floor(spot) + 1], found[c, math.ceil(spot) + 1], spot - math.floor(spot))
    mixed = lambda low, high, part: low if low == high else low * (1 - part) + high * part
    return {c: [mixed(*at(c, spot)) for spot in places] for c, places in spots.items()}


def _interval(x: Column, low: float, high: float, i: int, points: Column) -> list[Column]:
    """Counts under, on the low end of and between the ends of an interval, and a grid of the values between."""
    inside = (x > F.lit(low)) & (x < F.lit(high))
    return [
        F.count_if(x < F.lit(low)).alias(f"under_{i}"),
        F.count_if(x == F.lit(low)).alias(f"low_{i}"),
        F.count_if(inside).alias(f"between_{i}"),
        F.percentile_approx(F.when(inside, x), points, F.lit(40 * _GRID)).alias(f"grid_{i}"),
    ]


def _ranked_inside(df: DataFrame, x: dict[str, Column], few: dict[tuple[str, int], tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """The values of ranks whose open intervals are known to hold few values; each interval is sorted once."""
    spans = {s: i for i, s in enumerate(sorted({(c, low, high) for (c, _), (_, low, high) in few.items()}))}
    if not spans:
        return {}
    place = lambda k: spans[(k[0], *few[k][1:])]
    values = {
        i: F.array_sort(F.collect_list(F.when((x[c] > F.lit(low)) & (x[c] < F.lit(high)), x[c]))) for (c, low, high), i in spans.items()
    }
    sorted_row = df.agg(*[v.alias(f"v_{i}") for i, v in values.items()])
    picked = sorted_row.select(*[F.element_at(f"v_{place(k)}", F.lit(r)).alias(f"p_{j}") for j, (k, (r, _, _)) in enumerate(few.items())]).first()
    return {k: picked[j] for j, k in enumerate(few)}


def nth_value(df: DataFrame, value: str, n: int, final_rows: int = FINAL_ROWS):
    """The ``n``-th smallest (1-based) non-null value of a column."""
    ranks = df.sparkSession.range(1).select(F.lit(0).alias(_ALL), F.lit(n).cast("bigint").alias("rank"))
    return order_statistics(df.withColumn(_ALL, F.lit(0)), [_ALL], value, ranks, final_rows).first()[value]


def first_rows_condition(
    df: DataFrame, time: str, key: str, n: int, final_rows: int = FINAL_ROWS
) -> Column:
    """Condition that holds for exactly the first ``n`` rows in (time, key) order, null times last.

    The cut is found by counting, so no row is moved or sorted. ``key`` must be a number and unique
    among equal times.
    """
    if not isinstance(df.schema[key].dataType, T.NumericType):
        raise ValueError("the key that decides between equal times must be a number")
    if n <= 0:
        return F.lit(False)
    micros = df.select(F.unix_micros(time).alias("t"), F.col(key).alias("k"))
    rows, dated = micros.agg(F.count(F.lit(1)), F.count("t")).first()
    t, k = F.unix_micros(time), F.col(key)
    if n < dated and rows <= final_rows:
        cut, last_key = micros.orderBy(F.col("t").asc_nulls_last(), "k").offset(n - 1).first()
        return _up_to(t, k, cut, last_key)
    if n > dated:
        undated = micros.where("t is null")
        if n >= rows:
            return F.lit(True)
        last_key = nth_value(undated, "k", n - dated, final_rows)
        return t.isNotNull() | (k <= F.lit(last_key))
    cut = nth_value(micros, "t", n, final_rows)
    before = micros.where(F.col("t") < F.lit(cut)).count()
    last_key = nth_value(micros.where(F.col("t") == F.lit(cut)), "k", n - before, final_rows)
    return _up_to(t, k, cut, last_key)


def _up_to(t: Column, k: Column, cut: int, last_key) -> Column:
    return F.coalesce((t < F.lit(cut)) | ((t == F.lit(cut)) & (k <= F.lit(last_key))), F.lit(False))


def slice_rows(df: DataFrame, time: str, key: str, start: int, stop: int) -> DataFrame:
    """Rows at positions ``start`` (included) to ``stop`` (excluded), from 0, in (time, key) order."""
    if not 0 <= start <= stop:
        raise ValueError("a slice needs 0 <= start <= stop")
    return df.where(first_rows_condition(df, time, key, stop) & ~first_rows_condition(df, time, key, start))
