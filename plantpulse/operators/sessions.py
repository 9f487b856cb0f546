"""Sessions: stretches of a run without a pause, found by merging.

Rows less than a gap apart are one session, so all rows of one gap-long time bucket are: they are summed up first, map-side,
and only the buckets in use are ordered. A run that holds a third of all rows costs no more than its busy buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import RUN, STATUS, TIMESTAMP, require_columns
from ..functions.timebase import frequency_interval, frequency_micros
from ..storage import stage
from .features import sensor_columns
from .filters import nan_to_null
from .ordering import GROUP_ROWS, with_previous, with_running_totals

SESSION, START, END, ROWS = "session", "session_start", "session_end", "rows"


def _measures(sensors: Sequence[str]) -> list[Column]:
    """Least, greatest and mean value of each sensor."""
    kinds = {"min": F.min, "max": F.max, "mean": F.avg}
    return [f(F.col(s).cast("double")).alias(f"{s}_{k}") for s in sensors for k, f in kinds.items()]


def sessions(
    df: DataFrame, gap: str = "30min", sensors: Sequence[str] | None = None, run: str = RUN, time: str = TIMESTAMP, limit: int = GROUP_ROWS
) -> DataFrame:
    """(run, session, session_start, session_end, rows, measures): a session ends where the next row is more than ``gap`` later.

    Sessions are numbered from 1 in each run; the end is the time of the last row. Rows without a time or run are left out, and
    repeated rows count again. Missing values do not count in the measures.
    """
    require_columns(df, run, time)
    names = list(sensors if sensors is not None else sensor_columns(df, time, STATUS, (run,)))
    micros = frequency_micros(gap)
    rows = nan_to_null(df.where(F.col(time).isNotNull() & F.col(run).isNotNull()))
    value = {s: F.col(s).cast("double") for s in names}
    sums = [f(v).alias(f"_{k}_{s}") for s, v in value.items() for k, f in (("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))]
    bucket = F.floor(F.unix_micros(time) / F.lit(micros)).alias("_bucket")
    buckets = rows.groupBy(run, bucket).agg(F.min(time).alias("_from"), F.max(time).alias("_to"), F.count(F.lit(1)).alias("_rows"), *sums)
    paired = with_previous(stage(buckets, "busy-buckets"), [run], ["_bucket"], {"_before": F.col("_to")}, limit)
    pause = F.unix_micros("_from") - F.unix_micros("_before")
    begins = F.coalesce(pause > micros, F.lit(True)).cast("bigint")
    numbered = with_running_totals(paired.withColumn("_begins", begins), [run], ["_bucket"], {SESSION: F.col("_begins")}, limit)
    measures = [
        c.alias(f"{s}_{k}")
        for s in names
        for k, c in (("min", F.min(f"_min_{s}")), ("max", F.max(f"_max_{s}")), ("mean", F.sum(f"_sum_{s}") / F.nullif(F.sum(f"_n_{s}"), F.lit(0))))
    ]
    return numbered.groupBy(run, SESSION).agg(F.min("_from").alias(START), F.max("_to").alias(END), F.sum("_rows").alias(ROWS), *measures)


def stream_sessions(
    df: DataFrame, gap: str = "30min", delay: str = "10min", sensors: Sequence[str] | None = None, run: str = RUN, time: str = TIMESTAMP
) -> DataFrame:
    """The sessions of a stream, without their number; in append mode each leaves when the watermark has passed its gap.

    State is one row per open session. Rows more than ``delay`` behind are dropped by Spark.
    """
    names = list(sensors if sensors is not None else sensor_columns(df, time, STATUS, (run,)))
    rows = nan_to_null(df.where(F.col(time).isNotNull() & F.col(run).isNotNull())).withWatermark(time, frequency_interval(delay))
    # Event times pass through the window column only, so the last one is kept as a number.
    rows = rows.withColumn("_micros", F.unix_micros(time))
    found = rows.groupBy(F.session_window(time, frequency_interval(gap)).alias("_session"), run).agg(
        F.max("_micros").alias("_last"), F.count(F.lit(1)).alias(ROWS), *_measures(names)
    )
    kept = [c for c in found.columns if c not in ("_session", "_last", run)]
    return found.select(run, F.col("_session.start").alias(START), F.timestamp_micros("_last").alias(END), *kept)
