"""Health-status columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import NORMAL, STATUS_CODES, STATUS_REPAIRS, UNKNOWN_STATUS_CODE


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def clean_status(status: Column) -> Column:
    """Status without surrounding white space and with cut-off labels made whole."""
    stripped = F.regexp_replace(status, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.try_element_at(_literal_map(STATUS_REPAIRS), stripped), stripped)


def status_code(status: Column, codes: dict[str, int] = STATUS_CODES) -> Column:
    """Number for a status; any label outside ``codes``, and null, gives the unknown code."""
    return F.coalesce(F.try_element_at(_literal_map(codes), status), F.lit(UNKNOWN_STATUS_CODE))


def fault_type(status: Column, warning_type: Column, failure_type: Column) -> Column:
    """``none`` for a normal status, else the failure type or, without one, the warning type."""
    return F.when(status == NORMAL, "none").otherwise(F.coalesce(failure_type, warning_type))
