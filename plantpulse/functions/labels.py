"""Fine-grained labels read off file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import FAILURE_TYPES, UNKNOWN_LABEL, WARNING_TYPES


def file_stem(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def _first_contained(name: Column, labels) -> Column:
    choices = [F.when(name.contains(label), F.lit(label)) for label in labels]
    return F.coalesce(*choices, F.lit(UNKNOWN_LABEL))


def warning_label(stem: Column) -> Column:
    return _first_contained(stem, WARNING_TYPES)


def failure_label(stem: Column) -> Column:
    return _first_contained(stem, FAILURE_TYPES)


def layered_labels(path: Column, stem: Column | None = None) -> tuple[Column, Column]:
    """(warning type, failure type) for a path: at most one is set, and a warning path wins.

    Give the ``stem`` as a column of its own when labelling many rows, so it is cut out once a row.
    """
    stem = file_stem(path) if stem is None else stem
    lowered = F.lower(path)
    is_warning = lowered.contains("warning")
    is_failure = lowered.contains("failure")
    return F.when(is_warning, warning_label(stem)), F.when(~is_warning & is_failure, failure_label(stem))
