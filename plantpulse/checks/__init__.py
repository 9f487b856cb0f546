"""The registered queries, each with the SQL its result is compared with."""

from __future__ import annotations

from . import (
    aggregates,
    cleaning,
    learning,
    measures,
    ordering,
    partitions,
    scanning,
    streams,
)
from .base import Check

CHECKS: dict[str, Check] = {}
for _module in (scanning, cleaning, aggregates, measures, ordering, partitions, learning, streams):
    CHECKS.update(_module.CHECKS)
