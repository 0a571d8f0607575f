"""Rounding that makes query results comparable with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.scalars import col

# Added before rounding, so that a decimal tie at the seventh digit does not
# depend on the order in which a mean was summed.
TIE_NUDGE = 3.3e-8


def round6(c: Column | str) -> Column:
    return F.round(col(c) + TIE_NUDGE, 6)
