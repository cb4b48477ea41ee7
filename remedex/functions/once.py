"""A value that several expressions share, worked out once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value. Within it the value is a bound name, not a copy of its expression at each place."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
