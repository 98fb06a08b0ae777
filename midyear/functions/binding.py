"""Name an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Columns are trees, so using a long expression five times copies it five
    times, and nesting such uses multiplies the copies.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(value: Column) -> Column:
    """For a select list: ``value`` as a finished column.

    A generator of one row; unlike a plain projection it is not copied into the
    filters and projections that follow it.
    """
    return F.explode(F.array(value))
