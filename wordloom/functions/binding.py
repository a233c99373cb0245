"""One evaluation for a value that several places of an expression use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` as a lambda variable.  Projections do not
    give that: the optimiser merges them, and a scalar such as an array's
    maximum would be computed again for every element of a ``transform``."""
    return F.element_at(F.transform(F.array(value), use), 1)
