"""Values that are computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is never replaced by its expression, while the
    optimizer may copy a projected column's to wherever it is used, into lambdas that run once an element too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
