"""Values that an expression uses more than once, computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: lambdas hide it from rules that would copy it to each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
