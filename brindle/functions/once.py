"""Values used several times in one expression, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it, also within the functions of arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
