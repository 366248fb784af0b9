"""Arrow functions that are made when they are first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def kernel(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function over Arrow arrays, as a function over columns that returns ``kind``."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column) -> Column:
            return F.arrow_udf(f, kind)(*columns)

        call.__name__, call.__doc__ = f.__name__, f.__doc__
        return call

    return wrap
