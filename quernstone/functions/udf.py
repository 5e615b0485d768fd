"""Arrow UDFs that are made when they are used, as their types need a session to be read."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable:
    """As pandas_udf(kind), but the module that uses it can be imported without a session."""

    def made(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return made
