"""Arrow UDFs that are made when used: declaring one needs a session, which workers and plain imports lack."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType


def arrow_udf(returns: str) -> Callable:
    def declare(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns, PandasUDFType.SCALAR)(*columns)

        del call.__wrapped__
        return call

    return declare
