"""Registration of queries and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a query and, where SQL can say it, its SQL text."""
        def add(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql.strip()
            return function
        return add


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded without a negative zero.

    Parallel sums differ in the last bits. Halves of short decimals are common
    in the data and would round either way, so values move a little off them.
    """
    column = F.col(value) if isinstance(value, str) else value
    cut = F.round(column + F.lit(2.718e-3 * float(f"1e-{digits}")), digits)
    return F.when(cut == 0, F.lit(0.0)).otherwise(cut)


def text(moment: Column | str) -> Column:
    column = F.col(moment) if isinstance(moment, str) else moment
    return column.cast("string")
