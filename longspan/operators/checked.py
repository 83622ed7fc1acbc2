"""Checks of data, counted in the pass that makes the result.

A rule is a condition on a row; NULL breaks it. ``Checks.watch`` lets rows pass
and counts the breaches of every rule on the way, as observed metrics, so a check
reads no table of its own. The counts are there when an action has read the
watched rows to their end; ``verify`` then raises with all broken rules at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspan.session import materialise

_ROWS = "rows"


class Checks:
    """Rules of one or more tables and the breaches that an action counted."""

    def __init__(self):
        self._watched: list[tuple[str, list[str], Observation]] = []

    def watch(self, df: DataFrame, name: str, rules: Mapping[str, Column]) -> DataFrame:
        """The same rows; each rule's breaches are counted as they pass.

        ``name`` tells tables apart in reports. Rows dropped by a limit are not seen.
        """
        metrics = Observation()
        self._watched.append((name, list(rules), metrics))
        broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"rule{i}") for i, rule in enumerate(rules.values())]
        return df.observe(metrics, F.count(F.lit(1)).alias(_ROWS), *broken)

    def report(self) -> list[tuple[str, str, int, int]]:
        """(table, rule, rows, breaches) after an action; it waits for one. A table planned away has no rows."""
        found = []
        for name, rules, metrics in self._watched:
            counts = metrics.get
            found += [(name, rule, counts.get(_ROWS, 0), counts.get(f"rule{i}", 0)) for i, rule in enumerate(rules)]
        return found

    def verify(self) -> None:
        broken = [f"{name}: {rule} ({n} of {rows} rows)" for name, rule, rows, n in self.report() if n]
        if broken:
            raise ValueError("; ".join(broken))


def kept_checked(
    df: DataFrame, name: str, rules: Mapping[str, Column], keep: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """Rows written once by ``keep``; raises if a written row broke a rule."""
    checks = Checks()
    kept = keep(checks.watch(df, name, rules))
    checks.verify()
    return kept


def require_types(df: DataFrame, name: str, types: Mapping[str, T.DataType]) -> DataFrame:
    """Columns must have these types; read from the schema alone."""
    wrong = [
        f"{column} is {df.schema[column].dataType.simpleString() if column in df.columns else 'missing'}, "
        f"not {kind.simpleString()}"
        for column, kind in types.items() if column not in df.columns or df.schema[column].dataType != kind
    ]
    if wrong:
        raise ValueError(f"{name}: " + "; ".join(wrong))
    return df


def event_rules() -> dict[str, Column]:
    """Events carry a person, a concept and a moment; a value is a number or NULL."""
    value = F.col("value")
    return {
        "a person": F.col("person_id").isNotNull(),
        "a concept": F.col("concept_id").isNotNull(),
        "a moment": F.col("datetime").isNotNull(),
        "a finite value": value.isNull() | ~(F.isnan(value) | (F.abs(value) == float("inf"))),
    }


def visit_rules() -> dict[str, Column]:
    """Visits carry a person and both ends, and end no earlier than they start."""
    return {
        "a person": F.col("person_id").isNotNull(),
        "a start": F.col("start_datetime").isNotNull(),
        "an end": F.col("end_datetime").isNotNull(),
        "start before end": F.coalesce(F.col("start_datetime") <= F.col("end_datetime"), F.lit(True)),
    }


def daily_rules() -> dict[str, Column]:
    """Daily rows with their grid (lo, hi) and the day before of the same curve (before)."""
    value = F.col("value")
    return {
        "two days of grid": F.col("lo") < F.col("hi"),
        "a day on the grid": F.col("day").between(F.col("lo"), F.col("hi")),
        "one row per day": F.coalesce(F.col("before") < F.col("day"), F.lit(True)),
        "an event": F.col("n") > 0,
        "a finite value": value.isNull() | ~(F.isnan(value) | (F.abs(value) == float("inf"))),
    }
