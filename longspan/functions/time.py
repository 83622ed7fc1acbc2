"""Column expressions on dates and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
SECONDS_PER_DAY = 86400


def day_of(moment: Column) -> Column:
    return moment.cast("date")


def midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def whole_second(moment: Column) -> Column:
    """Drop the fraction of a second, on the wall clock."""
    fraction = F.extract(F.lit("SECOND"), moment) % 1
    return moment - F.make_dt_interval(secs=fraction.cast("decimal(18,6)"))


def second_number(moment: Column) -> Column:
    """Whole seconds since 1970-01-01 on the wall clock, free of time zones."""
    days = F.unix_date(moment.cast("date")).cast("long")
    return (
        days * SECONDS_PER_DAY
        + F.hour(moment) * 3600
        + F.minute(moment) * 60
        + F.floor(F.second(moment)).cast("long")
    )


def from_second_number(seconds: Column) -> Column:
    """Inverse of :func:`second_number`."""
    return F.date_add(
        F.lit("1970-01-01").cast("date"), F.floor(seconds / SECONDS_PER_DAY).cast("int")
    ).cast("timestamp_ntz") + F.make_dt_interval(
        secs=F.pmod(seconds, F.lit(SECONDS_PER_DAY)).cast("decimal(18,6)")
    )


def day_span(start: Column, stop: Column) -> Column:
    """Days between two moments by their dates."""
    return F.datediff(day_of(stop), day_of(start)).cast("long")


def years_between(start: Column, day: Column) -> Column:
    """Fractional years of 365.25 days."""
    return F.datediff(day, start) / F.lit(DAYS_PER_YEAR)


def recency(delta_days: Column, tau: Column) -> Column:
    """1 / (1 + delta / tau); 1 at the observation, towards 0 with age."""
    return F.lit(1.0) / (F.lit(1.0) + delta_days / tau)


def overlaps(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    """Closed intervals share a point."""
    return (a_start <= b_stop) & (b_start <= a_stop)


def sin_cos_encoding(
    offset: Column, dim: int = 64, decay_rate: float = 10_000.0, interleave: bool = True
) -> Column:
    """Sine/cosine position code of a real offset as ``ARRAY<DOUBLE>``."""
    if dim % 2:
        raise ValueError("dim must be even")
    rates = [math.exp(-math.log(decay_rate) * i / dim) for i in range(0, dim, 2)]
    waves = [(F.sin(offset * r), F.cos(offset * r)) for r in rates]
    if interleave:
        return F.array(*[part for pair in waves for part in pair])
    return F.array(*[s for s, _ in waves], *[c for _, c in waves])


def cued_encoding(offset: Column, cue: Column | None = None, **options) -> Column:
    """Code of ``offset``, plus the code of the distance to a cue time."""
    code = sin_cos_encoding(offset, **options)
    if cue is None:
        return code
    distance = sin_cos_encoding(F.abs(cue - offset), **options)
    return F.zip_with(code, distance, lambda a, b: a + b)
