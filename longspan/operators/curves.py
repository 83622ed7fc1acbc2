"""Daily curves per (person, concept) from irregular events.

Events shrink to one row per (person, concept, day) in a map-side combined
aggregate. From there every window holds at most one row per calendar day, so
a person or concept with a third of all events costs no more in one task than
the days of one history. Curves are worked out on the sparse event days and
days are filled in last, right before the trailing mean.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspan.functions.time import day_of, midnight, years_between
from longspan.operators.checked import daily_rules, kept_checked, require_types
from longspan.session import materialise

CURVE = ["person_id", "concept_id"]
# Writes an intermediate table once and reads it back.
Keep = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CurveOptions:
    """Windows in days; ``None`` leaves out the trailing mean or the carry."""

    pchip_window: int | None = 365
    intensity_window: int | None = 365
    binary_window: int | None = 365
    min_count: int = 10
    iterations: int = 100
    med_dates: bool = True
    round_up: bool = True

    @classmethod
    def windowed(cls, window: int | None, **options) -> "CurveOptions":
        return cls(window, window, window, **options)

    def __post_init__(self):
        for window in (self.pchip_window, self.intensity_window, self.binary_window):
            if window is not None and window < 1:
                raise ValueError("a window must be positive")
        if self.iterations < 1:
            raise ValueError("iterations must be positive")


# --- grid and daily rows -------------------------------------------------


def daily_events(data: DataFrame) -> DataFrame:
    """Events per day and the day's last value (ties: the larger value)."""
    latest = F.max(F.when(F.col("value").isNotNull(), F.struct("datetime", "value")))
    return data.groupBy(*CURVE, day_of(F.col("datetime")).alias("day")).agg(
        F.count("*").alias("n"), latest.alias("latest")
    ).select(*CURVE, "day", "n", F.col("latest.value").alias("value"))


def daily_with_midnight(events: DataFrame, keep: Keep = materialise) -> DataFrame:
    """Daily rows of all events, and of those exactly at midnight (n0, value0).

    A history that ends on a day sees the full days before it, and of that day
    only what carries midnight. Written once, so the events are read once.
    """
    day = day_of(F.col("datetime"))
    sharp = F.col("datetime") == midnight(day)
    seen = F.when(F.col("value").isNotNull(), F.struct("datetime", "value"))
    rows = events.groupBy(*CURVE, day.alias("day")).agg(
        F.count("*").alias("n"), F.max(seen).alias("latest"),
        F.count_if(sharp).alias("n0"), F.max(F.when(sharp, seen)).alias("latest0"),
    )
    return keep(rows.select(
        *CURVE, "day", "n", F.col("latest.value").alias("value"),
        "n0", F.col("latest0.value").alias("value0"),
    ))


def clip_daily(daily: DataFrame, bounds: DataFrame) -> DataFrame:
    """Daily rows from ``start`` up to midnight of the ``until`` day.

    A NULL bound is open. Persons without a row in ``bounds`` are left out.
    """
    ends = F.col("day") == F.col("until")
    return (
        daily.join(bounds.select("person_id", "start", "until"), "person_id")
        .filter((F.col("day") >= F.coalesce("start", "day")) & (F.col("day") <= F.coalesce("until", "day")))
        .select(*CURVE, "day", F.when(ends, F.col("n0")).otherwise(F.col("n")).alias("n"),
                F.when(ends, F.col("value0")).otherwise(F.col("value")).alias("value"))
        .filter(F.col("n") > 0)
    )


def day_grid(daily: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """First and last grid day per person, both inclusive."""
    seen = daily.groupBy("person_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    if bounds is None:
        return seen
    limits = bounds.select("person_id", "start", "until")
    return seen.join(limits, "person_id").select(
        "person_id",
        F.coalesce("start", "lo").alias("lo"),
        F.coalesce("until", "hi").alias("hi"),
    )


def grid_days(grid: DataFrame) -> DataFrame:
    return grid.select("person_id", F.explode(F.sequence("lo", "hi")).alias("day"))


def fractional_time(grid: DataFrame, start: Column | None = None) -> DataFrame:
    """Years of 365.25 days from ``start`` (default: the first grid day)."""
    origin = F.col("lo") if start is None else start
    return grid.select(
        "person_id", origin.alias("origin"), F.explode(F.sequence("lo", "hi")).alias("day")
    ).select("person_id", "day", years_between(F.col("origin"), F.col("day")).alias("value"))


def with_grid(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Attach the person's grid ends to the rows of each curve.

    Only one row per curve is joined on the person. The rows themselves move by
    (person, concept), the key of all later windows, so a person with very many
    rows is spread over its concepts and the windows need no further exchange.
    """
    curves = rows.select(*CURVE).distinct().join(grid, "person_id")
    return rows.join(curves, CURVE)


def trailing_mean(curve: DataFrame, window: int | None) -> DataFrame:
    """Mean over the last ``window`` days; over all days so far at the start."""
    if window is None:
        return curve
    last = Window.partitionBy(*CURVE).orderBy("day").rowsBetween(1 - window, 0)
    return curve.withColumn("value", F.avg("value").over(last))


def constant_curve(series: DataFrame, value: Column) -> DataFrame:
    """The same value on every day from ``lo`` to ``hi``."""
    return series.select(*CURVE, value.alias("value"), F.explode(F.sequence("lo", "hi")).alias("day"))


# --- monotone cubic interpolation ---------------------------------------


def pchip_knots(daily: DataFrame, grid: DataFrame) -> DataFrame:
    """Knots with their derivative and the next knot, one row per knot.

    Values are held flat from the outer observations to the grid ends. A single
    observation gives a constant. Interior derivatives are the weighted
    harmonic mean of the neighbouring slopes (zero at a turn); the ends use the
    one-sided three-point formula with its shape limits.
    """
    by_day = Window.partitionBy(*CURVE).orderBy("day")
    observed = (
        with_grid(daily.filter(F.col("value").isNotNull()), grid)
        .withColumns({
            "first": F.lag("day").over(by_day).isNull(),
            "last": F.lead("day").over(by_day).isNull(),
        })
    )

    def knot(at: str, wanted: Column, pad: bool) -> Column:
        return F.when(wanted, F.struct(F.col(at).alias("x"), F.col("value").alias("y"),
                                       F.lit(pad).alias("pad")))

    padded = F.filter(
        F.array(
            knot("lo", F.col("first") & (F.col("lo") < F.col("day")), True),
            knot("day", F.lit(True), False),
            knot("hi", F.col("last") & (F.col("hi") > F.col("day")), True),
        ),
        lambda k: k.isNotNull(),
    )
    knots = observed.select(*CURVE, F.explode(padded).alias("k")).select(*CURVE, "k.x", "k.y", "k.pad")

    w = Window.partitionBy(*CURVE).orderBy("x")
    gap = F.datediff(F.lead("x").over(w), F.col("x")).cast("double")
    rise = F.lead("y").over(w) - F.col("y")
    knots = knots.withColumns({"h1": gap, "m1": rise / gap, "x1": F.lead("x").over(w),
                               "y1": F.lead("y").over(w)})
    knots = knots.withColumns({
        "h0": F.lag("h1").over(w), "m0": F.lag("m1").over(w),
        "h2": F.lead("h1").over(w), "m2": F.lead("m1").over(w),
        "hb": F.lag("h1", 2).over(w), "mb": F.lag("m1", 2).over(w),
    })
    slope = knot_derivative()
    return knots.withColumn("d", slope).withColumn("d1", F.lead("d").over(w)).select(
        *CURVE, "x", "y", "d", "x1", "y1", "d1", "pad"
    )


def _end_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    raw = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (
        F.when(F.signum(raw) != F.signum(m0), F.lit(0.0))
        .when((F.signum(m0) != F.signum(m1)) & (F.abs(raw) > 3 * F.abs(m0)), 3 * m0)
        .otherwise(raw)
    )


def knot_derivative() -> Column:
    """Derivative from the slopes m and gaps h: b, 0 before; 1, 2 after."""
    h0, m0, h1, m1 = F.col("h0"), F.col("m0"), F.col("h1"), F.col("m1")
    before, after = 2 * h1 + h0, h1 + 2 * h0
    interior = F.when(m0 * m1 > 0, (before + after) / (before / m0 + after / m1)).otherwise(0.0)
    return (
        F.when(m0.isNull() & m1.isNull(), F.lit(0.0))
        .when(m0.isNull() & F.col("m2").isNull(), m1)
        .when(m0.isNull(), _end_slope(h1, F.col("h2"), m1, F.col("m2")))
        .when(m1.isNull() & F.col("mb").isNull(), m0)
        .when(m1.isNull(), _end_slope(h0, F.col("hb"), m0, F.col("mb")))
        .otherwise(interior)
    )


def hermite(t: Column, h: Column, y0: Column, y1: Column, d0: Column, d1: Column) -> Column:
    """Cubic through (0, y0) and (h, y1) with end slopes d0 and d1, at t."""
    m = (y1 - y0) / h
    c = (3 * m - 2 * d0 - d1) / h
    b = (d0 + d1 - 2 * m) / (h * h)
    return y0 + t * (d0 + t * (c + t * b))


def fill_knots(knots: DataFrame) -> DataFrame:
    """Daily values between the knots; the last knot stands for itself."""
    until = F.coalesce(F.date_sub("x1", 1), F.col("x"))
    days = knots.withColumn("day", F.explode(F.sequence("x", until)))
    t = F.datediff("day", "x").cast("double")
    h = F.datediff("x1", "x").cast("double")
    inner = hermite(t, h, F.col("y"), F.col("y1"), F.col("d"), F.col("d1"))
    value = F.when(F.col("x1").isNull() | (F.col("day") == F.col("x")), F.col("y")).otherwise(inner)
    return days.select(*CURVE, "day", value.alias("value"))


def pchip_curve(daily: DataFrame, grid: DataFrame, window: int | None) -> DataFrame:
    return trailing_mean(fill_knots(pchip_knots(daily, grid)), window)


# --- event intensity -----------------------------------------------------


def histogram_shifts(min_count: int, iterations: int) -> Mapping[int, float]:
    """Start shifts of the equal-count histograms and their weights.

    Shifts are whole events, so at most ``min_count`` of them differ.
    """
    m = max(min_count, 1)
    drawn = [m * i // iterations for i in range(iterations)]
    return {s: drawn.count(s) / iterations for s in sorted(set(drawn))}


def event_mass(daily: DataFrame) -> DataFrame:
    """Running number of events before and up to each event day."""
    w = Window.partitionBy(*CURVE).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    upto = daily.withColumn("upto", F.sum("n").over(w))
    return upto.withColumn("before", F.col("upto") - F.col("n"))


def _density_steps(mass: DataFrame, min_count: int, iterations: int) -> DataFrame:
    """Changes of the averaged histogram density, as (day offset, change).

    Each histogram cuts the event mass at s + m, s + 2m, ... while at least m
    events stay to the right; a day's events spread evenly over the day. All
    cuts inside one event day but the first and the last only separate bins of
    the day's own density, so two rows per day and shift carry everything.
    """
    m = max(min_count, 1)
    shifts = histogram_shifts(min_count, iterations)
    table = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(w).alias("w"))
                      for s, w in shifts.items()])
    rows = mass.withColumn("shift", F.explode(table)).select(
        *CURVE, "lo", "hi", "flat", "total", "day", "n", "before", "upto",
        F.col("shift.s").alias("s"), F.col("shift.w").alias("w"),
    )
    # Levels s + j*m with before < level <= upto, 1 <= j and level <= total - m.
    first = F.greatest(F.lit(1), F.floor((F.col("before") - F.col("s")) / m) + 1)
    last = F.floor((F.least("upto", F.col("total") - m) - F.col("s")) / m)
    offset = F.datediff("day", "lo")

    def cut(j: str) -> Column:
        level = F.col("s") + F.col(j) * m
        at = offset - 0.5 + (level - F.col("before")) / F.col("n")
        return F.struct(at.alias("t"), level.cast("double").alias("mass"))

    cuts = (
        rows.withColumns({"j0": first, "j1": last})
        .filter(F.col("j1") >= F.col("j0"))
        .withColumn("c", F.explode(F.array_distinct(F.array(cut("j0"), cut("j1")))))
        .select(*CURVE, "lo", "hi", "flat", "total", "s", "w", "c.t", "c.mass")
    )
    w = Window.partitionBy(*CURVE, "s").orderBy("mass")
    end = F.datediff("hi", "lo") + 0.5
    steps = cuts.withColumns({
        "t0": F.coalesce(F.lag("t").over(w), F.lit(-0.5)),
        "q0": F.coalesce(F.lag("mass").over(w), F.lit(0.0)),
        "t1": F.coalesce(F.lead("t").over(w), end),
        "q1": F.coalesce(F.lead("mass").over(w), F.col("total").cast("double")),
        "opening": F.lag("t").over(w).isNull(),
    })
    left = (F.col("mass") - F.col("q0")) / (F.col("t") - F.col("t0"))
    right = (F.col("q1") - F.col("mass")) / (F.col("t1") - F.col("t"))
    changes = F.array(
        F.struct(F.when(F.col("opening"), F.lit(-0.5)).alias("t"), (left * F.col("w")).alias("change")),
        F.struct(F.col("t"), ((right - left) * F.col("w")).alias("change")),
    )
    return (
        steps.select(*CURVE, "lo", "hi", "flat", F.explode(changes).alias("c"))
        .select(*CURVE, "lo", "hi", "flat", "c.t", "c.change")
        .filter(F.col("t").isNotNull())
    )


def _shift_mass(series: DataFrame, min_count: int, iterations: int) -> DataFrame:
    """Histograms without any cut: one bin with all events (rare, large shifts)."""
    m = max(min_count, 1)
    uncut = [(s, w) for s, w in histogram_shifts(min_count, iterations).items() if s > 0]
    if not uncut:
        return series.withColumn("flat", F.lit(0.0))
    weight = reduce(
        lambda a, b: a + b,
        [F.when(F.col("total") < s + 2 * m, F.lit(w)).otherwise(0.0) for s, w in uncut],
    )
    days = F.datediff("hi", "lo") + 1
    return series.withColumn("flat", weight * F.col("total") / days)


def intensity_curve(
    daily: DataFrame, grid: DataFrame, min_count: int, iterations: int, window: int | None
) -> DataFrame:
    """Events per day.

    Fewer than 2 * min_count events give the constant n / days. Otherwise the
    curve averages equal-count histograms with shifted starts: each bin holds
    at least min_count events, and the curve sums to n.
    """
    total = daily.groupBy(*CURVE).agg(F.sum("n").alias("total"))
    series = total.join(grid, "person_id")
    days = F.datediff("hi", "lo") + 1
    few = F.col("total") < 2 * min_count
    constant = constant_curve(series.filter(few), F.col("total") / days)

    busy = _shift_mass(series.filter(~few), min_count, iterations)
    mass = event_mass(daily.join(busy, CURVE))
    steps = _density_steps(mass, min_count, iterations)
    # A change at t raises its own day by the part after t and all later days.
    # Every curve has a change at its first day, where the first bins open.
    offset = F.greatest(F.lit(0), F.floor(F.col("t") + 0.5)).cast("int")
    changes = steps.groupBy(*CURVE, F.date_add("lo", offset).alias("day")).agg(
        F.first("hi").alias("hi"), F.first("flat").alias("flat"),
        F.sum("change").alias("later"),
        F.sum(F.col("change") * (offset + 0.5 - F.col("t"))).alias("now"),
    )
    w = Window.partitionBy(*CURVE).orderBy("day")
    level = changes.withColumns({
        "level": F.sum("later").over(w) + F.col("flat"),
        "next": F.lead("day").over(w),
    })
    days = level.withColumn("at", F.explode(F.sequence("day", F.coalesce(F.date_sub("next", 1), "hi"))))
    value = F.when(F.col("at") == F.col("day"), F.col("level") - F.col("later") + F.col("now")).otherwise(
        F.col("level")
    )
    varied = days.select(*CURVE, F.col("at").alias("day"),
                         F.greatest(value, F.lit(0.0)).alias("value"))
    return trailing_mean(varied, window).unionByName(constant)


# --- binary carry ---------------------------------------------------------


def marked_days(daily: DataFrame, reference: DataFrame, grid: DataFrame) -> DataFrame:
    """Each concept's 0/1 mark on every reference day of its person, with the grid."""
    concepts = daily.select(*CURVE).distinct().join(grid, "person_id")
    events = daily.select(*CURVE, "day", F.lit(1).alias("mark"))
    return (
        concepts.join(reference, "person_id")
        .join(events, [*CURVE, "day"], "left")
        .withColumn("mark", F.coalesce("mark", F.lit(0)))
    )


def binary_curve(
    daily: DataFrame, reference: DataFrame, grid: DataFrame, window: int | None, round_up: bool
) -> DataFrame:
    """1 on days nearest to a reference day with the event, else 0.

    Linear interpolation of the marks, rounded, is the nearest mark; half-way
    days round up or down. The ``window`` days after each event are set to 1.
    """
    w = Window.partitionBy(*CURVE).orderBy("day")
    event_day = F.when(F.col("mark") == 1, F.col("day"))
    spans = (
        marked_days(daily, reference, grid)
        .withColumns({
            "next_day": F.lead("day").over(w),
            "next_mark": F.lead("mark").over(w),
            "event": F.last(event_day, ignorenulls=True).over(w),
            "first": F.lag("day").over(w).isNull(),
        })
    )
    start = F.when(F.col("first"), F.col("lo")).otherwise(F.col("day"))
    stop = F.coalesce(F.date_sub("next_day", 1), F.col("hi"))
    days = spans.withColumns({"start": start, "stop": stop}).filter(
        F.col("start") <= F.col("stop")
    ).withColumn("at", F.explode(F.sequence("start", "stop")))
    to_prev = F.abs(F.datediff("at", "day"))
    to_next = F.datediff("next_day", "at")
    tie = F.greatest("mark", "next_mark") if round_up else F.least("mark", "next_mark")
    nearest = (
        F.when(F.col("next_day").isNull() | (to_prev < to_next), F.col("mark"))
        .when(to_prev > to_next, F.col("next_mark"))
        .otherwise(tie)
    )
    # Days before the first mark take the first mark.
    nearest = F.when(F.col("at") < F.col("day"), F.col("mark")).otherwise(nearest)
    if window is not None:
        since = F.datediff("at", "event")
        nearest = F.when(since.between(1, window), 1).otherwise(nearest)
    return days.select(*CURVE, F.col("at").alias("day"), nearest.cast("double").alias("value"))


# --- dispatch ---------------------------------------------------------------


def _mode(daily: DataFrame, mode: str) -> DataFrame:
    return daily.filter(F.col("data_mode") == mode).drop("data_mode")


def build_curves(
    data: DataFrame, meta: DataFrame, bounds: DataFrame | None = None,
    options: CurveOptions = CurveOptions(), keep: Keep = materialise,
) -> DataFrame:
    """Daily curve (person_id, concept_id, day, value) of each known concept.

    Conditions become intensities, measurements monotone interpolations and
    medications binary carries. Other modes have no curve; matrix assembly
    supplies their fill value. ``bounds`` (person_id, start DATE, until DATE)
    clips the events and sets the grid; otherwise each person's grid runs from
    the first to the last event. The daily rows are written once: the three
    kinds and the grid all read them, and the events are read once. ``keep``
    says how; tables kept by person need no exchange for the person joins.
    """
    if bounds is None:
        daily = keep(daily_events(data))
    else:
        daily = clip_daily(daily_with_midnight(data, keep), bounds)
    return curves_of_daily(daily, meta, bounds, options)


def on_grid(daily: DataFrame, grid: DataFrame) -> DataFrame:
    """Daily rows with their grid's ends and the day before of the same curve, for the rules of daily rows."""
    by_day = Window.partitionBy(*CURVE).orderBy("day")
    curves = daily.select(*CURVE).distinct().join(grid.select("person_id", "lo", "hi"), "person_id", "left")
    return daily.join(curves, CURVE).withColumn("before", F.lag("day").over(by_day))


def checked_daily(daily: DataFrame, grid: DataFrame, keep: Keep = materialise) -> DataFrame:
    """Daily rows that lie on their person's grid of two or more days, one per curve and day.

    The rows are written once and counted on the way; a breach raises with its
    number of rows. Wrong types of columns raise before anything runs.
    """
    require_types(daily, "daily rows", {"day": T.DateType(), "value": T.DoubleType()})
    require_types(grid, "grid", {"lo": T.DateType(), "hi": T.DateType()})
    return kept_checked(on_grid(daily, grid), "daily rows", daily_rules(), keep).select(*daily.columns)


def curves_of_daily(
    daily: DataFrame, meta: DataFrame, bounds: DataFrame | None = None, options: CurveOptions = CurveOptions(),
    validate: bool = False, keep: Keep = materialise,
) -> DataFrame:
    """The curves of kept or stored daily rows, as ``daily_events`` gives them.

    ``validate`` writes the rows once more with ``keep`` and raises for those that
    :func:`checked_daily` refuses.
    """
    grid = day_grid(daily, bounds)
    if validate:
        daily = checked_daily(daily, grid, keep)
    known = daily.join(meta.select("concept_id", "data_mode"), "concept_id")
    medications = _mode(known, "Medication")
    reference = medications if options.med_dates else daily
    return (
        intensity_curve(_mode(known, "Condition"), grid, options.min_count,
                        options.iterations, options.intensity_window)
        .unionByName(pchip_curve(_mode(known, "Measurement"), grid, options.pchip_window))
        .unionByName(
            binary_curve(medications, reference.select("person_id", "day").distinct(), grid,
                         options.binary_window, options.round_up)
        )
    )


def legacy_curves(
    frame: DataFrame, options: CurveOptions = CurveOptions(), bounds: DataFrame | None = None
) -> DataFrame:
    """Curves of string-keyed rows (person_id, date, mode, channel, value).

    Adds Age in years from the ``Age`` row's birth date, and Sex and Race as 1
    on every day. Returns (person_id, mode, channel, day, value).
    """
    dated = frame.filter(F.col("date").isNotNull())
    channels = dated.filter(~F.col("mode").isin("Age", "Sex", "Race")).withColumn(
        "concept_id", F.xxhash64("mode", "channel")
    )
    events = channels.select(
        "person_id", "concept_id", F.col("date").cast("timestamp_ntz").alias("datetime"),
        F.expr("try_cast(value as double)").alias("value"),
    )
    names = channels.select("concept_id", "mode", "channel").distinct()
    meta = names.select("concept_id", F.col("mode").alias("data_mode"))
    curves = build_curves(events, meta, bounds, options).join(names, "concept_id")
    grid = day_grid(daily_events(events), bounds)
    constants = frame.filter(F.col("mode").isin("Age", "Sex", "Race")).join(grid, "person_id")
    days = constants.withColumn("day", F.explode(F.sequence("lo", "hi")))
    age = F.datediff("day", F.expr("try_cast(value as date)")) / 365.25
    fixed = days.select(
        "person_id", "mode", "channel", "day",
        F.when(F.col("mode") == "Age", age).otherwise(1.0).alias("value"),
    )
    return curves.select("person_id", "mode", "channel", "day", "value").unionByName(fixed)


# --- use of curves --------------------------------------------------------


def cross_section(
    curves: DataFrame, index: DataFrame, grid: DataFrame | None = None, off_grid: str = "raise",
) -> DataFrame:
    """Curve values on the sampled days.

    Samples off their person's days have no values: they raise while the rows are
    joined, in the same pass. With ``grid`` (person_id, lo, hi) a sample must lie on
    it; without, some curve of its person must have the day. ``off_grid="drop"``
    leaves such samples out, and :func:`outside_grid` lists them.
    """
    if off_grid not in ("raise", "drop"):
        raise ValueError("off_grid is raise or drop")
    asked = index.select("person_id", day_of(F.col("datetime")).alias("day")).distinct()
    values = curves.select(*CURVE, "day", "value")
    if off_grid == "drop":
        return values.join(asked, ["person_id", "day"]).select(*CURVE, "day", "value")
    message = F.format_string(
        "a sample lies outside the days of its person: person %s, %s",
        F.col("person_id").cast("string"), F.col("day").cast("string"))

    def insist(rows: DataFrame, inside: Column) -> DataFrame:
        return rows.filter(F.when(F.coalesce(inside, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))

    if grid is not None:
        placed = asked.join(grid.select("person_id", "lo", "hi"), "person_id", "left")
        asked = insist(placed, F.col("day").between(F.col("lo"), F.col("hi"))).select("person_id", "day")
        return asked.join(values, ["person_id", "day"]).select(*CURVE, "day", "value")
    met = asked.join(values, ["person_id", "day"], "left")
    return insist(met, F.col("concept_id").isNotNull()).select(*CURVE, "day", "value")


def outside_grid(grid: DataFrame, index: DataFrame) -> DataFrame:
    """Samples with no grid day; empty for a valid index."""
    asked = index.select("person_id", day_of(F.col("datetime")).alias("day")).distinct()
    joined = asked.join(grid, "person_id", "left")
    inside = F.col("day").between(F.col("lo"), F.col("hi"))
    return joined.filter(~F.coalesce(inside, F.lit(False))).select("person_id", "day")


def constant_curves(curves: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per curve its first value and whether every day stays close to it.

    Close means |value - first| <= atol + rtol * |value|, tested against every
    value; the test runs on the extremes of the two one-sided bounds, so a
    plain aggregate suffices.
    """
    def closest(first: Column, value: Column) -> Column:
        return F.abs(value - first) <= atol + rtol * F.abs(value)

    firsts = curves.groupBy(*CURVE).agg(
        F.min_by("value", "day").alias("first"),
        F.min("value").alias("least"), F.max("value").alias("most"),
        F.count("*").alias("days"),
    )
    # The bound grows with |value| slower than the distance does (rtol < 1),
    # so the extremes decide for all values in between.
    constant = closest(F.col("first"), F.col("least")) & closest(F.col("first"), F.col("most"))
    return firsts.select(*CURVE, "days", constant.alias("is_constant"),
                         F.when(constant, F.col("first")).alias("constant"))


def compressed_curves(curves: DataFrame) -> DataFrame:
    """Constant curves as one number, the others as an array in day order.

    An array holds one entry per grid day of one curve.
    """
    flags = constant_curves(curves).select(*CURVE, "is_constant", "constant")
    dense = (
        curves.join(flags.filter(~F.col("is_constant")).select(*CURVE), CURVE)
        .groupBy(*CURVE)
        .agg(F.sort_array(F.collect_list(F.struct("day", "value"))).alias("points"))
        .select(*CURVE, F.transform("points", lambda p: p["value"]).alias("dense"))
    )
    return flags.join(dense, CURVE, "left")


def age_samples(
    index: DataFrame, cohort: DataFrame, mean: float | Column | None = None,
    sdev: float | Column | None = None, unit: float = 365.25,
) -> DataFrame:
    """Age in years at each sample, optionally standardised."""
    value = F.datediff("datetime", "birth_date") / F.lit(unit)
    if mean is not None:
        value = value - mean
    if sdev is not None:
        value = value / sdev
    return index.join(cohort.select("person_id", "birth_date"), "person_id").select(
        "person_id", "datetime", value.alias("value")
    )


def demographic_samples(index: DataFrame, cohort: DataFrame, concepts: list[int]) -> DataFrame:
    """One-hot demographic concepts at each sample; ``concepts`` is a short list."""
    own = F.array("gender_concept_id", "race_concept_id")
    table = F.array(*[F.lit(c).cast("long") for c in concepts])
    return index.join(
        cohort.select("person_id", "gender_concept_id", "race_concept_id"), "person_id"
    ).select(
        "person_id", "datetime", own.alias("own"), F.explode(table).alias("concept_id")
    ).select(
        "person_id", "datetime", "concept_id",
        F.coalesce(F.array_contains("own", F.col("concept_id")), F.lit(False))
        .cast("double").alias("value"),
    )


def cohort_demographics(cohort: DataFrame) -> DataFrame:
    """(concept_id, person_id) rows of gender and race, for semi joins."""
    return cohort.select(
        F.explode(F.array("gender_concept_id", "race_concept_id")).alias("concept_id"), "person_id"
    ).filter(F.col("concept_id").isNotNull()).distinct()
