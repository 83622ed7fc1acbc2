"""Point-in-time sampling: each sample sees only events up to its own day.

The curve of every (person, sample) pair differs, since its history ends at the
sample. Rebuilding it per sample would read each history once per sample.
Instead the running state of the full history is worked out once per event day
and each sample looks up the state it needs, with windows of at most one row
per calendar day. What a later event would have changed (the last intervals of
the interpolation, the last bins of the intensity) is recomputed in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.time import day_of, midnight
from longspan.operators.curves import (
    CURVE,
    CurveOptions,
    Keep,
    _end_slope,
    daily_with_midnight,
    event_mass,
    histogram_shifts,
    pchip_knots,
)
from longspan.session import materialise

SAMPLE = [*CURVE, "dt"]


def first_moments(ehr: DataFrame) -> DataFrame:
    return ehr.groupBy("person_id").agg(F.min("datetime").alias("first"))


def _sampled_days(index: DataFrame) -> DataFrame:
    return index.select("person_id", day_of(F.col("datetime")).alias("dt")).distinct()


def projection_misses(index: DataFrame, ehr: DataFrame) -> DataFrame:
    """Samples that are not after the person's first event."""
    early = F.coalesce(midnight(F.col("dt")) > F.col("first"), F.lit(False))
    joined = _sampled_days(index).join(first_moments(ehr), "person_id", "left")
    return joined.filter(~early).select("person_id", F.col("dt").alias("day"))


def without_misses(index: DataFrame, misses: DataFrame) -> DataFrame:
    days = index.withColumn("day", day_of(F.col("datetime")))
    return days.join(misses, ["person_id", "day"], "left_anti").drop("day")


def _looked_up(states: DataFrame, today: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """State before, and midnight row of, each queried day in one window.

    ``states`` is (keys, day, state), ``today`` (keys, day, today) and ``asked``
    (keys, day, query). Within a day the midnight row comes first, then the
    queries, then the day's full state, which a query must not see.
    """
    def row(df: DataFrame, kind: int) -> DataFrame:
        def column(name: str, source: DataFrame) -> Column:
            if name in df.columns:
                return F.col(name)
            return F.lit(None).cast(source.schema[name].dataType).alias(name)

        return df.select(*keys, "day", F.lit(kind).alias("kind"), column("state", states),
                         column("today", today), column("query", asked))

    w = Window.partitionBy(*keys).orderBy("day", "kind")
    midnight_row = F.last(F.when(F.col("kind") == 0, F.struct("day", "today")), ignorenulls=True).over(w)
    return (
        row(today, 0).unionByName(row(asked, 1)).unionByName(row(states, 2))
        .withColumns({"state": F.last("state", ignorenulls=True).over(w), "m": midnight_row})
        .filter(F.col("kind") == 1)
        .select(*keys, "day", "query", "state",
                F.when(F.col("m.day") == F.col("day"), F.col("m.today")).alias("today"))
    )


def _queries(samples: DataFrame, daily: DataFrame, window: int | None) -> DataFrame:
    """Each sample of a person with each concept: at dt and at the window start."""
    concepts = daily.select(*CURVE).distinct()
    start = F.greatest(F.col("lo"), F.date_sub("dt", (window or 1) - 1))
    both = F.array(
        F.struct(F.col("dt").alias("day"), F.lit(True).alias("own")),
        F.struct(start.alias("day"), F.lit(False).alias("own")),
    )
    return samples.join(concepts, "person_id").select(
        *CURVE, "dt", "lo", start.alias("a"), F.explode(both).alias("at")
    ).select(*CURVE, F.col("at.day").alias("day"), F.struct("dt", "lo", "a", "at.own").alias("query"))


def _paired(found: DataFrame) -> DataFrame:
    """One row per sample: ``s`` and ``today`` at dt, ``b`` at the window start."""
    own = F.col("query.own")
    return found.groupBy(*CURVE, F.col("query.dt").alias("dt")).agg(
        F.first("query.lo").alias("lo"), F.first("query.a").alias("a"),
        F.max(F.when(own, F.col("state"))).alias("s"),
        F.max(F.when(own, F.col("today"))).alias("today"),
        F.max(F.when(~own, F.col("state"))).alias("b"),
    )


def _power_sums(n: Column) -> list[Column]:
    """Sums of t**0 .. t**3 for t = 1 .. n."""
    return [n, n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6, (n * (n + 1) / 2) * (n * (n + 1) / 2)]


def _interval_sum(upto: Column, h: Column, y0: Column, y1: Column, d0: Column, d1: Column) -> Column:
    """Sum of the cubic of one interval over its days 1 .. upto."""
    m = (y1 - y0) / h
    c = (3 * m - 2 * d0 - d1) / h
    b = (d0 + d1 - 2 * m) / (h * h)
    s0, s1, s2, s3 = _power_sums(upto.cast("double"))
    return y0 * s0 + d0 * s1 + c * s2 + b * s3


def _interior_slope(h0: Column, m0: Column, h1: Column, m1: Column) -> Column:
    before, after = 2 * h1 + h0, h1 + 2 * h0
    return F.when(m0 * m1 > 0, (before + after) / (before / m0 + after / m1)).otherwise(0.0)


def _measured(samples: DataFrame, daily: DataFrame, grid: DataFrame, window: int | None) -> DataFrame:
    """Trailing mean at dt of the interpolation of the history up to dt.

    A history ends in a knot at dt: the midnight value of that day, or the last
    value held flat. The two intervals next to it are recomputed; all earlier
    ones are those of the full history, summed by knot.
    """
    valued = daily.filter(F.col("value").isNotNull())
    w = Window.partitionBy(*CURVE).orderBy("x")
    knots = pchip_knots(valued.select(*CURVE, "day", "value"), grid)
    gap = F.datediff("x1", "x").cast("double")
    own = _interval_sum(gap, gap, F.col("y"), F.col("y1"), F.col("d"), F.col("d1"))
    # "sum" covers all days up to and including the knot.
    knots = knots.withColumn("piece", F.lag(own).over(w)).withColumns({
        "sum": F.sum(F.coalesce("piece", F.col("y"))).over(w),
        "k": F.row_number().over(w),
    }).withColumns({
        "px": F.lag("x").over(w), "py": F.lag("y").over(w), "pd": F.lag("d").over(w),
        "psum": F.lag("sum").over(w),
    })
    fields = ("x", "y", "d", "x1", "y1", "d1", "sum", "k", "px", "py", "pd", "psum", "pad")
    states = knots.select(*CURVE, F.col("x").alias("day"), F.struct(*fields).alias("state"))
    today = daily.filter(F.col("value0").isNotNull()).select(*CURVE, "day", F.col("value0").alias("today"))
    now = _paired(_looked_up(states, today, _queries(samples, valued, window), CURVE))
    # A knot that only pads the grid start is no observation yet.
    observed = F.coalesce(~F.col("s.pad"), F.lit(False))
    now = now.withColumn("observed", observed).filter(F.col("observed") | F.col("today").isNotNull())
    if window is None:
        return now.select(*SAMPLE, F.coalesce("today", "s.y").alias("value"))

    s, b = F.col("s"), F.col("b")
    y_end, h, m, ph, pm, d_last, d_end, d_prev = map(F.col, ("y_end", "h", "m", "ph", "pm", "d_last", "d_end", "d_prev"))
    alone, pair = s["k"] == 1, s["k"] == 2
    # Columns used often are computed in steps; nested, their code outgrows what can be compiled.
    now = now.withColumns({
        "y_end": F.coalesce("today", s["y"]),
        "h": F.datediff("dt", s["x"]).cast("double"),
        "ph": F.datediff(s["x"], s["px"]).cast("double"),
    }).withColumns({
        "m": (y_end - s["y"]) / h,
        "pm": (s["y"] - s["py"]) / ph,
    }).withColumns({
        "d_last": F.when(alone, m).otherwise(_interior_slope(ph, pm, h, m)),
        "d_end": F.when(alone, m).otherwise(_end_slope(h, ph, m, pm)),
        "d_prev": F.when(pair, _end_slope(ph, h, pm, m)).otherwise(s["pd"]),
    })

    def tail(upto_day: Column) -> Column:
        return _interval_sum(upto_day, h, s["y"], y_end, d_last, d_end)

    def previous(upto_day: Column) -> Column:
        return _interval_sum(upto_day, ph, s["py"], s["y"], d_prev, d_last)

    # Sum over the days before a, by the interval in which that day lies.
    skip = F.date_sub("a", 1)
    into_tail = F.datediff(skip, s["x"])
    into_previous = F.datediff(skip, s["px"])
    bh = F.datediff(b["x1"], b["x"]).cast("double")
    full_before = b["sum"] + _interval_sum(
        F.datediff(skip, b["x"]), bh, b["y"], b["y1"], b["d"], b["d1"]
    )
    base = F.when(alone, s["y"]).otherwise(s["psum"])
    head = F.when(alone, F.lit(0.0)).otherwise(previous(ph))
    whole = base + head + tail(h)
    outside = (
        F.when(skip < F.col("lo"), F.lit(0.0))
        .when(skip >= s["x"], base + head + tail(into_tail))
        .when(pair | (skip >= s["px"]), base + previous(into_previous))
        .otherwise(full_before)
    )
    days = F.datediff("dt", "a") + 1
    smooth = (whole - outside) / days
    # Before any full-day observation the midnight value is the only one.
    value = F.when(F.col("observed"), smooth).otherwise(F.col("today"))
    return now.select(*SAMPLE, value.alias("value"))


def _carried(samples: DataFrame, daily: DataFrame, reference: DataFrame, window: int | None) -> DataFrame:
    """Binary carry at dt: the day's own mark, the carry window, or the last mark."""
    person = ["person_id"]
    marks = reference.groupBy("person_id", "day").agg(F.sum("n0").alias("n0"))
    placed = _looked_up(
        marks.select(*person, "day", F.col("day").alias("state")),
        marks.filter(F.col("n0") > 0).select(*person, "day", F.lit(True).alias("today")),
        samples.select(*person, F.col("dt").alias("day"), F.col("lo").alias("query")), person,
    ).select("person_id", F.col("day").alias("dt"), F.col("state").alias("reference"),
             F.col("today").alias("marked"))
    concepts = daily.select(*CURVE).distinct()
    asked = placed.join(concepts, "person_id").select(
        *CURVE, F.col("dt").alias("day"), F.struct("reference", "marked").alias("query"))
    now = _looked_up(
        daily.select(*CURVE, "day", F.col("day").alias("state")),
        daily.filter(F.col("n0") > 0).select(*CURVE, "day", F.lit(True).alias("today")),
        asked, CURVE,
    ).filter(F.col("state").isNotNull() | F.col("today").isNotNull())
    event = F.col("state")
    held = F.col("query.marked").isNull() & (event == F.col("query.reference"))
    fuzzy = F.lit(False) if window is None else F.datediff("day", event) <= window
    on = F.col("today").isNotNull() | F.coalesce(held | fuzzy, F.lit(False))
    return now.select(*CURVE, F.col("day").alias("dt"), on.cast("double").alias("value"))


def _intensity(samples: DataFrame, daily: DataFrame, min_count: int, iterations: int,
               window: int | None) -> DataFrame:
    """Mean intensity over the last ``window`` days of the history up to dt."""
    m, width = max(min_count, 1), window or 1
    mass = event_mass(daily)
    states = mass.select(*CURVE, "day", F.col("upto").alias("state"))
    today = daily.filter(F.col("n0") > 0).select(*CURVE, "day", F.col("n0").alias("today"))
    now = _paired(_looked_up(states, today, _queries(samples, daily, window), CURVE)).select(
        *SAMPLE, "lo", "a",
        F.coalesce("s", F.lit(0)).alias("full"), F.coalesce("today", F.lit(0)).alias("today"),
        F.coalesce("b", F.lit(0)).alias("past"), (F.datediff("dt", "lo") + 1).alias("days"),
    ).withColumn("n", F.col("full") + F.col("today")).filter(F.col("n") > 0)
    # A history inside one window averages over everything.
    short = F.col("days") <= width if window is not None else F.lit(False)
    flat = (F.col("n") < 2 * min_count) | short
    constant = now.filter(flat).select(*SAMPLE, (F.col("n") / F.col("days")).alias("value"))

    table = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(w).alias("w"))
                      for s, w in histogram_shifts(min_count, iterations).items()])
    busy = now.filter(~flat).withColumn("shift", F.explode(table)).withColumns({
        "s": F.col("shift.s"), "w": F.col("shift.w"),
    })
    top = F.greatest(F.lit(0), F.floor((F.col("n") - m - F.col("s")) / m))
    low = F.least(top, F.greatest(F.lit(0), F.floor((F.col("past") - F.col("s")) / m)))
    # The cuts around the window start: event masses to be placed in time.
    busy = busy.withColumns({"j": low, "top": top}).withColumns({
        "m0": F.when(F.col("j") > 0, F.col("s") + F.col("j") * m),
        "m1": F.when(F.col("j") < F.col("top"), F.col("s") + (F.col("j") + 1) * m),
    })
    sides = F.array(F.struct(F.col("m0").alias("mass"), F.lit(True).alias("before")),
                    F.struct(F.col("m1").alias("mass"), F.lit(False).alias("before")))
    levels = busy.select(*CURVE, F.struct("dt", "lo", "a", "full", "today", "days", "n", "s", "w").alias("q"),
                         F.explode(sides).alias("side"))
    asked = levels.select(*CURVE, F.coalesce("side.mass", F.lit(0)).alias("mass"), "q", "side")
    known = mass.select(*CURVE, F.col("upto").alias("mass"), F.struct("day", "n", "before").alias("at"))
    blank = known.withColumns({name: F.lit(None).cast(asked.schema[name].dataType) for name in ("q", "side")})
    both = blank.unionByName(asked.withColumn("at", F.lit(None).cast(known.schema["at"].dataType)))
    # From the largest mass down, the last day seen is the first to reach the mass.
    downward = Window.partitionBy(*CURVE).orderBy(F.desc("mass"), F.col("q").isNotNull())
    placed = both.withColumn("at", F.last("at", ignorenulls=True).over(downward)).filter("q is not null")
    level, q = F.col("side.mass"), F.col("q")
    full_day = F.datediff("at.day", "q.lo") - 0.5 + (level - F.col("at.before")) / F.col("at.n")
    own_day = q["days"] - 1.5 + F.try_divide(level - q["full"], q["today"])
    edge = F.when(F.col("side.before"), F.lit(-0.5)).otherwise(q["days"] - 0.5)
    time = F.when(level.isNull(), edge).when(level > q["full"], own_day).otherwise(full_day)
    reached = F.when(F.col("side.before"), F.coalesce(level, F.lit(0))).otherwise(F.coalesce(level, q["n"]))

    def on(side: bool, value: Column) -> Column:
        return F.max(F.when(F.col("side.before") == side, value))

    cuts = placed.groupBy(*CURVE, q["dt"].alias("dt"), q["s"].alias("s")).agg(
        F.first(q["w"]).alias("w"), F.first(q["n"]).alias("n"),
        F.first(F.datediff("q.a", "q.lo")).alias("a"),
        on(True, time).alias("t0"), on(True, reached).alias("q0"),
        on(False, time).alias("t1"), on(False, reached).alias("q1"),
    )
    share = (F.col("a") - 0.5 - F.col("t0")) / (F.col("t1") - F.col("t0"))
    below = F.col("q0") + (F.col("q1") - F.col("q0")) * share
    smooth = cuts.groupBy(*SAMPLE).agg(
        ((F.max("n") - F.sum(below * F.col("w"))) / width).alias("value")
    )
    return constant.unionByName(smooth)


def project_points(
    index: DataFrame, ehr: DataFrame, meta: DataFrame, options: CurveOptions = CurveOptions(),
    keep: Keep = materialise,
) -> DataFrame:
    """Curve values (person_id, concept_id, day, value) without look-ahead.

    The same as building each person's curves from the first event up to the
    sampled day, from events up to that day's midnight, and reading the last
    day. Samples not after the first event are misses and give no rows.
    """
    # Persons and modes are small tables of known size. The daily rows are aggregated before they
    # meet them, so a hot person is combined early, and written with their mode: every look-up
    # below reads them again, and none repeats the joins or sends the persons to all tasks anew.
    sampled = keep(index.select("person_id").distinct())
    modes = materialise(meta.select("concept_id", "data_mode"))
    days = keep(daily_with_midnight(ehr, lambda rows: rows).join(sampled, "person_id", "left_semi").join(
        modes, "concept_id", "left"
    ))
    starts = keep(first_moments(ehr).join(sampled, "person_id", "left_semi"))
    samples = keep(
        _sampled_days(index).join(starts, "person_id")
        .filter(midnight(F.col("dt")) > F.col("first"))
        .select("person_id", "dt", day_of(F.col("first")).alias("lo"))
    )
    # The knots start at the grid edge and are not held beyond the last value.
    edge = day_of(F.col("first"))
    grid = starts.select("person_id", edge.alias("lo"), edge.alias("hi"))

    def of(mode: str) -> DataFrame:
        return days.filter(F.col("data_mode") == mode).drop("data_mode")

    parts = [
        _intensity(samples, of("Condition"), options.min_count, options.iterations,
                   options.intensity_window),
        _measured(samples, of("Measurement"), grid, options.pchip_window),
        _carried(samples, of("Medication"), of("Medication") if options.med_dates else days,
                 options.binary_window),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.select(*CURVE, F.col("dt").alias("day"), "value")
