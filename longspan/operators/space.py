"""Sample spaces: per person a half-open time range to draw samples from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.time import day_of, from_second_number, midnight, second_number
from longspan.operators.running import bucket_count, hash_bucket, running_total

_SECOND = "INTERVAL '1' SECOND"


def sample_space(ehr: DataFrame) -> DataFrame:
    """Range [first, last + 1 s) and number of events of each person."""
    return ehr.groupBy("person_id").agg(
        F.min("datetime").alias("start"),
        (F.max("datetime") + F.expr(_SECOND)).alias("stop"),
        F.count("*").alias("datapoints"),
    )


def by_day(space: DataFrame) -> DataFrame:
    """The same ranges in whole days: [date(first), date(last) + 1)."""
    return space.withColumns({
        "start": day_of(F.col("start")),
        "stop": F.date_add(day_of(F.col("stop") - F.expr(_SECOND)), 1),
    })


def _is_daily(space: DataFrame) -> bool:
    return dict(space.dtypes)["start"] == "date"


def _ticks(df: DataFrame, column: str) -> Column:
    """A moment as a whole number of days or seconds."""
    if dict(df.dtypes)[column] == "date":
        return F.unix_date(column).cast("long")
    return second_number(F.col(column))


def _from_ticks(ticks: Column, daily: bool) -> Column:
    if daily:
        return F.date_from_unix_date(ticks.cast("int"))
    return from_second_number(ticks)


def space_totals(space: DataFrame) -> DataFrame:
    """One row: person-days, person-timepoints (seconds) and events."""
    start, stop = F.col("start"), F.col("stop")
    return space.agg(
        F.sum(F.datediff(day_of(stop), day_of(start)).cast("long")).alias("ndates"),
        F.sum(second_number(stop) - second_number(start)).alias("ntimepoints"),
        F.sum("datapoints").alias("ndatapoints"),
    )


def visit_timepoints(visits: DataFrame) -> DataFrame:
    seconds = second_number(F.col("end_datetime")) - second_number(F.col("start_datetime"))
    return visits.agg(F.sum(seconds).alias("ntimepoints"))


def index_totals(index: DataFrame) -> DataFrame:
    """Distinct persons and distinct moments of a sample index."""
    return index.agg(
        F.count_distinct("person_id").alias("npersons"),
        F.count_distinct("datetime").alias("ndates"),
    )


def dedupe_index(index: DataFrame) -> DataFrame:
    return index.select("person_id", "datetime").distinct()


def restrict_to_interval(space: DataFrame, start, stop) -> DataFrame:
    """Clamp to [start, stop); persons outside are dropped."""
    kind = dict(space.dtypes)["start"]
    low, high = F.lit(start).cast(kind), F.lit(stop).cast(kind)
    return space.filter((F.col("start") < high) & (low < F.col("stop"))).withColumns({
        "start": F.greatest("start", low),
        "stop": F.least("stop", high),
    })


def _matched(index: DataFrame, space: DataFrame) -> DataFrame:
    """Index rows with the bounds of their person, as whole ticks."""
    daily = dict(index.dtypes)["datetime"] == "date"
    if daily and not _is_daily(space):
        space = by_day(space)
    bounds = space.select(
        "person_id", _ticks(space, "start").alias("low"), (_ticks(space, "stop") - 1).alias("high")
    )
    at = index.select("person_id", _ticks(index, "datetime").alias("at"))
    return at.join(bounds, "person_id", "left").withColumns({
        "missing": ~F.coalesce(F.col("high") >= F.col("low"), F.lit(False)),
        "outside": (F.col("at") < F.col("low")) | (F.col("at") > F.col("high")),
    })


def fit_index_into_space(index: DataFrame, space: DataFrame) -> DataFrame:
    """Index rows of known persons, clamped into their range, each once.

    A DATE index is fitted at day resolution.
    """
    daily = dict(index.dtypes)["datetime"] == "date"
    held = F.greatest("low", F.least("high", "at"))
    return (
        _matched(index, space)
        .filter(~F.col("missing"))
        .select("person_id", _from_ticks(held, daily).alias("datetime"))
        .distinct()
    )


def fitted_space(index: DataFrame, space: DataFrame) -> DataFrame:
    """The part of the space that an index uses."""
    if dict(index.dtypes)["datetime"] == "date" and not _is_daily(space):
        space = by_day(space)
    return space.filter(F.col("stop") > F.col("start")).join(
        index.select("person_id"), "person_id", "left_semi"
    )


def fit_losses(index: DataFrame, space: DataFrame) -> DataFrame:
    """One row: persons dropped, samples dropped, samples clamped."""
    per_person = _matched(index, space).groupBy("person_id").agg(
        F.count_if("missing").alias("lost"),
        F.count_if(~F.col("missing") & F.col("outside")).alias("moved"),
    )
    return per_person.agg(
        F.count_if(F.col("lost") > 0).alias("n_missing_persons"),
        F.coalesce(F.sum("lost"), F.lit(0)).alias("n_missing_datapoints"),
        F.coalesce(F.sum("moved"), F.lit(0)).alias("n_out_of_range"),
    )


# --- uniform sampling ---------------------------------------------------


def permuted(position: Column, size: int, seed: int) -> Column:
    """The image of ``position`` under a seeded permutation of [0, size).

    A four-round Feistel network permutes a square of at least ``size`` cells;
    cells beyond ``size`` are walked on until they fall inside. The square has
    at most 2 * sqrt(size) spare cells, which also bounds the walk. Below 1,024
    points 64 steps cover that bound; above, one step misses with chance under
    1/15, so 32 steps miss with chance under 1e-37.
    """
    side = max(1, int(size**0.5))
    while side * side < size:
        side += 1
    width = F.lit(side).cast("long")

    def shuffle(cell: Column) -> Column:
        start = F.struct((cell / width).cast("long").alias("l"), (cell % width).alias("r"))

        def turn(state: Column, turn_number: Column) -> Column:
            noise = F.xxhash64(state["r"], turn_number, F.lit(seed))
            mixed = F.pmod(state["l"] + F.pmod(noise, width), width)
            return F.struct(state["r"].alias("l"), mixed.alias("r"))

        end = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn)
        return end["l"] * width + end["r"]

    limit = F.lit(size).cast("long")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(64 if size < 1024 else 32)),
        shuffle(position),
        lambda cell, _: F.when(cell < limit, cell).otherwise(shuffle(cell)),
    )


def enumerate_space(space: DataFrame, rows: int) -> DataFrame:
    """Give every range its stretch [lo, hi) of the numbered time points."""
    ranged = space.select(
        "person_id", _ticks(space, "start").alias("first"), _ticks(space, "stop").alias("end")
    ).filter(F.col("end") > F.col("first"))
    keyed = (
        ranged.groupBy("person_id", "first", "end").agg(F.count("*").alias("copies"))
        .withColumn("length", F.col("end") - F.col("first"))
        .withColumn("size", F.col("length") * F.col("copies"))
        .withColumn("bucket", hash_bucket(bucket_count(rows), "person_id", "first", "end"))
    )
    placed = running_total(keyed, "bucket", ["person_id", "first", "end"], {"lo": "size"})
    return placed.withColumn("hi", F.col("lo") + F.col("size"))


def locate(points: DataFrame, ranges: DataFrame, span: int, rows: int) -> DataFrame:
    """Range join: each ``rank`` gets the columns of the range [lo, hi) around it.

    The ranges are disjoint. The number line is cut in chunks; a range is
    listed once per chunk it touches, which adds at most one row per chunk.
    Inside a chunk a window carries the latest range start forward, so no pair
    of rows is formed.
    """
    chunk = max(1, -(-span // bucket_count(rows)))
    payload = [c for c in ranges.columns if c not in ("lo", "hi")]
    starts = ranges.select(
        F.struct("lo", *payload).alias("range"),
        F.explode(
            F.sequence((F.col("lo") / chunk).cast("long"), ((F.col("hi") - 1) / chunk).cast("long"))
        ).alias("chunk"),
        F.col("lo").alias("key"),
        F.lit(None).cast("long").alias("rank"),
    )
    asked = points.select(
        F.lit(None).cast(starts.schema["range"].dataType).alias("range"),
        (F.col("rank") / chunk).cast("long").alias("chunk"),
        F.col("rank").alias("key"),
        "rank",
    )
    forward = Window.partitionBy("chunk").orderBy("key", F.col("rank").asc_nulls_first())
    carried = F.last("range", ignorenulls=True).over(forward)
    return (
        starts.unionByName(asked)
        .withColumn("range", carried)
        .filter(F.col("rank").isNotNull())
        .select("rank", "range.*")
    )


def sample_uniform(space: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` distinct (person, time point) pairs, uniform over the space.

    Only the drawn ranks are materialised, never the space. Persons may have
    several ranges (visits). The driver sees one row of totals.
    """
    daily = _is_daily(space)
    length = _ticks(space, "stop") - _ticks(space, "start")
    total = space.agg(
        F.coalesce(F.sum(F.greatest(length, F.lit(0))), F.lit(0)).alias("points"),
        F.count("*").alias("rows"),
    ).first()
    if size > total["points"]:
        raise ValueError(f"cannot draw {size} of {total['points']} time points")
    ranks = space.sparkSession.range(size).select(
        permuted(F.col("id"), total["points"], seed).alias("rank")
    )
    ranges = enumerate_space(space, total["rows"])
    found = locate(ranks, ranges.select("lo", "hi", "person_id", "first", "length"),
                   total["points"], size + total["rows"])
    at = F.col("first") + F.pmod(F.col("rank") - F.col("lo"), F.col("length"))
    return found.select("person_id", _from_ticks(at, daily).alias("datetime"))


def age_stats(space: DataFrame, cohort: DataFrame) -> DataFrame:
    """Mean and population deviation of age in years over all person-days.

    Sums of days and of squared days over a run of integers have closed forms,
    so no day is materialised; decimals keep the sums exact.
    """
    if not _is_daily(space):
        space = by_day(space)
    born = cohort.select("person_id", "birth_date")
    low = F.datediff("start", "birth_date").cast("decimal(18,0)")
    high = F.datediff("stop", "birth_date").cast("decimal(18,0)")
    spans = space.join(born, "person_id").select(low.alias("lo"), high.alias("hi"))

    def squares_below(n: Column) -> Column:
        return ((n - 1) * n * (2 * n - 1)).cast("decimal(30,0)")  # six times the sum

    sums = spans.agg(
        F.sum(F.col("hi") - F.col("lo")).cast("double").alias("n"),
        F.sum(((F.col("hi") - F.col("lo")) * (F.col("hi") + F.col("lo") - 1)).cast("decimal(26,0)"))
        .cast("double").alias("twice"),
        F.sum(squares_below(F.col("hi")) - squares_below(F.col("lo"))).cast("double").alias("six"),
    )
    mean = F.col("twice") / 2 / F.col("n")
    variance = F.col("six") / 6 / F.col("n") - mean * mean
    return sums.select(
        (mean / 365.25).alias("mean_age"),
        (F.sqrt(F.greatest(variance, F.lit(0.0))) / 365.25).alias("sdev_age"),
    )
