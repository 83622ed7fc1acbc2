"""As-of lookups on windows.

Events first shrink to one row per (person, concept, day), so a window over a
person and concept holds at most one row per calendar day, and a window inside
a day at most one per second. No pair of event and target is formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspan.functions.time import SECONDS_PER_DAY, day_of, recency, second_number
from longspan.operators.running import carried
from longspan.session import materialise

# Decay in days of the recency curve.
CONDITION_TAU = 30.0
OTHER_TAU = 7.0


def _latest(df: DataFrame, *keys: str) -> DataFrame:
    """Latest event per key; among equal moments the larger value."""
    return df.groupBy(*keys).agg(F.max(F.struct("datetime", "value")).alias("seen"))


def latest_per_concept(
    index: DataFrame, ehr: DataFrame, keep: Callable[[DataFrame], DataFrame] = materialise
) -> DataFrame:
    """Backward as-of join: per sample and concept the last event not after it.

    Returns (person_id, target, concept_id, datetime, value); concepts without
    an earlier event are absent. The daily rows are written once, as ``keep`` does.
    """
    targets = index.select(
        "person_id",
        F.col("datetime").cast("timestamp_ntz").alias("target"),
        day_of(F.col("datetime")).alias("day"),
    ).distinct()
    # Aggregated before the person joins, so a hot person is combined early.
    events = ehr.withColumn("day", day_of(F.col("datetime")))
    daily = keep(
        _latest(events, "person_id", "concept_id", "day")
        .join(targets.select("person_id"), "person_id", "left_semi")
    )

    # Up to the day before: carry the last day with events forward.
    concepts = daily.select("person_id", "concept_id").distinct()
    asked = targets.select("person_id", "day").distinct().join(concepts, "person_id")
    marked = daily.withColumn("asked", F.lit(False)).unionByName(
        asked.withColumns({"seen": F.lit(None).cast(daily.schema["seen"].dataType),
                           "asked": F.lit(True)})
    )
    by_day = Window.partitionBy("person_id", "concept_id").orderBy("day", F.col("asked").desc())
    carried = (
        marked.withColumn("before", F.last("seen", ignorenulls=True).over(by_day))
        .filter("asked")
        .select("person_id", "concept_id", "day", "before")
    )

    # On the day itself: only events up to the moment of the sample.
    sampled = events.join(targets.select("person_id", "day"), ["person_id", "day"], "left_semi")
    moments = _latest(sampled.withColumn("at", F.col("datetime")), "person_id", "concept_id", "day", "at")
    active = daily.select("person_id", "concept_id", "day")
    asked_at = targets.join(active, ["person_id", "day"]).select(
        "person_id", "concept_id", "day", F.col("target").alias("at"),
        F.lit(None).cast(daily.schema["seen"].dataType).alias("seen"), F.lit(True).alias("asked"),
    )
    within = Window.partitionBy("person_id", "concept_id", "day").orderBy("at", F.col("asked"))
    today = (
        moments.withColumn("asked", F.lit(False)).unionByName(asked_at)
        .withColumn("today", F.last("seen", ignorenulls=True).over(within))
        .filter("asked")
        .select("person_id", "concept_id", F.col("at").alias("target"), "today")
    )
    return (
        targets.join(carried, ["person_id", "day"])
        .join(today, ["person_id", "concept_id", "target"], "left")
        .withColumn("seen", F.coalesce("today", "before"))
        .filter(F.col("seen").isNotNull())
        .select("person_id", "target", "concept_id", "seen.datetime", "seen.value")
    )


def recency_features(index: DataFrame, ehr: DataFrame, meta: DataFrame) -> DataFrame:
    """Recency and carried-forward value of every concept seen by each sample.

    ``recency`` is 1 / (1 + age / tau) with the age in days; ``carried`` is the
    last value where one was recorded.
    """
    tau = F.when(F.col("data_mode") == "Condition", CONDITION_TAU).otherwise(OTHER_TAU)
    age = (second_number(F.col("target")) - second_number(F.col("datetime"))) / SECONDS_PER_DAY
    return (
        latest_per_concept(index, ehr)
        .join(meta.select("concept_id", "data_mode"), "concept_id")
        .select("person_id", F.col("target").alias("datetime"), "concept_id",
                recency(age, tau).alias("recency"), F.col("value").alias("carried"))
    )


def match_sequence(
    points: DataFrame, bases: DataFrame, key: str, at: str, payload: str, from_prev: bool = False
) -> DataFrame:
    """Match each point to a base of its sequence: exact, else next (or previous).

    Points beyond the ends take the first or last base. ``bases`` must be
    unique per (key, at). A sequence may hold any share of the rows: it is
    scanned in parts.
    """
    known = bases.select(key, at, F.struct(F.col(at).alias("at"), F.col(payload).alias("base")).alias("b"),
                         F.lit(False).alias("asked"))
    asked = points.select(key, at).distinct().select(
        key, at, F.lit(None).cast(known.schema["b"].dataType).alias("b"), F.lit(True).alias("asked")
    )
    found = carried(known.unionByName(asked), (key,), [at], "b", "prev", "next").filter("asked")
    chosen: Column = (
        F.coalesce("prev", "next") if from_prev else F.coalesce("next", "prev")
    )
    return found.withColumn("b", chosen).select(
        key, at, F.col("b.at").alias("base_at"), F.col("b.base").alias(payload)
    )


def linspace(df: DataFrame, key: str, at: str, n_points: int) -> DataFrame:
    """``n_points`` even points from floor(min) to ceil(max) of each sequence.

    The ends are few bytes, which adaptive execution would put into one task; a fixed
    number of parts keeps the points, ``n_points`` times as many rows, spread. Spark drops
    a repartition into as many parts by the same key as the aggregate has, so it is twice that.
    """
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.groupBy(key).agg(F.floor(F.min(at)).alias("lo"), F.ceil(F.max(at)).alias("hi")).repartition(parts, key)
    step = F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(max(n_points - 1, 1))
    return ends.select(
        key, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")
    ).select(key, "i", (F.col("lo") + step).cast("double").alias(at))


def interpolate_sequence(
    data: DataFrame, model, key: str = "sequence_id", at: str = "at", payload: str = "base",
    n_points: int = 1000, from_prev: bool = False,
) -> DataFrame:
    """Mean and variance of a model at even points of each sequence.

    ``model`` takes (matched base, point) columns and returns a struct column
    with ``mean`` and ``variance``; a pandas UDF serves for trained models.
    Rows of kind "observed" hold the model at the sequence's own positions.
    """
    bases = data.select(key, F.col(at).cast("double").alias(at), payload)
    points = linspace(bases, key, at, n_points)
    matched = match_sequence(points, bases, key, at, payload, from_prev)
    rows = matched.select(key, at, payload, F.lit("interpolated").alias("kind")).unionByName(
        bases.select(key, at, payload, F.lit("observed").alias("kind"))
    )
    estimate = model(F.col(payload), F.col(at))
    return rows.withColumn("m", estimate).select(key, at, "kind", "m.mean", "m.variance")
