"""Extraction of event tables, concept and cohort selection, metadata.

Every function takes DataFrames and returns a lazy DataFrame; Catalyst pushes
the date filters and column lists into the scans. Dimension joins carry no
broadcast hint: Spark broadcasts them while they stay under the session's size
threshold and falls back to a shuffle join beyond it. The concepts that events are
joined on are written once first, so that their size is known: by an estimate from
the tables they come from, all events would be dealt by a handful of concepts.

Rows are deduplicated or aggregated before they are joined on the person. The
other way round, the join's partitioning by person would also serve the
aggregate, and all rows of a hot person would stay in one task. With the join
last, adaptive execution may split that person.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators.quantiles import frequencies, frequency_moments, frequency_quantiles
from longspan.session import materialise

# Concept ids and codes of the public vocabularies.
EGFR_CONCEPT = 44806420
NON_LAB_CODES = ("29463-7", "8302-2", "39156-5")  # body weight, height, mass index
INPATIENT_CONCEPT = 9201
UNKNOWN_GENDER = 2000003109
UNKNOWN_RACE = 2003603112
# One event in twenty years, the background rate of a diagnosis.
BACKGROUND_RATE = 1 / (20 * 365.25)

PERCENTILES = {
    "p0001": 0.0001, "p001": 0.001, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5,
    "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999, "p9999": 0.9999,
}


@dataclass(frozen=True)
class DataTable:
    """How one kind of data is selected, filled and labelled."""

    name: str
    mode: str
    selected: Callable[[], Column]
    fill: Callable[[], Column]
    metatable: str | None = None
    has_value: bool = False

    @property
    def meta_name(self) -> str:
        return self.metatable or self.name


CONDITIONS = DataTable(
    "conditions_daily", "Condition",
    selected=lambda: F.col("mentions_daily") >= 1000,
    fill=lambda: F.lit(BACKGROUND_RATE),
)
MEASUREMENTS = DataTable(
    "measurements_daily", "Measurement",
    selected=lambda: (F.col("mentions_daily") >= 1000) & (F.col("persons") >= 100),
    fill=lambda: F.col("p50"),
    metatable="measurement_stats",
    has_value=True,
)
MEDICATIONS = DataTable(
    "medications_daily", "Medication",
    selected=lambda: F.col("mentions_daily") >= 1000,
    fill=lambda: F.lit(0.0),
)
PROCEDURES = DataTable(
    "procedures", "Procedure",
    selected=lambda: F.col("mentions") >= 500,
    fill=lambda: F.lit(0.0),
)
DEFAULT_TABLES = (CONDITIONS, MEASUREMENTS, MEDICATIONS, PROCEDURES)


def union_rows(frames) -> DataFrame:
    """UNION: all rows of the frames, each once."""
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def _eligible(person: DataFrame, birthdate: str) -> DataFrame:
    born = F.col("birth_datetime") >= F.lit(birthdate).cast("timestamp_ntz")
    return person.filter(born).select("person_id")


def _since(column: str, startdate: str) -> Column:
    kind = "date" if column.endswith("_date") else "timestamp_ntz"
    return F.col(column) >= F.lit(startdate).cast(kind)


def _coded(concept: DataFrame, kept: Column, name: str) -> DataFrame:
    """Ids of the wanted concepts as a small table of its own."""
    return materialise(concept.filter(kept).select(F.col("concept_id").alias(name)).distinct())


def conditions(
    person: DataFrame, occurrence: DataFrame, concept: DataFrame,
    birthdate: str = "1920-01-01", startdate: str = "2000-01-01", daily: bool = True,
) -> DataFrame:
    """Diagnoses (person_id, concept_id, datetime), each once."""
    moment = "condition_start_date" if daily else "condition_start_datetime"
    coded = _coded(concept, (F.col("domain_id") == "Condition") & (F.col("vocabulary_id") == "SNOMED"),
                   "condition_concept_id")
    return (
        occurrence.filter(_since(moment, startdate))
        .join(coded, "condition_concept_id")
        .select("person_id", F.col("condition_concept_id").alias("concept_id"),
                F.col(moment).alias("datetime"))
        .distinct()
        .join(_eligible(person, birthdate), "person_id", "left_semi")
    )


def procedures(
    person: DataFrame, occurrence: DataFrame, concept: DataFrame,
    birthdate: str = "1920-01-01", startdate: str = "2000-01-01", daily: bool = False,
) -> DataFrame:
    """Procedures (person_id, concept_id, datetime), each once."""
    moment = "procedure_date" if daily else "procedure_datetime"
    coded = _coded(concept, F.col("domain_id") == "Procedure", "procedure_concept_id")
    return (
        occurrence.filter(_since(moment, startdate))
        .join(coded, "procedure_concept_id")
        .select("person_id", F.col("procedure_concept_id").alias("concept_id"),
                F.col(moment).alias("datetime"))
        .distinct()
        .join(_eligible(person, birthdate), "person_id", "left_semi")
    )


def medications(
    person: DataFrame, exposure: DataFrame, extension: DataFrame, ancestor: DataFrame,
    concept: DataFrame, birthdate: str = "1920-01-01", startdate: str = "2000-01-01",
    daily: bool = True,
) -> DataFrame:
    """Drug exposures rolled up to their ingredients."""
    moment = "drug_exposure_start_date" if daily else "drug_exposure_start_datetime"

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).isNotNull()

    documented = extension.filter(
        (filled("x_strength") | filled("x_dose"))
        & filled("x_frequency")
        & (F.col("x_doc_stype") == "Problem list")
    ).select("drug_exposure_id")
    ingredient = _coded(concept, F.col("concept_class_id") == "Ingredient", "ancestor_concept_id")
    # The closure table shrinks to ingredients before it meets the exposures.
    rolled = ancestor.join(ingredient, "ancestor_concept_id").select(
        F.col("ancestor_concept_id").alias("concept_id"),
        F.col("descendant_concept_id").alias("drug_concept_id"),
    )
    return (
        exposure.filter(_since(moment, startdate) & F.col("route_source_value").isNotNull())
        .join(documented, "drug_exposure_id", "left_semi")
        .join(rolled, "drug_concept_id")
        .select("person_id", "concept_id", F.col(moment).alias("datetime"))
        .distinct()
        .join(_eligible(person, birthdate), "person_id", "left_semi")
    )


def measurement_stats(measurement: DataFrame, concept: DataFrame, **limits) -> DataFrame:
    """Distribution of each measured concept.

    Everything comes from one frequency table per concept and value, so the
    measurements are read once and a concept with a third of all rows spreads
    over its values instead of landing in one task.
    """
    labs = materialise(concept.filter(
        F.col("concept_class_id").isin("Lab Test", "Clinical Observation")
        | (F.col("concept_id") == EGFR_CONCEPT)
    ).select("concept_id", "concept_class_id", "vocabulary_id", "concept_code", "concept_name"))
    rows = measurement.select(
        F.col("measurement_concept_id").alias("concept_id"),
        F.col("value_as_number").alias("value"),
    ).join(labs.select("concept_id"), "concept_id", "left_semi")
    freq = frequencies(rows, ["concept_id"], "value")
    moments = frequency_moments(freq, ["concept_id"], "value")
    quantiles = frequency_quantiles(
        freq, ["concept_id"], "value", list(PERCENTILES.values()), **limits
    ).select("concept_id", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(PERCENTILES)])
    p = F.col
    return (
        labs.join(moments, "concept_id")
        .join(quantiles, "concept_id")
        .filter(p("p50").isNotNull() & (p("p25") != p("p75")))
        .withColumns({
            "high_threshold": p("p99") + F.abs(p("p99") - p("p50")),
            "low_threshold": p("p01") - F.abs(p("p01") - p("p50")),
            "iqr": p("p75") - p("p25"),
        })
    )


def measurements(
    person: DataFrame, measurement: DataFrame, stats: DataFrame,
    birthdate: str = "1920-01-01", startdate: str = "2000-01-01", daily: bool = True,
) -> DataFrame:
    """Measured values without outliers; with ``daily`` the last of each day.

    Among values of one latest moment the largest wins, so the result does not
    depend on row order.
    """
    usable = stats.filter(~F.col("concept_code").isin(*NON_LAB_CODES)).select(
        F.col("concept_id").alias("measurement_concept_id"), "p01", "high_threshold"
    )
    value = F.col("value_as_number")
    kept = (
        measurement.filter(_since("measurement_datetime", startdate) & value.isNotNull())
        .join(usable, "measurement_concept_id")
        .filter(((F.col("p01") <= 0) | (value > 0)) & (value < F.col("high_threshold")))
    )
    eligible = _eligible(person, birthdate)
    concept = F.col("measurement_concept_id").alias("concept_id")
    if not daily:
        return kept.select(
            "person_id", concept, F.col("measurement_datetime").alias("datetime"),
            value.alias("value"),
        ).distinct().join(eligible, "person_id", "left_semi")
    latest = F.max(F.struct("measurement_datetime", "value_as_number"))
    return (
        kept.groupBy("person_id", concept, F.col("measurement_date").alias("datetime"))
        .agg(latest.alias("latest"))
        .select("person_id", "concept_id", "datetime",
                F.col("latest.value_as_number").alias("value"))
        .join(eligible, "person_id", "left_semi")
    )


def visits(
    occurrence: DataFrame, person: DataFrame,
    birthdate: str = "1920-01-01", startdate: str = "2000-01-01",
) -> DataFrame:
    """Inpatient stays with a positive duration."""
    stay = (
        _since("visit_start_datetime", startdate)
        & (F.col("visit_start_datetime") < F.col("visit_end_datetime"))
        & (F.col("visit_concept_id") == INPATIENT_CONCEPT)
    )
    return (
        occurrence.filter(stay)
        .select("person_id", F.col("visit_start_datetime").alias("start_datetime"),
                F.col("visit_end_datetime").alias("end_datetime"))
        .distinct()
        .join(_eligible(person, birthdate), "person_id", "left_semi")
    )


def concept_counts(data: DataFrame) -> DataFrame:
    """Mentions, mentions by distinct person-day, and persons per concept.

    Distinct counts run as nested aggregates from the finest key up. Each level
    combines before its shuffle, so a concept with most of the rows is spread
    by person and day, and no row is expanded per distinct clause.
    """
    by_day = data.groupBy("concept_id", "person_id", F.col("datetime").cast("date").alias("day")).agg(
        F.count("*").alias("mentions")
    )
    by_person = by_day.groupBy("concept_id", "person_id").agg(
        F.sum("mentions").alias("mentions"),
        F.count(F.when(F.col("person_id").isNotNull(), F.col("day"))).alias("days"),
    )
    return by_person.groupBy("concept_id").agg(
        F.sum("mentions").alias("mentions"),
        F.sum("days").alias("mentions_daily"),
        F.count("person_id").alias("persons"),
    )


def select_concepts(counts: Mapping[str, DataFrame], tables=DEFAULT_TABLES) -> DataFrame:
    """Concepts with enough data in any of the tables."""
    return union_rows(
        counts[t.name].filter(t.selected()).select("concept_id") for t in tables
    )


def select_cohort(
    data: Mapping[str, DataFrame], concepts: DataFrame, tables=DEFAULT_TABLES,
    intersect_on: DataFrame | None = None,
) -> DataFrame:
    """Persons with two distinct moments of some selected concept.

    Two distinct moments exist exactly when the least differs from the
    greatest, which needs no distinct count.
    """
    def persons(df: DataFrame) -> DataFrame:
        return (
            df.join(concepts, "concept_id", "left_semi")
            .groupBy("person_id", "concept_id")
            .agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"))
            .filter(F.col("first") < F.col("last"))
            .select("person_id")
        )

    cohort = union_rows(persons(data[t.name]) for t in tables)
    if intersect_on is not None:
        cohort = cohort.intersect(intersect_on.select("person_id"))
    return cohort


def _valued(df: DataFrame, table: DataTable) -> DataFrame:
    value = F.col("value") if table.has_value else F.lit(None)
    return df.select("person_id", "concept_id", F.col("datetime").cast("timestamp_ntz").alias("datetime"),
                     value.cast("double").alias("value"))


def select_data(
    data: Mapping[str, DataFrame], concepts: DataFrame, cohort: DataFrame,
    tables=DEFAULT_TABLES, date_convert: bool = False, parts: int | None = None,
) -> DataFrame:
    """All events of the selected concepts and persons, each once.

    The tables hold each moment once, so dealing rows by person, concept and moment over
    ``parts`` needs no aggregate on the map side, which would hold as many rows as a scan reads.
    """
    def part(t: DataTable) -> DataFrame:
        kept = data[t.name].join(concepts, "concept_id", "left_semi")
        return _valued(kept, t)

    merged = reduce(lambda a, b: a.unionByName(b), [part(t) for t in tables])
    if date_convert:
        merged = merged.withColumn("datetime", F.col("datetime").cast("date"))
    if parts:
        merged = merged.repartition(parts, "person_id", "concept_id", "datetime")
    return merged.distinct().join(cohort, "person_id", "left_semi")


def concept_metadata(
    metatables: Mapping[str, DataFrame], concepts: DataFrame, concept: DataFrame,
    tables=DEFAULT_TABLES,
) -> DataFrame:
    """Vocabulary entry, data mode and fill value of each selected concept."""
    extra = union_rows(
        metatables[t.meta_name].select(
            "concept_id", t.fill().cast("double").alias("fill_value"),
            F.lit(t.mode).alias("data_mode"),
        ).distinct()
        for t in tables
    )
    return (
        concept.join(concepts, "concept_id", "left_semi")
        .join(extra, "concept_id")
        .select("concept_id", "concept_name", "domain_id", "vocabulary_id", "concept_class_id",
                "concept_code", "data_mode", "fill_value")
    )


def demographics(cohort: DataFrame, person: DataFrame, concept: DataFrame) -> DataFrame:
    """Birth date, gender and race of each cohort member."""
    def named(kind: str) -> DataFrame:
        return concept.select(
            F.col("concept_id").alias(f"{kind}_concept_id"),
            F.col("concept_name").alias(f"{kind}_concept_name"),
        )

    return (
        person.join(cohort, "person_id", "left_semi")
        .join(named("gender"), "gender_concept_id")
        .join(named("race"), "race_concept_id")
        .select(
            "person_id",
            F.col("birth_datetime").cast("date").alias("birth_date"),
            "gender_concept_id",
            "gender_concept_name",
            F.coalesce("gender_source_concept_id", F.lit(UNKNOWN_GENDER)).alias(
                "gender_source_concept_id"
            ),
            "gender_source_value",
            "race_concept_id",
            "race_concept_name",
            F.coalesce("race_source_concept_id", F.lit(UNKNOWN_RACE)).alias(
                "race_source_concept_id"
            ),
            "race_source_value",
        )
        .distinct()
    )


def demographics_metadata(concept: DataFrame, vocabularies: Mapping[str, str]) -> DataFrame:
    """Concepts of the demographic vocabularies, mapped to their data mode."""
    mode = F.lit(None).cast("string")
    for vocabulary, name in vocabularies.items():
        mode = F.when(F.col("vocabulary_id") == vocabulary, name).otherwise(mode)
    return (
        concept.filter(F.col("vocabulary_id").isin(*vocabularies))
        .select("concept_id", "concept_name", "domain_id", "vocabulary_id", "concept_class_id",
                "concept_code", mode.alias("data_mode"), F.lit(0.0).alias("fill_value"))
        .distinct()
    )


def select_visits(
    stays: DataFrame, data: Mapping[str, DataFrame], concepts: DataFrame, cohort: DataFrame,
    tables=DEFAULT_TABLES,
) -> DataFrame:
    """Stays that end after the person's first event, clamped to start there.

    Duplicate events cannot move a minimum or maximum, so the parts are not
    deduplicated first.
    """
    def moments(t: DataTable) -> DataFrame:
        return data[t.name].join(concepts, "concept_id", "left_semi").select(
            "person_id", F.col("datetime").cast("timestamp_ntz").alias("datetime")
        )

    seen = reduce(lambda a, b: a.unionByName(b), [moments(t) for t in tables])
    ranges = (
        seen.groupBy("person_id")
        .agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"))
        .filter(F.col("first") < F.col("last"))
        .join(cohort, "person_id", "left_semi")
    )
    return (
        stays.join(ranges, "person_id")
        .filter((F.col("start_datetime") < F.col("end_datetime"))
                & (F.col("first") < F.col("end_datetime")))
        .select("person_id", F.greatest("start_datetime", "first").alias("start_datetime"),
                "end_datetime")
    )


def concept_lookup(meta: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """(data_mode, concept_code) to concept_id, optionally for some channels only."""
    keys = ["data_mode", "concept_code"]
    mapping = meta.select(*keys, "concept_id")
    if channels is not None:
        mapping = mapping.join(channels.select(*keys).distinct(), keys, "left_semi")
    return mapping


def legacy_events(frame: DataFrame, meta: DataFrame) -> DataFrame:
    """String-keyed rows (person_id, date, mode, channel, value) to event rows.

    Age, Sex and Race are no events and are left out, as are channels without a
    concept.
    """
    atemporal = F.lower("mode").isin("age", "sex", "race")
    mapping = meta.select(
        F.col("data_mode").alias("mode"), F.col("concept_code").alias("channel"), "concept_id"
    )
    return (
        frame.filter(~atemporal)
        .join(mapping, ["mode", "channel"])
        .select("person_id", "concept_id", F.col("date").cast("timestamp_ntz").alias("datetime"),
                F.col("value").cast("double").alias("value"))
    )


def gender_concept(code: Column) -> Column:
    """Letter codes to the standard gender concepts (fixed values)."""
    return F.when(F.upper(code) == "F", 8532).when(F.upper(code) == "M", 8507).otherwise(0)
