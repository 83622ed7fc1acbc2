"""Clinical-shaped tables derived from the given star schema.

``events`` already is an event log. The relational side maps orders to
diagnoses and admissions and line items to measurements, drug exposures and
procedures; parts supply the vocabulary. Nothing is generated: every row comes
from the given tables, so the work grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions.time import whole_second
from longspan.sources.tables import table

# Event types in alphabetical order and their data modes.
EVENT_CONCEPTS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
EVENT_MODES = {
    "click": "Condition",
    "error": "Condition",
    "purchase": "Measurement",
    "signup": "Medication",
    "view": "Measurement",
}
# Part types in alphabetical order, order priorities, return flags and their numbers.
PART_TYPES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
RETURN_FLAGS = {"A": 65, "N": 78, "R": 82}

CONDITION_BASE = 1000
MEASUREMENT_BASE = 2000
INGREDIENT_BASE = 3000
PROCEDURE_BASE = 4000
GENDER_BASE = 5000
RACE_BASE = 6000
DRUG_BASE = 100_000
INPATIENT = 9201


def _lookup(column: Column, mapping: dict) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*pairs)[column]


def _concept(column: Column, numbers: dict[str, int], base: int = 0) -> Column:
    """Concept id of a text: a number from the base on, or a negative hash if it is none of the known ones."""
    other = -F.shiftrightunsigned(F.xxhash64(column), 1) - 1
    return F.when(column.isNotNull(), F.coalesce(base + _lookup(column, numbers).cast("long"), other))


def event_concept(kind: Column) -> Column:
    return _concept(kind, EVENT_CONCEPTS)


def birth_date(person_id: Column) -> Column:
    return F.date_add(F.lit("1950-01-01").cast("date"), (person_id * 97 % 15000).cast("int"))


class Clinical:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._schemas: dict = {}

    def _table(self, name: str) -> DataFrame:
        """A fresh scan; the footer is read for the schema only once."""
        found = table(self.spark, self.folder, name, self._schemas.get(name))
        self._schemas.setdefault(name, found.schema)
        return found

    # --- event log -------------------------------------------------------

    @cached_property
    def ehr(self) -> DataFrame:
        kind = F.col("event_type")
        return self._table("events").select(
            F.col("user_id").alias("person_id"),
            event_concept(kind).alias("concept_id"),
            whole_second(F.col("ts")).alias("datetime"),
            F.when(_lookup(kind, EVENT_MODES) == "Measurement", F.col("value")).alias("value"),
        )

    @cached_property
    def meta(self) -> DataFrame:
        """Concept dimension of the event log; five fixed rows."""
        rows = [(EVENT_CONCEPTS[k], EVENT_MODES[k]) for k in EVENT_CONCEPTS]
        return self.spark.createDataFrame(rows, "concept_id long, data_mode string")

    @cached_property
    def users(self) -> DataFrame:
        """Persons of the event log with birthday and two demographic concepts."""
        ids = self._table("events").select(F.col("user_id").alias("person_id")).distinct()
        person = F.col("person_id")
        return ids.select(
            person,
            birth_date(person).alias("birth_date"),
            (GENDER_BASE + person % 2).alias("gender_concept_id"),
            (RACE_BASE + person % 5).alias("race_concept_id"),
        )

    # --- relational side -------------------------------------------------

    @cached_property
    def _items(self) -> DataFrame:
        """Line items with the ordering person."""
        orders = self._table("orders").select("o_orderkey", "o_custkey")
        return self._table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def person(self) -> DataFrame:
        nation = self._table("nation").select("n_nationkey", "n_regionkey")
        key = F.col("c_custkey")
        country = F.col("c_nationkey").cast("long")
        return (
            self._table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("person_id"),
                birth_date(key).cast("timestamp_ntz").alias("birth_datetime"),
                (GENDER_BASE + country).alias("gender_concept_id"),
                F.when(country % 5 != 0, GENDER_BASE + country).alias("gender_source_concept_id"),
                F.col("c_mktsegment").alias("gender_source_value"),
                (RACE_BASE + F.col("n_regionkey")).cast("long").alias("race_concept_id"),
                F.when(country % 3 != 0, RACE_BASE + F.col("n_regionkey"))
                .cast("long")
                .alias("race_source_concept_id"),
                F.col("n_regionkey").cast("string").alias("race_source_value"),
            )
        )

    @cached_property
    def concept(self) -> DataFrame:
        def rows(df, key, name, domain, vocabulary, kind, code):
            return df.select(
                key.cast("long").alias("concept_id"),
                name.alias("concept_name"),
                F.lit(domain).alias("domain_id"),
                F.lit(vocabulary).alias("vocabulary_id"),
                kind.alias("concept_class_id"),
                code.cast("string").alias("concept_code"),
            )

        orders = self._table("orders").select("o_orderpriority").distinct()
        part = self._table("part")
        brands = part.select("p_brand").distinct()
        number = _brand_number(F.col("p_brand"))
        lab = (
            F.when(number % 3 == 0, "Lab Test")
            .when(number % 3 == 1, "Clinical Observation")
            .otherwise("Survey")
        )
        types = part.select("p_type").distinct()
        flags = self._table("lineitem").select("l_returnflag").distinct()
        parts = [
            rows(orders, _priority_concept(), F.col("o_orderpriority"), "Condition", "SNOMED",
                 F.lit("Clinical Finding"), F.col("o_orderpriority")),
            rows(brands, MEASUREMENT_BASE + number, F.col("p_brand"), "Measurement", "LOINC",
                 lab, F.col("p_brand")),
            rows(types, _concept(F.col("p_type"), PART_TYPES, INGREDIENT_BASE), F.col("p_type"), "Drug",
                 "RxNorm", F.lit("Ingredient"), F.col("p_type")),
            rows(part, DRUG_BASE + F.col("p_partkey"), F.col("p_name"), "Drug", "RxNorm",
                 F.lit("Clinical Drug"), F.col("p_partkey")),
            rows(flags, _flag_concept(), F.col("l_returnflag"),
                 "Procedure", "CPT4", F.lit("CPT4"), F.col("l_returnflag")),
            rows(self._table("nation"), GENDER_BASE + F.col("n_nationkey"), F.col("n_name"),
                 "Gender", "Local Gender", F.lit("Gender"), F.col("n_nationkey")),
            rows(self._table("region"), RACE_BASE + F.col("r_regionkey"), F.col("r_name"),
                 "Race", "Local Race", F.lit("Race"), F.col("r_regionkey")),
        ]
        merged = parts[0]
        for other in parts[1:]:
            merged = merged.unionByName(other)
        return merged

    @cached_property
    def condition_occurrence(self) -> DataFrame:
        return self._table("orders").select(
            F.col("o_custkey").alias("person_id"),
            _priority_concept().alias("condition_concept_id"),
            F.col("o_orderdate").alias("condition_start_datetime"),
            F.col("o_orderdate").cast("date").alias("condition_start_date"),
        )

    @cached_property
    def measurement(self) -> DataFrame:
        part = self._table("part").select("p_partkey", "p_brand")
        moment = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))
        return self._items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("o_custkey").alias("person_id"),
            (MEASUREMENT_BASE + _brand_number(F.col("p_brand"))).alias("measurement_concept_id"),
            moment.alias("measurement_datetime"),
            F.col("l_shipdate").cast("date").alias("measurement_date"),
            F.col("l_quantity").alias("value_as_number"),
        )

    @property
    def _exposure_id(self) -> Column:
        return F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")

    @cached_property
    def drug_exposure(self) -> DataFrame:
        return self._items.select(
            self._exposure_id.alias("drug_exposure_id"),
            F.col("o_custkey").alias("person_id"),
            (DRUG_BASE + F.col("l_partkey")).alias("drug_concept_id"),
            F.col("l_shipdate").alias("drug_exposure_start_datetime"),
            F.col("l_shipdate").cast("date").alias("drug_exposure_start_date"),
            F.when(F.col("l_quantity") > 5, F.col("l_linestatus")).alias("route_source_value"),
        )

    @cached_property
    def x_drug_exposure(self) -> DataFrame:
        def text_if(present: Column, text: Column) -> Column:
            return F.when(present, text).otherwise("")

        return self._table("lineitem").select(
            self._exposure_id.alias("drug_exposure_id"),
            text_if(F.col("l_discount") > 0.02, F.lit("strength")).alias("x_strength"),
            text_if(F.col("l_tax") > 0.02, F.lit("dose")).alias("x_dose"),
            text_if(F.col("l_linenumber") > 1, F.lit("daily")).alias("x_frequency"),
            F.when(F.col("l_returnflag") != "R", "Problem list")
            .otherwise("Note")
            .alias("x_doc_stype"),
        )

    @cached_property
    def concept_ancestor(self) -> DataFrame:
        return self._table("part").select(
            _concept(F.col("p_type"), PART_TYPES, INGREDIENT_BASE).alias("ancestor_concept_id"),
            (DRUG_BASE + F.col("p_partkey")).alias("descendant_concept_id"),
        )

    @cached_property
    def procedure_occurrence(self) -> DataFrame:
        return self._items.select(
            F.col("o_custkey").alias("person_id"),
            _flag_concept().alias("procedure_concept_id"),
            F.col("l_shipdate").alias("procedure_datetime"),
            F.col("l_shipdate").cast("date").alias("procedure_date"),
        )

    @cached_property
    def visit_occurrence(self) -> DataFrame:
        ends = self._table("lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").alias("last_ship")
        )
        admitted = F.when(F.col("o_orderstatus") == "F", INPATIENT).otherwise(9202)
        return (
            self._table("orders")
            .join(ends, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(
                F.col("o_custkey").alias("person_id"),
                F.col("o_orderdate").alias("visit_start_datetime"),
                F.col("last_ship").alias("visit_end_datetime"),
                admitted.cast("long").alias("visit_concept_id"),
            )
        )

    @cached_property
    def matrix(self) -> DataFrame:
        """Observations with a dense feature array."""
        return self._table("embeddings").select(
            F.col("vec_id").alias("obs_id"),
            F.col("embedding").cast("array<double>").alias("features"),
            F.col("label").cast("long").alias("label"),
        )


def _priority_concept() -> Column:
    return _concept(F.col("o_orderpriority"), PRIORITIES, CONDITION_BASE)


def _flag_concept() -> Column:
    return _concept(F.col("l_returnflag"), RETURN_FLAGS, PROCEDURE_BASE)


def _brand_number(brand: Column) -> Column:
    return F.regexp_replace(brand, "Brand#", "").cast("long")
