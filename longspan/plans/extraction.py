"""Queries on extraction, selection and metadata."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.operators import evaluate as E
from longspan.operators import extract as X
from longspan.operators import space as S
from longspan.operators.checked import Checks, daily_rules, visit_rules
from longspan.operators.curves import on_grid
from longspan.operators.quantiles import exact_quantiles
from longspan.plans import views as V
from longspan.plans.common import Registry, rounded, text
from longspan.schema import EHR, conform, differing_rows
from longspan.session import TASK_ROWS, materialise, small_tasks, task_count
from longspan.sources.clinical import Clinical

R = Registry()
WHEN = {"birthdate": V.BORN, "startdate": V.SINCE}
VOCABULARIES = {"Local Gender": "Sex", "Local Race": "Race"}
C = V.CLINICAL

TABLES = (
    replace(X.CONDITIONS, selected=lambda: F.col("mentions_daily") >= V.MINIMUM),
    replace(X.MEASUREMENTS, selected=lambda: (F.col("mentions_daily") >= V.MINIMUM)
            & (F.col("persons") >= V.MINIMUM)),
    replace(X.MEDICATIONS, selected=lambda: F.col("mentions_daily") >= V.MINIMUM),
    replace(X.PROCEDURES, selected=lambda: F.col("mentions") >= V.MINIMUM),
)


class Extraction(Clinical):
    """The extraction DAG over one data folder."""

    @cached_property
    def _rows(self) -> int:
        """Rows of the largest table, from the footers."""
        return max(self._table(name).count() for name in ("lineitem", "orders"))

    def _written(self, df: DataFrame) -> DataFrame:
        """A table of its own, made in tasks of bounded size."""
        with small_tasks(self.spark, self._rows):
            return materialise(df)

    def share_items(self) -> None:
        """Line items with their persons as a table of their own, where several data tables read them: one join, not one each."""
        self._items = self._written(self._items.select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus", "o_custkey"))

    @cached_property
    def stats(self) -> DataFrame:
        """A table of its own: one row per concept, read by several steps."""
        with small_tasks(self.spark, self._rows):
            return materialise(X.measurement_stats(self.measurement, self.concept))

    def conditions(self, daily: bool) -> DataFrame:
        return X.conditions(self.person, self.condition_occurrence, self.concept, daily=daily, **WHEN)

    def procedures(self, daily: bool) -> DataFrame:
        return X.procedures(self.person, self.procedure_occurrence, self.concept, daily=daily, **WHEN)

    def medications(self, daily: bool) -> DataFrame:
        return X.medications(self.person, self.drug_exposure, self.x_drug_exposure,
                             self.concept_ancestor, self.concept, daily=daily, **WHEN)

    def measurements(self, daily: bool) -> DataFrame:
        return X.measurements(self.person, self.measurement, self.stats, daily=daily, **WHEN)

    @cached_property
    def data(self) -> dict[str, DataFrame]:
        """Tables of their own: counts, cohort, data and visits all read them."""
        self.share_items()
        return {
            "conditions_daily": self._written(self.conditions(True)),
            "measurements_daily": self._written(self.measurements(True)),
            "medications_daily": self._written(self.medications(True)),
            "procedures": self._written(self.procedures(False)),
        }

    @cached_property
    def counts(self) -> dict[str, DataFrame]:
        """Tables of their own: a few rows from an aggregate of all data."""
        return {name: self._written(X.concept_counts(df)) for name, df in self.data.items()}

    @cached_property
    def concepts(self) -> DataFrame:
        """A table of its own: one row per selected concept."""
        return materialise(X.select_concepts(self.counts, TABLES))

    @cached_property
    def cohort(self) -> DataFrame:
        """A table of its own: one row per person from an aggregate of all data."""
        return self._written(X.select_cohort(self.data, self.concepts, TABLES))

    @cached_property
    def parts(self) -> int | None:
        """Parts that all data together are dealt over; left to Spark while one task can hold them."""
        rows = sum(df.count() for df in self.data.values())
        return task_count(self.spark, rows) if rows > TASK_ROWS else None

    @cached_property
    def visits(self) -> DataFrame:
        return X.visits(self.visit_occurrence, self.person, **WHEN)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("datetime", text("datetime"))


def _rows(table: str, select: str = "person_id, concept_id, CAST(datetime AS VARCHAR) AS datetime") -> str:
    return f"WITH {C},{V.DATA[table]} SELECT {select} FROM {table}"


@R.query("conditions_daily_p2_j1", _rows("conditions_daily"))
def conditions_daily(spark, sf):
    return _dated(Extraction(spark, sf).conditions(True))


@R.query("conditions_p1_a8", _rows("conditions"))
def conditions(spark, sf):
    return _dated(Extraction(spark, sf).conditions(False))


@R.query("procedures_j1", _rows("procedures"))
def procedures(spark, sf):
    return _dated(Extraction(spark, sf).procedures(False))


@R.query("procedures_daily_j1", _rows("procedures_daily"))
def procedures_daily(spark, sf):
    return _dated(Extraction(spark, sf).procedures(True))


@R.query("medications_daily_j2_p4", _rows("medications_daily"))
def medications_daily(spark, sf):
    return _dated(Extraction(spark, sf).medications(True))


@R.query("medications_j2", _rows("medications"))
def medications(spark, sf):
    return _dated(Extraction(spark, sf).medications(False))


_STAT_TEXT = "concept_id, concept_class_id, vocabulary_id, concept_code, concept_name, count"
_STAT_NUMBERS = ["min_value", "max_value", "std_value", *V.PROBABILITIES, "high_threshold",
                 "low_threshold", "iqr"]
_STATS_SQL = f"""WITH {C},{V.STATS} SELECT {_STAT_TEXT},
    {", ".join(f"{V.rounded(c)} AS {c}" for c in _STAT_NUMBERS)} FROM measurement_stats"""


@R.query("measurement_stats_a2_a3_a4_p3", _STATS_SQL)
def measurement_stats(spark, sf):
    stats = Extraction(spark, sf).stats
    return stats.select(*_STAT_TEXT.split(", "), *[rounded(c).alias(c) for c in _STAT_NUMBERS])


@R.query("large_key_quantiles_a2", f"""
SELECT event_type, {", ".join(f"{V.rounded(f'quantile_cont(value, {p})')} AS {n}"
                              for n, p in V.PROBABILITIES.items())}
FROM events GROUP BY event_type""")
def large_key_quantiles(spark, sf):
    """Every key takes the path for keys too large for one task."""
    found = exact_quantiles(Clinical(spark, sf)._table("events"), ["event_type"], "value",
                            list(V.PROBABILITIES.values()), distinct_limit=0)
    return found.select("event_type", *[rounded(F.col("quantiles")[i]).alias(n)
                                        for i, n in enumerate(V.PROBABILITIES)])


_MEASURED = "person_id, concept_id, CAST(datetime AS VARCHAR) AS datetime, value"


@R.query("measurements_daily_w1_p5_j3", _rows("measurements_daily", _MEASURED))
def measurements_daily(spark, sf):
    return _dated(Extraction(spark, sf).measurements(True))


@R.query("measurements_p5_p6", _rows("measurements", _MEASURED))
def measurements(spark, sf):
    return _dated(Extraction(spark, sf).measurements(False))


@R.query("visits_p7", f"WITH {C},{V.VISITS} SELECT * FROM visits")
def visits(spark, sf):
    return Extraction(spark, sf).visits


@R.query("concept_counts_a1", f"WITH {V.EHR} {V.counts('ehr')}")
def concept_counts(spark, sf):
    return X.concept_counts(Clinical(spark, sf).ehr)


@R.query("concept_counts_tables_h6", f"WITH {C},{V.ALL_DATA}, {V.COUNTS} " + " UNION ALL ".join(
    f"SELECT '{t}' AS source, * FROM {t}_counts" for t in V.TABLES))
def concept_counts_tables(spark, sf):
    counts = Extraction(spark, sf).counts
    frames = [df.withColumn("source", F.lit(name)) for name, df in counts.items()]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


@R.query("concepts_a5_u1", f"WITH {C},{V.ALL_DATA}, {V.COUNTS}, {V.CONCEPTS} SELECT * FROM concepts")
def concepts(spark, sf):
    return Extraction(spark, sf).concepts


_LEGACY_WHERE = {
    "conditions_daily": "count(*) >= 200",
    "medications_daily": "count(*) >= 200",
    "measurements_daily": "count(*) >= 200 AND count(DISTINCT person_id) >= 10",
}


@R.query("concepts_older_rule_h11", f"WITH {C}," + ",".join(V.DATA[t] for t in _LEGACY_WHERE)
         + " " + " UNION ".join(f"SELECT concept_id FROM {t} GROUP BY concept_id HAVING {w}"
                                for t, w in _LEGACY_WHERE.items()))
def concepts_older_rule(spark, sf):
    """Earlier thresholds on plain row counts, over three tables."""
    return X.select_concepts(Extraction(spark, sf).counts, _older_tables())


def _older_tables():
    many = lambda: F.col("mentions") >= 200
    return (
        replace(X.CONDITIONS, selected=many),
        replace(X.MEDICATIONS, selected=many),
        replace(X.MEASUREMENTS, selected=lambda: many() & (F.col("persons") >= 10)),
    )


class Older(Extraction):
    """The earlier templates: three tables, row counts, two dates in any of them."""

    @cached_property
    def data(self) -> dict[str, DataFrame]:
        self.share_items()
        return {
            "conditions_daily": self._written(self.conditions(True)),
            "medications_daily": self._written(self.medications(True)),
            "measurements_daily": self._written(self.measurements(True)),
        }

    @cached_property
    def concepts(self) -> DataFrame:
        return materialise(X.select_concepts(self.counts, _older_tables()))

    @cached_property
    def cohort(self) -> DataFrame:
        return self._written(X.select_cohort(self.data, self.concepts, _older_tables()))


_OLDER = f"{C}," + ",".join(V.DATA[t] for t in _LEGACY_WHERE) + ", core AS (" + " UNION ".join(
    f"SELECT concept_id FROM {t} GROUP BY concept_id HAVING {w}" for t, w in _LEGACY_WHERE.items()) + "), people AS (" + " UNION ".join(
    f"SELECT person_id FROM {t} SEMI JOIN core USING (concept_id) GROUP BY person_id, concept_id HAVING count(DISTINCT datetime) > 1"
    for t in _LEGACY_WHERE) + ")"


@R.query("cohort_older_rule_h11", f"WITH {_OLDER} SELECT * FROM people")
def cohort_older_rule(spark, sf):
    return Older(spark, sf).cohort


@R.query("data_older_rule_h11", f"WITH {_OLDER}, points AS (" + " UNION ".join(
    f"SELECT person_id, concept_id, datetime, {'value' if t == 'measurements_daily' else 'CAST(NULL AS DOUBLE) AS value'} FROM {t}"
    for t in _LEGACY_WHERE) + """)
SELECT person_id, concept_id, CAST(CAST(datetime AS TIMESTAMP) AS VARCHAR) AS datetime, value
FROM points SEMI JOIN core USING (concept_id) SEMI JOIN people USING (person_id)""")
def data_older_rule(spark, sf):
    x = Older(spark, sf)
    return _dated(X.select_data(x.data, x.concepts, x.cohort, _older_tables(), parts=x.parts))


@R.query("metadata_older_rule_h11", f"""WITH {_OLDER}, fills AS (
    SELECT concept_id, 'Measurement' AS data_mode, p50 AS fill_value FROM measurement_stats
    UNION SELECT concept_id, 'Condition', 1 / (20 * 365.25) FROM conditions_daily
    UNION SELECT concept_id, 'Medication', 0 FROM medications_daily)
SELECT c.*, data_mode, {V.rounded('CAST(fill_value AS DOUBLE)', 9)} AS fill_value
FROM concept c SEMI JOIN core USING (concept_id) JOIN fills USING (concept_id)""")
def metadata_older_rule(spark, sf):
    x = Older(spark, sf)
    meta = X.concept_metadata({**x.data, "measurement_stats": x.stats}, x.concepts, x.concept, _older_tables())
    return meta.withColumn("fill_value", rounded("fill_value", 9))


@R.query("data_checks_t6_s7", f"""WITH {C}, ship AS (
    SELECT o_custkey AS person_id, l_linenumber AS concept_id, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS DOUBLE) AS value FROM items),
grid AS (SELECT o_custkey AS person_id, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1),
placed AS (SELECT *, lag(day) OVER (PARTITION BY person_id, concept_id ORDER BY day) AS before FROM ship LEFT JOIN grid USING (person_id)),
seen AS (SELECT count(*) AS rows, count(*) FILTER (lo >= hi) AS two_days, count(*) FILTER (day < lo OR day > hi) AS off,
    count(*) FILTER (before = day) AS again FROM placed),
stays AS (SELECT count(*) AS rows, count(*) FILTER (visit_end_datetime IS NULL) AS ends,
    count(*) FILTER (visit_start_datetime > visit_end_datetime) AS turned FROM visit_occurrence)
SELECT 'daily rows' AS "table", 'two days of grid' AS rule, rows, two_days AS breaches FROM seen
UNION ALL SELECT 'daily rows', 'a day on the grid', rows, off FROM seen
UNION ALL SELECT 'daily rows', 'one row per day', rows, again FROM seen
UNION ALL SELECT 'daily rows', 'an event', rows, 0 FROM seen
UNION ALL SELECT 'daily rows', 'a finite value', rows, 0 FROM seen
UNION ALL SELECT 'visits', 'a person', rows, 0 FROM stays
UNION ALL SELECT 'visits', 'a start', rows, 0 FROM stays
UNION ALL SELECT 'visits', 'an end', rows, ends FROM stays
UNION ALL SELECT 'visits', 'start before end', rows, turned FROM stays""")
def data_checks(spark, sf):
    """Breaches of the rules of daily rows (ship dates on a grid of order dates) and visits, each counted as the rows are written."""
    x = Extraction(spark, sf)
    orders = x._table("orders")
    ship = x._table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person_id"), F.col("l_linenumber").alias("concept_id"),
        F.col("l_shipdate").cast("date").alias("day"), F.lit(1).alias("n"), F.col("l_quantity").cast("double").alias("value"))
    grid = orders.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    stays = x.visit_occurrence.select("person_id", F.col("visit_start_datetime").alias("start_datetime"),
                                      F.col("visit_end_datetime").alias("end_datetime"))
    checks = Checks()
    materialise(checks.watch(on_grid(ship, grid), "daily rows", daily_rules()))
    materialise(checks.watch(stays, "visits", visit_rules()))
    return spark.createDataFrame(checks.report(), "table string, rule string, rows long, breaches long")


@R.query("conformed_events_s6", """SELECT user_id AS person_id, ascii(event_type) AS concept_id,
    date_trunc('second', ts) AS datetime, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value FROM events""")
def conformed_events(spark, sf):
    """Text keys, other names and NaN where there is no value, read back through the schema of events."""
    events = Extraction(spark, sf)._table("events").select(
        F.col("user_id").cast("string").alias("person_id"), F.ascii("event_type").alias("measurement_concept_id"),
        F.col("ts").alias("date"), F.when(F.col("event_type") == "click", float("nan")).otherwise(F.col("value")).alias("value"))
    return conform(events, EHR)


@R.query("differing_rows_p11", """WITH a AS (SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS day FROM orders),
b AS (SELECT o_custkey AS person_id, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT person_id, CAST(day AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS surplus
FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY person_id, day HAVING sum(n) <> 0""")
def differences(spark, sf):
    x = Extraction(spark, sf)
    orders = x._table("orders")
    shipped = x._table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    left = orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("day"))
    right = shipped.select(F.col("o_custkey").alias("person_id"), F.col("l_shipdate").cast("date").alias("day"))
    return differing_rows(left, right).withColumn("day", text("day"))


@R.query("cohort_a6_j4", f"WITH {V.SELECTION} SELECT * FROM cohort")
def cohort(spark, sf):
    return Extraction(spark, sf).cohort


@R.query("cohort_intersect_u2", f"""WITH {V.SELECTION}
SELECT person_id FROM cohort INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def cohort_intersect(spark, sf):
    x = Extraction(spark, sf)
    chosen = x._table("customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("person_id")
    )
    return x._written(X.select_cohort(x.data, x.concepts, TABLES, intersect_on=chosen))


_DATA_SQL = f"""WITH {V.SELECTION}, {V.DATAPOINTS}
SELECT DISTINCT person_id, concept_id, CAST({{}} AS VARCHAR) AS datetime, value
FROM datapoints JOIN concepts USING (concept_id) JOIN cohort USING (person_id)"""


@R.query("select_data_j6_o1", _DATA_SQL.format("datetime"))
def select_data(spark, sf):
    x = Extraction(spark, sf)
    found = _dated(X.select_data(x.data, x.concepts, x.cohort, TABLES, parts=x.parts))
    keys = ["person_id", "concept_id", "datetime"]
    if x.parts is None:
        return found.orderBy(*keys)
    return found.repartitionByRange(x.parts, *keys).sortWithinPartitions(*keys)


@R.query("select_data_dates_f1", _DATA_SQL.format("CAST(datetime AS DATE)"))
def select_data_dates(spark, sf):
    x = Extraction(spark, sf)
    return _dated(X.select_data(x.data, x.concepts, x.cohort, TABLES, date_convert=True, parts=x.parts))


_EXTRA = f"""extra AS (
    SELECT DISTINCT concept_id, 1 / (20 * 365.25) AS fill_value, 'Condition' AS data_mode FROM conditions_daily
    UNION SELECT concept_id, p50, 'Measurement' FROM measurement_stats
    UNION SELECT concept_id, 0.0, 'Medication' FROM medications_daily
    UNION SELECT concept_id, 0.0, 'Procedure' FROM procedures)"""


@R.query("concept_metadata_j7_p9_h7", f"""WITH {V.SELECTION}, {_EXTRA}
SELECT C.*, data_mode, {V.rounded('CAST(fill_value AS DOUBLE)', 9)} AS fill_value
FROM concepts JOIN concept C USING (concept_id) JOIN extra USING (concept_id)""")
def concept_metadata(spark, sf):
    x = Extraction(spark, sf)
    meta = X.concept_metadata({**x.data, "measurement_stats": x.stats}, x.concepts, x.concept, TABLES)
    return meta.withColumn("fill_value", rounded("fill_value", 9))


@R.query("concept_lookup_p16", f"""WITH {V.SELECTION}, {_EXTRA}
SELECT DISTINCT data_mode, concept_code, concept_id
FROM concepts JOIN concept C USING (concept_id) JOIN extra USING (concept_id)
JOIN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F') ON o_orderpriority = concept_code
WHERE data_mode = 'Condition'""")
def concept_lookup(spark, sf):
    x = Extraction(spark, sf)
    meta = X.concept_metadata({**x.data, "measurement_stats": x.stats}, x.concepts, x.concept, TABLES)
    channels = x._table("orders").filter(F.col("o_orderstatus") == "F").select(
        F.lit("Condition").alias("data_mode"), F.col("o_orderpriority").alias("concept_code"))
    return X.concept_lookup(meta, channels)


@R.query("demographics_j5_f2_h8", f"""WITH {V.SELECTION}
SELECT DISTINCT person_id, CAST(CAST(birth_datetime AS DATE) AS VARCHAR) AS birth_date, gender_concept_id,
    G.concept_name AS gender_concept_name,
    coalesce(gender_source_concept_id, 2000003109) AS gender_source_concept_id, gender_source_value,
    race_concept_id, A.concept_name AS race_concept_name,
    coalesce(race_source_concept_id, 2003603112) AS race_source_concept_id, race_source_value
FROM cohort JOIN person P USING (person_id) JOIN concept G ON P.gender_concept_id = G.concept_id
JOIN concept A ON P.race_concept_id = A.concept_id""")
def demographics(spark, sf):
    x = Extraction(spark, sf)
    return X.demographics(x.cohort, x.person, x.concept).withColumn("birth_date", text("birth_date"))


@R.query("demographics_metadata_p8_f5_h9", f"""WITH {C}
SELECT DISTINCT concept.*, CASE WHEN vocabulary_id = 'Local Gender' THEN 'Sex'
    WHEN vocabulary_id = 'Local Race' THEN 'Race' END AS data_mode, CAST(0.0 AS DOUBLE) AS fill_value
FROM concept WHERE vocabulary_id IN ('Local Gender', 'Local Race')""")
def demographics_metadata(spark, sf):
    return X.demographics_metadata(Clinical(spark, sf).concept, VOCABULARIES)


@R.query("select_visits_a7_j8_f4_h10", f"""WITH {V.SELECTION}, {V.DATAPOINTS}, {V.VISITS},
ranges AS (
    SELECT person_id, min(datetime) AS first, max(datetime) AS last
    FROM datapoints JOIN concepts USING (concept_id) JOIN cohort USING (person_id)
    GROUP BY person_id HAVING min(datetime) < max(datetime))
SELECT person_id, greatest(start_datetime, first) AS start_datetime, end_datetime
FROM visits JOIN ranges USING (person_id) WHERE start_datetime < end_datetime AND first < end_datetime""")
def select_visits(spark, sf):
    x = Extraction(spark, sf)
    return X.select_visits(x.visits, x.data, x.concepts, x.cohort, TABLES)


@R.query("overlapping_visits_p14", f"""WITH {C},{V.VISITS}, {V.DATA['conditions_daily']},
ranges AS (SELECT person_id, min(datetime) AS first, max(datetime) AS last FROM conditions_daily GROUP BY 1)
SELECT person_id, start_datetime, end_datetime FROM visits JOIN ranges USING (person_id)
WHERE start_datetime <= last AND first <= end_datetime""")
def overlapping_visits(spark, sf):
    from longspan.functions.time import overlaps

    x = Extraction(spark, sf)
    ranges = x.conditions(True).groupBy("person_id").agg(
        F.min("datetime").cast("timestamp_ntz").alias("first"),
        F.max("datetime").cast("timestamp_ntz").alias("last"))
    shared = overlaps(F.col("start_datetime"), F.col("end_datetime"), F.col("first"), F.col("last"))
    return x.visits.join(ranges, "person_id").filter(shared).select(
        "person_id", "start_datetime", "end_datetime")


@R.query("visit_timepoints_a10", f"""WITH {C},{V.VISITS}
SELECT CAST(sum(date_diff('second', start_datetime, end_datetime)) AS BIGINT) AS ntimepoints FROM visits""")
def visit_timepoints(spark, sf):
    return S.visit_timepoints(Extraction(spark, sf).visits)


@R.query("legacy_events_s23", f"""WITH {C}
SELECT person_id, concept_id, CAST(condition_start_date AS TIMESTAMP) AS datetime, CAST(NULL AS DOUBLE) AS value
FROM condition_occurrence JOIN concept ON concept_id = condition_concept_id""")
def legacy_events(spark, sf):
    """String-keyed rows (with a demographic row per person) mapped to concepts."""
    x = Clinical(spark, sf)
    orders = x._table("orders").select(
        F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("date"),
        F.lit("Condition").alias("mode"), F.col("o_orderpriority").alias("channel"),
        F.lit(None).cast("double").alias("value"))
    sexes = x._table("customer").select(
        F.col("c_custkey").alias("person_id"), F.lit(None).cast("date").alias("date"),
        F.lit("Sex").alias("mode"), F.col("c_mktsegment").alias("channel"), F.lit(1.0).alias("value"))
    meta = x.concept.withColumn("data_mode", F.lit("Condition")).filter(F.col("domain_id") == "Condition")
    return X.legacy_events(orders.unionByName(sexes), meta)


@R.query("gender_letters_s23", """
SELECT c_custkey AS person_id, CASE WHEN c_nationkey % 3 = 0 THEN 8532 WHEN c_nationkey % 3 = 1 THEN 8507
    ELSE 0 END AS concept_id FROM customer""")
def gender_letters(spark, sf):
    letter = F.when(F.col("c_nationkey") % 3 == 0, "f").when(F.col("c_nationkey") % 3 == 1, "M")
    return Clinical(spark, sf)._table("customer").select(
        F.col("c_custkey").alias("person_id"), X.gender_concept(letter).alias("concept_id"))


@R.query("threshold_grid_a20", f"""WITH {C},{V.ALL_DATA}, {V.COUNTS},
counted AS ({" UNION ALL ".join(f"SELECT * FROM {t}_counts" for t in V.TABLES)}),
n AS (SELECT unnest([1, 10, 100, 500, 1000, 2000]) AS n)
SELECT CAST(a.n AS BIGINT) AS persons, CAST(b.n AS BIGINT) AS mentions,
    (SELECT count(*) FROM counted c WHERE c.persons >= a.n AND c.mentions >= b.n) AS concepts FROM n a, n b""")
def threshold_grid(spark, sf):
    return E.threshold_grid(concept_counts_tables(spark, sf))


@R.query("threshold_grid_100_a20", f"""WITH {C},{V.ALL_DATA}, {V.COUNTS},
counted AS ({" UNION ALL ".join(f"SELECT * FROM {t}_counts" for t in V.TABLES)}),
n AS (SELECT 1 + k * k AS n FROM (SELECT unnest(range(100)) AS k))
SELECT a.n AS persons, b.n AS mentions, count(c.persons) AS concepts
FROM n a CROSS JOIN n b LEFT JOIN counted c ON c.persons >= a.n AND c.mentions >= b.n GROUP BY 1, 2""")
def threshold_grid_100(spark, sf):
    return E.threshold_grid(concept_counts_tables(spark, sf), [1 + k * k for k in range(100)])
