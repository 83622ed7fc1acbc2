"""SQL text of the clinical-shaped views, for the side-by-side checks."""

from __future__ import annotations

EHR = """
ehr AS (
    SELECT user_id AS person_id,
        CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
             WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS BIGINT) AS concept_id,
        date_trunc('second', ts) AS datetime,
        CASE WHEN event_type IN ('purchase', 'view') THEN value END AS value
    FROM events),
meta AS (
    SELECT CAST(concept_id AS BIGINT) AS concept_id, data_mode
    FROM (VALUES (1, 'Condition'), (2, 'Condition'), (3, 'Measurement'), (4, 'Medication'),
                 (5, 'Measurement')) AS t(concept_id, data_mode)),
users AS (
    SELECT person_id, DATE '1950-01-01' + CAST(person_id * 97 % 15000 AS INTEGER) AS birth_date,
        5000 + person_id % 2 AS gender_concept_id, 6000 + person_id % 5 AS race_concept_id
    FROM (SELECT DISTINCT user_id AS person_id FROM events))
"""

CLINICAL = """
items AS (
    SELECT l.*, o_custkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
type_numbers AS (
    SELECT * FROM (VALUES ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 4), ('SMALL', 5),
                          ('STANDARD', 6)) AS t(p_type, number)),
person AS (
    SELECT c_custkey AS person_id,
        CAST(DATE '1950-01-01' + CAST(c_custkey * 97 % 15000 AS INTEGER) AS TIMESTAMP) AS birth_datetime,
        5000 + CAST(c_nationkey AS BIGINT) AS gender_concept_id,
        CASE WHEN c_nationkey % 5 <> 0 THEN 5000 + CAST(c_nationkey AS BIGINT) END AS gender_source_concept_id,
        c_mktsegment AS gender_source_value,
        6000 + CAST(n_regionkey AS BIGINT) AS race_concept_id,
        CASE WHEN c_nationkey % 3 <> 0 THEN 6000 + CAST(n_regionkey AS BIGINT) END AS race_source_concept_id,
        CAST(n_regionkey AS VARCHAR) AS race_source_value
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
concept AS (
    SELECT DISTINCT 1000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS concept_id,
        o_orderpriority AS concept_name, 'Condition' AS domain_id, 'SNOMED' AS vocabulary_id,
        'Clinical Finding' AS concept_class_id, o_orderpriority AS concept_code FROM orders
    UNION ALL
    SELECT DISTINCT 2000 + CAST(replace(p_brand, 'Brand#', '') AS BIGINT), p_brand, 'Measurement', 'LOINC',
        CASE CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 3 WHEN 0 THEN 'Lab Test'
             WHEN 1 THEN 'Clinical Observation' ELSE 'Survey' END, p_brand FROM part
    UNION ALL
    SELECT DISTINCT 3000 + number, p_type, 'Drug', 'RxNorm', 'Ingredient', p_type
    FROM part JOIN type_numbers USING (p_type)
    UNION ALL
    SELECT 100000 + p_partkey, p_name, 'Drug', 'RxNorm', 'Clinical Drug', CAST(p_partkey AS VARCHAR) FROM part
    UNION ALL
    SELECT DISTINCT 4000 + ascii(l_returnflag), l_returnflag, 'Procedure', 'CPT4', 'CPT4', l_returnflag
    FROM lineitem
    UNION ALL
    SELECT 5000 + n_nationkey, n_name, 'Gender', 'Local Gender', 'Gender', CAST(n_nationkey AS VARCHAR)
    FROM nation
    UNION ALL
    SELECT 6000 + r_regionkey, r_name, 'Race', 'Local Race', 'Race', CAST(r_regionkey AS VARCHAR) FROM region),
condition_occurrence AS (
    SELECT o_custkey AS person_id, 1000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS condition_concept_id,
        o_orderdate AS condition_start_datetime, CAST(o_orderdate AS DATE) AS condition_start_date FROM orders),
measurement AS (
    SELECT o_custkey AS person_id, 2000 + CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS measurement_concept_id,
        l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS measurement_datetime,
        CAST(l_shipdate AS DATE) AS measurement_date, l_quantity AS value_as_number
    FROM items JOIN part ON l_partkey = p_partkey),
drug_exposure AS (
    SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS drug_exposure_id, o_custkey AS person_id,
        100000 + l_partkey AS drug_concept_id, l_shipdate AS drug_exposure_start_datetime,
        CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
        CASE WHEN l_quantity > 5 THEN l_linestatus END AS route_source_value
    FROM items),
x_drug_exposure AS (
    SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS drug_exposure_id,
        CASE WHEN l_discount > 0.02 THEN 'strength' ELSE '' END AS x_strength,
        CASE WHEN l_tax > 0.02 THEN 'dose' ELSE '' END AS x_dose,
        CASE WHEN l_linenumber > 1 THEN 'daily' ELSE '' END AS x_frequency,
        CASE WHEN l_returnflag <> 'R' THEN 'Problem list' ELSE 'Note' END AS x_doc_stype
    FROM lineitem),
concept_ancestor AS (
    SELECT 3000 + number AS ancestor_concept_id, 100000 + p_partkey AS descendant_concept_id
    FROM part JOIN type_numbers USING (p_type)),
procedure_occurrence AS (
    SELECT o_custkey AS person_id, CAST(4000 + ascii(l_returnflag) AS BIGINT) AS procedure_concept_id,
        l_shipdate AS procedure_datetime, CAST(l_shipdate AS DATE) AS procedure_date FROM items),
visit_occurrence AS (
    SELECT o_custkey AS person_id, o_orderdate AS visit_start_datetime, last_ship AS visit_end_datetime,
        CASE WHEN o_orderstatus = 'F' THEN 9201 ELSE 9202 END AS visit_concept_id
    FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1)
        ON o_orderkey = l_orderkey),
eligible AS (SELECT person_id FROM person WHERE birth_datetime >= TIMESTAMP '1960-01-01')
"""

BORN, SINCE = "1960-01-01", "1996-01-01"


# Each table below is its source's recent rows, restricted step by step by semi joins with what is allowed.


def _coded(name: str, kind: str, source: str, moment: str, allowed: str) -> str:
    """Occurrences of allowed concepts in eligible persons, each key once."""
    return f"""
{name}_recent AS (
    SELECT person_id, {kind}_concept_id AS concept_id, {kind}_{moment} AS datetime
    FROM {source} WHERE {kind}_{moment} >= TIMESTAMP '{SINCE}'),
{name}_allowed AS (
    FROM {name}_recent SEMI JOIN (SELECT concept_id FROM concept WHERE {allowed}) USING (concept_id)),
{name} AS (SELECT DISTINCT * FROM {name}_allowed SEMI JOIN eligible USING (person_id))"""


def _taken(name: str, moment: str) -> str:
    """Documented exposures of eligible persons, as ingredients."""
    return f"""
{name}_documented AS (
    SELECT drug_exposure_id FROM x_drug_exposure
    WHERE x_doc_stype = 'Problem list' AND x_frequency <> '' AND x_strength || x_dose <> ''),
{name}_routed AS (
    SELECT drug_exposure_id, person_id, drug_concept_id, drug_exposure_start_{moment} AS datetime FROM drug_exposure
    WHERE route_source_value IS NOT NULL AND drug_exposure_start_{moment} >= TIMESTAMP '{SINCE}'),
{name}_complete AS (
    FROM {name}_routed SEMI JOIN {name}_documented USING (drug_exposure_id) SEMI JOIN eligible USING (person_id)),
{name}_ingredients AS (
    SELECT ancestor_concept_id AS concept_id, descendant_concept_id AS drug_concept_id FROM concept_ancestor
    WHERE ancestor_concept_id IN (SELECT concept_id FROM concept WHERE concept_class_id = 'Ingredient')),
{name} AS (
    SELECT DISTINCT person_id, concept_id, datetime FROM {name}_complete JOIN {name}_ingredients USING (drug_concept_id))"""


PROBABILITIES = {
    "p0001": 0.0001, "p001": 0.001, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5,
    "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999, "p9999": 0.9999,
}
_NAMED = ", ".join(f"q[{i}] AS {name}" for i, name in enumerate(PROBABILITIES, 1))

# One list of quantiles per concept; spread and thresholds come from it afterwards.
STATS = f"""
labs AS (
    SELECT concept_id, concept_class_id, vocabulary_id, concept_code, concept_name FROM concept
    WHERE concept_id = 44806420 OR concept_class_id IN ('Clinical Observation', 'Lab Test')),
lab_lists AS (
    SELECT measurement_concept_id AS concept_id, count(*) AS count, min(value_as_number) AS min_value,
        max(value_as_number) AS max_value, stddev_samp(value_as_number) AS std_value,
        quantile_cont(value_as_number, {list(PROBABILITIES.values())}) AS q
    FROM measurement GROUP BY measurement_concept_id),
lab_quantiles AS (SELECT concept_id, count, min_value, max_value, std_value, {_NAMED} FROM lab_lists),
measurement_stats AS (
    SELECT *, p99 + abs(p99 - p50) AS high_threshold, p01 - abs(p01 - p50) AS low_threshold, p75 - p25 AS iqr
    FROM labs JOIN lab_quantiles USING (concept_id) WHERE p75 > p25)"""

# Values of eligible persons without outliers, and without values that must be positive but are not.
_PLAUSIBLE = f"""
labs_kept AS (
    SELECT concept_id, high_threshold, p01 > 0 AS is_positive FROM measurement_stats
    WHERE concept_code NOT IN ('29463-7', '8302-2', '39156-5')),
values_seen AS (
    SELECT person_id, measurement_concept_id AS concept_id, measurement_datetime AS moment, measurement_date AS day,
        value_as_number AS value
    FROM measurement SEMI JOIN eligible USING (person_id) WHERE measurement_datetime >= TIMESTAMP '{SINCE}'),
plausible AS (
    SELECT person_id, concept_id, moment, day, value FROM values_seen JOIN labs_kept USING (concept_id)
    WHERE value < high_threshold AND NOT (is_positive AND value <= 0))"""

MEASUREMENTS = f"""{_PLAUSIBLE},
measurements AS (SELECT DISTINCT person_id, concept_id, moment AS datetime, value FROM plausible)"""
MEASUREMENTS_DAILY = f"""{_PLAUSIBLE},
measurements_daily AS (
    SELECT person_id, concept_id, day AS datetime, value FROM plausible
    QUALIFY row_number() OVER (PARTITION BY person_id, concept_id, day ORDER BY moment DESC, value DESC) = 1)"""

_DIAGNOSES = "(domain_id, vocabulary_id) = ('Condition', 'SNOMED')"
DATA = {
    "conditions": _coded("conditions", "condition", "condition_occurrence", "start_datetime", _DIAGNOSES),
    "conditions_daily": _coded("conditions_daily", "condition", "condition_occurrence", "start_date", _DIAGNOSES),
    "procedures": _coded("procedures", "procedure", "procedure_occurrence", "datetime", "domain_id = 'Procedure'"),
    "procedures_daily": _coded("procedures_daily", "procedure", "procedure_occurrence", "date", "domain_id = 'Procedure'"),
    "medications": _taken("medications", "datetime"),
    "medications_daily": _taken("medications_daily", "date"),
    "measurements": STATS + "," + MEASUREMENTS,
    "measurements_daily": STATS + "," + MEASUREMENTS_DAILY,
}
VISITS = f"""
stays AS (
    SELECT person_id, visit_start_datetime AS start_datetime, visit_end_datetime AS end_datetime FROM visit_occurrence
    WHERE visit_concept_id = 9201 AND visit_start_datetime >= TIMESTAMP '{SINCE}'),
visits AS (SELECT DISTINCT * FROM stays SEMI JOIN eligible USING (person_id) WHERE end_datetime > start_datetime)"""

TABLES = ("conditions_daily", "measurements_daily", "medications_daily", "procedures")
ALL_DATA = ",".join(DATA[t] for t in TABLES)


def counts(table: str) -> str:
    """Counts per concept, of rows without NULL keys."""
    return f"""
    SELECT concept_id, count(*) AS mentions,
        count(DISTINCT CASE WHEN person_id IS NOT NULL AND datetime IS NOT NULL
              THEN (person_id, CAST(datetime AS DATE)) END) AS mentions_daily,
        count(DISTINCT person_id) AS persons
    FROM {table} GROUP BY concept_id"""


MINIMUM = 100
COUNTS = ",".join(f"{t}_counts AS ({counts(t)})" for t in TABLES)
SELECTED = {
    "conditions_daily": f"mentions_daily >= {MINIMUM}",
    "measurements_daily": f"mentions_daily >= {MINIMUM} AND persons >= {MINIMUM}",
    "medications_daily": f"mentions_daily >= {MINIMUM}",
    "procedures": f"mentions >= {MINIMUM}",
}
CONCEPTS = "concepts AS (" + " UNION ".join(
    f"SELECT concept_id FROM {t}_counts WHERE {SELECTED[t]}" for t in TABLES
) + ")"
COHORT = "cohort AS (" + " UNION ".join(
    f"SELECT person_id FROM {t} JOIN concepts USING (concept_id) GROUP BY person_id, concept_id "
    f"HAVING count(DISTINCT datetime) >= 2" for t in TABLES
) + ")"
DATAPOINTS = "datapoints AS (" + " UNION ".join(
    f"SELECT person_id, concept_id, CAST(datetime AS TIMESTAMP) AS datetime, "
    f"{'value' if t == 'measurements_daily' else 'CAST(NULL AS DOUBLE)'} AS value FROM {t}" for t in TABLES
) + ")"
SELECTION = ",".join([CLINICAL, ALL_DATA, COUNTS, CONCEPTS, COHORT])


def rounded(expression: str, digits: int = 6) -> str:
    """Rounded without a negative zero, moved a little off exact halves."""
    moved = f"round({expression} + 2.718e-3 * 1e-{digits}, {digits})"
    return f"CASE WHEN {moved} = 0 THEN 0.0 ELSE {moved} END"


# --- curves ---------------------------------------------------------------
# Each block reads obs(g, concept_id, day, n, value) and grid(g, lo, hi).


def pchip(name: str, window: int | None) -> str:
    value = "value" if window is None else (
        f"avg(value) OVER (PARTITION BY g, concept_id ORDER BY day "
        f"ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    )
    return f"""
{name}_points AS (
    SELECT g, concept_id, day AS x, value AS y FROM obs WHERE value IS NOT NULL
    UNION ALL
    SELECT o.g, concept_id, lo, arg_min(value, day) FROM obs o JOIN grid USING (g)
    WHERE value IS NOT NULL GROUP BY o.g, concept_id, lo HAVING min(day) > lo
    UNION ALL
    SELECT o.g, concept_id, hi, arg_max(value, day) FROM obs o JOIN grid USING (g)
    WHERE value IS NOT NULL GROUP BY o.g, concept_id, hi HAVING max(day) < hi),
{name}_secants AS (
    SELECT *, CAST(lead(x) OVER w - x AS DOUBLE) AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS m,
        lead(x) OVER w AS xn, lead(y) OVER w AS yn
    FROM {name}_points WINDOW w AS (PARTITION BY g, concept_id ORDER BY x)),
{name}_around AS (
    SELECT *, lag(h) OVER w AS hp, lag(m) OVER w AS mp, lag(h, 2) OVER w AS hpp, lag(m, 2) OVER w AS mpp,
        lead(h) OVER w AS hq, lead(m) OVER w AS mq
    FROM {name}_secants WINDOW w AS (PARTITION BY g, concept_id ORDER BY x)),
{name}_raw AS (
    SELECT *, CASE
        WHEN mp IS NULL AND m IS NULL THEN 0
        WHEN mp IS NULL AND mq IS NULL THEN m
        WHEN m IS NULL AND mpp IS NULL THEN mp
        WHEN mp IS NULL THEN ((2 * h + hq) * m - h * mq) / (h + hq)
        WHEN m IS NULL THEN ((2 * hp + hpp) * mp - hp * mpp) / (hp + hpp)
        WHEN sign(mp) <> sign(m) OR m = 0 OR mp = 0 THEN 0
        ELSE 1 / (((2 * h + hp) / mp + (h + 2 * hp) / m) / (3 * h + 3 * hp)) END AS d0
    FROM {name}_around),
{name}_slopes AS (
    SELECT *, CASE
        WHEN mp IS NULL AND m IS NOT NULL AND mq IS NOT NULL THEN
            CASE WHEN sign(d0) <> sign(m) THEN 0
                 WHEN sign(m) <> sign(mq) AND abs(d0) > 3 * abs(m) THEN 3 * m ELSE d0 END
        WHEN m IS NULL AND mp IS NOT NULL AND mpp IS NOT NULL THEN
            CASE WHEN sign(d0) <> sign(mp) THEN 0
                 WHEN sign(mp) <> sign(mpp) AND abs(d0) > 3 * abs(mp) THEN 3 * mp ELSE d0 END
        ELSE d0 END AS d
    FROM {name}_raw),
{name}_pieces AS (
    SELECT *, lead(d) OVER (PARTITION BY g, concept_id ORDER BY x) AS dn FROM {name}_slopes),
{name}_days AS (
    SELECT *, unnest(generate_series(0, CASE WHEN h IS NULL THEN 0 ELSE CAST(h AS BIGINT) - 1 END)) AS i
    FROM {name}_pieces),
{name}_values AS (
    SELECT g, concept_id, x + CAST(i AS INTEGER) AS day, CASE WHEN h IS NULL THEN y ELSE
        (2 * power(i / h, 3) - 3 * power(i / h, 2) + 1) * y + h * (power(i / h, 3) - 2 * power(i / h, 2) + i / h) * d
        + (3 * power(i / h, 2) - 2 * power(i / h, 3)) * yn + h * (power(i / h, 3) - power(i / h, 2)) * dn
        END AS value
    FROM {name}_days),
{name} AS (SELECT g, concept_id, day, {value} AS value FROM {name}_values)"""


def intensity(name: str, window: int | None, min_count: int = 10) -> str:
    m = min_count
    value = "value" if window is None else (
        f"avg(value) OVER (PARTITION BY g, concept_id ORDER BY day "
        f"ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    )
    return f"""
{name}_mass AS (
    SELECT g, concept_id, lo, hi, day, n, sum(n) OVER (PARTITION BY g, concept_id ORDER BY day) AS upto,
        sum(n) OVER (PARTITION BY g, concept_id) AS total
    FROM obs JOIN grid USING (g)),
{name}_series AS (SELECT DISTINCT g, concept_id, lo, hi, CAST(total AS BIGINT) AS total FROM {name}_mass),
{name}_levels AS (
    SELECT g, concept_id, lo, s, s + j * {m} AS mass
    FROM (SELECT *, unnest(generate_series(0, {m - 1})) AS s FROM {name}_series WHERE total >= {2 * m}) AS a,
        LATERAL (SELECT unnest(generate_series(1, (total - {m} - s) // {m})) AS j) AS b),
{name}_cuts AS (
    SELECT l.g, l.concept_id, s, mass, (day - l.lo) - 0.5 + (mass - (upto - n)) / CAST(n AS DOUBLE) AS t
    FROM {name}_levels l JOIN {name}_mass e
        ON e.g = l.g AND e.concept_id = l.concept_id AND mass > upto - n AND mass <= upto
    UNION ALL
    SELECT g, concept_id, unnest(generate_series(0, {m - 1})), 0, -0.5 FROM {name}_series WHERE total >= {2 * m}
    UNION ALL
    SELECT g, concept_id, unnest(generate_series(0, {m - 1})), total, (hi - lo) + 0.5
    FROM {name}_series WHERE total >= {2 * m}),
{name}_bins AS (
    SELECT g, concept_id, s, t AS t0, lead(t) OVER w AS t1, lead(mass) OVER w - mass AS held
    FROM {name}_cuts WINDOW w AS (PARTITION BY g, concept_id, s ORDER BY mass)),
{name}_grid AS (
    SELECT g, concept_id, lo, total, hi - lo + 1 AS days, unnest(generate_series(0, hi - lo)) AS i
    FROM {name}_series),
{name}_values AS (
    SELECT g, concept_id, lo + CAST(i AS INTEGER) AS day, CAST(total AS DOUBLE) / days AS value
    FROM {name}_grid WHERE total < {2 * m}
    UNION ALL
    SELECT d.g, d.concept_id, lo + CAST(i AS INTEGER),
        sum(held / (t1 - t0) * greatest(0, least(t1, i + 0.5) - greatest(t0, i - 0.5))) / {m}
    FROM {name}_grid d JOIN {name}_bins b ON b.g = d.g AND b.concept_id = d.concept_id
    WHERE t1 IS NOT NULL AND total >= {2 * m} AND t0 < i + 0.5 AND t1 > i - 0.5
    GROUP BY d.g, d.concept_id, lo, i),
{name} AS (SELECT g, concept_id, day, {value} AS value FROM {name}_values)"""


def binary(name: str, reference: str, window: int | None, round_up: bool = True) -> str:
    """Reads also ``reference`` (g, day), the days on which marks are known."""
    compare = ">=" if round_up else ">"
    fuzzy = "0" if window is None else (
        f"max(CASE WHEN date_diff('day', e.day, d.day) BETWEEN 1 AND {window} THEN 1 ELSE 0 END)"
    )
    return f"""
{name}_grid AS (
    SELECT c.g, concept_id, lo + CAST(i AS INTEGER) AS day
    FROM (SELECT DISTINCT g, concept_id FROM obs) c JOIN grid USING (g),
        LATERAL (SELECT unnest(generate_series(0, hi - lo)) AS i) s),
{name}_near AS (
    SELECT d.g, d.concept_id, d.day, max(CASE WHEN r.day <= d.day THEN r.day END) AS p,
        min(CASE WHEN r.day >= d.day THEN r.day END) AS q
    FROM {name}_grid d JOIN {reference} r ON r.g = d.g GROUP BY 1, 2, 3),
{name}_marks AS (
    SELECT d.*, CASE WHEN a.day IS NULL THEN 0 ELSE 1 END AS mp, CASE WHEN b.day IS NULL THEN 0 ELSE 1 END AS mq
    FROM {name}_near d
    LEFT JOIN obs a ON a.g = d.g AND a.concept_id = d.concept_id AND a.day = coalesce(d.p, d.q)
    LEFT JOIN obs b ON b.g = d.g AND b.concept_id = d.concept_id AND b.day = coalesce(d.q, d.p)),
{name} AS (
    SELECT d.g, d.concept_id, d.day, CAST(greatest(max(CASE
        WHEN p IS NULL OR q IS NULL OR p = q THEN mp
        WHEN mp + (mq - mp) * (d.day - p) / CAST(q - p AS DOUBLE) {compare} 0.5 THEN 1 ELSE 0 END),
        {fuzzy}) AS DOUBLE) AS value
    FROM {name}_marks d JOIN obs e ON e.g = d.g AND e.concept_id = d.concept_id
    GROUP BY d.g, d.concept_id, d.day)"""


def daily(source: str, key: str = "person_id") -> str:
    """obs: events per day with the day's last value."""
    return f"""
    SELECT {key} AS g, concept_id, CAST(datetime AS DATE) AS day, count(*) AS n,
        arg_max(value, (datetime, value)) FILTER (WHERE value IS NOT NULL) AS value
    FROM {source} GROUP BY 1, 2, 3"""
