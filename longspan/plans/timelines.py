"""Queries on sample spaces, as-of lookups and daily curves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.time import day_of, sin_cos_encoding
from longspan.operators import asof as A
from longspan.operators import curves as U
from longspan.operators import projection as P
from longspan.operators import space as S
from longspan.operators.running import running_total
from longspan.plans import views as V
from longspan.plans.common import Registry, rounded, text
from longspan.session import checkpoint_dir
from longspan.sources.clinical import Clinical
from longspan.sources.stored import by_person, create_schema_at, store

R = Registry()
WINDOW = 7
EHR = V.EHR
OBS = f"WITH {EHR}, daily AS ({V.daily('ehr')})"
GRID = "grid AS (SELECT g, min(day) AS lo, max(day) AS hi FROM daily GROUP BY g)"
SPACE = """space AS (SELECT person_id, min(datetime) AS start, max(datetime) + INTERVAL 1 SECOND AS stop,
    count(*) AS datapoints FROM ehr GROUP BY person_id)"""
DAYSPACE = """dayspace AS (SELECT person_id, CAST(min(datetime) AS DATE) AS start,
    CAST(max(datetime) AS DATE) + 1 AS stop FROM ehr GROUP BY person_id)"""
# Samples: noon of each day on which a person has events, a day later for even persons.
INDEX = """idx AS (SELECT DISTINCT person_id,
    CAST(CAST(datetime AS DATE) + CAST(1 - person_id % 2 AS INTEGER) AS TIMESTAMP) + INTERVAL 12 HOUR AS datetime
    FROM ehr)"""


def _index(ehr: DataFrame) -> DataFrame:
    day = F.date_add(day_of(F.col("datetime")), (1 - F.col("person_id") % 2).cast("int"))
    noon = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    return ehr.select("person_id", noon.alias("datetime")).distinct()


def _curve_sql(block: str, name: str, digits: int = 6) -> str:
    return f"""{block} SELECT g AS person_id, concept_id, CAST(day AS VARCHAR) AS day,
    {V.rounded('value', digits)} AS value FROM {name}"""


def _shown(curves: DataFrame, digits: int = 6) -> DataFrame:
    return curves.select("person_id", "concept_id", text("day").alias("day"),
                         rounded("value", digits).alias("value"))


# --- spaces -----------------------------------------------------------------


@R.query("sample_space_a9", f"WITH {EHR}, {SPACE} SELECT * FROM space")
def sample_space(spark, sf):
    return S.sample_space(Clinical(spark, sf).ehr)


@R.query("space_totals_a10", f"""WITH {EHR}, {SPACE}
SELECT CAST(sum(date_diff('day', CAST(start AS DATE), CAST(stop AS DATE))) AS BIGINT) AS ndates,
    CAST(sum(date_diff('second', start, stop)) AS BIGINT) AS ntimepoints,
    CAST(sum(datapoints) AS BIGINT) AS ndatapoints FROM space""")
def space_totals(spark, sf):
    return S.space_totals(S.sample_space(Clinical(spark, sf).ehr))


@R.query("index_totals_a11", f"""WITH {EHR}, {INDEX}
SELECT count(DISTINCT person_id) AS npersons, count(DISTINCT datetime) AS ndates FROM idx""")
def index_totals(spark, sf):
    return S.index_totals(_index(Clinical(spark, sf).ehr))


@R.query("space_restricted_p13", f"""WITH {EHR}, {SPACE}
SELECT person_id, greatest(start, TIMESTAMP '2024-01-03 06:00:00') AS start,
    least(stop, TIMESTAMP '2024-01-28 00:00:00') AS stop, datapoints
FROM space WHERE start < TIMESTAMP '2024-01-28 00:00:00' AND TIMESTAMP '2024-01-03 06:00:00' < stop""")
def space_restricted(spark, sf):
    space = S.sample_space(Clinical(spark, sf).ehr)
    return S.restrict_to_interval(space, "2024-01-03 06:00:00", "2024-01-28 00:00:00")


# Samples around the space: order dates of customers moved into the events' years.
WIDE = """wide AS (SELECT o_custkey AS person_id, o_orderdate + INTERVAL 9600 DAY + INTERVAL 5 HOUR AS datetime
    FROM orders)"""


def _wide(spark, sf) -> DataFrame:
    moved = F.col("o_orderdate") + F.make_dt_interval(days=F.lit(9600), hours=F.lit(5))
    return Clinical(spark, sf)._table("orders").select(
        F.col("o_custkey").alias("person_id"), moved.alias("datetime"))


@R.query("index_fitted_p15", f"""WITH {EHR}, {SPACE}, {WIDE}
SELECT DISTINCT person_id, greatest(start, least(stop - INTERVAL 1 SECOND, datetime)) AS datetime
FROM wide JOIN space USING (person_id)""")
def index_fitted(spark, sf):
    return S.fit_index_into_space(_wide(spark, sf), S.sample_space(Clinical(spark, sf).ehr))


@R.query("index_fitted_days_p15", f"""WITH {EHR}, {DAYSPACE}, {WIDE}
SELECT DISTINCT person_id, CAST(greatest(start, least(stop - 1, CAST(datetime AS DATE))) AS VARCHAR) AS datetime
FROM wide JOIN dayspace USING (person_id)""")
def index_fitted_days(spark, sf):
    days = _wide(spark, sf).withColumn("datetime", day_of(F.col("datetime")))
    fitted = S.fit_index_into_space(days, S.sample_space(Clinical(spark, sf).ehr))
    return fitted.withColumn("datetime", text("datetime"))


@R.query("fitted_space_p15", f"""WITH {EHR}, {SPACE}, {WIDE}
SELECT * FROM space WHERE person_id IN (SELECT person_id FROM wide)""")
def fitted_space(spark, sf):
    return S.fitted_space(_wide(spark, sf), S.sample_space(Clinical(spark, sf).ehr))


@R.query("fit_losses_p15", f"""WITH {EHR}, {SPACE}, {WIDE}
SELECT count(DISTINCT CASE WHEN start IS NULL THEN person_id END) AS n_missing_persons,
    count(*) FILTER (WHERE start IS NULL) AS n_missing_datapoints,
    count(*) FILTER (WHERE datetime < start OR datetime > stop - INTERVAL 1 SECOND) AS n_out_of_range
FROM wide LEFT JOIN space USING (person_id)""")
def fit_losses(spark, sf):
    return S.fit_losses(_wide(spark, sf), S.sample_space(Clinical(spark, sf).ehr))


@R.query("index_deduped_o9", f"WITH {EHR} SELECT DISTINCT person_id, datetime FROM ehr")
def index_deduped(spark, sf):
    return S.dedupe_index(Clinical(spark, sf).ehr)


@R.query("age_stats_a16", f"""WITH {EHR}, {DAYSPACE},
ages AS (SELECT (start - birth_date + unnest(generate_series(0, stop - start - 1))) / 365.25 AS age
    FROM dayspace JOIN users USING (person_id))
SELECT {V.rounded('avg(age)')} AS mean_age, {V.rounded('stddev_pop(age)')} AS sdev_age FROM ages""")
def age_stats(spark, sf):
    x = Clinical(spark, sf)
    stats = S.age_stats(S.sample_space(x.ehr), x.users)
    return stats.select(rounded("mean_age").alias("mean_age"), rounded("sdev_age").alias("sdev_age"))


@R.query("sample_uniform_o4")
def sample_uniform(spark, sf):
    """As many samples as there are events, over seconds of the sample space."""
    ehr = Clinical(spark, sf).ehr
    return S.sample_uniform(S.sample_space(ehr), ehr.count(), seed=11)


OFFSETS = """offsets AS (SELECT person_id, length,
    CAST(sum(length) OVER (ORDER BY person_id) AS BIGINT) - length AS lo
    FROM (SELECT person_id, date_diff('second', start, stop) AS length FROM space))"""


def _offsets(spark, sf) -> DataFrame:
    from longspan.functions.time import second_number

    space = S.sample_space(Clinical(spark, sf).ehr)
    length = second_number(F.col("stop")) - second_number(F.col("start"))
    rows = space.select("person_id", length.alias("length")).withColumn(
        "bucket", F.floor(F.col("person_id") / 100))
    return running_total(rows, "bucket", ["person_id"], {"lo": "length"}).select(
        "person_id", "length", "lo")


@R.query("interval_offsets_w3", f"WITH {EHR}, {SPACE}, {OFFSETS} SELECT * FROM offsets")
def interval_offsets(spark, sf):
    return _offsets(spark, sf)


@R.query("range_join_j15", f"""WITH {EHR}, {SPACE}, {OFFSETS}
SELECT event_id * 1000 AS rank, person_id, lo FROM events
JOIN offsets ON event_id * 1000 >= lo AND event_id * 1000 < lo + length""")
def range_join(spark, sf):
    ranges = _offsets(spark, sf).withColumn("hi", F.col("lo") + F.col("length"))
    span = ranges.agg(F.max("hi")).first()[0]
    points = Clinical(spark, sf)._table("events").select((F.col("event_id") * 1000).alias("rank"))
    return S.locate(points, ranges.select("lo", "hi", "person_id"), span, points.count()).select(
        "rank", "person_id", "lo")


# --- as-of lookups ------------------------------------------------------------

LATEST = f"""WITH {EHR}, {INDEX},
latest AS (SELECT i.person_id, i.datetime AS target, concept_id, max(e.datetime) AS datetime,
    arg_max(value, (e.datetime, coalesce(value, -1e300))) AS value
    FROM idx i JOIN ehr e ON e.person_id = i.person_id AND e.datetime <= i.datetime GROUP BY 1, 2, 3)"""


@R.query("asof_latest_j10", f"{LATEST} SELECT person_id, target, concept_id, datetime, value FROM latest")
def asof_latest(spark, sf):
    ehr = Clinical(spark, sf).ehr
    return A.latest_per_concept(_index(ehr), ehr)


@R.query("asof_stored_j9_j10", f"{LATEST} SELECT person_id, target, concept_id, datetime, value FROM latest")
def asof_stored(spark, sf):
    """As-of lookups over daily rows kept by person."""
    ehr = Clinical(spark, sf).ehr
    return A.latest_per_concept(_index(ehr), ehr, _by_person(spark))


@R.query("recency_features_t13_f8", f"""{LATEST}
SELECT person_id, target AS datetime, concept_id, value AS carried,
    {V.rounded("1 / (1 + date_diff('second', datetime, target) / 86400.0 / CASE WHEN data_mode = 'Condition' THEN 30.0 ELSE 7.0 END)", 9)} AS recency
FROM latest JOIN meta USING (concept_id)""")
def recency_features(spark, sf):
    x = Clinical(spark, sf)
    return A.recency_features(_index(x.ehr), x.ehr, x.meta).withColumn("recency", rounded("recency", 9))


@R.query("last_of_group_w7", f"""WITH {EHR}
SELECT person_id, concept_id, max(datetime) AS datetime FROM ehr GROUP BY 1, 2""")
def last_of_group(spark, sf):
    return A._latest(Clinical(spark, sf).ehr, "person_id", "concept_id").select(
        "person_id", "concept_id", "seen.datetime")


SEQUENCE = """seq AS (SELECT user_id AS sequence_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS DOUBLE) AS pos,
    max(value) AS base FROM events GROUP BY 1, 2),
points AS (SELECT sequence_id, floor(min(pos)) + i * (ceil(max(pos)) - floor(min(pos))) / 999 AS pos
    FROM seq, (SELECT unnest(generate_series(0, 999)) AS i) GROUP BY sequence_id, i)"""


def _sequence(spark, sf) -> DataFrame:
    hour = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return Clinical(spark, sf)._table("events").groupBy(
        F.col("user_id").alias("sequence_id"), hour.cast("double").alias("pos")
    ).agg(F.max("value").alias("base"))


def _matched_sql(from_prev: bool) -> str:
    nearest = "coalesce(p.pos, n.pos)" if from_prev else "coalesce(n.pos, p.pos)"
    return f"""WITH {SEQUENCE},
m AS (SELECT q.sequence_id, q.pos, {nearest} AS base_at FROM (SELECT DISTINCT * FROM points) q
    ASOF LEFT JOIN seq p ON p.sequence_id = q.sequence_id AND p.pos <= q.pos
    ASOF LEFT JOIN seq n ON n.sequence_id = q.sequence_id AND n.pos >= q.pos)
SELECT m.sequence_id, {V.rounded('m.pos')} AS pos, base_at, base
FROM m JOIN seq s ON s.sequence_id = m.sequence_id AND s.pos = base_at"""


def _matched(spark, sf, from_prev: bool) -> DataFrame:
    bases = _sequence(spark, sf)
    points = A.linspace(bases, "sequence_id", "pos", 1000)
    found = A.match_sequence(points, bases, "sequence_id", "pos", "base", from_prev)
    return found.withColumn("pos", rounded("pos"))


@R.query("match_forward_j11", _matched_sql(False))
def match_forward(spark, sf):
    return _matched(spark, sf, False)


@R.query("match_backward_j11", _matched_sql(True))
def match_backward(spark, sf):
    return _matched(spark, sf, True)


@R.query("sequence_interpolated_t16", f"""WITH {SEQUENCE},
m AS (SELECT q.sequence_id, q.pos, coalesce(n.base, p.base) AS base FROM (SELECT DISTINCT * FROM points) q
    ASOF LEFT JOIN seq p ON p.sequence_id = q.sequence_id AND p.pos <= q.pos
    ASOF LEFT JOIN seq n ON n.sequence_id = q.sequence_id AND n.pos >= q.pos),
both_kinds AS (SELECT *, 'interpolated' AS kind FROM m UNION ALL SELECT *, 'observed' FROM seq)
SELECT sequence_id, kind, {V.rounded('pos')} AS pos, {V.rounded('base + 0.01 * pos')} AS mean,
    {V.rounded('1 + 0.5 * base')} AS variance FROM both_kinds""")
def sequence_interpolated(spark, sf):
    """A linear stand-in for the trained model."""
    def model(base, at):
        return F.struct((base + 0.01 * at).alias("mean"), (1 + 0.5 * base).alias("variance"))

    out = A.interpolate_sequence(_sequence(spark, sf), model, at="pos")
    return out.select("sequence_id", "kind", *[rounded(c).alias(c) for c in ("pos", "mean", "variance")])


@R.query("sin_cos_encoding_f11", f"""WITH offsets AS (
    SELECT event_id, epoch(date_trunc('second', ts) - TIMESTAMP '2024-01-01') / 86400.0 AS dt FROM events),
slots AS (SELECT unnest(generate_series(0, 7)) AS slot)
SELECT event_id, CAST(slot AS BIGINT) AS slot, {V.rounded('''CASE slot % 2
    WHEN 0 THEN sin(dt * exp(-ln(10000.0) * slot / 8)) + sin(abs(30 - dt) * exp(-ln(10000.0) * slot / 8))
    ELSE cos(dt * exp(-ln(10000.0) * (slot - 1) / 8)) + cos(abs(30 - dt) * exp(-ln(10000.0) * (slot - 1) / 8))
    END''', 8)} AS code
FROM offsets, slots""")
def sin_cos(spark, sf):
    from longspan.functions.time import cued_encoding, second_number

    start = 1704067200  # 2024-01-01
    dt = (second_number(F.col("ts")) - start) / 86400.0
    rows = Clinical(spark, sf)._table("events").select("event_id", dt.alias("dt"))
    code = F.posexplode(cued_encoding(F.col("dt"), F.lit(30.0), dim=8)).alias("slot", "code")
    return rows.select("event_id", code).select(
        "event_id", F.col("slot").cast("long").alias("slot"), rounded("code", 8).alias("code"))


# --- curves ---------------------------------------------------------------------


@R.query("day_grid_t1", f"""WITH {EHR}, {DAYSPACE}
SELECT person_id, CAST(start + CAST(unnest(generate_series(0, stop - start - 1)) AS INTEGER) AS VARCHAR) AS day
FROM dayspace""")
def day_grid(spark, sf):
    grid = U.day_grid(U.daily_events(Clinical(spark, sf).ehr))
    return U.grid_days(grid).withColumn("day", text("day"))


@R.query("fractional_time_f9", f"""WITH {EHR}, {DAYSPACE}, d AS (
    SELECT person_id, start, start + CAST(unnest(generate_series(0, stop - start - 1)) AS INTEGER) AS day FROM dayspace)
SELECT person_id, CAST(day AS VARCHAR) AS day, {V.rounded('(day - start) / 365.25', 9)} AS value FROM d""")
def fractional_time(spark, sf):
    grid = U.day_grid(U.daily_events(Clinical(spark, sf).ehr))
    return U.fractional_time(grid).select("person_id", text("day").alias("day"),
                                          rounded("value", 9).alias("value"))


@R.query("daily_events_w1", f"""{OBS} SELECT g AS person_id, concept_id, CAST(day AS VARCHAR) AS day, n, value
FROM daily""")
def daily_events(spark, sf):
    return U.daily_events(Clinical(spark, sf).ehr).withColumn("day", text("day"))


def _measurement_sql(window):
    return _curve_sql(f"""{OBS}, obs AS (SELECT daily.* FROM daily JOIN meta USING (concept_id)
    WHERE data_mode = 'Measurement'), {GRID}, {V.pchip('curve', window)}""", "curve")


def _daily_of(x: Clinical, mode: str):
    daily = U.daily_events(x.ehr)
    known = daily.join(x.meta, "concept_id")
    return U._mode(known, mode), U.day_grid(daily)


@R.query("measurement_curve_t2", _measurement_sql(None))
def measurement_curve(spark, sf):
    daily, grid = _daily_of(Clinical(spark, sf), "Measurement")
    return _shown(U.pchip_curve(daily, grid, None))


@R.query("measurement_curve_smoothed_t2_w2", _measurement_sql(WINDOW))
def measurement_curve_smoothed(spark, sf):
    daily, grid = _daily_of(Clinical(spark, sf), "Measurement")
    return _shown(U.pchip_curve(daily, grid, WINDOW))


def _condition_sql(window, mode="data_mode = 'Condition'", min_count=10):
    return _curve_sql(f"""{OBS}, obs AS (SELECT daily.* FROM daily JOIN meta USING (concept_id)
    WHERE {mode}), {GRID}, {V.intensity('curve', window, min_count)}""", "curve")


@R.query("condition_intensity_t3", _condition_sql(None))
def condition_intensity(spark, sf):
    daily, grid = _daily_of(Clinical(spark, sf), "Condition")
    return _shown(U.intensity_curve(daily, grid, 10, 100, None))


@R.query("condition_intensity_smoothed_t3_w2", _condition_sql(WINDOW))
def condition_intensity_smoothed(spark, sf):
    daily, grid = _daily_of(Clinical(spark, sf), "Condition")
    return _shown(U.intensity_curve(daily, grid, 10, 100, WINDOW))


@R.query("event_intensity_small_bins_t3", _condition_sql(None, "true", 3))
def event_intensity_small_bins(spark, sf):
    """All event types as conditions, three events per bin."""
    daily = U.daily_events(Clinical(spark, sf).ehr)
    return _shown(U.intensity_curve(daily, U.day_grid(daily), 3, 99, None))


def _binary_sql(window, round_up, own=False):
    reference = """reference AS (SELECT DISTINCT g, day FROM daily WHERE concept_id IN (1, 4))""" if own else (
        "reference AS (SELECT DISTINCT g, day FROM daily)")
    return _curve_sql(f"""{OBS}, obs AS (SELECT * FROM daily), {reference}, {GRID},
    {V.binary('curve', 'reference', window, round_up)}""", "curve")


@R.query("binary_signal_t4_w5", _binary_sql(None, True))
def binary_signal(spark, sf):
    """Every event type as a binary signal over all days with events."""
    daily = U.daily_events(Clinical(spark, sf).ehr)
    reference = daily.select("person_id", "day").distinct()
    return _shown(U.binary_curve(daily, reference, U.day_grid(daily), None, True))


@R.query("binary_signal_round_down_t4_j12", _binary_sql(None, False))
def binary_signal_round_down(spark, sf):
    daily = U.daily_events(Clinical(spark, sf).ehr)
    reference = daily.select("person_id", "day").distinct()
    return _shown(U.binary_curve(daily, reference, U.day_grid(daily), None, False))


@R.query("binary_signal_carried_w4", _binary_sql(3, True))
def binary_signal_carried(spark, sf):
    daily = U.daily_events(Clinical(spark, sf).ehr)
    reference = daily.select("person_id", "day").distinct()
    return _shown(U.binary_curve(daily, reference, U.day_grid(daily), 3, True))


def _curves_block(window, med_dates=True, source="daily", grid=GRID):
    """All three kinds of curves over ``source``, as curves(g, concept_id, day, value)."""
    marks = "WHERE concept_id = 4" if med_dates else ""
    return f"""all_obs AS (SELECT * FROM {source}), {grid},
reference AS (SELECT DISTINCT g, day FROM all_obs {marks}),
labs AS ({_nested(f"obs AS (SELECT * FROM all_obs WHERE concept_id IN (3, 5)), {V.pchip('curve', window)}")}),
codes AS ({_nested(f"obs AS (SELECT * FROM all_obs WHERE concept_id IN (1, 2)), {V.intensity('curve', window)}")}),
meds AS ({_nested(f"obs AS (SELECT * FROM all_obs WHERE concept_id = 4), {V.binary('curve', 'reference', window)}")}),
curves AS (SELECT * FROM labs UNION ALL SELECT * FROM codes UNION ALL SELECT * FROM meds)"""


def _nested(block: str) -> str:
    return f"WITH {block} SELECT * FROM curve"


@R.query("curves_t7", _curve_sql(f"{OBS}, {_curves_block(WINDOW)}", "curves"))
def curves(spark, sf):
    x = Clinical(spark, sf)
    return _shown(U.build_curves(x.ehr, x.meta, options=U.CurveOptions.windowed(WINDOW)))


def _by_person(spark):
    return by_person(int(spark.conf.get("spark.sql.shuffle.partitions")))


@R.query("curves_stored_s16_s17_j9", _curve_sql(f"{OBS}, {_curves_block(WINDOW)}", "curves"))
def curves_stored(spark, sf):
    """The same curves from daily rows that a CREATE TABLE AS stored by person in a schema of ours."""
    x = Clinical(spark, sf)
    folder = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    create_schema_at(spark, "longspan_stored", f"{checkpoint_dir(spark)}/longspan_stored")
    daily = store(U.daily_events(x.ehr), "longspan_stored.daily", int(spark.conf.get("spark.sql.shuffle.partitions")), folder)
    return _shown(U.curves_of_daily(daily, x.meta, options=U.CurveOptions.windowed(WINDOW)))


@R.query("curves_365_t7_w2", _curve_sql(f"{OBS}, {_curves_block(365)}", "curves"))
def curves_default(spark, sf):
    """All defaults: windows of 365 days."""
    x = Clinical(spark, sf)
    return _shown(U.build_curves(x.ehr, x.meta))


@R.query("curves_all_dates_t7", _curve_sql(f"{OBS}, {_curves_block(WINDOW, med_dates=False)}", "curves"))
def curves_all_dates(spark, sf):
    x = Clinical(spark, sf)
    options = U.CurveOptions.windowed(WINDOW, med_dates=False)
    return _shown(U.build_curves(x.ehr, x.meta, options=options))


BOUNDED = f"""WITH {EHR}, clipped AS (SELECT * FROM ehr
    WHERE datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'),
daily AS ({V.daily('clipped')})"""
FIXED_GRID = """grid AS (SELECT DISTINCT g, DATE '2024-01-05' AS lo, DATE '2024-01-25' AS hi FROM daily)"""


@R.query("curves_bounded_t7_p12", _curve_sql(f"{BOUNDED}, {_curves_block(WINDOW, grid=FIXED_GRID)}", "curves"))
def curves_bounded(spark, sf):
    x = Clinical(spark, sf)
    bounds = x.users.select("person_id", F.lit("2024-01-05").cast("date").alias("start"),
                            F.lit("2024-01-25").cast("date").alias("until"))
    return _shown(U.build_curves(x.ehr, x.meta, bounds, U.CurveOptions.windowed(WINDOW)))


@R.query("legacy_curves_t8", f"""{OBS}, {_curves_block(WINDOW)},
names AS (SELECT *, CASE concept_id WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase'
    WHEN 4 THEN 'signup' ELSE 'view' END AS channel FROM meta),
fixed AS (SELECT g, lo, lo + CAST(unnest(generate_series(0, hi - lo)) AS INTEGER) AS day, birth_date, g % 2 AS sex
    FROM grid JOIN users ON person_id = g)
SELECT g AS person_id, data_mode AS mode, channel, CAST(day AS VARCHAR) AS day, {V.rounded('value')} AS value
FROM curves JOIN names USING (concept_id)
UNION ALL SELECT g, 'Age', 'Age', CAST(day AS VARCHAR), {V.rounded('(day - birth_date) / 365.25')} FROM fixed
UNION ALL SELECT g, 'Sex', CASE sex WHEN 0 THEN 'F' ELSE 'M' END, CAST(day AS VARCHAR), 1.0 FROM fixed""")
def legacy_curves(spark, sf):
    x = Clinical(spark, sf)
    modes = F.create_map(*[F.lit(v) for kv in
                           {"click": "Condition", "error": "Condition", "purchase": "Measurement",
                            "signup": "Medication", "view": "Measurement"}.items() for v in kv])
    events = x._table("events").select(
        F.col("user_id").alias("person_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("date"),
        modes[F.col("event_type")].alias("mode"), F.col("event_type").alias("channel"),
        F.col("value").cast("string").alias("value"))
    none = F.lit(None).cast("timestamp_ntz").alias("date")
    ages = x.users.select("person_id", none, F.lit("Age").alias("mode"), F.lit("Age").alias("channel"),
                          F.col("birth_date").cast("string").alias("value"))
    letter = F.when(F.col("person_id") % 2 == 0, "F").otherwise("M")
    sexes = x.users.select("person_id", none, F.lit("Sex").alias("mode"), letter.alias("channel"),
                           F.lit("1").alias("value"))
    out = U.legacy_curves(events.unionByName(ages).unionByName(sexes), U.CurveOptions.windowed(WINDOW))
    return out.select("person_id", "mode", "channel", text("day").alias("day"),
                      rounded("value").alias("value"))


@R.query("constant_curves_t9_a19", f"""{OBS}, {_curves_block(None)},
firsts AS (SELECT g, concept_id, arg_min(value, day) AS first FROM curves GROUP BY 1, 2)
SELECT g AS person_id, concept_id, count(*) AS days,
    bool_and(abs(value - first) <= 1e-8 + 1e-5 * abs(value)) AS is_constant,
    CASE WHEN bool_and(abs(value - first) <= 1e-8 + 1e-5 * abs(value)) THEN {V.rounded('any_value(first)')} END AS constant
FROM curves JOIN firsts USING (g, concept_id) GROUP BY g, concept_id""")
def constant_curves(spark, sf):
    x = Clinical(spark, sf)
    built = U.build_curves(x.ehr, x.meta, options=U.CurveOptions.windowed(None))
    return U.constant_curves(built).withColumn("constant", rounded("constant"))


@R.query("compressed_curves_t9", f"""{OBS}, {_curves_block(None)},
firsts AS (SELECT g, concept_id, arg_min(value, day) AS first FROM curves GROUP BY 1, 2),
dense AS (SELECT g, concept_id FROM curves JOIN firsts USING (g, concept_id) GROUP BY g, concept_id
    HAVING NOT bool_and(abs(value - first) <= 1e-8 + 1e-5 * abs(value)))
SELECT g AS person_id, concept_id, CAST(row_number() OVER (PARTITION BY g, concept_id ORDER BY day) - 1 AS INTEGER) AS place,
    {V.rounded('value')} AS value
FROM curves SEMI JOIN dense USING (g, concept_id)
UNION ALL SELECT g, concept_id, NULL, {V.rounded('first')} FROM firsts ANTI JOIN dense USING (g, concept_id)""")
def compressed_curves(spark, sf):
    """Numbers of constant curves (no place), entries of the arrays of the others."""
    x = Clinical(spark, sf)
    packed = U.compressed_curves(U.build_curves(x.ehr, x.meta, options=U.CurveOptions.windowed(None)))
    entries = F.when(F.col("is_constant"), F.array(F.struct(F.lit(None).cast("int").alias("place"), F.col("constant").alias("value"))))
    entries = entries.otherwise(F.transform("dense", lambda v, i: F.struct(i.alias("place"), v.alias("value"))))
    return packed.select("person_id", "concept_id", F.inline(entries)).withColumn("value", rounded("value"))


@R.query("cross_section_t10_j13", f"""{OBS}, {_curves_block(WINDOW)}, {INDEX}
SELECT DISTINCT g AS person_id, concept_id, CAST(day AS VARCHAR) AS day, {V.rounded('value')} AS value
FROM curves JOIN idx ON person_id = g AND day = CAST(datetime AS DATE)""")
def cross_section(spark, sf):
    x = Clinical(spark, sf)
    built = U.build_curves(x.ehr, x.meta, options=U.CurveOptions.windowed(WINDOW))
    return _shown(U.cross_section(built, _index(x.ehr), off_grid="drop"))


@R.query("outside_grid_j13", f"""{OBS}, {GRID}, {INDEX}
SELECT DISTINCT person_id, CAST(CAST(datetime AS DATE) AS VARCHAR) AS day FROM idx LEFT JOIN grid ON g = person_id
WHERE g IS NULL OR CAST(datetime AS DATE) NOT BETWEEN lo AND hi""")
def outside_grid(spark, sf):
    x = Clinical(spark, sf)
    grid = U.day_grid(U.daily_events(x.ehr))
    return U.outside_grid(grid, _index(x.ehr)).withColumn("day", text("day"))


@R.query("age_samples_t11", f"""WITH {EHR}, {INDEX}
SELECT person_id, datetime, {V.rounded("(date_diff('day', birth_date, CAST(datetime AS DATE)) / 365.25 - 50) / 12")} AS value
FROM idx JOIN users USING (person_id)""")
def age_samples(spark, sf):
    x = Clinical(spark, sf)
    return U.age_samples(_index(x.ehr), x.users, 50.0, 12.0).withColumn("value", rounded("value"))


@R.query("demographic_samples_t12", f"""WITH {EHR}, {INDEX}, c AS (
    SELECT unnest([5000, 5001, 5002, 6000, 6001, 6002, 6003, 6004]) AS concept_id)
SELECT person_id, datetime, CAST(concept_id AS BIGINT) AS concept_id,
    CAST(CASE WHEN concept_id IN (gender_concept_id, race_concept_id) THEN 1 ELSE 0 END AS DOUBLE) AS value
FROM idx JOIN users USING (person_id), c""")
def demographic_samples(spark, sf):
    x = Clinical(spark, sf)
    concepts = [5000, 5001, 5002, 6000, 6001, 6002, 6003, 6004]
    return U.demographic_samples(_index(x.ehr), x.users, concepts)


@R.query("cohort_demographics_a18", f"""WITH {EHR}
SELECT gender_concept_id AS concept_id, person_id FROM users UNION SELECT race_concept_id, person_id FROM users""")
def cohort_demographics(spark, sf):
    return U.cohort_demographics(Clinical(spark, sf).users)


# --- point in time --------------------------------------------------------------

# Every sample becomes a history of its own, numbered by person and day.
PROJECTED = f"""WITH {EHR}, {INDEX},
firsts AS (SELECT person_id, min(datetime) AS first FROM ehr GROUP BY 1),
samples AS (SELECT DISTINCT person_id, CAST(datetime AS DATE) AS dt, first,
    person_id * 1000 + (CAST(datetime AS DATE) - DATE '2024-01-01') AS sample
    FROM idx JOIN firsts USING (person_id) WHERE CAST(CAST(datetime AS DATE) AS TIMESTAMP) > first),
history AS (SELECT sample, concept_id, datetime, value FROM samples JOIN ehr USING (person_id)
    WHERE datetime <= CAST(dt AS TIMESTAMP)),
daily AS ({V.daily('history', 'sample')})"""
SAMPLE_GRID = "grid AS (SELECT sample AS g, CAST(first AS DATE) AS lo, dt AS hi FROM samples)"


@R.query("projection_points_t15", f"""{PROJECTED}, {_curves_block(WINDOW, grid=SAMPLE_GRID)}
SELECT person_id, concept_id, CAST(dt AS VARCHAR) AS day, {V.rounded('value')} AS value
FROM curves JOIN samples ON sample = g AND dt = day""")
def projection_points(spark, sf):
    x = Clinical(spark, sf)
    return _shown(P.project_points(_index(x.ehr), x.ehr, x.meta, U.CurveOptions.windowed(WINDOW)))


@R.query("projection_stored_j9_t15", f"""{PROJECTED}, {_curves_block(WINDOW, grid=SAMPLE_GRID)}
SELECT person_id, concept_id, CAST(dt AS VARCHAR) AS day, {V.rounded('value')} AS value
FROM curves JOIN samples ON sample = g AND dt = day""")
def projection_stored(spark, sf):
    """Point-in-time projection whose daily rows, starts and samples are kept by person."""
    x = Clinical(spark, sf)
    return _shown(P.project_points(
        _index(x.ehr), x.ehr, x.meta, U.CurveOptions.windowed(WINDOW), _by_person(spark)))


@R.query("projection_points_365_t15", f"""{PROJECTED}, {_curves_block(365, grid=SAMPLE_GRID)}
SELECT person_id, concept_id, CAST(dt AS VARCHAR) AS day, {V.rounded('value')} AS value
FROM curves JOIN samples ON sample = g AND dt = day""")
def projection_points_default(spark, sf):
    """All defaults: windows of 365 days."""
    x = Clinical(spark, sf)
    return _shown(P.project_points(_index(x.ehr), x.ehr, x.meta))


@R.query("projection_points_unsmoothed_t15", f"""{PROJECTED}, {_curves_block(None, grid=SAMPLE_GRID)}
SELECT person_id, concept_id, CAST(dt AS VARCHAR) AS day, {V.rounded('value')} AS value
FROM curves JOIN samples ON sample = g AND dt = day""")
def projection_points_unsmoothed(spark, sf):
    x = Clinical(spark, sf)
    return _shown(P.project_points(_index(x.ehr), x.ehr, x.meta, U.CurveOptions.windowed(None)))


@R.query("projection_misses_j18_u4", f"""WITH {EHR}, {WIDE}, firsts AS (
    SELECT person_id, min(datetime) AS first FROM ehr GROUP BY 1)
SELECT DISTINCT person_id, CAST(CAST(datetime AS DATE) AS VARCHAR) AS day FROM wide LEFT JOIN firsts USING (person_id)
WHERE first IS NULL OR CAST(CAST(datetime AS DATE) AS TIMESTAMP) <= first ORDER BY 1, 2""")
def projection_misses(spark, sf):
    misses = P.projection_misses(_wide(spark, sf), Clinical(spark, sf).ehr)
    return misses.withColumn("day", text("day")).orderBy("person_id", "day")


@R.query("index_without_misses_j18", f"""WITH {EHR}, {WIDE}, firsts AS (
    SELECT person_id, min(datetime) AS first FROM ehr GROUP BY 1)
SELECT person_id, datetime FROM wide JOIN firsts USING (person_id)
WHERE CAST(CAST(datetime AS DATE) AS TIMESTAMP) > first""")
def index_without_misses(spark, sf):
    index = _wide(spark, sf)
    return P.without_misses(index, P.projection_misses(index, Clinical(spark, sf).ehr))


@R.query("persons_of_index_p17", f"""WITH {EHR}, {WIDE}
SELECT * FROM ehr WHERE person_id IN (SELECT person_id FROM wide WHERE datetime >= TIMESTAMP '2024-06-01')""")
def persons_of_index(spark, sf):
    later = _wide(spark, sf).filter(F.col("datetime") >= F.lit("2024-06-01").cast("timestamp_ntz"))
    return Clinical(spark, sf).ehr.join(later.select("person_id"), "person_id", "left_semi")
