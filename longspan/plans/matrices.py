"""Queries on statistics, matrices, linear algebra, evaluation and datasets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.functions.text import feature_label, short_label
from longspan.operators import affinity as A
from longspan.operators import curves as U
from longspan.operators import datasets as D
from longspan.operators import evaluate as E
from longspan.operators import leading as C
from longspan.operators import linalg as L
from longspan.operators import matrix as M
from longspan.operators import projection as P
from longspan.operators import space as S
from longspan.operators import stats as T
from longspan.plans import timelines as TL
from longspan.plans import views as V
from longspan.plans.common import Registry, rounded, text
from longspan.session import materialise
from longspan.sources.clinical import Clinical

R = Registry()
EHR = V.EHR
FIELDS = ("count", "mean", "variance", "negative", "minval", "maxval")

# Labelled values: thousands that each line sells for above or below 25,000, by part.
VALUES = "vals AS (SELECT l_partkey AS label, (l_extendedprice - 25000) / 1000 AS value FROM lineitem)"


def _values(spark, sf) -> DataFrame:
    return Clinical(spark, sf)._table("lineitem").select(
        F.col("l_partkey").alias("label"), ((F.col("l_extendedprice") - 25000) / 1000).alias("value"))


def _stats_sql(source: str, value: str = "value") -> str:
    return f"""SELECT label, count({value}) AS count, avg({value}) AS mean, var_pop({value}) AS variance,
    count(*) FILTER (WHERE {value} < 0) AS negative, min({value}) AS minval, max({value}) AS maxval
    FROM {source} WHERE {value} IS NOT NULL GROUP BY label"""


def _stats_out(source: str, digits: int = 4) -> str:
    columns = ", ".join(
        f"CAST({c} AS BIGINT) AS {c}" if c in ("count", "negative") else f"{V.rounded(c, digits)} AS {c}"
        for c in FIELDS)
    return f"SELECT label, {columns} FROM {source}"


def _shown(stats: DataFrame, digits: int = 4) -> DataFrame:
    return stats.select("label", *[
        F.col(c) if c in ("count", "negative") else rounded(c, digits).alias(c) for c in FIELDS])


# --- statistics -------------------------------------------------------------


@R.query("stats_a12", f"WITH {VALUES}, s AS ({_stats_sql('vals')}) {_stats_out('s')}")
def stats(spark, sf):
    return _shown(T.collect_stats(_values(spark, sf)))


@R.query("stats_with_gaps_a12_h3", f"""WITH vals AS (SELECT l_partkey AS label,
    CASE WHEN l_returnflag = 'A' THEN l_quantity - 10 WHEN l_returnflag = 'N' THEN NULL END AS value FROM lineitem
    WHERE l_linestatus = 'O'), parts AS (SELECT p_partkey AS label FROM part), s AS ({_stats_sql('vals')}),
filled AS (SELECT label, coalesce(count, 0) AS count, mean, variance, coalesce(negative, 0) AS negative, minval,
    maxval FROM parts LEFT JOIN s USING (label)) {_stats_out('filled')}""")
def stats_with_gaps(spark, sf):
    """NaN and NULL do not count; labels without values stay listed."""
    x = Clinical(spark, sf)
    value = F.when(F.col("l_returnflag") == "A", F.col("l_quantity") - 10).when(
        F.col("l_returnflag") == "R", F.lit(float("nan")))
    rows = x._table("lineitem").filter(F.col("l_linestatus") == "O").select(
        F.col("l_partkey").alias("label"), value.alias("value"))
    labels = x._table("part").select(F.col("p_partkey").alias("label"))
    return _shown(T.collect_stats(rows, labels=labels))


_CURVE_VALUES = f"{TL.OBS}, {TL._curves_block(TL.WINDOW)}, vals AS (SELECT concept_id AS label, value FROM curves)"


def _curve_stats(spark, sf):
    x = Clinical(spark, sf)
    built = U.build_curves(x.ehr, x.meta, options=U.CurveOptions.windowed(TL.WINDOW))
    long = built.select(F.col("concept_id").alias("label"), "value")
    return x, *T.collect_with_log10(long)


@R.query("curve_stats_t14", f"{_CURVE_VALUES}, s AS ({_stats_sql('vals')}) {_stats_out('s', 6)}")
def curve_stats(spark, sf):
    return _shown(_curve_stats(spark, sf)[1], 6)


@R.query("curve_log10_stats_t14_f7", f"""{_CURVE_VALUES},
logs AS (SELECT label, CASE WHEN value > 0 THEN log10(value) END AS value FROM vals),
s AS ({_stats_sql('logs')}) {_stats_out('s', 6)}""")
def curve_log10_stats(spark, sf):
    return _shown(_curve_stats(spark, sf)[2], 6)


@R.query("stats_merged_a13_u3", f"WITH {VALUES}, s AS ({_stats_sql('vals')}) {_stats_out('s')}")
def stats_merged(spark, sf):
    """Partial statistics by return flag, merged, equal those of all rows."""
    lines = Clinical(spark, sf)._table("lineitem")
    parts = []
    for flag in ("A", "N", "R"):
        rows = lines.filter(F.col("l_returnflag") == flag).select(
            F.col("l_partkey").alias("label"), ((F.col("l_extendedprice") - 25000) / 1000).alias("value"))
        parts.append(T.collect_stats(rows))
    return _shown(T.merge_stats(*parts))


_EXTENDED = f"""{VALUES}, s AS ({_stats_sql('vals')}),
padded AS (SELECT label, value, 1 AS n FROM vals UNION ALL
    SELECT label, -3.5, 100 - count FROM s),
e AS (SELECT label, sum(n) AS count, sum(n * value) / sum(n) AS mean, sum(CASE WHEN value < 0 THEN n ELSE 0 END) AS negative,
    min(value) AS minval, max(value) AS maxval FROM padded GROUP BY label),
v AS (SELECT label, sum(n * power(p.value - e.mean, 2)) / sum(n) AS variance FROM padded p JOIN e USING (label) GROUP BY label),
x AS (SELECT * FROM e JOIN v USING (label))"""


@R.query("stats_extended_a14", f"WITH {_EXTENDED} {_stats_out('x')}")
def stats_extended(spark, sf):
    return _shown(T.extend_stats(T.collect_stats(_values(spark, sf)), 100, -3.5))


_GROUPED = f"""{VALUES}, brands AS (SELECT p_partkey AS label, p_brand FROM part),
grouped AS (SELECT p_brand AS label, value FROM vals JOIN brands USING (label)), g AS ({_stats_sql('grouped')})"""


@R.query("stats_pooled_a15", f"""WITH {_GROUPED}, x AS (
    SELECT s.label, g.* EXCLUDE (label) FROM (SELECT DISTINCT label FROM vals) s
    JOIN brands b ON b.label = s.label JOIN g ON g.label = p_brand) {_stats_out('x')}""")
def stats_pooled(spark, sf):
    groups = Clinical(spark, sf)._table("part").select(
        F.col("p_partkey").alias("label"), F.col("p_brand").alias("group"))
    return _shown(T.pool_stats(T.collect_stats(_values(spark, sf)), groups))


@R.query("stats_pooled_over_all_a15", f"""WITH {VALUES}, one AS (SELECT 0 AS label, value FROM vals),
g AS ({_stats_sql('one')}), x AS (SELECT s.label, g.* EXCLUDE (label) FROM (SELECT DISTINCT label FROM vals) s, g)
{_stats_out('x')}""")
def stats_pooled_over_all(spark, sf):
    return _shown(T.pool_all(T.collect_stats(_values(spark, sf))))


# --- standardisation -----------------------------------------------------------

# Curves are filled up to the time points of the sample space: seconds from each person's first event to the last.
N_OBS = "(SELECT sum(n) FROM (SELECT date_diff('second', min(ts), max(ts)) + 1 AS n FROM events GROUP BY user_id))"


def _scaler_sql(condition_fill: str) -> str:
    return f"""{_CURVE_VALUES},
b AS ({_stats_sql('vals')}),
logs AS (SELECT label, CASE WHEN value > 0 THEN log10(value) END AS value FROM vals),
l AS ({_stats_sql('logs')}),
modes AS (SELECT concept_id AS label, data_mode FROM meta),
pads AS (SELECT * FROM (VALUES ('Condition', {condition_fill}, log10({condition_fill})), ('Medication', 0.0, NULL)) AS t(data_mode, fill, lfill)),
weighted AS (
    SELECT label, count AS n, mean AS m, variance AS v, negative, minval, maxval FROM b
    UNION ALL SELECT label, {N_OBS} - count, fill, 0, 0, fill, fill FROM b JOIN modes USING (label) JOIN pads USING (data_mode)),
lweighted AS (
    SELECT label, count AS n, mean AS m, variance AS v FROM l
    UNION ALL SELECT label, {N_OBS} - count, lfill, 0 FROM l JOIN modes USING (label) JOIN pads USING (data_mode)
    WHERE lfill IS NOT NULL),
keyed AS (SELECT *, CASE WHEN data_mode = 'Measurement' THEN CAST(label AS VARCHAR) ELSE data_mode END AS k FROM modes),
wm AS (SELECT k, sum(n) AS count, sum(n * m) / sum(n) AS mean, sum(negative) AS negative, min(minval) AS minval,
    max(maxval) AS maxval FROM weighted JOIN keyed USING (label) GROUP BY k),
wv AS (SELECT k, sum(n * (v + power(m - mean, 2))) / sum(n) AS variance FROM weighted JOIN keyed USING (label) JOIN wm USING (k) GROUP BY k),
lkeyed AS (SELECT label, CASE WHEN data_mode = 'Condition' THEN data_mode ELSE CAST(label AS VARCHAR) END AS lk FROM modes),
lm AS (SELECT lk, sum(n * m) / sum(n) AS lmean FROM lweighted JOIN lkeyed USING (label) GROUP BY lk),
lv AS (SELECT lk, sum(n * (v + power(m - lmean, 2))) / sum(n) AS lvariance FROM lweighted JOIN lkeyed USING (label) JOIN lm USING (lk) GROUP BY lk),
joint AS (SELECT keyed.label, data_mode, count, mean, negative, minval, maxval, variance, lmean, lvariance,
    variance <= 1e-8 + 1e-5 * variance OR maxval - minval < 1e-6 * (maxval + minval) AS flat,
    negative > 0.01 * count AS many
    FROM keyed JOIN wm USING (k) JOIN wv USING (k) JOIN lkeyed ON lkeyed.label = keyed.label
    LEFT JOIN lm USING (lk) LEFT JOIN lv USING (lk)),
scaler AS (SELECT label,
    CASE WHEN data_mode = 'Medication' THEN 0 WHEN flat THEN minval WHEN many THEN mean
         WHEN data_mode = 'Condition' THEN 0 ELSE mean END AS shift,
    CASE WHEN data_mode = 'Medication' THEN 2 * sqrt(variance) WHEN flat THEN 1 WHEN many THEN 2 * sqrt(variance)
         WHEN data_mode = 'Condition' THEN 2 * sqrt(lvariance) ELSE 2 * sqrt(variance) END AS scale,
    data_mode = 'Condition' AND NOT flat AND NOT many AS log10, 1e-6 AS eps FROM joint)"""


_SCALER = _scaler_sql("1e-6")


def _scaler(spark, sf, params=M.DEFAULT_PARAMS):
    x, base, lg10 = _curve_stats(spark, sf)
    modes = x.meta.withColumnRenamed("concept_id", "label")
    points = S.space_totals(S.sample_space(x.ehr)).first()["ntimepoints"]
    return x, M.make_scaler(base, lg10, modes, points, params)


@R.query("scaler_m3", f"""{_SCALER} SELECT label, {V.rounded('shift', 8)} AS shift, {V.rounded('scale', 8)} AS scale,
    log10, CAST(eps AS DOUBLE) AS eps FROM scaler""")
def scaler(spark, sf):
    return _scaler(spark, sf)[1].select("label", rounded("shift", 8).alias("shift"),
                                        rounded("scale", 8).alias("scale"), "log10", "eps")


@R.query("scaler_background_m3_m6", f"""{_scaler_sql('(1 / (20 * 365.25))')} SELECT label, {V.rounded('shift', 8)} AS shift,
    {V.rounded('scale', 8)} AS scale, log10, CAST(eps AS DOUBLE) AS eps FROM scaler""")
def scaler_background(spark, sf):
    """Conditions filled at their background rate."""
    return _scaler(spark, sf, M.background_params())[1].select(
        "label", rounded("shift", 8).alias("shift"), rounded("scale", 8).alias("scale"), "log10", "eps")


_SCALED = "(CASE WHEN log10 THEN log10(greatest(value, 1e-300) + eps) ELSE value END - shift) / scale"


@R.query("scaled_values_m4", f"""{_SCALER}, e AS (SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1
    WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS label, value FROM events)
SELECT event_id, label, {V.rounded(_SCALED)} AS value FROM e JOIN scaler USING (label)""")
def scaled_values(spark, sf):
    x, made = _scaler(spark, sf)
    return M.apply_scaler(_labelled_events(x), made).withColumn("value", rounded("value"))


def _labelled_events(x: Clinical) -> DataFrame:
    from longspan.sources.clinical import event_concept

    return x._table("events").select("event_id", event_concept(F.col("event_type")).alias("label"), "value")


@R.query("scaled_back_m4_f7", """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1
    WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS label,
    """ + V.rounded("value") + " AS value FROM events")
def scaled_back(spark, sf):
    """Scaling and its inverse give back the values."""
    x, made = _scaler(spark, sf)
    there = M.apply_scaler(_labelled_events(x), made)
    return M.invert_scaler(there, made).withColumn("value", rounded("value"))


@R.query("impact_f13", f"""{_SCALER}, d AS (SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1
    WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS label,
    value / 1000 - 0.2 AS delta FROM events),
ends AS (SELECT event_id, label, delta, log10,
    CASE WHEN log10 THEN power(10, scale + shift) - eps ELSE scale + shift END AS low,
    CASE WHEN log10 THEN power(10, (1 + delta) * scale + shift) - eps ELSE (1 + delta) * scale + shift END AS high
    FROM d JOIN scaler USING (label))
SELECT event_id, label, {V.rounded('delta', 9)} AS delta, CASE
    WHEN log10 AND low < high THEN 'x' || printf('%.3f', floor(high / low * 1000 + 0.5) / 1000)
    WHEN log10 THEN '/' || printf('%.3f', floor(low / high * 1000 + 0.5) / 1000)
    ELSE printf('%+.3f', sign(high - low) * (floor(abs(high - low) * 1000 + 0.5) / 1000)) END AS impact FROM ends""")
def impact(spark, sf):
    x, made = _scaler(spark, sf)
    deltas = _labelled_events(x).select("event_id", "label", (F.col("value") / 1000 - 0.2).alias("delta"))
    return M.impact(deltas, made, digits=3).withColumn("delta", rounded("delta", 9))


# --- dense matrices ---------------------------------------------------------------


@R.query("dense_matrix_m1", f"""WITH {EHR}, d AS (SELECT person_id, CAST(datetime AS DATE) AS day, concept_id,
    max(value) AS value FROM ehr GROUP BY 1, 2, 3),
obs AS (SELECT DISTINCT person_id, day FROM d), fills AS (SELECT * FROM (VALUES (1, 0.5), (2, 0.25), (3, 10.0), (4, 0.0), (5, -1.0)) AS t(label, fill))
SELECT o.person_id, CAST(o.day AS VARCHAR) AS day, CAST(label AS BIGINT) AS label,
    coalesce(d.value, CAST(fill AS DOUBLE)) AS value
FROM obs o CROSS JOIN fills f LEFT JOIN d ON d.person_id = o.person_id AND d.day = o.day AND d.concept_id = f.label""")
def dense_matrix(spark, sf):
    daily = Clinical(spark, sf).ehr.groupBy(
        "person_id", F.col("datetime").cast("date").cast("string").alias("day"),
        F.col("concept_id").alias("label")).agg(F.max("value").alias("value"))
    fills = {1: 0.5, 2: 0.25, 3: 10.0, 4: 0.0, 5: -1.0}
    observations = daily.select("person_id", "day")
    dense = M.dense_rows(daily, ["person_id", "day"], sorted(fills), fills, observations)
    return M.dense_long(dense, ["person_id", "day"], sorted(fills)).withColumn("label", F.col("label").cast("long"))


_FILLS = {1: 1 / (20 * 365.25), 2: 1 / (20 * 365.25), 3: 25.0, 4: 0.0, 5: 25.0}
_ASSEMBLED = f"""{TL.INDEX},
points AS (SELECT DISTINCT person_id, CAST(datetime AS DATE) AS day FROM idx),
age AS (SELECT avg(a) AS m, stddev_pop(a) AS s FROM (
    SELECT (CAST(min(datetime) AS DATE) - any_value(birth_date)
        + unnest(generate_series(0, CAST(max(datetime) AS DATE) - CAST(min(datetime) AS DATE)))) / 365.25 AS a
    FROM ehr JOIN users USING (person_id) GROUP BY person_id)),
fills AS (SELECT CAST(label AS BIGINT) AS label, CAST(fill AS DOUBLE) AS value FROM (VALUES {", ".join(f"({k}, {v!r})" for k, v in _FILLS.items())}) AS t(label, fill)),
sampled AS (SELECT person_id, points.day, label, coalesce(c.value, f.value) AS value FROM points CROSS JOIN fills f
    LEFT JOIN {{source}} c ON c.g = person_id AND c.day = points.day AND c.concept_id = label),
assembled AS (
    SELECT person_id, day, label, {_SCALED} AS value FROM sampled JOIN scaler USING (label)
    UNION ALL SELECT person_id, day, 3022304, ((day - birth_date) / 365.25 - m) / s FROM points JOIN users USING (person_id), age
    UNION ALL SELECT person_id, day, d, CASE WHEN d IN (gender_concept_id, race_concept_id) THEN 1 ELSE 0 END
        FROM points JOIN users USING (person_id), (SELECT unnest([5000, 5001, 6000, 6001, 6002, 6003, 6004]) AS d))"""
_DEMOGRAPHICS = [5000, 5001, 6000, 6001, 6002, 6003, 6004]


def _assembled(spark, sf, look_ahead: bool):
    x, made = _scaler(spark, sf)
    index = TL._index(x.ehr)
    options = U.CurveOptions.windowed(TL.WINDOW)
    if look_ahead:
        samples = U.cross_section(U.build_curves(x.ehr, x.meta, options=options), index, off_grid="drop")
    else:
        index = P.without_misses(index, P.projection_misses(index, x.ehr))
        samples = P.project_points(index, x.ehr, x.meta, options)
    fills = F.create_map(*[F.lit(v) for kv in _FILLS.items() for v in kv])
    meta = x.meta.withColumn("fill_value", fills[F.col("concept_id").cast("int")])
    age = S.age_stats(S.sample_space(x.ehr), x.users).first()
    return M.assemble_matrix(index, samples, meta, made, x.users, _DEMOGRAPHICS, age["mean_age"], age["sdev_age"],
                             off_grid="fill" if look_ahead else "raise")


_ASSEMBLED_OUT = f"""SELECT person_id, CAST(day AS VARCHAR) AS datetime, CAST(label AS BIGINT) AS label,
    {V.rounded('value')} AS value FROM assembled"""


@R.query("assembled_matrix_m2_m5_m6", f"{_SCALER}, {_ASSEMBLED.format(source='curves')} {_ASSEMBLED_OUT}")
def assembled_matrix(spark, sf):
    """Standardised matrix of curve samples, age and demographics."""
    dense, order = _assembled(spark, sf, True)
    long = M.dense_long(dense, ["person_id", "datetime"], order)
    return long.select("person_id", text("datetime").alias("datetime"),
                       F.col("label").cast("long").alias("label"), rounded("value").alias("value"))


_SEEN_INDEX = TL.INDEX.replace("idx AS", "idx0 AS") + """, firsts AS (SELECT person_id, min(datetime) AS first FROM ehr GROUP BY 1),
idx AS (SELECT idx0.* FROM idx0 JOIN firsts USING (person_id) WHERE CAST(CAST(datetime AS DATE) AS TIMESTAMP) > first)"""


@R.query("projected_matrix_t15_m2", f"""WITH scaler AS ({_SCALER} SELECT * FROM scaler),
projected AS ({TL.PROJECTED}, {TL._curves_block(TL.WINDOW, grid=TL.SAMPLE_GRID)}
    SELECT person_id AS g, concept_id, dt AS day, value FROM curves JOIN samples ON sample = g AND dt = day),
{EHR}, {_ASSEMBLED.format(source='projected').replace(TL.INDEX, _SEEN_INDEX)} {_ASSEMBLED_OUT}""")
def projected_matrix(spark, sf):
    """Standardised matrix that sees only what came before each point; points without a past are removed."""
    dense, order = _assembled(spark, sf, False)
    long = M.dense_long(dense, ["person_id", "datetime"], order)
    return long.select("person_id", text("datetime").alias("datetime"),
                       F.col("label").cast("long").alias("label"), rounded("value").alias("value"))


# --- linear algebra ---------------------------------------------------------------

CELLS = """cells AS (SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v
    FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i))"""


@R.query("covariance_a23", f"""WITH {CELLS},
m AS (SELECT i, avg(v) AS mean FROM cells GROUP BY i),
c AS (SELECT vec_id, i, v - mean AS v FROM cells JOIN m USING (i))
SELECT a.i, b.i AS j, {V.rounded('sum(a.v * b.v) / (SELECT count(*) FROM embeddings)', 9)} AS covariance
FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i""")
def covariance(spark, sf):
    table = L.covariance_table(Clinical(spark, sf).matrix)
    return table.withColumn("covariance", rounded("covariance", 9))


def _identity(k: int) -> str:
    return f"""SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS covariance
    FROM (SELECT unnest(generate_series(0, {k - 1})) AS i), (SELECT unnest(generate_series(0, {k - 1})) AS j)"""


@R.query("whitened_covariance_l1_o3", _identity(16))
def whitened_covariance(spark, sf):
    """Whitened rows have the identity as covariance."""
    matrix = Clinical(spark, sf).matrix
    white = L.learn_whitening(matrix, 16).apply(matrix)
    return L.covariance_table(white).withColumn("covariance", rounded("covariance", 6))


@R.query("whitening_reconstructs_l1_o3", f"""WITH {CELLS},
m AS (SELECT i, avg(v) AS mean FROM cells GROUP BY i),
c AS (SELECT vec_id, i, v - mean AS v FROM cells JOIN m USING (i))
SELECT a.i, b.i AS j, {V.rounded('sum(a.v * b.v) / (SELECT count(*) FROM embeddings)', 9)} AS covariance
FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i""")
def whitening_reconstructs(spark, sf):
    """The inverse of K, times its transpose, is the covariance of the rows that K was learned from."""
    matrix = Clinical(spark, sf).matrix
    back = np.linalg.inv(L.learn_whitening(matrix, -1).k)
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(back @ back.T)]
    table = spark.createDataFrame(rows, "i long, j long, covariance double")
    return table.withColumn("covariance", rounded("covariance", 9))


# Quantities of each part by return flag and line number, with both margins: 31 features of rank 21.
_FLAGS, _LINES = ("A", "N", "R"), range(1, 8)
_MARGINS = """cells AS (SELECT l_partkey AS part, l_returnflag || l_linenumber AS feature, sum(l_quantity) AS v FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_partkey, l_returnflag, sum(l_quantity) FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_partkey, CAST(l_linenumber AS VARCHAR), sum(l_quantity) FROM lineitem GROUP BY ALL),
total AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem),
sums AS (SELECT feature, sum(v) AS s FROM cells GROUP BY feature),
products AS (SELECT a.feature AS i, b.feature AS j, sum(a.v * b.v) AS s FROM cells a JOIN cells b USING (part) GROUP BY ALL),
cov AS (SELECT a.feature AS i, b.feature AS j, coalesce(p.s, 0) / n - a.s / n * b.s / n AS c
    FROM sums a CROSS JOIN sums b CROSS JOIN total LEFT JOIN products p ON p.i = a.feature AND p.j = b.feature),
square AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM cov a JOIN cov b ON a.j = b.i GROUP BY ALL),
traces AS (SELECT (SELECT sum(c) FROM cov WHERE i = j) AS t1, (SELECT sum(c * c) FROM cov) AS t2,
    (SELECT sum(s.c * c.c) FROM square s JOIN cov c ON s.i = c.j AND s.j = c.i) AS t3)"""


@R.query("leading_components_l1_o3", f"""WITH {_MARGINS}
SELECT CAST(1 AS BIGINT) AS power, {V.rounded('ln(t1)', 9)} AS total FROM traces
UNION ALL SELECT 2, {V.rounded('ln(t2)', 9)} FROM traces UNION ALL SELECT 3, {V.rounded('ln(t3)', 9)} FROM traces""")
def leading_components(spark, sf):
    """Power sums of the variances of the leading components, found without a covariance: the traces of its powers."""
    lines = Clinical(spark, sf)._table("lineitem")
    of_flag = {f: F.col("l_returnflag") == f for f in _FLAGS}
    of_line = {n: F.col("l_linenumber") == n for n in _LINES}
    wanted = [a & b for a in of_flag.values() for b in of_line.values()] + [*of_flag.values(), *of_line.values()]
    columns = [F.sum(F.when(w, F.col("l_quantity")).otherwise(0.0)) for w in wanted]
    features = materialise(lines.groupBy("l_partkey").agg(F.array(*columns).alias("features")))
    found = C.leading_components(features, 21, oversample=4)
    rows = [(m, float(np.log(np.sum(found.values**m)))) for m in (1, 2, 3)]
    return spark.createDataFrame(rows, "power long, total double").withColumn("total", rounded("total", 9))


@R.query("sources_covariance_l3_l6", _identity(4))
def sources_covariance(spark, sf):
    """Independent components keep the identity covariance of white rows."""
    matrix = Clinical(spark, sf).matrix
    white = L.learn_whitening(matrix, 4).apply(matrix).persist()
    w, _ = L.fastica(white, np.eye(4) + 0.1, max_iter=6, tol=1e-3)
    return L.covariance_table(L.sources(white, w)).withColumn("covariance", rounded("covariance", 6))


@R.query("sources_mixed_back_l3_l6", f"WITH {CELLS} SELECT vec_id AS obs_id, i, {V.rounded('v', 5)} AS v FROM cells")
def sources_mixed_back(spark, sf):
    """All independent components of the rows, mixed back: A s + mean is the row that s was found from."""
    matrix = Clinical(spark, sf).matrix
    whitening = L.learn_whitening(matrix, -1)
    white = materialise(whitening.apply(matrix))
    start = np.linalg.qr(np.vander(np.linspace(-1, 1, len(whitening.k)), increasing=True) + np.eye(len(whitening.k)))[0]
    w, _ = L.fastica(white, start, max_iter=12)
    back = L.project(L.sources(white, w), L.mixing(w, whitening.k), whitening.mean)
    return back.select("obs_id", F.posexplode("features").alias("i", "v")).select(
        "obs_id", F.col("i").cast("long").alias("i"), rounded("v", 5).alias("v"))


@R.query("ica_step_l4_l5", f"""WITH {CELLS}, w AS (SELECT c, i, ((c * 5 + i * 3) % 7 - 3) / 40.0::DOUBLE AS w
    FROM (SELECT unnest(generate_series(0, 63)) AS c), (SELECT unnest(generate_series(0, 63)) AS i)),
u AS (SELECT vec_id, c, tanh(sum(w * v)) AS g FROM cells JOIN w USING (i) GROUP BY 1, 2),
s AS (SELECT c, avg(1 - g * g) AS slope FROM u GROUP BY c),
m AS (SELECT c, i, sum(g * v) / (SELECT count(*) FROM embeddings) AS moment FROM u JOIN cells USING (vec_id) GROUP BY 1, 2)
SELECT CAST(c AS BIGINT) AS component, CAST(i AS BIGINT) AS feature, {V.rounded('moment - slope * w', 9)} AS weight
FROM m JOIN s USING (c) JOIN w USING (c, i)""")
def ica_step(spark, sf):
    """One fixed-point step from given weights, before decorrelation."""
    w = np.array([[((c * 5 + i * 3) % 7 - 3) / 40.0 for i in range(64)] for c in range(64)])
    sums, slopes = L.ica_moments(Clinical(spark, sf).matrix, w)
    rows = [(c, i, float(v)) for (c, i), v in np.ndenumerate(L.updated(sums, w, slopes))]
    table = spark.createDataFrame(rows, "component long, feature long, weight double")
    return table.withColumn("weight", rounded("weight", 9))


@R.query("projected_rows_l2", f"""WITH {CELLS}, k AS (SELECT unnest(generate_series(0, 4)) AS c)
SELECT vec_id AS obs_id, CAST(c AS BIGINT) AS component,
    {V.rounded('sum(((c * 7 + i * 3) % 5 - 2) * v) + c')} AS value FROM cells, k GROUP BY vec_id, c""")
def projected_rows(spark, sf):
    weights = np.array([[(c * 7 + i * 3) % 5 - 2 for i in range(64)] for c in range(5)], dtype=float)
    rows = L.project(Clinical(spark, sf).matrix, weights, np.arange(5.0))
    return rows.select("obs_id", F.posexplode("features").alias("component", "value")).select(
        "obs_id", F.col("component").cast("long").alias("component"), rounded("value").alias("value"))


@R.query("unit_variance_l7", f"""WITH {CELLS}, f AS (
    SELECT i, stddev_samp(v) * 2 * CASE WHEN abs(min(v)) > max(v) THEN -1 ELSE 1 END AS factor FROM cells GROUP BY i)
SELECT vec_id AS obs_id, i AS component, {V.rounded('v / factor')} AS value FROM cells JOIN f USING (i)""")
def unit_variance(spark, sf):
    rows, _, _ = L.scale_to_unit_variance(Clinical(spark, sf).matrix, np.eye(64), 2.0, True)
    return rows.select("obs_id", F.posexplode("features").alias("component", "value")).select(
        "obs_id", F.col("component").cast("long").alias("component"), rounded("value").alias("value"))


# Component sets: mean vectors per label, of even and of odd rows.
_SETS = f"""{CELLS}, sides AS (SELECT CAST(label AS BIGINT) AS component, vec_id % 2 AS side, i, avg(v) AS v
    FROM cells JOIN embeddings USING (vec_id) GROUP BY ALL),
cosines AS (SELECT a.component AS a, b.component AS b,
    sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)) AS cosine
    FROM sides a JOIN sides b ON a.i = b.i AND a.side = 0 AND b.side = 1 GROUP BY 1, 2)"""


def _component_sets(spark, sf):
    cells = Clinical(spark, sf).matrix.select(
        "label", (F.col("obs_id") % 2).alias("side"), F.posexplode("features").alias("i", "v"))
    means = cells.groupBy("label", "side", "i").agg(F.avg("v").alias("v"))
    vectors = means.groupBy("label", "side").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("features"))
    named = vectors.withColumnRenamed("label", "component")
    return tuple(named.filter(F.col("side") == s).drop("side") for s in (0, 1))


@R.query("cosine_similarity_l8", f"WITH {_SETS} SELECT a, b, {V.rounded('cosine')} AS cosine FROM cosines")
def cosine_similarity(spark, sf):
    return A.cosine_similarity(*_component_sets(spark, sf)).withColumn("cosine", rounded("cosine"))


@R.query("affinity_l8", f"WITH {_SETS} SELECT a, b, {V.rounded('cosine * cosine')} AS affinity FROM cosines")
def affinity(spark, sf):
    return A.affinity(*_component_sets(spark, sf)).withColumn("affinity", rounded("affinity"))


def _best_sql(by: str) -> str:
    other = "b" if by == "a" else "a"
    return f"""WITH {_SETS}, best AS (SELECT {by}, arg_max({other}, cosine * cosine) AS {other},
    max(cosine * cosine) AS affinity FROM cosines GROUP BY {by})
SELECT {by}, {other}, {V.rounded('affinity')} AS affinity,
    row_number() OVER (ORDER BY affinity DESC, {by}) - 1 AS place FROM best"""


@R.query("max_affinity_rows_l10_o11", _best_sql("a"))
def max_affinity_rows(spark, sf):
    pairs = A.affinity(*_component_sets(spark, sf))
    return A.max_affinity(pairs, "a").withColumn("affinity", rounded("affinity"))


@R.query("max_affinity_columns_l10_o11", _best_sql("b"))
def max_affinity_columns(spark, sf):
    pairs = A.affinity(*_component_sets(spark, sf))
    return A.max_affinity(pairs, "b").withColumn("affinity", rounded("affinity"))


def _partners_sql(by: str) -> str:
    other = "b" if by == "a" else "a"
    return f"""WITH {CELLS}, means AS (SELECT CAST(label AS BIGINT) AS component, i, avg(v) AS v
    FROM cells JOIN embeddings USING (vec_id) GROUP BY 1, 2),
cosines AS (SELECT a.component AS a, b.vec_id AS b, sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)) AS cosine
    FROM means a JOIN cells b USING (i) GROUP BY 1, 2),
best AS (SELECT {by} AS a, arg_max({other}, (cosine * cosine, -{other})) AS b, max(cosine * cosine) AS affinity FROM cosines GROUP BY {by})
SELECT a, b, {V.rounded('affinity')} AS affinity, row_number() OVER (ORDER BY affinity DESC, a) - 1 AS place FROM best"""


def _partners(spark, sf, by: str) -> DataFrame:
    rows = Clinical(spark, sf).matrix
    means = rows.select("label", F.posexplode("features").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    few = means.groupBy(F.col("label").alias("component")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("features"))
    many = rows.select(F.col("obs_id").alias("component"), "features")
    found = A.best_partners(few, many) if by == "a" else A.best_partners(many, few)
    return found.withColumn("affinity", rounded("affinity"))


@R.query("best_partners_l8_l10_o11", _partners_sql("a"))
def best_partners(spark, sf):
    """The row nearest to each label's mean: more columns than rows."""
    return _partners(spark, sf, "a")


@R.query("best_partners_columns_l8_l10_o11", _partners_sql("b"))
def best_partners_columns(spark, sf):
    return _partners(spark, sf, "b")


@R.query("optimal_matching_l9")
def optimal_matching(spark, sf):
    pairs = A.affinity(*_component_sets(spark, sf))
    return A.optimal_matching(pairs, "a").withColumn("affinity", rounded("affinity"))


@R.query("leading_elements_w6", f"""WITH {CELLS},
r AS (SELECT vec_id, i, v, row_number() OVER w AS rank, sqrt(sum(v * v) OVER (w ROWS UNBOUNDED PRECEDING)
    / sum(v * v) OVER (PARTITION BY vec_id)) AS cumulative FROM cells WINDOW w AS (PARTITION BY vec_id ORDER BY v * v DESC, i)),
c AS (SELECT vec_id, min(rank) AS cutoff FROM r WHERE cumulative > 0.8 GROUP BY vec_id)
SELECT vec_id AS component, i AS element, rank, {V.rounded('v')} AS value, {V.rounded('cumulative')} AS cumulative, cutoff
FROM r JOIN c USING (vec_id) WHERE rank <= least(25, greatest(5, cutoff))""")
def leading_elements(spark, sf):
    rows = Clinical(spark, sf).matrix.select(
        F.col("obs_id").alias("component"), F.posexplode("features").alias("element", "value"))
    found = E.leading_elements(rows.withColumn("element", F.col("element").cast("long")), 0.8, 5, 25)
    return found.select("component", "element", F.col("rank").cast("long").alias("rank"),
                        rounded("value").alias("value"), rounded("cumulative").alias("cumulative"),
                        F.col("cutoff").cast("long").alias("cutoff"))


# --- evaluation ---------------------------------------------------------------------

SCORED = """scored AS (SELECT doc_id, lang, quality AS label, n_chars % 1000 + toxic AS score
    FROM labels JOIN documents USING (doc_id))"""


def _scored(spark, sf) -> DataFrame:
    x = Clinical(spark, sf)
    docs = x._table("documents").select("doc_id", "lang", "n_chars")
    return x._table("labels").join(docs, "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"),
        (F.col("n_chars") % 1000 + F.col("toxic")).cast("double").alias("score"))


def _auc_sql(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {SCORED},
r AS (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {keys} score) - 1) / 2.0 AS rk FROM scored)
SELECT {keys} {V.rounded('''(sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
    / nullif(count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0), 0)''')} AS auc FROM r {group}"""


@R.query("auc_a24", _auc_sql())
def auc(spark, sf):
    return E.auc(_scored(spark, sf)).withColumn("auc", rounded("auc"))


@R.query("auc_by_language_a24", _auc_sql("lang"))
def auc_by_language(spark, sf):
    return E.auc(_scored(spark, sf), ("lang",)).withColumn("auc", rounded("auc"))


@R.query("auc_bootstrap_a24")
def auc_bootstrap(spark, sf):
    return E.auc_bootstrap(_scored(spark, sf), n=100, seed=3)


@R.query("auc_replicates_a24", f"""WITH {SCORED}, w AS (SELECT r AS replicate, score,
    sum(CASE WHEN label = 1 THEN (doc_id * (r + 1)) % 3 ELSE 0 END) AS pos,
    sum(CASE WHEN label = 1 THEN 0 ELSE (doc_id * (r + 1)) % 3 END) AS neg
    FROM scored, (SELECT unnest(generate_series(0, 99)) AS r) GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY replicate ORDER BY score) - neg AS below FROM w)
SELECT CAST(replicate AS BIGINT) AS replicate,
    {V.rounded('sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0)')} AS auc FROM c GROUP BY 1""")
def auc_replicates(spark, sf):
    """A hundred fixed weightings in one pass."""
    weights = F.array(*[(F.col("doc_id") * (r + 1) % 3).cast("double") for r in range(100)])
    found = E.auc_replicates(_scored(spark, sf).withColumn("weights", weights), "weights", 100)
    return found.withColumn("auc", rounded("auc"))


@R.query("shared_histogram_a21", f"""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_returnflag AS split, CAST(least(98, floor((l_extendedprice - lo) / ((hi - lo) / 99))) AS BIGINT) AS bin,
    count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def shared_histogram(spark, sf):
    rows = Clinical(spark, sf)._table("lineitem").select(F.col("l_returnflag").alias("split"), "l_extendedprice")
    return E.shared_histogram(rows, "split", "l_extendedprice", 100)


@R.query("signed_histogram_a21", f"""WITH v AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM v WHERE v <> 0)
SELECT CASE WHEN v > 0 THEN 'pos' ELSE 'neg' END AS side, CAST(least(49, floor((v - lo) / ((hi - lo) / 50))) AS BIGINT) AS bin,
    count(*) AS n FROM v, e WHERE v <> 0 GROUP BY 1, 2""")
def signed_histogram(spark, sf):
    values = Clinical(spark, sf).matrix.select(F.explode("features").alias("v"))
    return E.signed_histogram(values, "v", 51)


LOSSES = """losses AS (SELECT l_linestatus AS split, CAST(date_diff('month', TIMESTAMP '1990-01-01', l_shipdate) AS BIGINT) AS epoch,
    l_discount * 10 AS loss FROM lineitem)"""


def _losses(spark, sf) -> DataFrame:
    months = (F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate") - 1
    return Clinical(spark, sf)._table("lineitem").select(
        F.col("l_linestatus").alias("split"), months.cast("long").alias("epoch"),
        (F.col("l_discount") * 10).alias("loss"))


_PER_EPOCH = f"""{LOSSES}, raw AS (SELECT split, epoch, avg(loss) AS raw FROM losses GROUP BY 1, 2),
held AS (SELECT split, epoch, least(0.52, greatest(0.48, raw)) AS loss, raw < 0.48 OR raw > 0.52 AS clipped FROM raw)"""


@R.query("epoch_losses_a22_g5", f"WITH {_PER_EPOCH} SELECT split, epoch, {V.rounded('loss')} AS loss, clipped FROM held")
def epoch_losses(spark, sf):
    return E.epoch_losses(_losses(spark, sf), 0.48, 0.52).withColumn("loss", rounded("loss"))


@R.query("best_epoch_a22", f"""WITH {LOSSES}, raw AS (SELECT split, epoch, round(avg(loss), 9) AS loss FROM losses GROUP BY 1, 2)
SELECT split, arg_min(epoch, (loss, epoch)) AS epoch, {V.rounded('min(loss)')} AS loss FROM raw GROUP BY split""")
def best_epoch(spark, sf):
    per_epoch = E.epoch_losses(_losses(spark, sf)).withColumn("loss", F.round("loss", 9))
    return E.best_epoch(per_epoch).withColumn("loss", rounded("loss"))


PREDICTED = """pred AS (SELECT event_id, value AS target, value + (event_id % 7 - 3) * 2.0 AS mean,
    (event_id % 5) * 4.0 AS variance FROM events)"""


def _predicted(spark, sf) -> DataFrame:
    return Clinical(spark, sf)._table("events").select(
        "event_id", F.col("value").alias("target"),
        (F.col("value") + (F.col("event_id") % 7 - 3) * 2.0).alias("mean"),
        ((F.col("event_id") % 5) * 4.0).cast("double").alias("variance"))


_NLL = "0.5 * (0.7 * ln(greatest(variance, 0.5)) + 1.3 * power(mean - target, 2) / greatest(variance, 0.5)) + 0.5 * ln(2 * pi())"


@R.query("gaussian_nll_mean_a25", f"WITH {PREDICTED} SELECT {V.rounded(f'avg({_NLL})')} AS loss FROM pred")
def gaussian_nll_mean(spark, sf):
    out = E.nll_loss(_predicted(spark, sf), "mean", alpha=0.7, beta=1.3, full=True, eps=0.5)
    return out.select(rounded("loss").alias("loss"))


@R.query("gaussian_nll_rows_a25", f"WITH {PREDICTED} SELECT event_id, {V.rounded(_NLL)} AS loss FROM pred")
def gaussian_nll_rows(spark, sf):
    out = E.nll_loss(_predicted(spark, sf), "none", alpha=0.7, beta=1.3, full=True, eps=0.5)
    return out.select("event_id", rounded("loss").alias("loss"))


@R.query("error_intervals_f10_g2", f"""WITH {PREDICTED}, e AS (SELECT *, mean - target AS error, 1.96 * sqrt(variance) AS half FROM pred)
SELECT event_id, {V.rounded('greatest(-5, least(5, error))')} AS error, {V.rounded('least(half, 5)')} AS interval,
    abs(error) > half AS outside, {V.rounded('greatest(abs(error) - half, 0)')} AS beyond, half < 5 AS interval_in_range,
    abs(error) < 5 AS error_in_range FROM e""")
def error_intervals(spark, sf):
    out = E.error_intervals(_predicted(spark, sf), clip=5.0)
    return out.select("event_id", *[rounded(c).alias(c) for c in ("error", "interval", "beyond")],
                      "outside", "interval_in_range", "error_in_range")


@R.query("sampled_by_value_o5")
def sampled_by_value(spark, sf):
    return E.sampled_by_value(_predicted(spark, sf), "event_id", "variance", 1000, seed=5)


@R.query("cross_validated_forest_l11")
def cross_validated_forest(spark, sf):
    """Out-of-fold scores of a small forest on embeddings, label zero or not."""
    data = Clinical(spark, sf).matrix.withColumn("label", (F.col("label") == 0).cast("int"))
    _, _, predictions = E.cross_validated_forest(data, "obs_id", folds=3, trees=5, maxDepth=4)
    return predictions


# --- text ----------------------------------------------------------------------------

# Long code names put together from part attributes.
_NAME = """p_name || ', total ' || CASE p_size % 4 WHEN 0 THEN '[Moles/volume]' WHEN 1 THEN '[Entitic mass]'
    WHEN 2 THEN '[' || p_type || '/Area]' ELSE '[#/' || p_brand || ']' END || CASE p_size % 3
    WHEN 0 THEN ' in  Serum' WHEN 1 THEN ' IN Serum or Plasma' ELSE ' by Automated_Count in Blood by automated count' END"""
_LABEL = f"""named AS (SELECT p_partkey, {_NAME} AS name FROM part),
cut AS (SELECT p_partkey, name, regexp_extract(name, '^(.*\\[)([^/]*)(/?)(.*)(\\].*)$', 1) AS a,
    regexp_extract(name, '^(.*\\[)([^/]*)(/?)(.*)(\\].*)$', 5) AS z,
    split_part(regexp_extract(name, '\\[(.*)\\]', 1), '/', 1) AS head,
    lower(split_part(regexp_extract(name, '\\[(.*)\\]', 1), '/', 2)) AS tail FROM named),
units AS (SELECT p_partkey, a || CASE head WHEN 'Moles' THEN 'mol' WHEN 'Entitic mass' THEN 'M' ELSE head END
    || CASE tail WHEN '' THEN '' WHEN 'volume' THEN '/V' WHEN 'area' THEN '/A' ELSE '/' || tail END || z AS t FROM cut),
phrased AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    'in serum or plasma', 'in SP', 'gi'), 'in serum', 'in S', 'gi'), 'in plasma', 'in P', 'gi'),
    'in blood', 'in B', 'gi'), 'by automated count', 'by AC', 'gi') AS t FROM units),
flat AS (SELECT p_partkey, replace(regexp_replace(t, '\\s+', ' ', 'g'), '_', ' ') AS t FROM phrased)"""


def _named_parts(spark, sf) -> DataFrame:
    size = F.col("p_size")
    unit = (F.when(size % 4 == 0, "[Moles/volume]").when(size % 4 == 1, "[Entitic mass]")
            .when(size % 4 == 2, F.concat(F.lit("["), "p_type", F.lit("/Area]")))
            .otherwise(F.concat(F.lit("[#/"), "p_brand", F.lit("]"))))
    where = (F.when(size % 3 == 0, " in  Serum").when(size % 3 == 1, " IN Serum or Plasma")
             .otherwise(" by Automated_Count in Blood by automated count"))
    return Clinical(spark, sf)._table("part").select(
        "p_partkey", F.concat("p_name", F.lit(", total "), unit, where).alias("name"))


@R.query("short_labels_f12", f"WITH {_LABEL} SELECT p_partkey, t AS label FROM flat")
def short_labels(spark, sf):
    return _named_parts(spark, sf).select("p_partkey", short_label(F.col("name"), None).alias("label"))


@R.query("shortened_texts_f12", r"""
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
words AS (SELECT doc_id, t, unnest(string_split(replace(t, '-', ''), ' ')) AS w, generate_subscripts(string_split(replace(t, '-', ''), ' '), 1) AS i FROM flat),
ends AS (SELECT doc_id, i, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS stop FROM words),
kept AS (SELECT doc_id, max(stop) FILTER (WHERE stop + 3 <= 60) AS stop FROM ends GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(replace(t, '-', '')) <= 60 THEN replace(t, '-', '') WHEN stop IS NULL THEN '...'
    ELSE left(replace(t, '-', ''), CAST(stop AS BIGINT)) || '...' END AS label FROM flat JOIN kept USING (doc_id)""")
def shortened_texts(spark, sf):
    """Whole documents (without hyphens) cut at a word boundary."""
    from longspan.functions.text import shorten

    flat = F.translate(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), "-", "")
    return Clinical(spark, sf)._table("documents").select("doc_id", shorten(flat, 60).alias("label"))


# A line may break before a space, or after a hyphen between two letters and a word.
@R.query("shortened_names_f12", r"""
WITH named AS (SELECT p_partkey, replace(p_name, ' ', '-') || ' ' || p_brand || ' ' || p_type || '-' || p_size || '-' || p_name AS t FROM part),
places AS (SELECT p_partkey, t, unnest(generate_series(1, 27)) AS i FROM named),
breaks AS (SELECT p_partkey, max(i) AS i FROM places WHERE substr(t, i + 1, 1) = ' ' OR (substr(t, i, 1) = '-' AND i > 2
    AND regexp_matches(substr(t, i - 2, 2), '^\w[A-Za-z_]$') AND regexp_matches(substr(t, i + 1), '^\w+[A-Za-z_]'))
    GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN length(t) <= 30 THEN t WHEN i IS NULL THEN '...' ELSE substr(t, 1, i) || '...' END AS label
FROM named LEFT JOIN breaks USING (p_partkey)""")
def shortened_names(spark, sf):
    """Names with hyphens, some of them next to numbers, cut to 30 characters."""
    from longspan.functions.text import shorten

    name = F.concat(F.translate("p_name", " ", "-"), F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit("-"),
                    F.col("p_size").cast("string"), F.lit("-"), "p_name")
    return Clinical(spark, sf)._table("part").select("p_partkey", shorten(name, 30).alias("label"))


@R.query("feature_labels_f15", f"""WITH {_LABEL} SELECT p_partkey, t || ' (' || p_partkey || ') [ '
    || printf('%+.4f', p_retailprice - 950) || ' ]' AS label FROM flat JOIN part USING (p_partkey)""")
def feature_labels(spark, sf):
    prices = Clinical(spark, sf)._table("part").select("p_partkey", "p_retailprice")
    named = _named_parts(spark, sf).join(prices, "p_partkey")
    effect = F.format_string("%+.4f", F.col("p_retailprice") - 950)
    return named.select("p_partkey", feature_label(
        short_label(F.col("name"), None), F.col("p_partkey"), effect).alias("label"))


# --- datasets ------------------------------------------------------------------------


@R.query("batch_sizes_o7", """WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT b AS batch, CAST(least(32, n - 32 * b) AS BIGINT) AS n FROM n, (SELECT unnest(generate_series(0, (SELECT (n - 1) // 32 FROM n))) AS b)""")
def batch_sizes(spark, sf):
    """Shuffled batches are full but for the last."""
    return D.batches(Clinical(spark, sf).matrix, "obs_id", 32, seed=1).groupBy("batch").agg(
        F.count_distinct("obs_id").alias("n"))


@R.query("ordered_batches_o7", """WITH n AS (SELECT count(*) AS n FROM embeddings),
r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)
SELECT vec_id AS obs_id, i // 48 AS batch FROM r, n WHERE i // 48 < n // 48""")
def ordered_batches(spark, sf):
    rows = Clinical(spark, sf).matrix.select("obs_id")
    return D.batches(rows, "obs_id", 48, shuffle=False, drop_last=True)


@R.query("contiguous_parts_o10", """WITH r AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS part FROM orders)
SELECT o_orderkey, part FROM r""")
def contiguous_parts(spark, sf):
    return D.contiguous_parts(Clinical(spark, sf)._table("orders").select("o_orderkey"), "o_orderkey", 7)


@R.query("contiguous_parts_text_o10", """SELECT c_custkey, ntile(11) OVER (ORDER BY c_mktsegment DESC, c_name) - 1 AS part FROM customer""")
def contiguous_parts_text(spark, sf):
    """Runs in the order of two text keys."""
    rows = Clinical(spark, sf)._table("customer").select("c_custkey", "c_mktsegment", "c_name")
    return D.contiguous_parts(rows, [F.col("c_mktsegment").desc(), "c_name"], 11).select("c_custkey", "part")


@R.query("resampled_o6")
def resampled(spark, sf):
    return D.resample(Clinical(spark, sf)._table("events").select("event_id", "value"), "event_id", 0.2, 4)


@R.query("repeated_o8", """SELECT vec_id AS obs_id, CAST(r AS BIGINT) AS repeat
FROM embeddings, (SELECT unnest(generate_series(0, 2)) AS r)""")
def repeated(spark, sf):
    rows = D.repeated(Clinical(spark, sf).matrix.select("obs_id"), 3)
    return rows.withColumn("repeat", F.col("repeat").cast("long"))


@R.query("online_scaler_a26_m8", f"""WITH {VALUES}, s AS ({_stats_sql('vals')}), x AS (
    SELECT label, count, mean, greatest(variance, 1e-5) AS variance, negative, minval, maxval FROM s) {_stats_out('x')}""")
def online_scaler(spark, sf):
    """Line items arriving in three batches, by return flag."""
    import uuid

    from longspan.streaming.online_scaler import OnlineScaler

    learner = OnlineScaler(spark, f"parts-{uuid.uuid4().hex}")
    lines = Clinical(spark, sf)._table("lineitem")
    for flag in ("A", "N", "R"):
        learner.update(lines.filter(F.col("l_returnflag") == flag).select(
            F.col("l_partkey").alias("label"), ((F.col("l_extendedprice") - 25000) / 1000).alias("value")))
    return _shown(learner.stats)


@R.query("keyed_stats_a26_m8", f"""WITH vals AS (SELECT l_suppkey AS label, l_extendedprice / 1000 - 25 AS value FROM lineitem),
s AS ({_stats_sql('vals')}), x AS (
    SELECT label, count, mean, greatest(variance, 1e-5) AS variance, negative, minval, maxval FROM s) {_stats_out('x')}""")
def keyed_stats(spark, sf):
    """Line items of each supplier as a stream; the statistics are read back from its checkpoint."""
    import uuid

    from longspan.session import checkpoint_dir
    from longspan.streaming import keyed_stats as K

    own = spark.newSession()  # its state store setting stays here
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    K.use_keyed_state(own)
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf}/lineitem.parquet"
    # A stream's path must be a folder or a pattern; this pattern matches the one table, be it file or folder.
    lines = own.readStream.schema(own.read.parquet(path).schema).parquet(f"{sf}/lineitem.parque[t]")
    K.running_stats(lines.select(
        F.col("l_suppkey").alias("label"), (F.col("l_extendedprice") / 1000 - 25).alias("value"),
    )).writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(
        availableNow=True).start().awaitTermination()
    return _shown(K.kept_stats(own, folder))


@R.query("wide_and_back_s12", """SELECT l_orderkey, l_linenumber, label, value FROM (
    UNPIVOT (SELECT l_orderkey, l_linenumber, max(l_quantity) AS quantity, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2)
    ON quantity, tax INTO NAME label VALUE value)""")
def wide_and_back(spark, sf):
    rows = Clinical(spark, sf)._table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("quantity"), F.max("l_tax").alias("tax"))
    keyed = rows.withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    back = T.long_to_wide(T.wide_to_long(keyed.select("key", "quantity", "tax"), "key", ["quantity", "tax"]),
                          "key", ["quantity", "tax"])
    return T.wide_to_long(back, "key", ["quantity", "tax"]).select("key.*", "label", "value")
