"""Curves against direct numpy computations on small random histories."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import curves as U
from longspan.operators import projection as P

DAY0 = dt.datetime(2020, 1, 1)
MODES = [(1, "Condition"), (2, "Measurement"), (3, "Medication"), (4, "Medication")]


def history(seed, persons=4, days=60, events=70, midnight=0.5):
    rng = np.random.default_rng(seed)
    rows = set()
    for person in range(persons):
        for _ in range(events):
            concept = int(rng.integers(1, 5))
            at = DAY0 + dt.timedelta(days=int(rng.integers(0, days)))
            if rng.random() > midnight:
                at += dt.timedelta(seconds=int(rng.integers(1, 86400)))
            value = float(np.round(rng.normal(5, 2), 3)) if concept == 2 else None
            rows.add((person, concept, at, value))
    return sorted(rows, key=lambda r: r[:3])


def frames(spark, rows):
    ehr = spark.createDataFrame(
        rows, "person_id long, concept_id long, datetime timestamp_ntz, value double")
    return ehr, spark.createDataFrame(MODES, "concept_id long, data_mode string")


def pchip(x, y, grid):
    """Fritsch-Carlson interpolation written from the textbook formulas."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    h, m = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(len(x))
    if len(x) == 2:
        d[:] = m[0]
    else:
        for k in range(1, len(x) - 1):
            if m[k - 1] * m[k] > 0:
                a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                d[k] = (a + b) / (a / m[k - 1] + b / m[k])

        def end(h0, h1, m0, m1):
            e = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
            if np.sign(e) != np.sign(m0):
                return 0.0
            return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(e) > 3 * abs(m0) else e

        d[0], d[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
    out = []
    for g in grid:
        k = min(max(np.searchsorted(x, g, side="right") - 1, 0), len(x) - 2)
        t = (g - x[k]) / h[k]
        out.append((1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * d[k]
                   + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * d[k + 1])
    return np.array(out)


def trailing(curve, window):
    if window is None:
        return curve
    return np.array([curve[max(0, i - window + 1):i + 1].mean() for i in range(len(curve))])


def intensity(days, length, m):
    if len(days) < 2 * m:
        return np.full(length, len(days) / length)
    unique, counts = np.unique(days, return_counts=True)
    upto = np.cumsum(counts)

    def when(mass):
        k = int(np.searchsorted(upto, mass))
        return unique[k] - 0.5 + (mass - (upto[k] - counts[k])) / counts[k]

    total = np.zeros(length)
    for s in range(m):
        levels = [l for l in range(s + m, len(days) - m + 1, m)]
        t = np.array([-0.5] + [when(l) for l in levels] + [length - 0.5])
        mass = np.array([0] + levels + [len(days)], float)
        cumulative = np.interp(np.arange(length + 1) - 0.5, t, mass)
        total += np.diff(cumulative)
    return total / m


def expected(rows, window, m=10):
    out = {}
    for person in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == person]
        all_days = [(r[2] - DAY0).days for r in own]
        lo, length = min(all_days), max(all_days) - min(all_days) + 1
        meds = sorted({(r[2] - DAY0).days - lo for r in own if r[1] in (3, 4)})
        for concept, mode in MODES:
            part = sorted([r for r in own if r[1] == concept], key=lambda r: (r[2], r[3] or 0))
            if not part:
                continue
            days = [(r[2] - DAY0).days - lo for r in part]
            if mode == "Condition":
                curve = intensity(np.array(days), length, m)
                curve = trailing(curve, window) if len(days) >= 2 * m else curve
            elif mode == "Measurement":
                last = dict(zip(days, [r[3] for r in part]))
                x, y = list(last), list(last.values())
                if len(x) == 1:
                    curve = np.full(length, y[0])
                else:
                    if x[0] > 0:
                        x, y = [0] + x, [y[0]] + y
                    if x[-1] < length - 1:
                        x, y = x + [length - 1], y + [y[-1]]
                    curve = trailing(pchip(x, y, range(length)), window)
            else:
                marks = np.isin(meds, days).astype(float)
                curve = np.rint(np.interp(range(length), meds, marks) + 1e-12)
                for day in days:
                    curve[day + 1:day + 1 + (window or 0)] = 1
            for i, v in enumerate(curve):
                out[person, concept, (DAY0 + dt.timedelta(days=lo + i)).date()] = v
    return out


def collected(curves):
    return {(r.person_id, r.concept_id, r.day): r.value for r in curves.collect()}


def assert_same(found, wanted):
    assert found.keys() == wanted.keys()
    for key, value in wanted.items():
        assert found[key] == pytest.approx(value, abs=1e-8), key


@pytest.mark.parametrize("seed,window,m", [(0, None, 10), (1, 7, 3), (2, 365, 2)])
def test_curves_match_direct_computation(spark, seed, window, m):
    rows = history(seed)
    ehr, meta = frames(spark, rows)
    options = U.CurveOptions.windowed(window, min_count=m, iterations=10 * m)
    assert_same(collected(U.build_curves(ehr, meta, options=options)), expected(rows, window, m))


def test_intensity_keeps_the_number_of_events(spark):
    rows = [(0, 1, DAY0 + dt.timedelta(days=int(d), seconds=i), None)
            for i, d in enumerate(np.random.default_rng(5).integers(0, 90, 400))]
    ehr, meta = frames(spark, rows)
    curve = U.build_curves(ehr, meta, options=U.CurveOptions.windowed(None))
    total, least = curve.agg(F.sum("value"), F.min("value")).first()
    assert total == pytest.approx(400) and least >= 0


def test_unknown_mode_and_concept_have_no_curve(spark):
    rows = [(0, 9, DAY0, None), (0, 2, DAY0 + dt.timedelta(days=1), 1.0)]
    ehr, _ = frames(spark, rows)
    meta = spark.createDataFrame([(9, "Procedure"), (2, "Measurement")], "concept_id long, data_mode string")
    found = collected(U.build_curves(ehr, meta))
    assert {k[1] for k in found} == {2} and len(found) == 2 and set(found.values()) == {1.0}


def test_bounds_drop_events_after_midnight_of_the_last_day(spark):
    rows = [(0, 2, DAY0, 1.0), (0, 2, DAY0 + dt.timedelta(days=4, hours=3), 9.0)]
    ehr, meta = frames(spark, rows)
    bounds = spark.createDataFrame([(0, DAY0.date(), (DAY0 + dt.timedelta(days=4)).date())],
                                   "person_id long, start date, until date")
    found = collected(U.build_curves(ehr, meta, bounds))
    assert len(found) == 5 and set(found.values()) == {1.0}


@pytest.mark.parametrize("window,m,med_dates", [(None, 10, True), (5, 3, True), (11, 2, False)])
def test_projection_equals_rebuilding_each_history(spark, window, m, med_dates):
    """Each sample as a person of its own, rebuilt from its own history."""
    rows = history(7, persons=3, days=50, events=90)
    ehr, meta = frames(spark, rows)
    samples = [(p, DAY0 + dt.timedelta(days=d)) for p in range(3) for d in (-1, 0, 1, 2, 9, 20, 33, 49, 55, 80)]
    index = spark.createDataFrame(samples, "person_id long, datetime timestamp_ntz")
    options = U.CurveOptions.windowed(window, min_count=m, iterations=10 * m, med_dates=med_dates)
    found = collected(P.project_points(index, ehr, meta, options))

    first = {p: min(r[2] for r in rows if r[0] == p) for p in range(3)}
    hits = [(i, p, at) for i, (p, at) in enumerate(samples) if at > first[p]]
    copies = [(i, r[1], r[2], r[3]) for i, p, at in hits for r in rows if r[0] == p and r[2] <= at]
    ehr2, _ = frames(spark, copies)
    bounds = spark.createDataFrame([(i, first[p].date(), at.date()) for i, p, at in hits],
                                   "person_id long, start date, until date")
    rebuilt = collected(U.build_curves(ehr2, meta, bounds, options))
    wanted = {(p, c, at.date()): rebuilt[i, c, at.date()] for i, p, at in hits
              for c, _ in MODES if (i, c, at.date()) in rebuilt}
    assert_same(found, wanted)
    misses = {(r.person_id, r.day) for r in P.projection_misses(index, ehr).collect()}
    assert misses == {(p, at.date()) for p, at in samples if at <= first[p]}


def test_compressed_curves_keep_dense_values_in_order(spark):
    curves = spark.createDataFrame(
        [(0, 1, (DAY0 + dt.timedelta(days=i)).date(), 2.0 + 1e-9 * i) for i in range(5)]
        + [(0, 2, (DAY0 + dt.timedelta(days=i)).date(), float(i)) for i in range(5)],
        "person_id long, concept_id long, day date, value double")
    found = {r.concept_id: r for r in U.compressed_curves(curves).collect()}
    assert found[1].is_constant and found[1].constant == 2.0 and found[1].dense is None
    assert not found[2].is_constant and found[2].dense == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_hot_person_gives_the_same_curves(spark):
    """A person with a third of all events, mostly on one day."""
    rows = history(11, persons=3, events=40)
    hot = [(0, 1, DAY0 + dt.timedelta(days=30, seconds=s), None) for s in range(5000)]
    ehr, meta = frames(spark, rows + hot)
    found = collected(U.build_curves(ehr, meta, options=U.CurveOptions.windowed(None)))
    assert_same(found, expected(sorted(rows + hot, key=lambda r: r[:3]), None))


def test_one_sided_bounds_are_open(spark):
    from longspan.operators.curves import CURVE, clip_daily

    rows = [("p", "c", d) for d in range(1, 6)]
    daily = spark.createDataFrame(rows, "person_id string, concept_id string, d int").selectExpr(
        *[c if c in ("person_id", "concept_id") else f"CAST(NULL AS string) AS {c}" for c in CURVE],
        "date_add(DATE'2020-01-01', d) AS day", "1L AS n", "1.0D AS value", "1L AS n0", "1.0D AS value0")
    for start, until, left in (("2020-01-03", None, 4), (None, "2020-01-03", 2), (None, None, 5)):
        bounds = spark.createDataFrame([("p", start, until)], "person_id string, start string, until string").selectExpr(
            "person_id", "CAST(start AS date) AS start", "CAST(until AS date) AS until")
        assert clip_daily(daily, bounds).count() == left
