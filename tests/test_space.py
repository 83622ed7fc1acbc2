import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.operators import asof as A
from longspan.operators import running as N
from longspan.operators import space as S

T0 = dt.datetime(2021, 3, 1)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1024, 5000])
def test_permutation_is_a_bijection(spark, size):
    image = [r[0] for r in spark.range(size).select(S.permuted(F.col("id"), size, 3)).collect()]
    assert sorted(image) == list(range(size))


def _space(spark):
    rows = [(p, T0 + dt.timedelta(seconds=7 * p), T0 + dt.timedelta(seconds=7 * p + 3 + p % 5), 1)
            for p in range(40)]
    return spark.createDataFrame(rows, "person_id long, start timestamp_ntz, stop timestamp_ntz, datapoints long"), rows


def test_sampling_everything_returns_every_point_once(spark):
    space, rows = _space(spark)
    total = sum((stop - start).seconds for _, start, stop, _ in rows)
    found = S.sample_uniform(space, total, seed=9).collect()
    wanted = {(p, start + dt.timedelta(seconds=i)) for p, start, stop, _ in rows
              for i in range((stop - start).seconds)}
    assert len(found) == total and {(r.person_id, r.datetime) for r in found} == wanted
    with pytest.raises(ValueError):
        S.sample_uniform(space, total + 1)


def test_sampling_is_seeded_distinct_and_inside(spark):
    space, rows = _space(spark)
    one, two, other = (sorted(map(tuple, S.sample_uniform(space, 60, s).collect())) for s in (1, 1, 2))
    assert one == two != other and len(set(one)) == 60
    bounds = {p: (a, b) for p, a, b, _ in rows}
    assert all(bounds[p][0] <= at < bounds[p][1] for p, at in one)


def test_sampling_is_even_over_a_hot_person(spark):
    rows = [(0, T0, T0 + dt.timedelta(days=300), 1)] + [
        (p, T0, T0 + dt.timedelta(days=2), 1) for p in range(1, 301)]
    space = spark.createDataFrame(rows, "person_id long, start timestamp_ntz, stop timestamp_ntz, datapoints long")
    found = S.sample_uniform(S.by_day(space), 450, seed=4)
    hot = found.filter("person_id = 0").count()
    assert found.count() == 450 and 110 < hot < 190  # a third of the days is 150


def test_range_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 30, 50)
    lengths[10] = 600
    lo = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ranges = spark.createDataFrame([(int(a), int(a + n), i) for i, (a, n) in enumerate(zip(lo, lengths))],
                                   "lo long, hi long, person_id long")
    total = int(lengths.sum())
    points = [int(x) for x in rng.integers(0, total, 300)]
    found = S.locate(spark.createDataFrame([(p,) for p in points], "rank long"), ranges, total, 350)
    wanted = sorted((p, int(np.searchsorted(lo, p, side="right") - 1)) for p in points)
    assert sorted((r["rank"], r.person_id) for r in found.collect()) == wanted


def test_running_total_over_many_buckets(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 100, 500)
    df = spark.createDataFrame([(i, float(i), int(v)) for i, v in enumerate(values)], "k long, x double, v long")
    placed = N.range_bucket(df, ["x"], partitions=7)
    assert placed.select("bucket").distinct().count() == 7
    found = N.running_total(placed, "bucket", ["k"], {"before": "v"}).orderBy("k").collect()
    assert [r.before for r in found] == [int(x) for x in np.concatenate([[0], np.cumsum(values)[:-1]])]


def test_visits_work_as_a_space_with_repeated_persons(spark):
    rows = [(1, T0, T0 + dt.timedelta(seconds=4)), (1, T0 + dt.timedelta(seconds=10), T0 + dt.timedelta(seconds=13)),
            (2, T0, T0 + dt.timedelta(seconds=2))]
    space = spark.createDataFrame(rows, "person_id long, start timestamp_ntz, stop timestamp_ntz")
    found = {(r.person_id, r.datetime) for r in S.sample_uniform(space, 9).collect()}
    assert len(found) == 9


def test_asof_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    events = sorted({(int(rng.integers(0, 3)), int(rng.integers(0, 4)),
                      T0 + dt.timedelta(hours=int(rng.integers(0, 200)))) for _ in range(150)})
    events = [(p, c, at, float(i)) for i, (p, c, at) in enumerate(events)]
    targets = sorted({(int(rng.integers(0, 4)), T0 + dt.timedelta(hours=int(rng.integers(-10, 220)))) for _ in range(60)})
    ehr = spark.createDataFrame(events, "person_id long, concept_id long, datetime timestamp_ntz, value double")
    index = spark.createDataFrame(targets, "person_id long, datetime timestamp_ntz")
    wanted = set()
    for p, t in targets:
        for c in range(4):
            past = [(at, v) for q, k, at, v in events if q == p and k == c and at <= t]
            if past:
                wanted.add((p, t, c, *max(past)))
    assert {tuple(r) for r in A.latest_per_concept(index, ehr).collect()} == wanted


def test_empty_index_gives_no_rows(spark):
    ehr = spark.createDataFrame([(1, 1, T0, 1.0)], "person_id long, concept_id long, datetime timestamp_ntz, value double")
    index = spark.createDataFrame([], "person_id long, datetime timestamp_ntz")
    meta = spark.createDataFrame([(1, "Condition")], "concept_id long, data_mode string")
    assert A.recency_features(index, ehr, meta).count() == 0
    assert S.fit_index_into_space(index, S.sample_space(ehr)).count() == 0


def test_ranks_of_text_and_null_keys_with_one_large_key(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", None if i % 11 == 0 else f"{int(rng.integers(0, 40))}", i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v string, id long")
    found = N.ranked(df, ["v", "id"], ("k",), partitions=9)
    assert found.columns == ["k", "v", "id", "rank"]
    wanted = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        wanted.update({r[2]: i for i, r in enumerate(mine, 1)})
    assert {r["id"]: r["rank"] for r in found.collect()} == wanted
    placed = N.range_bucket(df, ["k", "v", "id"], partitions=9)
    assert placed.where("k = 'hot'").select("bucket").distinct().count() > 3


@pytest.mark.parametrize("partitions", [1, 8])
def test_carried_values_of_one_large_sequence(spark, partitions):
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 3 else ["a", None][i % 2], float(at), None if rng.random() < 0.8 else i)
            for i, at in enumerate(rng.permutation(900))]
    rows += [("alone", 1.0, None), ("alone", 2.0, None)]
    df = spark.createDataFrame(rows, "k string, at double, v long")
    found = N.carried(df, ("k",), ["at"], "v", partitions=partitions).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        got = sorted((r for r in found if r.k == key), key=lambda r: r["at"])
        assert len(got) == len(mine)
        for i, r in enumerate(got):
            before = [v for _, _, v in mine[:i + 1] if v is not None]
            after = [v for _, _, v in mine[i:] if v is not None]
            assert r.previous == (before[-1] if before else None) and r.following == (after[0] if after else None)


def test_points_of_sequences_are_made_in_many_tasks(spark):
    from longspan.operators.asof import linspace

    ends = spark.createDataFrame([(k, float(v)) for k in range(40) for v in (0, 9)], "k int, at double")
    points = linspace(ends, "k", "at", 10).withColumn("task", F.spark_partition_id())
    assert points.select("task").distinct().count() > 1
    assert sorted((r.k, r.at) for r in points.collect()) == [(k, float(v)) for k in range(40) for v in range(10)]
