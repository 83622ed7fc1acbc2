import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan import schema as C
from longspan.sources import arrays as A
from longspan.sources import statements as Q
from longspan.sources import tables as B
from longspan.streaming.online_scaler import OnlineScaler

T0 = dt.datetime(2022, 5, 1, 3, 4, 5, 600000)


def test_statements_keep_quotes_and_the_tail():
    script = """
    -- a comment; with a semicolon
    CREATE TABLE a AS SELECT ';' AS x, '--no' AS y; -- tail
    SELECT "b;c" /* in; here */ FROM `d;e`;

    SELECT 1
    """
    assert Q.split_statements(script) == (
        "CREATE TABLE a AS SELECT ';' AS x, '--no' AS y",
        'SELECT "b;c"   FROM `d;e`',
        "SELECT 1",
    )
    assert Q.split_statements(["SELECT 1;", "SELECT 'it''s;'"]) == ("SELECT 1", "SELECT 'it''s;'")
    assert Q.split_statements(" -- nothing\n;;") == ()


def test_scripts_and_selects(spark, tmp_path):
    assert Q.run_scripts(spark, "CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS a; "
                                "CREATE OR REPLACE TEMP VIEW v2 AS SELECT a + 1 AS b FROM v1") == 2
    assert Q.select_rows(spark, "SELECT * FROM v2") == (("b",), [("b",), (2,)])
    assert Q.select_arrow(spark, "SELECT * FROM v2").to_pydict() == {"b": [2]}
    assert Q.select_arrow(spark, "SELECT * FROM v2", str(tmp_path / "p")).first()["b"] == 2
    assert Q.table_name("concepts", "x") == "x_concepts" and Q.table_name("concepts") == "concepts"


def test_conform_coerces_orders_and_complains(spark):
    df = spark.createDataFrame([(1.0, "7", T0, float("nan")), (2.0, "8", T0, 1.5)],
                               "person_id double, measurement_concept_id string, date timestamp_ntz, value double")
    got = C.conform(df, C.EHR).orderBy("person_id").collect()
    assert tuple(got[0]) == (1, 7, T0.replace(microsecond=0), None) and got[1].value == 1.5
    with pytest.raises(ValueError):
        C.conform(df.drop("value"), C.EHR)


def test_visit_checks_and_row_equality(spark):
    good = spark.createDataFrame([(1, T0, T0)], C.VISITS)
    assert C.require_visits(good) is good
    with pytest.raises(ValueError):
        C.require_visits(spark.createDataFrame([(1, None, T0)], C.VISITS))
    a = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, None), (2, 3.0), (2, 3.0)], "k int, v double")
    assert C.same_rows(a, a.orderBy(F.desc("k"))) and not C.same_rows(a, b)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, T0.replace(microsecond=0), 0.5), (3, 4, T0.replace(microsecond=0), None)], C.EHR)
    B.write_clustered(df, str(tmp_path / "ehr"), "person_id", "concept_id")
    assert C.same_rows(B.read_conformed(spark, str(tmp_path / "ehr"), C.EHR), df)
    assert B.peek(spark, str(tmp_path / "ehr")).names == C.EHR.names
    numbers = df.select("person_id", "concept_id")
    A.to_npz(numbers, str(tmp_path / "x.npz"))
    assert C.same_rows(A.from_npz(spark, str(tmp_path / "x.npz"), numbers.schema), numbers)
    with pytest.raises(ValueError):
        A.to_npz(numbers, str(tmp_path / "y.npz"), limit=1)
    for name in ("r.pkl", "r.pkl.gz"):
        A.write_records([(1, "a"), (2, "b")], str(tmp_path / name))
        assert list(A.read_records(str(tmp_path / name))) == [(1, "a"), (2, "b")]
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(2, 3))
    assert A.array_header(str(tmp_path / "m.npy"))[0] == (2, 3)
    assert A.load_matrix(spark, str(tmp_path / "m.npy"), transpose=True).count() == 3


def _batch(spark, values):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values], "label long, value double")


def test_online_scaler_learns_holds_and_freezes(spark):
    scaler = OnlineScaler(spark, "t1", fill=0.0)
    rng = np.random.default_rng(0)
    data = rng.normal(3, 2, (4, 25))
    for i, part in enumerate(data):
        scaler.update(_batch(spark, [(0, v) for v in part] + [(1, 5.0)]), i)
    scaler.update(_batch(spark, [(0, 100.0)]), 3)  # a replay does nothing
    stats = {r.label: r for r in scaler.stats.collect()}
    assert stats[0]["count"] == 100
    assert (stats[0].mean, stats[0].variance) == pytest.approx((data.mean(), data.var()))
    assert stats[1].variance == 1e-5
    scaler.frozen = True
    out = {r.label: r.value for r in scaler.forward(_batch(spark, [(0, data.mean()), (1, None)])).collect()}
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == 0.0
    assert {r.label: r["count"] for r in scaler.stats.collect()}[0] == 100


def test_online_scaler_on_a_stream(spark, tmp_path):
    for i in range(3):
        _batch(spark, [(0, i), (0, i + 1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema("label long, value double").option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in")))
    scaler = OnlineScaler(spark, "t2")
    query = scaler.attach(stream, str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = scaler.stats.first()
    assert (got["count"], got["mean"]) == (6, pytest.approx(1.5))


def test_scaler_statistics_of_many_labels_are_written_by_all_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scaler = OnlineScaler(spark, "t3", folder=str(tmp_path))
        scaler.update(_batch(spark, [(k, k) for k in range(200)]), 0)
        scaler.update(_batch(spark, [(k, k + 2) for k in range(200)]), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(scaler.stats.inputFiles()) > 1
    assert {r.label: (r["count"], r["mean"]) for r in scaler.stats.collect()} == {k: (2, k + 1.0) for k in range(200)}
    # A version that an older scaler wrote holds the rows themselves.
    scaler.stats.coalesce(1).write.parquet(scaler._path(2))
    assert OnlineScaler(spark, "t3", folder=str(tmp_path)).stats.count() == 200
