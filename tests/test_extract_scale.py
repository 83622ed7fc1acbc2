import datetime as dt

from pyspark.sql import functions as F

from longspan import session
from longspan.operators import extract as X
from longspan.plans import extraction
from longspan.plans.extraction import TABLES, Extraction, Older


def test_events_are_not_dealt_by_a_few_concepts(spark, tmp_path):
    """Concepts found among the events are few, whatever the size of the table they come from."""
    folder = str(tmp_path / "events")
    spark.range(20_000).select(
        (F.col("id") % 500).alias("person_id"), (F.col("id") % 3).alias("procedure_concept_id"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id % 50 as int))").alias("procedure_datetime"),
    ).withColumn("procedure_date", F.col("procedure_datetime").cast("date")).write.parquet(folder)
    occurrence = spark.read.parquet(folder)
    concept = occurrence.select(F.col("procedure_concept_id").alias("concept_id")).distinct().where("concept_id < 2").withColumns(
        {"domain_id": F.lit("Procedure"), "vocabulary_id": F.lit("CPT4")})
    person = spark.range(400).select(
        F.col("id").alias("person_id"), F.lit(dt.datetime(1950, 1, 1)).cast("timestamp_ntz").alias("birth_datetime"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        found = X.procedures(person, occurrence, concept, daily=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(procedure_concept_id" not in plan
    start = dt.date(2020, 1, 1)
    assert got == {(i % 500, i % 3, start + dt.timedelta(days=i % 50)) for i in range(20_000) if i % 3 < 2 and i % 500 < 400}


def test_data_tables_share_one_join_of_items_and_orders(spark, tmp_path):
    """After the data tables no table reads line items with their orders again, and the rows are those of the separate joins."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 9)
    put("region", [(0, "R")], "r_regionkey int, r_name string")
    put("nation", [(i, f"N{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(100 + i, f"C{i}", i % 3, 1.0, "BUILDING") for i in range(8)],
        "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("part", [(i, f"P{i}", f"Brand#{12 + i % 3}", "PROMO", 1, 1.0) for i in range(6)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    orders = [(i, 100 + i % 9, "F", 1.0, day(i), "1-URGENT") for i in range(30)] + [(None, 101, "F", 1.0, day(1), None), (3, 102, "O", 1.0, None, "5-LOW")]
    put("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    items = [(i % 32, i % 7, 1, i % 4, float(i % 11), 9.0, 0.05, 0.05, "ANR"[i % 3], "O", day(i)) for i in range(200)]
    items += [(None, 1, 1, 2, 8.0, 9.0, 0.05, 0.05, "A", "O", day(2)), (4, None, 1, 2, None, 9.0, 0.05, 0.05, None, None, None)]
    put("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    shared, apart = Extraction(spark, str(tmp_path)), Extraction(spark, str(tmp_path))
    data = shared.data
    for df in (shared.measurement, shared.drug_exposure, shared.procedure_occurrence):
        assert not [f for f in df.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]
    wanted = {"conditions_daily": apart.conditions(True), "measurements_daily": apart.measurements(True),
              "medications_daily": apart.medications(True), "procedures": apart.procedures(False)}
    for name, df in wanted.items():
        same = lambda rows: sorted(map(str, rows.collect()))
        assert same(data[name]) == same(df) != []


def _many_items(spark, folder, n):
    """Shop tables with ``n`` line items of many persons and days."""
    def put(name, df):
        df.write.parquet(f"{folder}/{name}.parquet")

    ids = lambda m: spark.range(0, m, 1, 2)
    day = lambda k: F.expr(f"timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id % {k} as int))")
    put("region", ids(1).select(F.col("id").cast("int").alias("r_regionkey"), F.lit("R").alias("r_name")))
    put("nation", ids(3).select(F.col("id").cast("int").alias("n_nationkey"), F.lit("N").alias("n_name"), F.lit(0).alias("n_regionkey")))
    put("customer", ids(900).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"), (F.col("id") % 3).cast("int").alias("c_nationkey"),
                                    F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")))
    put("part", ids(40).select(F.col("id").alias("p_partkey"), F.lit("P").alias("p_name"), F.concat(F.lit("Brand#"), 12 + F.col("id") % 3).alias("p_brand"),
                               F.lit("PROMO").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")))
    put("orders", ids(n // 4).select(F.col("id").alias("o_orderkey"), (F.col("id") % 1000).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
                                     F.lit(1.0).alias("o_totalprice"), day(300).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")))
    put("lineitem", ids(n).select(
        (F.col("id") % (n // 4)).alias("l_orderkey"), (F.col("id") % 40).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit(9.0).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"), F.lit(0.05).alias("l_tax"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        day(997).alias("l_shipdate")))


def test_tasks_of_data_tables_and_counts_do_not_grow(spark, tmp_path, monkeypatch):
    """More rows make more tasks, not larger ones, and what is returned aggregates no data table any more."""
    _many_items(spark, tmp_path, 12_000)
    monkeypatch.setattr(session, "TASK_ROWS", 1_000, raising=False)
    monkeypatch.setattr(session, "TASK_BYTES", dict.fromkeys(getattr(session, "TASK_BYTES", {}), "8k"), raising=False)
    conf = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.minPartitionSize", *session.TASK_BYTES)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        x = Extraction(spark, str(tmp_path))
        files = {name: len(df.inputFiles()) for name, df in x.data.items()}
        assert min(files["measurements_daily"], files["procedures"]) > 8  # the fixture's shuffles have 4 parts
        for made in (x, Older(spark, str(tmp_path))):
            for df in (*made.counts.values(), made.cohort):
                assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in conf.items():
            assert k not in session.TASK_BYTES or spark.conf.get(k, None) == v
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    plain = Extraction(spark, str(tmp_path))
    same = lambda rows: sorted(map(str, rows.collect()))
    assert same(x.data["procedures"]) == same(plain.procedures(False)) != []


def test_selected_data_is_dealt_before_it_is_made_distinct(spark, tmp_path, monkeypatch):
    """No scan of the data tables aggregates; the rows are those without dealing."""
    _many_items(spark, tmp_path, 4_000)
    monkeypatch.setattr(extraction.V, "MINIMUM", 5)
    x = Extraction(spark, str(tmp_path))
    assert x.parts is None
    apart = X.select_data(x.data, x.concepts, x.cohort, TABLES)
    for date_convert in (False, True):
        dealt = X.select_data(x.data, x.concepts, x.cohort, TABLES, date_convert, parts=5)
        plan = dealt._jdf.queryExecution().sparkPlan().toString()
        assert plan.rindex("Aggregate") < plan.index("hashpartitioning") and "5" in plan[plan.index("hashpartitioning"):].split(")")[0]
        rows = dealt.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
        assert sorted(map(str, rows.collect())) == sorted(map(str, apart.collect())) != []
