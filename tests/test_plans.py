import re

from catalog import adapters as a
from catalog import queries as q
from conftest import day, rows
from pyspark.sql import functions as F

from vitalspan.ml import neighbours
from vitalspan.operators.features import admin_tenure
from vitalspan.plans import training
from vitalspan.session import scratch_path
from vitalspan.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranking_never_gathers_in_one_task(spark):
    text = plan(q.one_cohort("Student Count")(spark, SF))
    # The one gathered exchange holds partial counts for the scalar row count.
    single = [line for line in text.splitlines() if "SinglePartition" in line]
    assert len(single) <= 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_features_join_by_equality(spark):
    for query in (q.report_usage, q.admin_tenure, q.admin_first_rollover, q.common_assessments, q.tenant_run):
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, query.__name__


def test_training_table_has_no_nested_loops(spark):
    text = plan(q.build_training(spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark):
    path = scratch_path(spark, "log")
    a.tenant_tables(spark, SF).basic_log.withColumn("unused", F.lit(1)).write.parquet(path)
    log = spark.read.parquet(path)
    t = a.tenant_tables(spark, SF)
    owners = t.clients.withColumn("sf_an", F.lit("x"))
    text = plan(admin_tenure(owners, log, t.users, t.user_roles, t.roles, a.AS_OF))
    scans = [s for s in text.splitlines() if "FileScan" in s and "log_time" in s]
    # Edits and logins come from one scan of the log.
    assert len(scans) == 1 and "unused" not in scans[0]
    assert re.search(r"PushedFilters: \[.*LessThan\(log_time", scans[0])


def test_copies_are_limited_before_the_shuffle(spark):
    points = spark.createDataFrame([(1, 0.0, [1.0])], "row_id long, label double, vector array<double>")
    assert "WindowGroupLimit" in plan(neighbours.copies(points, 4))


FEATURE = "client string, sf_an string, month_start date, academic_year int"


def test_duplicate_feature_rows_yield_the_smallest(spark):
    common = spark.createDataFrame(
        [("d", "a", day("2020-01-01"), 2020, 3, 9), ("d", "a", day("2020-01-01"), 2020, 2, 11), ("d", "a", day("2020-02-01"), 2020, 1, 1)],
        FEATURE + ", common_assessment_count long, cumulative_common_assessment_count_per_ay long",
    )
    found = training.first_per_month(common, "cumulative_common_assessment_count_per_ay")
    assert rows(found, "start_date", "cumulative_common_assessment_count_per_ay") == [(day("2020-01-01"), 9), (day("2020-02-01"), 1)]
    reports = spark.createDataFrame(
        [
            ("d", "a", day("2020-01-01"), 2020, 1, "Assessment Matrix Report", 5, 1),
            ("d", "a", day("2020-01-01"), None, 1, "Assessment Matrix Report", 9, 2),
            ("d", "a", day("2020-01-01"), 2020, 2, "Site Assessment Overview", 4, 3),
            ("d", "a", day("2020-01-01"), 2020, 3, "Teacher Assessment Overview", 4, 3),
        ],
        FEATURE + ", jasper_prebuilt_id long, title string, times_accessed long, count_of_distinct_users long",
    )
    found = training.report_columns(reports).first()
    assert (found["matrix_times_accessed"], found["matrix_distinct_users"]) == (5, 1)
    assert (found["site_asmt_ovr_times_accessed"], found["rsp_freq_times_accessed"]) == (4, None)


def test_labelled_rows_drop_gaps_and_both_ends_of_the_spell(spark):
    df = spark.createDataFrame(
        [
            (day("2019-12-31"), 1, True),
            (day("2020-01-01"), 2, True),
            (day("2020-06-01"), 3, False),
            (day("2020-06-02"), 4, False),
            (day("2020-09-01"), None, True),
            (day("2020-09-01"), 5, None),
        ],
        "start_date date, n int, hs_did_change boolean",
    )
    assert rows(training.labelled_rows(df), "n") == [(1,), (2,), (3,), (4,)]
    assert rows(training.labelled_rows(df, ["n"], training.SPELL), "n") == [(1,), (4,)]
    features, label = training.split_features(df)
    assert features.columns == ["start_date", "n"] and label.columns == ["hs_did_change"]


def test_stored_sets_are_replaced(spark):
    path = scratch_path(spark, "set")
    df = spark.createDataFrame([(1, True), (2, None)], "n int, hs_did_change boolean")
    tables.snapshot(df, path)
    assert tables.snapshot(df.where("n = 2").unionByName(df), path).count() == 3
    assert rows(tables.read_labelled(spark, path), "n") == [(1,)]
    assert "IsNotNull(hs_did_change)" in plan(tables.read_labelled(spark, path))


def test_materialized_set_is_recreated(spark):
    df = spark.createDataFrame([(1,)], "n int")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS vs_test LOCATION '{scratch_path(spark, 'db')}'")
    tables.materialize(df, "vs_test.training_set")
    assert tables.materialize(df.union(df), "vs_test.training_set").count() == 2
    spark.sql("DROP DATABASE vs_test CASCADE")


def test_tenant_features_reach_accounts_without_being_spread_over_them(spark):
    common = spark.createDataFrame(
        [("n1", "x", day("2020-01-01"), 2020, 1, 4), ("n2", "x", day("2020-01-01"), 2020, 1, 3), (None, "x", day("2020-01-01"), 2020, 1, 1)],
        FEATURE + ", common_assessment_count long, cumulative_common_assessment_count_per_ay long",
    )
    admins = spark.createDataFrame([("n1", "x", day("2020-02-01"), 7), ("n1", "x", day("2020-02-01"), 5)], "client string, sf_an string, month_start date, sa_tenure_in_days int")
    reports = spark.createDataFrame(
        [("n2", "x", day("2020-01-01"), 2020, 1, "Assessment Matrix Report", 5, 1)],
        FEATURE + ", jasper_prebuilt_id long, title string, times_accessed long, count_of_distinct_users long",
    )
    # An account named twice, one with two tenants, one without any, and no account at all.
    owners = spark.createDataFrame(
        [("1", "db_1", "n1"), ("1", "db_1", "n1"), ("2", "db_2", "n1"), ("2", "db_2", "n2"), ("3", "db_3", None), (None, None, "n1")],
        "sf_an string, atd_database string, client string",
    )
    accounts = [("1", "db_1"), ("1", "db_9"), ("2", "db_2"), ("3", "db_3"), ("4", "db_4"), (None, None)]
    panel = spark.createDataFrame([(s, d, day(m)) for s, d in accounts for m in ("2020-01-01", "2020-02-01")], "sf_an string, atd_database string, start_date date")
    shown = ["sf_an", "atd_database", "start_date", "cumulative_common_assessment_count_per_ay", "sa_tenure_in_days", "matrix_times_accessed"]
    got = training.with_tenant_features(panel, owners, common, admins, reports)
    keys, spread = shown[:3], []
    for df in (common, admins, reports):
        own = owners.withColumnRenamed("atd_database", "db")
        spread.append(df.drop("sf_an").join(own, "client").drop("client").withColumnRenamed("db", "client"))
    want = (
        panel.join(training.first_per_month(spread[0], shown[3]), keys, "left")
        .join(training.first_per_month(spread[1], shown[4]), keys, "left")
        .join(training.report_columns(spread[2]), keys, "left")
    )
    assert rows(got, *shown) == rows(want, *shown)
    assert ("2", "db_2", day("2020-01-01"), 3, None, 5) in rows(got, *shown)


def test_full_training_set_hands_features_on_by_tenant(spark):
    text = plan(q.build_full_training(spark, SF))
    assert "tenants" in text and "CartesianProduct" not in text and "NestedLoop" not in text
