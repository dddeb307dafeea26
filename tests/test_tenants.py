import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.operators import tenants
from vitalspan.session import scratch_path
from vitalspan.sources import tenant_files


def test_naming_rules_are_case_sensitive(spark):
    names = ["a_b", "_x", "x_old", "demo1", "Postgres", "ok", "postgres", "my_sandbox", "portalx", "x_candidate"]
    df = spark.createDataFrame([("01", n) for n in names], "server string, db string")
    done = spark.createDataFrame([("a",)], "client string")
    assert rows(tenants.pending_tenants(df, done), "db") == [("Postgres",), ("a_b",), ("ok",)]
    assert rows(tenants.pending_tenants(df, spark.createDataFrame([("a_b",)], "client string")), "db") == [
        ("Postgres",),
        ("ok",),
    ]


def account_frames(spark, keys, values):
    clients = spark.createDataFrame([("c",), ("d",)], "client string")
    definitions = spark.createDataFrame([("c", i, k) for i, k in enumerate(keys)], "client string, definition_id long, key string")
    entries = spark.createDataFrame([("c", i, v) for i, v in values], "client string, definition_id long, value string")
    return clients, definitions, entries


def test_account_lookup(spark):
    found = tenants.tenant_accounts(*account_frames(spark, ["Salesforce.Account-Number", "other"], [(0, "{7}"), (1, "x")]))
    assert rows(found, "client", "sf_an") == [("c", "7"), ("d", "none")]
    braced = tenants.tenant_accounts(*account_frames(spark, ["salesforceXaccount_number"], [(0, "{7}")]), strip=False)
    assert rows(braced, "client", "sf_an") == [("c", "none"), ("d", "none")]
    kept = tenants.tenant_accounts(*account_frames(spark, ["salesforce.account_number"], [(0, "{7}")]), strip=False)
    assert rows(kept, "client", "sf_an")[0] == ("c", "{7}")
    unset = tenants.tenant_accounts(*account_frames(spark, ["salesforce.account_number"], [(5, "x")]))
    assert rows(unset, "client", "sf_an")[0] == ("c", "none")


def test_two_settings_are_an_error(spark):
    frames = account_frames(spark, ["salesforce.account_number", "SALESFORCE.ACCOUNT_NUMBER"], [(0, "1"), (1, "2")])
    with pytest.raises(Exception, match="more than one account setting"):
        tenants.tenant_accounts(*frames).collect()


def test_extract_is_incremental_and_replaces_whole_tenants(spark):
    path = scratch_path(spark, "csv")
    first = spark.createDataFrame([("a_b", 1, "x"), ("a_b", 2, None), ("c", 3, 'q "t", u')], "client string, n int, t string")
    tenant_files.write_tenant_csv(first, path)
    tenant_files.write_tenant_csv(spark.createDataFrame([("c", 9, "z")], first.schema), path)
    schema = T.StructType.fromDDL("n int, t string")
    found = tenant_files.read_tenant_csv(spark, path, schema)
    assert rows(found, "client", "n", "t") == [("a_b", 1, "x"), ("a_b", 2, None), ("c", 9, "z")]
    assert rows(tenant_files.finished_tenants(spark, path), "client") == [("a_b",), ("c",)]
    asked = spark.createDataFrame([("a_b",), ("c",), ("gone",)], "client string")
    assert rows(tenants.row_ledger(asked, found), "client", "row_count") == [("a_b", 2), ("c", 1), ("gone", 0)]


def test_gathering_matches_columns_by_name(spark):
    one = spark.createDataFrame([(1, "x")], "n int, t string")
    two = spark.createDataFrame([("y",)], "t string")
    found = tenant_files.gather_tenants({"a": one, "b": two})
    assert found.columns == ["client", "n", "t"]
    assert rows(found, "client", "n", "t") == [("a", 1, "x"), ("b", None, "y")]
    left, right = scratch_path(spark, "l"), scratch_path(spark, "r")
    tenant_files.write_tenant_csv(one.withColumn("client", F.lit("a")), left)
    tenant_files.write_tenant_csv(two.withColumn("client", F.lit("b")), right)
    both = tenant_files.combine_csv(
        spark, [left, right], [T.StructType.fromDDL("n int, t string"), T.StructType.fromDDL("t string")]
    )
    assert rows(both, "client", "n", "t") == [("a", 1, "x"), ("b", None, "y")]
