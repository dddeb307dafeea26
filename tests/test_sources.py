"""Gathering by header, resumed runs and swapped tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.session import scratch_path
from vitalspan.sources import tables, tenant_files

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("note", T.StringType())])


def write(spark, path, client, columns, made):
    df = spark.createDataFrame([(client, *r) for r in made], f"client string, {columns}")
    tenant_files.write_tenant_csv(df, path)


def test_columns_are_taken_by_name(spark):
    path = scratch_path(spark, "csv")
    write(spark, path, "a", "event_id long, k int, note string", [(1, 10, "x"), (2, 20, None)])
    write(spark, path, "b [1] c", "k int, event_id long", [(2, 20)])
    write(spark, path, "d%e", "more string, note string, event_id long", [("m", 'q, "r"', 7)])
    got = rows(tenant_files.read_tenant_csv(spark, path, SCHEMA), "client", "event_id", "k", "note")
    assert got == sorted([("a", 1, 10, "x"), ("a", 2, 20, None), ("b [1] c", 20, 2, None), ("d%e", 7, None, 'q, "r"')], key=str)
    unknown = tenant_files.unknown_columns(spark, path, SCHEMA).collect()
    assert [r["column"] for r in unknown] == ["more"] and "client=d" in unknown[0]["file"]


def test_a_header_is_read_from_the_first_block_only(spark):
    path = scratch_path(spark, "csv")
    write(spark, path, "a", "k int, event_id long", [(i, i + 1) for i in range(500)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert [r["header"] for r in tenant_files.csv_headers(spark, path).collect()] == ["k,event_id"] * tenant_files.csv_headers(spark, path).count()
        got = tenant_files.read_tenant_csv(spark, path, SCHEMA).agg(F.sum("k"), F.sum("event_id")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tuple(got) == (sum(range(500)), sum(range(1, 501)))


def test_a_failed_batch_is_taken_again(spark):
    path = scratch_path(spark, "runs")
    clients = spark.createDataFrame([(f"c{i}",) for i in range(12)], "client string")
    data = spark.createDataFrame([(f"c{i % 11}", i, 1, "n") for i in range(50)], "client string, event_id long, k int, note string")
    asked, broken = [], [True]

    def extract(some):
        names = {r[0] for r in some.collect()}
        asked.append(names)
        if "c3" in names and broken:
            broken.clear()
            raise ConnectionError("no answer")
        return data.join(some, "client", "left_semi")

    first = tenant_files.run_tenants(clients, extract, path, batches=3)
    failed = {r["client"] for r in first.where("failure IS NOT NULL").collect()}
    assert "c3" in failed and first.count() == 12 and first.where("failure IS NOT NULL").agg(F.sum("row_count")).first()[0] == 0
    # What a run that was cut short has left is not read.
    tenant_files.write_tenant_csv(data.where("client = 'c3'"), f"{path}/cut-short")
    assert {r[0] for r in tenant_files.read_committed(spark, path, SCHEMA).select("client").distinct().collect()}.isdisjoint(failed)
    asked.clear()
    second = tenant_files.run_tenants(clients, extract, path, batches=3)
    assert {r["client"] for r in second.collect()} == failed == set().union(*asked)
    assert tenant_files.run_tenants(clients, extract, path, batches=3).collect() == []
    assert rows(tenant_files.read_committed(spark, path, SCHEMA), "client", "event_id") == rows(data, "client", "event_id")
    ledger = {r["client"]: r["row_count"] for r in tenant_files.read_ledger(spark, path).where("failure IS NULL").collect()}
    assert ledger == {f"c{i}": sum(j % 11 == i for j in range(50)) for i in range(12)}


def test_a_table_is_replaced_from_itself_or_left_alone(spark):
    name = "t_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    tables.materialize(spark.range(10), name)
    reader = spark.table(name)
    tables.materialize(spark.table(name).where("id >= 4"), name)
    assert spark.table(name).count() == 6
    assert reader.count() in (6, 10)

    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.materialize(broken, name)
    assert spark.table(name).count() == 6
    tables.materialize(spark.range(3).select(F.col("id").alias("other")), name)
    assert spark.table(name).columns == ["other"]
    spark.sql(f"DROP TABLE {name}")


def test_an_ordered_set_has_every_row_in_its_place(spark):
    made = [(None if i % 7 == 0 else f"t{i % 5}", i % 3, i) for i in range(200)] + [("t1", 1, 500)] * 3
    df = spark.createDataFrame(made, "title string, month int, n int")
    path = scratch_path(spark, "ordered")
    manifest = tables.write_ordered(df, path, ["title", "month"], parts=6).orderBy("part").collect()
    assert sum(r["size"] for r in manifest) == len(made) and len(manifest) > 2
    got = sorted((r["place"], r["title"], r["month"], r["n"]) for r in tables.read_ordered(spark, path).collect())
    want = sorted(made, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))
    assert got == [(k + 1, *r) for k, r in enumerate(want)]
    tables.write_ordered(df.limit(0), path, ["title"])
    assert tables.read_ordered(spark, path).collect() == []
