"""Per-tenant extracts as CSV folders, one ``client=`` folder per tenant."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.session import cut_lineage


def gather_tenants(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of separately read tenants under one schema, tagged with ``client`` first."""
    tagged = [df.select(F.lit(client).alias("client"), "*") for client, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_tenant_csv(rows: DataFrame, path: str) -> None:
    """Write with headers, replacing only the folders of the tenants present.

    Rebalancing keeps small tenants to one file and splits a large one over several tasks.
    """
    (
        rows.hint("rebalance", F.col("client"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("client")
        .csv(path)
    )


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header) of every CSV file below ``path``: the first line of its first block."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    numbered = lines.where("block = 0").withColumn("line", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.rtrim(F.min_by("value", "line")).alias("header"))


def _columns(header: str) -> list[str]:
    return next(csv.reader([header]), [])


def read_tenant_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All tenants' rows by the names in each file's header; ``client`` comes first, as text.

    Files are grouped by their header line and read once, one projection for each distinct
    header. A column that a file lacks is NULL in its rows; one that ``schema`` does not have
    is left out (see ``unknown_columns``). No files give no rows.
    """
    fields = [f for f in schema if f.name != "client"]
    wanted = {f.name: f.dataType for f in fields}
    client = T.StructField("client", T.StringType())
    groups = csv_headers(spark, path).groupBy("header").agg(F.collect_list("file").alias("files")).collect()  # names of files
    frames = []
    for group in groups:
        names = _columns(group["header"])
        declared = T.StructType([*(T.StructField(n, wanted.get(n, T.StringType())) for n in names), client])
        # Names of files are URIs, and paths are patterns.
        files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in group["files"]]
        rows = spark.read.schema(declared).option("header", True).option("enforceSchema", False).option("basePath", path).csv(files)
        columns = [F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        frames.append(rows.select("client", *columns))
    if not frames:
        return spark.createDataFrame([], T.StructType([client, *fields]))
    return reduce(DataFrame.unionByName, frames)


def unknown_columns(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, column) of the columns in files' headers that ``schema`` does not have."""
    known = {f.name for f in schema}
    headers = csv_headers(spark, path)
    lines = [(r["header"], n) for r in headers.select("header").distinct().collect() for n in _columns(r["header"]) if n not in known]
    found = spark.createDataFrame(lines, "header string, column string")
    return headers.join(found, "header").select("file", "column")


def combine_csv(spark: SparkSession, paths: list[str], schemas: list[T.StructType]) -> DataFrame:
    """Extracts of several runs stacked by column name; absent columns are NULL."""
    frames = [read_tenant_csv(spark, p, s) for p, s in zip(paths, schemas, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def finished_tenants(spark: SparkSession, path: str) -> DataFrame:
    """Tenants that already have output, from the listing of files; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    folder = F.regexp_extract("path", "/client=([^/]*)/", 1)
    return listed.select(F.url_decode(folder).alias("client")).where("client <> ''").distinct()


LEDGER = "client string, run string, folder string, row_count long, failure string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every line the runs below ``path`` have added; no lines before the first."""
    place = f"{path.rstrip('/')}/ledger"
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(place)
    return spark.read.schema(LEDGER).parquet(place)


def run_tenants(tenants: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, batches: int = 8) -> DataFrame:
    """Extract the tenants that have not been committed yet; this run's ledger lines.

    ``tenants`` has ``client``; ``extract`` gets some of them and returns rows tagged with it.
    Tenants go in batches, each written below a folder of its own and committed by ledger
    lines, a tenant's rows counted as they lie there, 0 if it delivered none. A batch that
    fails leaves lines with 0 rows, no folder and the failure's text; its tenants and those of
    a run cut short are taken again by the next run, and what they left is read by nobody.
    """
    spark, run = tenants.sparkSession, uuid.uuid4().hex
    done = read_ledger(spark, path).where("failure IS NULL").select("client")
    pending = tenants.select("client").distinct().join(done, "client", "left_anti")
    pending = cut_lineage(pending.withColumn("batch", F.pmod(F.xxhash64("client"), F.lit(batches))))
    for batch in sorted(r[0] for r in pending.select("batch").distinct().collect()):
        mine, folder, failure = pending.where(F.col("batch") == batch).select("client"), f"{run}-{batch}", None
        try:
            write_tenant_csv(extract(mine), f"{path.rstrip('/')}/{folder}")
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
            some = bool(found.load(f"{path.rstrip('/')}/{folder}").select("path").take(1))
        except Exception as error:  # noqa: BLE001 - whatever stopped the batch is its ledger's text
            failure, some = str(error)[:500], False
        if some:
            text = spark.read.option("header", True).option("inferSchema", False).csv(f"{path.rstrip('/')}/{folder}")
            rows = text.select(F.col("client").cast("string").alias("client"))
        else:
            rows = spark.createDataFrame([], "client string")
        counts = rows.groupBy("client").agg(F.count(F.lit(1)).alias("row_count"))
        lines = mine.join(counts, "client", "left").select(
            "client",
            F.lit(run).alias("run"),
            F.lit(folder if some else None).cast("string").alias("folder"),
            F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"),
            F.lit(failure).cast("string").alias("failure"),
        )
        lines.write.mode("append").parquet(f"{path.rstrip('/')}/ledger")
    return read_ledger(spark, path).where(F.col("run") == run)


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed tenants below ``path``."""
    folders = read_ledger(spark, path).where("failure IS NULL AND folder IS NOT NULL").select("folder").distinct()
    frames = [read_tenant_csv(spark, f"{path.rstrip('/')}/{r[0]}", schema) for r in folders.collect()]  # one per batch
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField("client", T.StringType()), *(f for f in schema if f.name != "client")]))
    return reduce(DataFrame.unionByName, frames)
