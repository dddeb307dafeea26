"""Table reads and writes: the training set, snapshots, evaluation logs and models."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.session import cut_lineage, scratch_path

EVALUATION_LOG = T.StructType(
    [
        T.StructField("logged_at", T.TimestampType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("weights", T.MapType(T.IntegerType(), T.DoubleType())),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("kind", T.StringType()),
        T.StructField("outside_spell", T.BooleanType()),
        T.StructField("c", T.DoubleType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet under a declared schema: no inference job before the query."""
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Replace the named table with ``df`` and read it back.

    The rows go to a new place below ``folder`` (by default the session's shared folder); once
    they are counted there, the table is pointed at it. Readers see the old rows or the new
    ones, a set may be made from itself, and a failed or short write leaves the table as it
    was. The old files stay for readers that have begun; other columns than before make a new
    table under the name.
    """
    spark = df.sparkSession
    place = scratch_path(spark, name.replace(".", "-")) if folder is None else f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(place)
    stored = spark.read.schema(df.schema).parquet(place)
    if stored.count() != written.get["n"]:
        raise ValueError(f"{place} does not hold the rows written for {name}")
    if spark.catalog.tableExists(name):
        if [(c.name, c.dataType) for c in spark.table(name).schema] == [(c.name, c.dataType) for c in df.schema]:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{place}'")
            spark.catalog.refreshTable(name)
            return spark.table(name)
        spark.sql(f"DROP TABLE {name}")
    return spark.catalog.createTable(name, path=place, source="parquet", schema=df.schema)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Replace the snapshot at ``path`` with ``df`` and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Write ``df`` in ascending order of ``keys``, NULL last, and return its manifest.

    Tasks hold ranges of the order, each written sorted below ``part=<number>``. The manifest
    has a line for each part: its number, its rows and how many rows are before it. Rows equal
    in ``keys`` are ordered by the other columns that can be compared.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c, kind in df.dtypes if c not in keys and "map<" not in kind and "variant" not in kind]
    order = [F.col(c).asc_nulls_last() for c in (*keys, *rest)]
    # Rows are placed once: a second sampling of the ranges could place them otherwise.
    placed = cut_lineage(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long"))
    numbered.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a line for each part
    counts.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """The rows of an ordered set, with each row's place in the whole order, from 1."""
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "before")
    rows = spark.read.parquet(f"{path}/rows").withColumnRenamed("place", "__place").join(F.broadcast(manifest), "part")
    return rows.withColumn(place, F.col("before") + F.col("__place")).drop("part", "before", "__place")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Stored training rows whose label is known; the test reaches the scan."""
    return spark.read.parquet(path).where(F.col("hs_did_change").isNotNull())


def append_evaluations(evaluations: DataFrame, path: str) -> None:
    """Append sweep results to the log, stamped with the time of writing."""
    stamped = evaluations.withColumn("logged_at", F.current_timestamp())
    stamped.select(*[F.col(f.name).cast(f.dataType) for f in EVALUATION_LOG]).write.mode("append").parquet(path)


def read_evaluations(spark: SparkSession, path: str, drop: Sequence[str] = ()) -> DataFrame:
    return spark.read.schema(EVALUATION_LOG).parquet(path).drop(*drop)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
