"""Reading tables, and Arrow functions with typed output."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows handed from partition to partition that are broadcast, at most.
CARRIED_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of columns, which get the Arrow types of ``schema``."""
    spark_schema = T._parse_datatype_string(schema)
    fields = to_arrow_schema(spark_schema)

    def wrapped(batches):
        for columns in run(batches):
            arrays = [c if isinstance(c, pa.Array) and c.type == f.type else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(wrapped, spark_schema)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session; only a local session (tests) may leave it unset and gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark, "_docloom_dir", None)
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = spark._docloom_dir = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage by writing a Parquet table into the shared folder and reading it again; it outlives any executor and is removed by :func:`release` or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    _written(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str = "step") -> DataFrame:
    """The distinct rows of ``df``, written once in as many buckets of ``keys`` as a shuffle has partitions: later joins and groupings by ``keys`` don't move them again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/docloom-{name}-{key}"
    table = f"docloom_{name}_{key}"
    _written(spark, path)
    spark._docloom_tables = [*getattr(spark, "_docloom_tables", []), table]
    df.repartition(buckets, *keys).dropDuplicates().write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(table)
    return spark.table(table)


def _written(spark: SparkSession, path: str) -> None:
    """Note a step's folder, to be removed by :func:`release` or when the driver ends."""
    if not hasattr(spark, "_docloom_steps"):
        spark._docloom_steps = set()
        atexit.register(release, spark)
    spark._docloom_steps.add(path)


def release(spark: SparkSession) -> int:
    """Remove all steps written in this session, and the indexes it keeps; returns how many. Results that haven't been written or collected yet can't be read after it, so a long session calls it between jobs."""
    steps = getattr(spark, "_docloom_steps", set())
    n = len(steps)
    while steps:
        _remove(spark, steps.pop())
    for table in getattr(spark, "_docloom_tables", []):
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the session has ended
            break
    spark._docloom_tables = []
    getattr(spark, "_docloom_indexes", {}).clear()
    return n


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def ranged(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, Window]:
    """Rows ranged over partitions by ``group`` and ``order``, written once with their partition number ``__p``, and the window of a group's rows within a partition. A group of any size spreads over as many tasks as it needs."""
    rows = materialize(df.repartitionByRange(group, *order).withColumn("__p", F.spark_partition_id()), "ranged")
    return rows, Window.partitionBy("__p", group).orderBy(*order)


def carried(rows: DataFrame, handed: DataFrame, group: str) -> DataFrame:
    """Joins what earlier partitions of the same group hand on: one row per partition and group."""
    return rows.join(broadcast_if_small(handed, handed.count(), CARRIED_ROWS), ["__p", group], "left")


def fill_forward(df: DataFrame, group: str, order: list[str], value: str, out: str, strict: bool = False) -> DataFrame:
    """Adds ``out``: the last value of ``value`` that isn't null up to the row (before it, if ``strict``) within its group, null where there is none."""
    rows, w = ranged(df, group, order)
    last = rows.groupBy("__p", group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    earlier = last.select("__p", group, F.last("__last", ignorenulls=True).over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    local = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    return carried(rows.withColumn("__local", local), earlier, group).withColumn(out, F.coalesce("__local", "__before")).drop("__p", "__local", "__before")


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only for a table counted to have at most ``limit`` rows; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df
