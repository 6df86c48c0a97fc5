"""Intermediate tables in the folder that all executors share, counted broadcasts and global row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side table may be broadcast; counted before, never assumed.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local session uses its warehouse; a cluster has no such folder, so that is an error."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/strandweave"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and keeps a narrow
    intermediate from being computed twice. The folder goes with release(), at
    the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _filesystem(spark, path)
    fs.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these; nothing that still reads them may run later."""
    for df in frames:
        if path := df.__dict__.pop("_scratch", None):
            fs, at = _filesystem(df.sparkSession, path)
            fs.delete(at, True)


def _filesystem(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _bytes(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType):
        return F.octet_length(F.to_json(F.struct(c))) + 16
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes, counted."""
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0))
    n = df.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return n["n"] <= rows and (n["b"] or 0) <= most


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes stay within the limits; else left to shuffle joins, whose skewed keys AQE splits."""
    return F.broadcast(df) if is_small(df, rows) else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by the hash of keys over three tasks a core: for heavy work on each row of a table whose file is a split or two. A fixed number, as AQE would join such small partitions again."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def numbered(df: DataFrame, name: str, *order: Column, start: int = 0) -> DataFrame:
    """df with `name`: each row's rank in the order, from start. Ties get ranks in any order.

    Rows are range-partitioned and numbered within partitions; a broadcast of
    one offset for each partition makes the ranks global, so no task sorts all.
    """
    part, place, base = (f"__{name}_{x}" for x in ("part", "place", "base"))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id())
    rows = materialise(rows, "ranks")
    # One row a partition is what this window sorts.
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = rows.groupBy(F.col(part).alias("p")).agg(F.count("*").alias("n"), F.min(place).alias("first")).select("p", (before - F.col("first") + start).alias(base))
    joined = rows.join(F.broadcast(bases), F.col(part) == F.col("p"))
    return joined.withColumn(name, F.col(place) + F.col(base)).select(*[f"`{c}`" for c in df.columns], name)


def running_total(df: DataFrame, name: str, value: Column, *order: Column) -> DataFrame:
    """df with `name`: the sum of value, a whole number, over the rows before in the order, which must be strict. No task sorts all."""
    part, own = f"__{name}_part", f"__{name}_own"
    rows = materialise(df.withColumn(own, value.cast("long")).repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "totals")
    # One row a partition is what this window sorts.
    before = F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = rows.groupBy(F.col(part).alias("p")).agg(F.sum(own).alias("s")).select("p", before.alias("base"))
    within = F.coalesce(F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn(name, within).join(F.broadcast(bases), F.col(part) == F.col("p"))
    return placed.withColumn(name, F.col(name) + F.col("base")).select(*[f"`{c}`" for c in df.columns], name)
