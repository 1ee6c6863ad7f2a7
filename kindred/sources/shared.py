"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a local session that names none gets a new folder, a cluster an exception."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again, which cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/kindred-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table is broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table``, to be broadcast where its rows (counted, unless given) are few, else left to the optimiser."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table


def rows_by_key(table: DataFrame, keys) -> dict[str, int]:
    """How many rows ``table(key, ...)`` has for each of these keys; 0 for those it lacks."""
    counts = dict.fromkeys(keys, 0)
    counts.update((r[0], r[1]) for r in table.filter(F.col("key").isin(*counts)).groupBy("key").count().collect())
    return counts


def removed(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered_by(df: DataFrame, draw: Column, tie: str, out: str) -> DataFrame:
    """Number rows from 1 in the order of a hex text, without one task seeing them all.

    The text's first three digits deal the rows into 4,096 buckets, whose counts give each bucket's start.
    """
    dealt = df.withColumn("_d", draw).withColumn("_b", F.conv(F.substring("_d", 1, 3), 16, 10).cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    placed = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_d", tie)))
    return placed.join(F.broadcast(starts), "_b").select(*df.columns, (F.col("_s") + F.col("_k")).cast("long").alias(out))
