"""Tables that outlive an executor, and joins that survive a hot key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds more than one in HOT_SHARE rows, so at most HOT_SHARE groups are hot.
HOT_SHARE = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a machine's own temporary folder would not do on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


#: Bytes and rows of a batch that goes to a Python worker, if the session leaves Spark's own.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": (f"{64 << 20}b", f"{8 << 20}b"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000")}


def small_batches(spark: SparkSession) -> None:
    """Has Spark send texts to Python workers in small batches: a worker holds some copies of one. Settings of one's own stay."""
    for name, (spark_own, ours) in BATCH.items():
        if spark.conf.get(name, spark_own) == spark_own:
            spark.conf.set(name, ours)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to a fresh table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are broadcast, at most; counted first.
FEW = 1 << 20


def semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids; rows stay where they are if ids are counted to be FEW at most, else both sides are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, key, "left_semi")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one row per key in groups, of which `size` counts the rows.

    Rows of hot keys are joined to a broadcast of those keys, at most HOT_SHARE
    of them by construction; all others take part in an ordinary shuffled join.
    """
    bar = total / HOT_SHARE
    hot = F.broadcast(groups.filter(F.col(size) > bar)).withColumn("_hot", F.lit(True))
    marked = rows.join(hot, key, "left")
    added = [c for c in groups.columns if c != key]
    cold = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    cold = cold.join(groups.filter(F.col(size) <= bar), key, "left")
    return marked.filter("_hot").select(*rows.columns, *added).unionByName(cold.select(*rows.columns, *added))
