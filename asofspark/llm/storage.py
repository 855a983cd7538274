"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="asofspark-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later steps start from files."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As stored(), in buckets of ``key`` (an external table): joins on the key don't shuffle it."""
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/table-{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def share_of(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` of all; the smallest shares are met, too."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2**64) - 2**63)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by stored()."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if "/table-" in path and root.rpartition("/")[2] in path:
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
