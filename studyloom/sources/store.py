"""Where iterative jobs cut their lineage: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session of one machine, as in tests, gets a new local one where none is set."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="studyloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/studyloom/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there; survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like keep, as a table in buckets of a key, so that joins by the key don't shuffle it again."""
    spark = df.sparkSession
    path, buckets = new_path(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"studyloom_{path.rpartition('/')[2]}"
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)
