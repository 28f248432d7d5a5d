"""Tables that are worked out once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster raises RuntimeError."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quorumlake.own.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quorumlake-")
        spark.conf.set("quorumlake.own.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
