"""Where intermediate tables go: the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. On one machine a temporary folder stands in where none is named; on a
    cluster that is an error, as each executor would write to its own disk."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` as a Parquet table in the shared folder: lineage ends there, and lost executors cost no
    recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Checkpointed with its parts and their order known to later plans, so that joins by the same parts shuffle and sort
    nothing; a checkpoint of an adaptive plan does not tell them."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", was)
