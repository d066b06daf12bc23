"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spark_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. In local mode one is made where none is set; a cluster names its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: no folder that driver and executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="meshfield-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{spark_dir(spark)}/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df from a table of its own: lineage ends there, and so do estimates of its size, which joins round after round would multiply beyond all bounds."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
