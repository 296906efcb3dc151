"""The folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset, a folder of our own, but only with a local master: executors elsewhere would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is unset; with the master {master} it must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="bookflow-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bookflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
