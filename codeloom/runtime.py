"""Checkpoints and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of short strings that each executor may hold whole; about 100 bytes a row in a join.
NEAR = 500_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where that is unset (local mode and tests)."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not there and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(there or f"file://{tempfile.mkdtemp(prefix='codeloom-')}")
    return there or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df from Parquet files in the shared folder: for large tables of which several readers take some columns or rows."""
    folder = work_dir(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def near(df: DataFrame, most: int = NEAR) -> DataFrame:
    """df, which is computed already, with a hint to send it to all executors if its counted rows are few."""
    return F.broadcast(df) if df.count() <= most else df


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/codeloom-{name}-{uuid.uuid4().hex}"
