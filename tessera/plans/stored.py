"""Tables that outlive a job: written once to a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all work is on one machine, as in tests, a new local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not where and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (where or _own[0]).rstrip("/")


def new_folder(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is computed once, its lineage ends there, and lost executors don't take it along."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
