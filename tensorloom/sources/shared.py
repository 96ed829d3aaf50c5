"""Tables written in between, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only where the setting is unset and one process does it all (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tensorloom-")
    return _own[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once and read back: steps that read it several times share the work, and plans stay small."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tensorloom/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders `kind=<n>` below path whose write Spark has finished."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))
