"""Tables written to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and all runs on this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="vellum-")
    return _OWN[context.applicationId]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as it is at this moment: a lost executor does not make it anew."""
    path = f"{folder(df.sparkSession)}/vellum-notes/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table that stored() wrote; no plan over it can run afterwards."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._vellum_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
