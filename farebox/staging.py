"""Shared intermediate tables, written once and read by every later step.

A staged table cuts the lineage, is columnar, and survives the loss of executors.
It lives under the folder the cluster names in ``spark.checkpoint.dir``.
"""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a fresh local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="farebox-")
    return _LOCAL_ROOTS[app]


def staging_folder(spark: SparkSession) -> str:
    """Where this application's staged tables are."""
    return f"{checkpoint_root(spark)}/{spark.conf.get('spark.app.id')}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every table this application has staged. Frames that read them are void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
