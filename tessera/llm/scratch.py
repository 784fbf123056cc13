"""Cutting lineage: tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a folder of our own if driver and executors are one
    process (tests), and an error on a cluster, whose executors would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str = "tessera") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs a read and not a rerun."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove what ``save`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more, now and not at the next full collection."""
    gc.collect()
    spark._jvm.System.gc()
