"""Small files in a folder of any file system that Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path`` in order; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write ``value`` under a name that must be new: whole or not at all, and an error if another writer was first."""
    fs, p = _fs(spark, path)
    _, new = _fs(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    if fs.exists(p) or not fs.rename(new, p):
        fs.delete(new, False)
        raise RuntimeError(f"{path} was written by another writer")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
