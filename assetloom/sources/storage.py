"""Results kept for reuse: written once below the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that spark.checkpoint.dir names; a temporary one where none is set, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="assetloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/assetloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote to scratch folders; for when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(scratch(spark, "any")))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def text_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text, from any store; None if there is none."""
    here, fs = _file_system(spark, path)
    if not fs.exists(here):
        return None
    stream = fs.open(here)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, body: str) -> None:
    """A small file with that text, in place of what was there."""
    here, fs = _file_system(spark, path)
    out = fs.create(here, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
