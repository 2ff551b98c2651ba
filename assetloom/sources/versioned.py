"""Tables that are replaced as a whole or by bucket, with a commit that is one rename.

A table is a folder. Data lie in folders below it that are never changed; `_versions` has a
small file a version that names the data folders of that version. Readers take the highest
version. A writer writes its data, then the version file under another name, and renames that:
before the rename the old version holds, after it the new one. Data that neither of the last
two versions names are deleted later; a crash leaves at most such data behind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = "all"


class NotCommitted(RuntimeError):
    """The new version did not come to hold; the old one does."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the committed versions, ascending."""
    p, fs = _fs(spark, f"{path}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def current(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The version file of that number (the highest, unless told): folders by bucket, schema, and what the writer added; None if there is none."""
    known = versions(spark, path)
    if not known:
        return None
    p, fs = _fs(spark, f"{path}/_versions/v{number or known[-1]:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, held: dict | None = None) -> DataFrame | None:
    """The table as of that version; None if nothing was ever committed."""
    held = held or current(spark, path)
    if held is None:
        return None
    schema = T.StructType.fromJson(held["schema"])
    folders = [f"{path}/{d}" for d in held["folders"].values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, path: str, number: int, body: dict) -> None:
    """The one step that makes a version hold."""
    temporary, fs = _fs(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps(body).encode()))
    finally:
        out.close()
    target, _ = _fs(spark, f"{path}/_versions/v{number:012d}.json")
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise NotCommitted(f"version {number} of {path} is another writer's, or could not be renamed")


def _clean(spark: SparkSession, path: str) -> None:
    """Deletes version files but the last two, and data folders that those do not name."""
    known = versions(spark, path)
    last = [current(spark, path, n) for n in known[-2:]]
    named = {d.split("/")[0] for held in last for d in held["folders"].values()}
    top, fs = _fs(spark, path)
    for n in known[:-2]:
        fs.delete(_fs(spark, f"{path}/_versions/v{n:012d}.json")[0], False)
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        if name.startswith("d-") and name not in named and name.split("-")[1] <= f"{known[-1]:012d}":
            fs.delete(status.getPath(), True)


def replace(df: DataFrame, path: str, **extra) -> int:
    """Makes df the table's new version, whose number it returns. extra: JSON values kept with the version."""
    spark = df.sparkSession
    number = (versions(spark, path) or [0])[-1] + 1
    folder = f"d-{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _publish(spark, path, number, {"folders": {WHOLE: folder}, "schema": df.schema.jsonValue(), **extra})
    _clean(spark, path)
    return number


def replace_buckets(df: DataFrame, path: str, buckets: list[int], bucket_col: str = "_bucket", **extra) -> int:
    """A new version in which those buckets have the rows of df (with bucket_col) and all others the rows they had.

    Only the buckets told are written; the bytes written are theirs, not the table's.
    """
    spark = df.sparkSession
    held, known = current(spark, path), versions(spark, path)
    number = (known or [0])[-1] + 1
    folder = f"d-{number:012d}-{uuid.uuid4().hex}"
    where, fs = _fs(spark, f"{path}/{folder}")
    df.where(F.col(bucket_col).isin(buckets)).repartition(max(1, min(len(buckets), 200)), bucket_col).write.partitionBy(bucket_col).parquet(f"{path}/{folder}")
    made = {s.getPath().getName() for s in fs.listStatus(where)}
    folders = dict(held["folders"]) if held else {}
    for b in map(str, buckets):
        folders.pop(b, None)
        if f"{bucket_col}={b}" in made:
            folders[b] = f"{folder}/{bucket_col}={b}"
    _publish(spark, path, number, {"folders": folders, "schema": df.drop(bucket_col).schema.jsonValue(), **extra})
    _clean(spark, path)
    return number
