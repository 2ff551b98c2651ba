"""What a project keeps between runs: scan snapshots, learned rules and tags."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession

from . import versioned
from .storage import text_file

VERSION = 7
LEARNED = "ord int, kind string, pattern string, tags array<string>, confidence double"
TAGS, BINDINGS = "id string, name string, color string, description string", "path string, tag_id string"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_snapshot(assets: DataFrame, path: str, root: str) -> None:
    """The catalog of a scan, with the version of its form and the root it is of; readers see the old one or this one."""
    versioned.replace(assets, path, form=VERSION, root=root.rstrip("/"))


def load_snapshot(spark: SparkSession, path: str, root: str) -> DataFrame | None:
    """The catalog saved at path; None if there is none, or it has another form or root."""
    held = versioned.current(spark, path)
    if held is None or (held.get("form"), held.get("root")) != (VERSION, root.rstrip("/")):
        return None
    return versioned.read(spark, path, held)


def learned_rules(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """Rules of a learned-rule file (TOML, a table a rule) in order, and a warning. No file: neither; one that can't be read: a warning alone."""
    body = text_file(spark, path)
    if body is None:
        return None, None
    try:
        rows = [(i, str(r["kind"]), str(r["pattern"]), [str(t) for t in r["tags"]], float(r.get("confidence", 0.5))) for i, r in enumerate(tomllib.loads(body).get("rules", []))]
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError) as e:
        return None, f"rules_unreadable: {e}"
    return spark.createDataFrame(rows, LEARNED), None


def load_tags(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tags and bindings of a tag file (JSON: tags, asset_tags). A file that can't be read is moved to .corrupt, unless one is there; then there are none."""
    body = text_file(spark, path)
    tags, bindings = [], []
    if body is not None:
        try:
            doc = json.loads(body)
            tags = [(t["id"], t["name"], t["color"], t.get("description")) for t in doc["tags"]]
            bindings = [(p, i) for p, ids in doc["asset_tags"].items() for i in ids]
        except (ValueError, KeyError, TypeError, AttributeError):
            tags, bindings = [], []
            here, fs = _file_system(spark, path)
            aside, _ = _file_system(spark, f"{path}.corrupt")
            if not fs.exists(aside):
                fs.rename(here, aside)
    return spark.createDataFrame(tags, TAGS), spark.createDataFrame(bindings, BINDINGS)
