"""Ignore files: their patterns as rows, and which paths they leave out.

A rule holds for its directory and all below. Of the rules that fit a path or a directory
above it, the one of the deepest directory counts, of those of one directory .ignore before
.gitignore before the repository's exclude list before the global one, and of one file the
last line. Nothing below an ignored directory comes back.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..streaming.watch import ancestors

#: Names of ignore files in a directory, the weaker first.
FILES = (".git/info/exclude", ".gitignore", ".ignore")
MOST_RULES = 100_000
RULES = "dir string, rank long, pattern string, negated boolean, only_dirs boolean"


def translated(line: str) -> tuple[str, bool, bool] | None:
    """A line as (regular expression over the path below the rule's directory, negated, only for directories), or None."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\)[ \t]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    if not line:
        return None
    anchored = "/" in line
    out, i, body = [], 0, line.lstrip("/")
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += len(body[i:]) - len(body[i:].lstrip("*"))
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("(?!/)[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$", negated, only_dirs


def rules_of(files: list[tuple[str, int, str]]) -> list[tuple[str, int, str, bool, bool]]:
    """Rows of RULES from (directory, strength, text) of ignore files; rank grows with depth, strength and line."""
    rows = []
    for folder, strength, body in files:
        depth = folder.rstrip("/").count("/")
        for n, line in enumerate(body.splitlines()):
            if (rule := translated(line)) is not None:
                rows.append((folder.rstrip("/"), (depth << 40) | (strength << 32) | n, *rule))
    return rows


def rows(spark: SparkSession, rules: list[tuple[str, int, str, bool, bool]]) -> DataFrame:
    """The rules as RULES; by way of Arrow, as a list of tuples would take a Python worker of its own a core."""
    schema = T.StructType.fromDDL(RULES)
    types = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rules], t) for i, t in enumerate(types.types)], schema=types), schema)


def kept(listing: DataFrame, rules: DataFrame, root: str) -> DataFrame:
    """The files (path, ...) of a listing below root that the rules leave in.

    Rules are few and written by hand; their number is checked before they are sent to every
    task. Directories are judged once each, not once a file.
    """
    if rules.count() > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} ignore rules")
    top = root.rstrip("/")
    folders = listing.select(F.explode(ancestors(F.regexp_replace("path", "/[^/]*$", ""))).alias("path")).where(F.col("path").startswith(top + "/")).distinct()
    entries = folders.withColumn("is_dir", F.lit(True)).unionByName(listing.select("path", F.lit(False).alias("is_dir")))
    above = entries.select("path", "is_dir", F.explode(ancestors(F.regexp_replace("path", "/[^/]*$", ""))).alias("dir"))
    fits = (F.col("is_dir") | ~F.col("only_dirs")) & F.rlike(F.expr("substring(path, length(dir) + 2)"), F.col("pattern"))
    verdicts = above.join(F.broadcast(rules), "dir").where(fits).groupBy("path", "is_dir").agg(F.max_by("negated", "rank").alias("negated"))
    bad = verdicts.where("NOT negated").select(F.col("path").alias("bad"), "is_dir")
    out = listing.join(bad.where("NOT is_dir").select("bad"), F.col("path") == F.col("bad"), "left_anti")
    below = out.select("path", F.explode(ancestors(F.regexp_replace("path", "/[^/]*$", ""))).alias("bad")).join(bad.where("is_dir").select("bad"), "bad", "left_semi").select("path")
    return out.join(below, "path", "left_anti")


def matcher(spark: SparkSession, root: str, texts: dict[str, str], global_text: str = "") -> DataFrame:
    """Rules of a project's root alone, by name of its ignore files, and of a global list: for single paths, as in a change feed."""
    files = [(root, 0, global_text), *((root, 1 + FILES.index(n), t) for n, t in texts.items())]
    return rows(spark, rules_of(files))
