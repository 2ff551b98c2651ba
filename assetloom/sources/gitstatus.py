"""Version-control statuses from the listing that `git status --porcelain --untracked-files=all` prints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.browse import status_of

# The two letters of a path that both sides changed, and the escapes of quoted names.
CONFLICTS = ("DD", "AU", "UD", "UA", "DU", "AA", "UU")
_ESCAPES = {b"a": b"\a", b"b": b"\b", b"t": b"\t", b"n": b"\n", b"v": b"\v", b"f": b"\f", b"r": b"\r", b'"': b'"', b"\\": b"\\"}
_NAME = r'"(?:[^"\\]|\\.)*"|.*?'


def unquoted(name: str) -> str:
    """A name of the listing without its quotes: escapes are one character, or a byte in three octal digits."""
    if not name.startswith('"'):
        return name
    body = re.sub(rb"\\([0-7]{3}|.)", lambda m: _ESCAPES.get(m[1], m[1]) if len(m[1]) == 1 else bytes([int(m[1], 8)]), name[1:-1].encode())
    return body.decode("utf-8", "replace")


def statuses(lines: DataFrame, root: str, *, line_col: str = "value") -> DataFrame:
    """path and status of each line (`XY name`, or `XY old -> new`); lines of another form, and paths without a status, are left out.

    A line a path, in any order and any number of partitions. The strongest flag counts, of
    the index or of the working tree; of a renamed path the new name. Repeated paths come once.
    """

    @F.pandas_udf("string")
    def plain(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else unquoted(n))

    line = F.regexp_replace(F.col(line_col), r"\r$", "")
    moved = F.regexp_extract(line, rf"^..\x20(?:{_NAME})\x20->\x20({_NAME})$", 1)
    name = F.when(line.rlike(r"^(?:[RC].|.[RC])\x20") & (moved != ""), moved).otherwise(F.substring(line, 4, 1 << 30))
    rows = lines.where(line.rlike(r"^[ MTADRCU?!]{2}\x20.")).select(F.substring(line, 1, 2).alias("xy"), F.when(name.startswith('"'), plain(name)).otherwise(name).alias("name"))
    either = lambda *letters: F.substring("xy", 1, 1).isin(*letters) | F.substring("xy", 2, 1).isin(*letters)
    flags = {
        "conflicted": F.col("xy").isin(*CONFLICTS), "new": F.substring("xy", 1, 1).isin("A", "C"), "untracked": F.col("xy") == "??", "modified": either("M"), "deleted": either("D"), "renamed": either("R"),
        "typechange": either("T"), "ignored": F.col("xy") == "!!",
    }
    found = rows.select(F.concat(F.lit(root.rstrip("/") + "/"), "name").alias("path"), status_of(flags).alias("status")).where("status IS NOT NULL")
    return found.dropDuplicates(["path"])


def read_statuses(spark: SparkSession, path: str, root: str) -> DataFrame:
    """statuses of a listing kept as a text file, or as several."""
    return statuses(spark.read.text(path), root)
