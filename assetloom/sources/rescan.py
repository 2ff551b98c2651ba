"""Incremental scans end to end: only changed files are opened, only their buckets are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import snapshot
from . import fsscan, versioned
from .storage import stored

FORM = 1
BUCKETS = 256


def rescan(spark: SparkSession, root: str, where: str, *, buckets: int = BUCKETS, respect_ignores: bool = False) -> tuple[DataFrame, DataFrame]:
    """The catalog of the tree, and counts: total, cached, rescanned, removed.

    where: a versioned table of the last scan; it becomes that of this one. A file is opened
    if it is new, or its time (nanoseconds), its size or its sidecar's time is another; all
    others keep what was read. Files of the last scan that are gone or now ignored go. Without
    a usable last scan (none, another root, form or number of buckets) every file is opened.
    A rescan without changes writes nothing.
    """
    top = root.rstrip("/")
    held = versioned.current(spark, where)
    mine = held is not None and (held.get("form"), held.get("root"), held.get("n_buckets")) == (FORM, top, buckets)
    found = stored(fsscan.listing(spark, root, respect_ignores=respect_ignores), "listing")
    meta = found.where(F.col("path").endswith(".meta")).select(F.regexp_replace("path", r"\.meta$", "").alias("path"), F.col("modified_nanos").alias("meta_modified_nanos"))
    name = text.base_name(F.col("path"))
    now = found.where(~text.is_sidecar(name) & (text.extension(name) != "")).join(meta, "path", "left")
    now = stored(now, "now")
    before = versioned.read(spark, where, held) if mine else None
    if before is None:
        changes = now.select("path", F.lit("added").alias("change"))
    else:
        changes = snapshot.diff(before, now)
    changes = stored(changes.withColumn("_bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")), "changes")
    dirty = [r[0] for r in changes.where("change <> 'same'").select("_bucket").distinct().collect()]  # `buckets` at most
    counts = snapshot.stats(changes)
    if not dirty and mine:
        return before.drop("modified_nanos", "meta_modified_nanos"), counts
    wanted = now.join(changes.where("change IN ('added', 'changed')").select("path"), "path", "left_semi")
    rows = fsscan.parsed(found, wanted.select("path", "size", "modified")).join(wanted.select("path", "modified_nanos", "meta_modified_nanos"), "path")
    if before is not None:
        same = changes.where((F.col("change") == "same") & F.col("_bucket").isin(dirty)).select("path")
        rows = before.join(same, "path", "left_semi").unionByName(rows)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    extra = {"form": FORM, "root": top, "n_buckets": buckets}
    if mine or held is None:
        versioned.replace_buckets(rows, where, dirty, **extra)
    else:  # what lies there is of another root or form: none of it stays
        versioned.replace_buckets(rows, where, sorted({*dirty, *(int(b) for b in held["folders"] if b != versioned.WHOLE)}), **extra)
    return versioned.read(spark, where).drop("modified_nanos", "meta_modified_nanos"), counts
