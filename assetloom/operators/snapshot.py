"""Incremental scans: differences of a listing against the last snapshot, and merging them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

FINGERPRINT = ("modified_nanos", "size", "meta_modified_nanos")


def diff(before: DataFrame, now: DataFrame, fingerprint: tuple[str, ...] = FINGERPRINT) -> DataFrame:
    """path and change (added, changed, same, removed). One full join by path; nulls compare equal."""
    b = before.select(F.col("path").alias("b_path"), *(F.col(c).alias(f"b_{c}") for c in fingerprint))
    n = now.select(F.col("path").alias("n_path"), *(F.col(c).alias(f"n_{c}") for c in fingerprint))
    same = F.lit(True)
    for c in fingerprint:
        same &= F.col(f"b_{c}").eqNullSafe(F.col(f"n_{c}"))
    change = F.when(F.col("b_path").isNull(), "added").when(F.col("n_path").isNull(), "removed").when(same, "same").otherwise("changed")
    return b.join(n, F.col("b_path") == F.col("n_path"), "full").select(F.coalesce("n_path", "b_path").alias("path"), change.alias("change"))


def merge(before: DataFrame, now: DataFrame, parsed: DataFrame) -> DataFrame:
    """The new snapshot: rows of `before` still listed in `now`, those in `parsed` replaced, and new ones."""
    kept = before.join(now.select("path"), "path", "left_semi").join(parsed.select("path"), "path", "left_anti")
    return kept.unionByName(parsed.join(now.select("path"), "path", "left_semi"))


def stats(changes: DataFrame) -> DataFrame:
    """total listed, cached and rescanned."""
    n = lambda *s: F.count_if(F.col("change").isin(*s))
    return changes.agg(n("added", "changed", "same").alias("total"), n("same").alias("cached"), n("added", "changed").alias("rescanned"), n("removed").alias("removed"))


def moved(gone: DataFrame, come: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """from_path and to_path where one vanished and one appeared file share an identity, and no others do."""
    one = lambda df, name: df.groupBy(*identity).agg(F.count("*").alias("c"), F.min("path").alias(name)).where("c = 1").drop("c")
    return one(gone, "from_path").join(one(come, "to_path"), list(identity)).select(*identity, "from_path", "to_path")


def below(path: Column, folder: Column) -> Column:
    """Whether the path is the folder or lies in it, by whole components."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def with_path(assets: DataFrame, path: Column) -> DataFrame:
    """assets under a new path: what derives from the path follows, content columns stay."""
    out = assets.withColumn("path", path)
    name = text.base_name(F.col("path"))
    derived = {"name": name, "dir": text.parent(F.col("path")), "extension": text.extension(name), "asset_type": text.asset_type(text.extension(name))}
    return out.withColumns({k: v for k, v in derived.items() if k in assets.columns})


def rekeyed(assets: DataFrame, old: str, new: str) -> DataFrame:
    """The catalog after a directory or file moved from old to new."""
    hit = below(F.col("path"), F.lit(old))
    return with_path(assets, F.when(hit, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path")))
