"""Rules across assets: copies, references, texture sets and stale exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.config import DccSource, PbrSet
from ..sources.catalog import order_key
from ..sources.storage import stored

# Extensions of the sources of broken-reference reports, of the wider ones that make
# an asset count as used, and the guids of built-in resources.
MISSING_SOURCES = ("prefab", "unity", "mat", "controller", "asset")
USING_SOURCES = tuple("prefab unity mat controller overridecontroller asset anim spriteatlas spriteatlasv2 terrainlayer playable shadervariants guiskin fontsettings flare preset".split())
BUILTIN_GUIDS = ("0000000000000000e000000000000000", "0000000000000000f000000000000000")


def hashed(files: DataFrame) -> DataFrame:
    """path, size, sha256 of the files (path, size, content) with a content, hashed once and stored.

    Contents are hashed where they are read, so that only path and hash are shuffled. Files
    that have a sha256 already, as by fsscan.duplicates (which reads only what sizes and starts
    leave together), are taken as they are.
    """
    if "sha256" in files.columns:
        return files.where("sha256 IS NOT NULL").select("path", "size", "sha256")
    return stored(_hashed(files), "hashes")


def _hashed(files: DataFrame) -> DataFrame:
    return files.where("content IS NOT NULL").select("path", "size", F.sha2("content", 256).alias("sha256"))


def duplicates(files: DataFrame) -> DataFrame:
    """Groups of equal files: size, sha256, n, original, anchor (the second). Empty files do group.

    Two partial aggregates, so a group of any size meets nowhere whole; its members are the
    rows of duplicate_members.
    """
    key = ["size", "sha256"]
    rows = hashed(files)
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min_by("path", order_key()).alias("original")).where("n > 1")
    copies = rows.join(groups.select(*key, "original"), key).where("path <> original")
    second = copies.groupBy(*key).agg(F.min_by("path", order_key()).alias("anchor"))
    return groups.join(second, key).select(*key, "n", "original", "anchor")


def duplicate_members(files: DataFrame) -> DataFrame:
    """path, original of every copy but the originals: partial sums by hash, then a join that Spark can split."""
    rows = hashed(files)
    groups = rows.groupBy("size", "sha256").agg(F.count("*").alias("n"), F.min_by("path", order_key()).alias("original")).where("n > 1").drop("n")
    return rows.join(groups, ["size", "sha256"]).where("path <> original").select("original", "path")


def is_builtin(guid: Column) -> Column:
    return (F.coalesce(guid, F.lit("")) == "") | guid.isin("0" * 32, *BUILTIN_GUIDS)


def missing_references(refs: DataFrame, known: DataFrame, packages: DataFrame) -> DataFrame:
    """src_path and guid, once each, of references to what neither the project nor a package holds.

    known is the catalog before anything is ignored. Where it knows no guid at all, nothing is
    reported. Left-anti joins; Spark picks broadcast or shuffle by size.
    """
    guids = known.where("guid IS NOT NULL").select("guid")
    asked = refs.where(F.lower("src_extension").isin(*MISSING_SOURCES) & ~is_builtin(F.col("guid"))).select("src_path", "guid").distinct()
    lost = asked.join(guids, "guid", "left_anti").join(packages.select("guid"), "guid", "left_anti")
    some = guids.limit(1).select(F.lit(1).alias("any"))
    return lost.join(F.broadcast(some), F.lit(True), "inner").select("src_path", "guid")  # one row at most


def unused_assets(known: DataFrame, refs: DataFrame) -> DataFrame:
    """path and guid of the assets, but scenes, that no reference names. Of a guid's paths the last counts."""
    last = known.where("guid IS NOT NULL").groupBy("guid").agg(F.max_by(F.struct("path", "asset_type"), order_key()).alias("m")).select("guid", "m.path", "m.asset_type")
    used = refs.where(F.lower("src_extension").isin(*USING_SOURCES)).select("guid")
    return last.where("asset_type <> 'scene'").join(used, "guid", "left_anti").select("path", "guid")


def pbr_sets(assets: DataFrame, c: PbrSet = PbrSet()) -> DataFrame:
    """Texture sets that hold the trigger channel: dir, key, display, anchor, channels, missing, complete.

    A set is a directory and the name before its last _, case ignored. A suffix listed under
    several channels counts for the first by name.
    """
    roles: dict[str, tuple[str, ...]] = {}
    for role in sorted(c.channels):
        for s in c.channels[role]:
            roles.setdefault(s.lower(), (role,))
    for s, many in c.packed.items():
        roles.setdefault(s.lower(), tuple(many))
    table = F.create_map(*(x for s, r in roles.items() for x in (F.lit(s), F.array(*map(F.lit, r)))))
    stem = text.stem(F.col("name"))
    parts = assets.where("asset_type = 'texture'").select("path", "dir", F.regexp_extract(stem, "^(.+)_[^_]*$", 1).alias("base"), F.lower(F.regexp_extract(stem, "_([^_]*)$", 1)).alias("suffix"))
    rows = parts.where("base <> ''").withColumn("roles", table[F.col("suffix")]).where("roles IS NOT NULL")
    trigger = F.array_contains("roles", c.trigger)
    sets = rows.withColumn("key", F.lower("base")).groupBy("dir", "key").agg(
        F.min_by("base", order_key()).alias("display"),
        F.coalesce(F.min_by(F.when(trigger, F.col("path")), F.when(trigger, order_key())), F.min_by("path", order_key())).alias("anchor"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("channels"),
    )
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, c.required)), F.col("channels")))
    return sets.where(F.array_contains("channels", c.trigger)).withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


def candidate_dirs(folder: Column, c: DccSource) -> Column:
    """Directories, in order, where an export of a source in `folder` may lie.

    Its own; and for each component named like a sibling directory, from the lowest up, the
    directory above it and that one's other siblings.
    """
    parts = F.split(folder, "/", -1)
    siblings = [s.lower() for s in c.sibling_dirs]

    def around(i: Column) -> Column:
        above = F.array_join(F.slice(parts, F.lit(1), i - 1), "/")
        here = F.lower(F.element_at(parts, i))
        others = F.filter(F.array(*map(F.lit, siblings)), lambda s: s != here)
        beside = F.transform(others, lambda s: F.when(above == "", s).otherwise(F.concat(above, F.lit("/"), s)))
        return F.when(here.isin(*siblings), F.concat(F.array(above), beside)).otherwise(F.array().cast("array<string>"))

    walk = F.when(F.size(parts) >= 2, F.flatten(F.transform(F.reverse(F.sequence(F.lit(2), F.size(parts))), around))).otherwise(F.array().cast("array<string>"))
    own = F.array(folder) if c.same_dir else F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.concat(own, walk if siblings else own)), lambda d: d != "")


def stale_exports(assets: DataFrame, c: DccSource = DccSource()) -> DataFrame:
    """Sources newer than their newest export by more than the tolerance: source, export, age_secs.

    assets carries `modified` as read when the analysis runs. An equi-join on (directory,
    lower-case stem); the newest export wins, of equal times the one in the earlier candidate
    directory, then the first path.
    """
    exports: dict[str, list[str]] = {}
    for _, sources, made in c.mappings:
        for s in sources.split():
            exports.setdefault(s, made.split())
    made = F.create_map(*(x for s, m in exports.items() for x in (F.lit(s), F.array(*map(F.lit, m)))))
    rows = assets.select("path", "dir", "modified", F.lower("extension").alias("ext"), F.lower(text.stem(F.col("name"))).alias("stem"))
    sources = rows.withColumn("made", made[F.col("ext")]).where("made IS NOT NULL")
    asked = sources.select(F.col("path").alias("source"), F.col("modified").alias("source_time"), "made", "stem", F.posexplode(candidate_dirs(F.col("dir"), c)).alias("rank", "dir"))
    targets = rows.where(F.col("ext").isin(*sorted({e for m in exports.values() for e in m})))
    pairs = asked.join(targets, ["dir", "stem"]).where(F.array_contains("made", F.col("ext")))
    newest = pairs.groupBy("source", "source_time").agg(F.max_by(F.struct("path", "modified"), F.struct(F.col("modified"), -F.col("rank"))).alias("e"))
    late = F.col("source_time") - F.col("e.modified")
    return newest.where(late > c.mtime_tolerance_secs).select("source", F.col("e.path").alias("export"), late.alias("age_secs"))
