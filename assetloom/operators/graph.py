"""Dependency graphs: nodes, edges, bounded neighbourhoods and reverse references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .cross import is_builtin


def edges(refs: DataFrame) -> DataFrame:
    """src and dst of the references between things with guids; builtin ones left out, repeats kept."""
    return refs.where(F.col("src_guid").isNotNull() & ~is_builtin(F.col("guid"))).select(F.col("src_guid").alias("src"), F.col("guid").alias("dst"))


def nodes(refs: DataFrame, known: DataFrame, packages: DataFrame) -> DataFrame:
    """id, kind (asset, package, unresolved), label: the catalog and every unknown thing referred to, once."""
    own = known.where("guid IS NOT NULL").groupBy(F.col("guid").alias("id")).agg(F.max("path").alias("label")).select("id", F.lit("asset").alias("kind"), "label")
    packs = packages.groupBy(F.col("guid").alias("p_id")).agg(F.max("package").alias("package"))
    named = edges(refs).select(F.col("dst").alias("id")).distinct().join(own, "id", "left_anti")
    outside = named.join(packs, F.col("id") == F.col("p_id"), "left").select("id", F.when(F.col("package").isNull(), "unresolved").otherwise("package").alias("kind"), F.coalesce("package", "id").alias("label"))
    return own.unionByName(outside)


def neighbourhood(edge: DataFrame, start: Column, hops: int = 2, assets: DataFrame | None = None) -> DataFrame:
    """id, direction and the least number of hops from the start nodes, forward and backward apart.

    edge: src, dst. The first hop is a filter of the edges, as `start` tells its nodes; each
    further one sends the edges once a direction to those that were reached, which are written
    down. Repeats are dropped from what is reached, never by sending all edges for that. assets
    (id): if given, only these are gone on from; other nodes end a way.
    """
    ways = {"forward": ("src", "dst"), "backward": ("dst", "src")}
    own = None if assets is None else assets.select("id").distinct()
    go_on = lambda rows: rows if own is None else rows.join(own, "id", "left_semi")
    # a node that only receives is a start of the other direction too
    both = edge.select(F.explode(F.array("src", "dst")).alias("id")).where(start).distinct()
    seen = both.select("id", F.explode(F.array(*map(F.lit, ways))).alias("direction"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        steps = []
        for direction, (here, there) in ways.items():
            links = edge.select(F.col(here).alias("id"), F.col(there).alias("to"))
            if hop == 1:
                step = go_on(links.where(start))
            else:
                step = links.join(go_on(seen.where((F.col("hop") == hop - 1) & (F.col("direction") == direction)).select("id")), "id", "left_semi")
            steps.append(step.select(F.col("to").alias("id"), F.lit(direction).alias("direction"), F.lit(hop).alias("hop")))
        seen = stored(seen.unionByName(steps[0]).unionByName(steps[1]).groupBy("id", "direction").agg(F.min("hop").alias("hop")), "reached")
    return seen.select("id", "hop", "direction")


def reached_edges(edge: DataFrame, reached: DataFrame) -> DataFrame:
    """The distinct edges between nodes (id) that were reached, whichever way. Repeats go last, when few edges are left."""
    ids = reached.select("id").distinct()
    inside = edge.select("src", "dst").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.distinct()


def reverse_references(refs: DataFrame) -> DataFrame:
    """guid with the number of the files that name it, once each, itself left out, and the first by name.

    Partial sums only; the files themselves are the rows of referring_files.
    """
    rows = refs.where(~is_builtin(F.col("guid")) & ~F.col("guid").eqNullSafe(F.col("src_guid"))).select("guid", "src_path").distinct()
    return rows.groupBy("guid").agg(F.count("*").alias("n_files"), F.min("src_path").alias("first_file"))


def referring_files(refs: DataFrame, guids: DataFrame) -> DataFrame:
    """guid, src_path for the given guids, a row each."""
    return refs.join(guids.select("guid"), "guid", "left_semi").where(~F.col("guid").eqNullSafe(F.col("src_guid"))).select("guid", "src_path").distinct()


def mentions(refs: DataFrame, project_file: str = "project.godot") -> DataFrame:
    """target, path, ord of the files that name a target (refs: path, target, self), once each, itself left out.

    ord sorts a target's files: the project file first, then the catalog's order.
    """
    rows = refs.where(~F.col("self").eqNullSafe(F.col("target"))).select("target", "path").distinct()
    own = F.substring_index("path", "/", -1) != project_file
    return rows.withColumn("ord", F.struct(own.alias("later"), F.lower("path").alias("low"), "path"))


def resource_references(files: DataFrame, content: str = "content") -> DataFrame:
    """path and target of the quoted res:// paths in a text."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(r'"(res://[^"]*)"'), 1))).alias("target"))


def yaml_references(files: DataFrame, content: str = "content") -> DataFrame:
    """path, guid, file_id, ref_type of the references in scene and prefab texts, once each.

    Each line's first `guid:` counts, if exactly 32 hex digits follow; lines of # or % don't.
    """
    lines = files.select("path", F.explode(F.split(content, "\n")).alias("line")).where(~F.col("line").rlike(r"^\s*[#%]"))
    rest = F.regexp_extract("line", r"^(?:(?!guid:).)*guid:\s*(.*)$", 1)
    rows = lines.select("path", F.lower(F.regexp_extract(rest, r"^([0-9A-Fa-f]{32})(?![0-9A-Fa-f])", 1)).alias("guid"), F.regexp_extract("line", r"fileID:\s*(-?[0-9]+)", 1).try_cast("long").alias("file_id"), F.regexp_extract("line", r"type:\s*([0-9]+)", 1).try_cast("int").alias("ref_type"))
    return rows.where("guid <> ''").distinct()
