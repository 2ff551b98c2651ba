"""Renames in sequence: where each file is after a batch, by composing its moves in order of time.

An act hits paths: a move what is at or below its old path, and what lies at its new one; a
removal what is at or below its path; a write what lies at its path. A file goes from act to
act. Moves of single paths are joined by pointer jumping, so a chain of any length takes
about its logarithm in rounds; moves of directories are followed one by one.

The joins are told to sort (hint "merge"): their sides grow with the batch or the catalog, and
Spark takes the bytes of compressed files for their size, so it would broadcast many times the
size that it means to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.storage import stored


def ancestors(path: Column) -> Column:
    """The path and all directories above it."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _hits(acts: DataFrame) -> DataFrame:
    """h (a path that is hit), below (whether what lies below it is hit, too), and the act: at, act, to, size, modified."""
    what = lambda act: F.struct("at", F.lit(act).alias("act"), F.col("to_path").alias("to"), "size", "modified")
    own = acts.select(F.col("path").alias("h"), (F.col("act") != "put").alias("below"), F.when(F.col("act") == "move", what("move")).when(F.col("act") == "drop", what("drop")).otherwise(what("put")).alias("hit"))
    return own.unionByName(acts.where("act = 'move'").select(F.col("to_path").alias("h"), F.lit(False).alias("below"), what("over").alias("hit")))


def above(folder: Column) -> Column:
    """The directory and all directories above it; none for the one above the first name of a path."""
    return F.when(F.size(F.split(folder, "/", -1)) > 1, ancestors(folder)).otherwise(F.array().cast("array<string>"))


def _hit_folders(paths: DataFrame, hits: DataFrame) -> DataFrame | None:
    """folder and h: the directories that files (path) lie in, and hit paths at or above each; None if there are none.

    Ancestors are exploded once a directory: once a file, all files would meet at the topmost one.
    """
    below = hits.where("below").select("h").distinct()
    found = paths.select(text.parent(F.col("path")).alias("folder")).distinct().select("folder", F.explode(above(F.col("folder"))).alias("h"))
    found = stored(found.join(below.hint("merge"), "h", "left_semi").select("folder", "h"), "hit-folders")
    return None if found.isEmpty() else found


def _first_after(asked: DataFrame, hits: DataFrame, columns: list[str]) -> DataFrame:
    """asked (h, at, columns) with hit: the first of hits (h, hit) on h after `at`; null where none is. Rows go by h once, with their columns."""
    kinds = {f.name: f.dataType for f in asked.schema.fields}
    rows = asked.select("h", "at", F.lit(True).alias("asks"), F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), *columns)
    rows = rows.unionByName(hits.where("h IS NOT NULL").select("h", F.col("hit.at").alias("at"), F.lit(False).alias("asks"), "hit", *(F.lit(None).cast(kinds[c]).alias(c) for c in columns)))
    later = Window.partitionBy("h").orderBy(F.col("at").desc_nulls_last(), ~F.col("asks")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hit", F.last("hit", ignorenulls=True).over(later)).where("asks").drop("asks")


def _next(states: DataFrame, hits: DataFrame) -> DataFrame:
    """states (path, at, ...) with h, strict and hit of the first act after `at` that hits the path; null where none does.

    Acts on the path itself are found by the path; those on directories above it once for each
    different (directory, time), so the files below a moved directory share one lookup.
    """
    own = [c for c in states.columns if c not in ("path", "at")]
    exact = _first_after(states.withColumnRenamed("path", "h"), hits.select("h", "hit"), own).withColumnRenamed("h", "path")
    folders = _hit_folders(states, hits)
    if folders is None:
        return exact.select(*states.columns, F.when(F.col("hit").isNotNull(), F.col("path")).alias("h"), F.when(F.col("hit").isNotNull(), F.lit(False)).alias("strict"), "hit")
    exact = exact.withColumnRenamed("hit", "own_hit").withColumn("folder", text.parent(F.col("path")))
    known = folders.select("folder").distinct()
    asked = exact.select("folder", "at").join(known.hint("merge"), "folder", "left_semi").distinct().join(folders.hint("merge"), "folder")
    times = asked.select("h", "at").distinct()
    found = _first_after(times, hits.where("below").select("h", "hit"), []).where("hit IS NOT NULL").select(F.col("h").alias("fh"), F.col("at").alias("fa"), "hit")
    near = asked.join(found.hint("merge"), (F.col("h") == F.col("fh")) & F.col("at").eqNullSafe(F.col("fa")))
    first = near.groupBy(F.col("folder").alias("f"), F.col("at").alias("a")).agg(F.min_by(F.struct("h", "hit"), "hit.at").alias("n"))
    both = exact.join(first.hint("merge"), (F.col("folder") == F.col("f")) & F.col("at").eqNullSafe(F.col("a")), "left")
    mine = F.col("own_hit").isNotNull() & (F.col("n").isNull() | (F.col("own_hit.at") < F.col("n.hit.at")))
    return both.select(*states.columns, F.when(mine, F.col("path")).otherwise(F.col("n.h")).alias("h"), F.when(mine, F.lit(False)).when(F.col("n").isNotNull(), F.lit(True)).alias("strict"), F.when(mine, F.col("own_hit")).otherwise(F.col("n.hit")).alias("hit"))


def nothing(path: str, kind: T.StructType) -> Column:
    """In place of a null `at` that is joined by: a value that no act has and that differs by path, so rows that look for nothing do not meet in one task."""
    parts = {"step": F.lit(-1), "h": F.xxhash64(path)}
    return F.struct(*(parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))


def same_extension(a: Column, b: Column) -> Column:
    return F.lower(text.extension(text.base_name(a))) == F.lower(text.extension(text.base_name(b)))


def _walk(items: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (path, at, ...) followed through moves of directories above them, up to a move of their own path or their end.

    Adds stop (move, drop, over, put or stay), went (time of that act), end_path, last (time of
    the last move). Also the times of the moves that turned out to be of directories.
    """
    done, folders = None, None
    rows = items.withColumns({"end_path": F.col("path"), "last": F.col("at")})
    own = [c for c in items.columns if c not in ("path", "at")]
    while True:
        now = stored(_next(rows.select(*own, F.col("path").alias("path0"), F.col("at").alias("at0"), F.col("end_path").alias("path"), F.col("last").alias("at")), hits), "walk")
        by_folder = now.where("strict AND hit.act = 'move'")
        ended = now.where("NOT coalesce(strict AND hit.act = 'move', false)").select(
            *own, F.col("path0").alias("path"), F.col("at0").alias("at"), F.coalesce("hit.act", F.lit("stay")).alias("stop"), F.col("hit.at").alias("went"), F.col("path").alias("end_path"), F.col("at").alias("last"))
        done = ended if done is None else done.unionByName(ended)
        seen = by_folder.select(F.col("hit.at").alias("folder_at")).distinct()
        folders = seen if folders is None else folders.unionByName(seen)
        if by_folder.isEmpty():
            return done, folders.distinct()
        target = F.concat(F.col("hit.to"), F.expr("substring(path, length(h) + 1)"))
        rows = by_folder.select(*own, F.col("path0").alias("path"), F.col("at0").alias("at"), target.alias("end_path"), F.col("hit.at").alias("last"))


def _jumped(links: DataFrame) -> DataFrame:
    """links (e, nxt, stop, end_path, last, keep, size, modified) with every chain of nxt run to its end."""
    links = stored(links, "links")
    every, going = links, stored(links.where("stop = 'move'"), "links")
    ended = links.where("NOT stop <=> 'move'")
    while not going.isEmpty():
        on = every.select(*(F.col(c).alias(f"o_{c}") for c in links.columns))
        over = lambda c: F.coalesce(F.col(f"o_{c}"), F.when(F.col("o_keep"), F.col(c)))
        after = {c: F.col(f"o_{c}") for c in ("stop", "end_path", "last", "nxt")} | {"keep": F.col("keep") & F.col("o_keep")} | {c: over(c) for c in ("size", "modified")}
        # only chains that still go on are joined and written
        now = stored(going.join(on.hint("merge"), F.col("nxt") == F.col("o_e"), "left").withColumns(after).select(*links.columns), "links")
        ended, going = ended.unionByName(now.where("NOT stop <=> 'move'")), now.where("stop = 'move'")
        every = ended.unionByName(going)
    return ended


def followed(catalog_paths: DataFrame, acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What became of files (kind, from_path, born, path, fate, last, keep, size, modified, own, went_away), and of moved directories (at, from_path, path, fate).

    acts (read several times): at (a struct that orders them; distinct), act (move, drop, put), path, to_path (of a move), size, modified.
    kind: cat (a catalog path that an act hits), put (written by an act, at `born`), move (came
    by a move whose old path had no file). fate: stay (it is at `path`), else the act that
    ended it there (drop, over: another file came, put). keep: no extension changed on the
    way. size, modified: what the moves said last. own: a move of its own path is among the
    moves; went_away: any move is.
    """
    hits = _hits(acts)
    none = F.lit(None).cast(acts.schema["at"].dataType)
    land = acts.where("act = 'move'").select(F.lit("land").alias("kind"), F.col("at").alias("born"), F.col("to_path").alias("path"), "at")
    puts = acts.where("act = 'put'").select(F.lit("put").alias("kind"), F.col("at").alias("born"), "path", "at")
    # catalog paths that nothing hits are left out early: first hits are looked up by one distinct path list
    touched, folders = catalog_paths.join(hits.select(F.col("h").alias("path")).distinct().hint("merge"), "path", "left_semi"), _hit_folders(catalog_paths, hits)
    if folders is not None:
        inside = catalog_paths.join(folders.select("folder").distinct().hint("merge"), text.parent(F.col("path")) == F.col("folder"), "left_semi")
        touched = touched.unionByName(inside)
    cats = touched.select("path").distinct().select(F.lit("cat").alias("kind"), none.alias("born"), "path", none.alias("at"))
    walked, folder_at = _walk(land.unionByName(puts).unionByName(cats), hits)

    moves = acts.where("act = 'move'").select(F.col("at").alias("m_at"), F.col("path").alias("m_from"), F.col("to_path").alias("m_to"), F.col("size").alias("m_size"), F.col("modified").alias("m_modified"))
    landed = walked.where("kind = 'land'").join(moves.hint("merge"), F.col("born") == F.col("m_at"))
    links = landed.select(F.col("born").alias("e"), F.col("went").alias("nxt"), "stop", "end_path", "last", same_extension(F.col("m_from"), F.col("m_to")).alias("keep"), F.col("m_size").alias("size"), F.col("m_modified").alias("modified"))
    links = _jumped(links)

    through = F.col("stop") == "move"
    ends = links.select(F.col("e"), *(F.col(c).alias(f"l_{c}") for c in ("stop", "end_path", "last", "keep", "size", "modified")))
    pick = lambda own, then: F.when(through, F.col(f"l_{then}")).otherwise(own)
    items = walked.where("kind <> 'land'").join(ends.hint("merge"), F.when(through, F.col("went")).otherwise(nothing("path", acts.schema["at"].dataType)) == F.col("e"), "left").select(
        "kind", F.col("path").alias("from_path"), "born", pick(F.col("end_path"), "end_path").alias("path"), pick(F.col("stop"), "stop").alias("fate"), pick(F.col("last"), "last").alias("last"), pick(F.lit(True), "keep").alias("keep"),
        pick(F.lit(None).cast("long"), "size").alias("size"), pick(F.lit(None).cast("long"), "modified").alias("modified"), through.alias("own"), (~F.col("end_path").eqNullSafe(F.col("path"))).alias("by_folder"))
    items = items.withColumn("went_away", F.col("own") | F.col("by_folder")).drop("by_folder")
    # a move without a file at its old path, and not of a directory: a file that came from elsewhere
    real = walked.where("kind <> 'land'").unionByName(walked.where("kind = 'land'").join(folder_at.hint("merge"), F.col("born") == F.col("folder_at"), "left_anti"))
    carried = real.where("stop = 'move'").select(F.col("went").alias("c_at")).distinct()
    come = links.join(folder_at.hint("merge"), F.col("e") == F.col("folder_at"), "left_anti").join(carried.hint("merge"), F.col("e") == F.col("c_at"), "left_anti").join(moves.select("m_at", "m_from").hint("merge"), F.col("e") == F.col("m_at"))
    come = come.select(F.lit("move").alias("kind"), F.col("m_from").alias("from_path"), F.col("e").alias("born"), F.col("end_path").alias("path"), F.col("stop").alias("fate"), "last", F.lit(False).alias("keep"), "size", "modified", F.lit(True).alias("own"), F.lit(True).alias("went_away"))
    folders = links.join(folder_at.hint("merge"), F.col("e") == F.col("folder_at"), "left_semi").join(moves.select("m_at", "m_from").hint("merge"), F.col("e") == F.col("m_at"))
    return items.unionByName(come), folders.select(F.col("e").alias("at"), F.col("m_from").alias("from_path"), F.col("end_path").alias("path"), F.col("stop").alias("fate"))


def followed_bindings(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """from_path and to_path of bound paths after moves (at, path, to_path) one after the other; ones that stay are left out.

    A binding that others come to is not ended: they lie on one path then.
    """
    null = F.lit(None).cast("long")
    acts = stored(moves.select("at", "path", "to_path", null.alias("size"), null.alias("modified"), F.lit("move").alias("act")), "acts")
    hits = _hits(acts).where("hit.act = 'move'")
    none = F.lit(None).cast(acts.schema["at"].dataType)
    items = paths.select(F.lit("tag").alias("kind"), none.alias("born"), "path", none.alias("at")).distinct().unionByName(acts.select(F.lit("land").alias("kind"), F.col("at").alias("born"), F.col("to_path").alias("path"), "at"))
    walked, _ = _walk(items, hits)
    links = _jumped(walked.where("kind = 'land'").select(F.col("born").alias("e"), F.col("went").alias("nxt"), "stop", "end_path", "last", F.lit(True).alias("keep"), null.alias("size"), null.alias("modified")))
    tags = walked.where("kind = 'tag'").join(links.select("e", F.col("end_path").alias("l_path")).hint("merge"), F.when(F.col("stop") == "move", F.col("went")).otherwise(nothing("path", acts.schema["at"].dataType)) == F.col("e"), "left")
    return tags.select(F.col("path").alias("from_path"), F.coalesce("l_path", "end_path").alias("to_path")).where("from_path <> to_path")
