"""Change feeds: the events of a batch are reduced to net changes and merged into the catalog.

Events: ts, event_id, kind (create, modify, touch, remove, rename), path, to_path (of a
rename), size, modified. Time is arrival time and a batch is final; the watermark of the
window counts is this library's own addition for replays. What exists when a batch ends is
what the last event of each path says, unless a listing is given.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import text
from ..operators import stats
from ..operators.snapshot import with_path
from ..sources import versioned
from ..sources.storage import put_text, stored, text_file
from .renames import above, ancestors, followed, followed_bindings, nothing

DEBOUNCE = "500 milliseconds"
STATE = "path string, size long, modified long"


# --- routing ------------------------------------------------------------------------------


def host_of(path: Column) -> Column:
    """The asset that a .meta sidecar belongs to; other paths as they are."""
    return F.regexp_replace(path, r"(?<=[^/])\.meta$", "")


def trackable(path: Column, root: str) -> Column:
    """Below root, with no hidden component, and no sidecar."""
    r = root.rstrip("/")
    return path.startswith(r + "/") & ~F.substring(path, len(r) + 1, 1 << 30).rlike(r"/\.|/$") & ~text.is_sidecar(text.base_name(path))


def routed(events: DataFrame, root: str) -> DataFrame:
    """Events as singles and rename pairs: route is single, rename, or drop.

    Only a rename with both paths is a pair. A pair of one path changes nothing; one with a
    sidecar on either side is two singles; one between paths that are not tracked is dropped.
    """
    columns = [c for c in ("ts", "event_id", "size", "modified") if c in events.columns]
    to = F.col("to_path") if "to_path" in events.columns else F.lit(None).cast("string")
    rows = events.select(*columns, "kind", "path", to.alias("to_path"))
    pair = (F.col("kind") == "rename") & F.col("to_path").isNotNull()
    sidecar = text.is_sidecar(text.base_name(F.col("path"))) | text.is_sidecar(text.base_name(F.col("to_path")))
    drop = (F.col("path") == F.col("to_path")) | (~sidecar & ~trackable(F.col("path"), root) & ~trackable(F.col("to_path"), root))
    return rows.withColumn("route", F.when(~pair, "single").when(F.col("path") == F.col("to_path"), "drop").when(sidecar, "single").when(drop, "drop").otherwise("rename"))


def effects(events: DataFrame, root: str) -> DataFrame:
    """What each event does to which path: path, kind (upsert or remove), from_path, paired, and the event's columns.

    A pair removes its old path and upserts the new one; sidecars stand for their hosts, and
    the removal of one is a change of its host. Files need an extension; removals do not, as
    they may be of a directory.
    """
    rows = routed(events, root).where("route <> 'drop'")
    paired = F.col("route") == "rename"
    one = lambda path, kind, source: F.struct(path.alias("path"), kind.alias("kind"), source.alias("from_path"))
    none = F.lit(None).cast("string")
    alone = lambda path: one(host_of(path), F.when((F.col("kind") == "remove") & (host_of(path) == path), "remove").otherwise("upsert"), none)
    both = F.array(one(F.col("path"), F.lit("remove"), none), one(F.col("to_path"), F.lit("upsert"), F.col("path")))
    # two singles of a sidecar's rename: the old path is gone, the new one is there
    split = F.array(one(host_of(F.col("path")), F.when(host_of(F.col("path")) == F.col("path"), "remove").otherwise("upsert"), none), one(host_of(F.col("to_path")), F.lit("upsert"), none))
    made = F.when(paired, both).when(F.col("to_path").isNotNull() & (F.col("kind") == "rename"), split).otherwise(F.array(alone(F.col("path"))))
    kept = [c for c in ("ts", "event_id", "size", "modified") if c in rows.columns]
    out = rows.select(*kept, paired.alias("paired"), F.posexplode(made).alias("step", "e")).select(*kept, "paired", "step", "e.path", "e.kind", "e.from_path")
    has_extension = text.extension(text.base_name(F.col("path"))) != ""
    return out.where(trackable(F.col("path"), root) & ((F.col("kind") == "remove") | has_extension | F.col("paired")))


def tracked(events: DataFrame, root: str) -> DataFrame:
    """The events that do something to a tracked path, as effects."""
    return effects(events, root)


def net_changes(found: DataFrame, *keys: str) -> DataFrame:
    """The last effect on each path (and of each of `keys`), and how many there were. Partial sums by path."""
    last = F.struct("ts", "event_id", "step")
    carried = [c for c in ("size", "modified", "from_path", "paired") if c in found.columns]
    return found.groupBy(*keys, "path").agg(F.max_by("kind", last).alias("kind"), *(F.max_by(c, last).alias(c) for c in carried), F.count("*").alias("n_events"))


def batches(found: DataFrame, width: str = DEBOUNCE) -> DataFrame:
    """Net changes of recorded effects by tumbling windows (batch: its start), as a feed with that debounce time would see them."""
    return net_changes(found.withColumn("batch", F.window(F.col("ts").cast("timestamp"), width)["start"]), "batch")


def probed(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """path, kind, size, modified of candidates (path) by a listing (path, size, modified) of what there is.

    A file is an upsert, a directory an upsert of each file below it, anything else is gone.
    Directories are found by the ancestors of the listed files, so both are equi-joins.
    """
    asked = candidates.select("path").distinct()
    files = present.join(asked, "path", "left_semi").select("path", "size", "modified")
    inside = present.select("path", "size", "modified", F.explode(ancestors(F.col("path"))).alias("a")).join(asked.select(F.col("path").alias("a")), "a").where("path <> a")
    there = files.select(F.col("path").alias("a")).union(inside.select("a")).distinct()
    gone = asked.join(there, asked["path"] == there["a"], "left_anti").select("path", F.lit("remove").alias("kind"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("modified"))
    found = files.unionByName(inside.select("path", "size", "modified")).distinct()
    return found.select("path", F.lit("upsert").alias("kind"), "size", "modified").unionByName(gone)


# --- merging ------------------------------------------------------------------------------


def swept(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    """path and gone_path of the catalog's files at or below the removed paths (path).

    By exploding each path's ancestors (a few rows a path) and an equi-join, not by comparing
    every path with every removal.
    """
    return catalog.select("path", F.explode(ancestors(F.col("path"))).alias("gone_path")).join(gone.select(F.col("path").alias("gone_path")).distinct(), "gone_path").select("path", "gone_path")


def apply_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """catalog (path, size) after net changes: removals, of whole directories too, then upserts.

    A renamed file without a size of its own keeps that of the old path.
    """
    hit = swept(catalog, changes.where("kind = 'remove'")).select("path").distinct()
    fresh = changes.where("kind <> 'remove'")
    if "from_path" in changes.columns:
        old = catalog.select(F.col("path").alias("from_path"), F.col("size").alias("old_size"))
        fresh = fresh.join(old, "from_path", "left").withColumn("size", F.coalesce("size", "old_size"))
    fresh = fresh.select("path", "size")
    return catalog.select("path", "size").join(hit, "path", "left_anti").join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


@dataclass
class Batch:
    """What a batch made of the catalog: the new one, and the net delta."""

    catalog: DataFrame
    updated: DataFrame  # rows of the new catalog that the batch wrote, once each
    removed: DataFrame  # path; a path may be in both, removals come first
    renamed: DataFrame  # from_path, to_path, is_dir: from the batch's start to its end
    reap: DataFrame  # path: gone for good, their tags go
    moves: DataFrame  # at, path, to_path: what tags follow, in order
    rejoined: DataFrame  # from_path, to_path: files that vanished here and appeared there
    touched: DataFrame  # path: all whose row is another one, or gone, or new


def acts_of(events: DataFrame, root: str) -> DataFrame:
    """at, act (move, put, drop), path, to_path, size, modified: what the events of a batch do, in order of `at`.

    Events of one time and id go by step, then by a hash of what they are; repeated rows count
    once. Without columns size or modified these are null.
    """
    for c in ("size", "modified"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("long"))
    at = lambda step: F.struct("ts", "event_id", step.cast("int").alias("step"), F.xxhash64("kind", "path", "to_path").alias("h"))
    plain = ["path", "to_path", F.col("size").cast("long").alias("size"), F.col("modified").cast("long").alias("modified")]
    moves = routed(events, root).where("route = 'rename'").select(at(F.lit(0)).alias("at"), F.lit("move").alias("act"), *plain)
    singles = effects(events, root).where("NOT paired").withColumn("to_path", F.lit(None).cast("string"))
    singles = singles.select(at(F.col("step")).alias("at"), F.when(F.col("kind") == "remove", "drop").otherwise("put").alias("act"), *plain)
    return moves.unionByName(singles).dropDuplicates(["at"])


def apply_batch(catalog: DataFrame, events: DataFrame, root: str) -> Batch:
    """A batch of events over a catalog (path, name, extension, size, modified and more columns).

    The events count one after the other: every file is followed through the moves of its path
    and of the directories above it. It keeps its parsed columns as long as its extension is
    the same but for case; written files and those that came from elsewhere are known by size
    and time until they are read again. A move replaces what lies at its target. A file that
    vanished and one that appeared with the same name, size and time are one that moved, if
    there is one of each; if there are several, their tags stay where they are. Tags follow the
    moves in order, but not one of a file whose old path has a file again at the end (an editor
    that saves safely). Only what the events hit is looked up; what a batch needs again is
    written down once. Nothing is broadcast: both sides of the joins grow with the tables.
    """
    return delta(stored(catalog, "catalog"), events, root)


def delta(catalog: DataFrame, events: DataFrame, root: str) -> Batch:
    """apply_batch on a stored catalog: what is written down grows with the events, not with the catalog."""
    acts = stored(acts_of(events, root), "acts")
    found, folders = followed(catalog.select("path"), acts)
    written = acts.where("act = 'put'").select(F.col("at").alias("w_at"), F.col("size").alias("w_size"), F.col("modified").alias("w_modified"))
    old = catalog.select(F.col("path").alias("o_path"), F.struct(*(F.col(c) for c in catalog.columns)).alias("old"))
    asked = F.when(F.col("kind") == "put", F.col("born")).otherwise(nothing("from_path", acts.schema["at"].dataType))
    known = found.join(old.hint("merge"), (F.col("kind") == "cat") & (F.col("from_path") == F.col("o_path")), "left").join(written.hint("merge"), asked == F.col("w_at"), "left")
    known = known.withColumns({c: F.coalesce(c, F.when(F.col("keep"), F.coalesce(f"old.{c}", f"w_{c}"))) for c in ("size", "modified")}).withColumn("old", F.when(F.col("keep"), F.col("old")))
    known = stored(known, "known")
    seen = trackable(F.col("path"), root) & (text.extension(text.base_name(F.col("path"))) != "")
    last = known.where((F.col("fate") == "stay") & seen).groupBy("path").agg(F.max_by(F.struct("kind", "from_path", "own", "size", "modified", "old"), "last").alias("x")).select("path", "x.*")
    last = stored(last, "last")
    rows = last.select("path", *((F.col(c) if c in ("size", "modified") else F.col("old")[c]).alias(c) for c in catalog.columns if c != "path"))
    rows = stored(with_path(rows, F.col("path")).select(*catalog.columns), "rows")
    gone = known.where("kind = 'cat'").select(F.col("from_path").alias("path"))
    touched = stored(gone.unionByName(rows.select("path")).distinct(), "touched")
    new = catalog.join(touched.hint("merge"), "path", "left_anti").unionByName(rows)
    present = new.select("path")

    identity = ["name", "size", "modified"]
    lost = known.where("kind = 'cat' AND fate = 'drop' AND NOT own").select("path", text.base_name(F.col("path")).alias("name"), "size", "modified").join(present.hint("merge"), "path", "left_anti")
    put = last.where("kind = 'put'").select("path").join(catalog.select("path").hint("merge"), "path", "left_anti").join(known.where("fate = 'put'").select("path").hint("merge"), "path", "left_anti")
    come = rows.join(put.hint("merge"), "path", "left_semi").select("path", text.base_name(F.col("path")).alias("name"), "size", "modified")
    both = lost.groupBy(*identity).agg(F.count("*").alias("n_lost"), F.min("path").alias("from_path")).join(come.groupBy(*identity).agg(F.count("*").alias("n_come"), F.min("path").alias("to_path")).hint("merge"), identity)
    rejoined = both.where("n_lost = 1 AND n_come = 1").select("from_path", "to_path")
    reap = lost.join(both.hint("merge"), identity, "left_anti").select("path")

    held = known.where("kind = 'cat'").select(text.parent(F.col("from_path")).alias("a")).distinct().select(F.explode(above(F.col("a"))).alias("a")).distinct()
    first = folders.groupBy("from_path").agg(F.min_by(F.struct("path", "fate"), "at").alias("x")).select("from_path", F.col("x.path").alias("to_path"), F.col("x.fate").alias("fate"))
    whole = first.where((F.col("fate") == "stay") & trackable(F.col("to_path"), root) & (F.col("from_path") != F.col("to_path"))).join(held.hint("merge"), F.col("from_path") == F.col("a"), "left_semi").select("from_path", "to_path", F.lit(True).alias("is_dir"))
    pairs = last.where("own AND from_path <> path").select("from_path", F.col("path").alias("to_path")).join(present.hint("merge"), F.col("from_path") == F.col("path"), "left_anti")
    renamed = whole.unionByName(pairs.unionByName(rejoined).distinct().withColumn("is_dir", F.lit(False)))
    away = known.where("kind = 'cat' AND went_away").select(F.col("from_path").alias("path"))
    dropped = known.where("kind = 'cat' AND fate = 'drop' AND NOT went_away").select(F.col("from_path").alias("path")).join(present.hint("merge"), "path", "left_anti")
    moves = acts.where("act = 'move'").select("at", "path", "to_path").join(folders.select("at", F.lit(True).alias("folder")).hint("merge"), "at", "left").join(present.withColumn("again", F.lit(True)).hint("merge"), "path", "left")
    moves = moves.where("folder OR again IS NULL").select("at", "path", "to_path")
    return Batch(new, rows, away.unionByName(dropped).distinct(), renamed, reap, moves, rejoined, touched)


def totals(catalog: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a batch: count and bytes, files by type, and the directory tree's roll-up."""
    whole = catalog.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return whole, stats.counts(catalog, "asset_type"), stats.folder_rollup(catalog, root)


def moved_tags(bindings: DataFrame, batch: Batch) -> DataFrame:
    """path and to_path of bound paths that a batch moves, and of those whose tags go (to_path null)."""
    bound = bindings.select("path").distinct()
    went = followed_bindings(bound, batch.moves)
    again, reap = batch.rejoined.select(F.col("from_path").alias("at"), F.col("to_path").alias("again")), batch.reap.select(F.col("path").alias("reaped"))
    at = bound.join(went.select(F.col("from_path").alias("path"), F.col("to_path").alias("went")).hint("merge"), "path", "left").withColumn("at", F.coalesce("went", "path"))
    at = at.join(again.hint("merge"), "at", "left").withColumn("to_path", F.coalesce("again", "at")).join(reap.distinct().hint("merge"), F.col("to_path") == F.col("reaped"), "left")
    return at.select("path", F.when(F.col("reaped").isNull(), F.col("to_path")).alias("to_path")).where("NOT path <=> to_path")


def follow_tags(bindings: DataFrame, batch: Batch) -> DataFrame:
    """bindings (path, tag_id) after a batch: they move with its moves, one after the other, then those of files gone for good go.

    What the new path already had stays, once.
    """
    moved = moved_tags(bindings, batch).withColumn("moves", F.lit(True))
    return bindings.join(moved.hint("merge"), "path", "left").select(F.when(F.col("moves"), F.col("to_path")).otherwise(F.col("path")).alias("path"), "tag_id").where("path IS NOT NULL").distinct()


def same_epoch(events: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Events (with the root they were collected under) of the current root, and the number of the others by root."""
    now = F.col("root") == root.rstrip("/")
    return events.where(now).drop("root"), events.where(~now).groupBy("root").agg(F.count("*").alias("n_dropped"))


# --- streams ------------------------------------------------------------------------------


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind, with a watermark; ts is cast, as watermarks need a timestamp."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


@dataclass
class Counters:
    """What a feed did so far: batches merged, batches dropped (with their last error), events of other roots."""

    merged: int = 0
    dropped: int = 0
    foreign: int = 0
    last_error: str | None = None


def follow(
    events: DataFrame, catalog_dir: str, checkpoint: str, root: str, *, trigger: dict | None = None, on_delta: Callable[[DataFrame, int], None] | None = None,
    drop_failed: bool = False, counters: Counters | None = None,
) -> StreamingQuery:
    """Merges a streaming frame of events into versions of the catalog under catalog_dir.

    Every micro-batch writes the next version (v=<batch>) from the one before it, so a batch
    that is run again after a failure gives the same version. on_delta gets the net changes.
    Events with a root column count only for this root. drop_failed: a batch that fails is
    counted and left out instead of ending the query.
    """
    seen = counters if counters is not None else Counters()

    def merge(events: DataFrame, number: int) -> None:
        spark, batch = events.sparkSession, events.persist()  # its source is read once
        changes = None
        try:
            if "root" in batch.columns:
                batch, foreign = same_epoch(batch, root)
                seen.foreign += foreign.agg(F.coalesce(F.sum("n_dropped"), F.lit(0)).alias("n")).first()["n"]
            changes = net_changes(effects(batch, root)).persist()
            earlier = _version_before(spark, catalog_dir, number)
            now = earlier if earlier is not None else spark.createDataFrame([], "path string, size long")
            apply_changes(now, changes).write.mode("overwrite").parquet(f"{catalog_dir}/v={number}")
            if on_delta is not None:
                on_delta(changes, number)
            seen.merged += 1
        finally:
            if changes is not None:
                changes.unpersist()
            events.unpersist()

    def step(batch: DataFrame, number: int) -> None:
        try:
            merge(batch, number)
        except Exception as e:
            if not drop_failed:
                raise
            seen.dropped += 1
            seen.last_error = str(e)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def bucket_of(path: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")


def _patched(spark: SparkSession, where: str, number: int, table: DataFrame, gone: DataFrame, rows: DataFrame, held: dict) -> None:
    """The table without the rows of the paths `gone`, and with `rows`: only the buckets of these paths are written."""
    n = held["n_buckets"]
    paths = gone.select("path").unionByName(rows.select("path")).distinct()
    dirty = [r[0] for r in paths.select(bucket_of(F.col("path"), n).alias("b")).distinct().collect()]  # n_buckets at most
    mine = table.withColumn("_bucket", bucket_of(F.col("path"), n)).where(F.col("_bucket").isin(dirty)).join(gone.hint("merge"), "path", "left_anti")
    extra = {k: v for k, v in held.items() if k not in ("folders", "schema")}
    versioned.replace_buckets(mine.unionByName(rows.withColumn("_bucket", bucket_of(F.col("path"), n))).distinct(), where, dirty, **{**extra, "batch": number})


def merge_batch(spark: SparkSession, events: DataFrame, number: int, where: str, root: str, tags_where: str | None = None) -> Batch | None:
    """One batch of a feed merged into the versioned catalog at `where`, and into the bindings (path, tag_id) at tags_where.

    Renames count in sequence, tags follow. Bytes are written for the buckets that the batch
    touches. The version keeps the batch's number: one that is there already is left out, so
    a batch that is run again changes nothing. Tags are written first; if the job ends in
    between, the next run does the rest.
    """
    held = versioned.current(spark, where)
    if held is None:
        raise ValueError(f"no catalog at {where}: scan first")
    if held.get("batch", -1) >= number:
        return None
    catalog = versioned.read(spark, where, held)
    batch = delta(catalog, events, root)
    tags_held = versioned.current(spark, tags_where) if tags_where else None
    if tags_held is not None and tags_held.get("batch", -1) < number:
        bindings = versioned.read(spark, tags_where, tags_held)
        moved = stored(moved_tags(bindings, batch), "moved-tags")
        came = bindings.join(moved.where("to_path IS NOT NULL").hint("merge"), "path").select(F.col("to_path").alias("path"), "tag_id")
        _patched(spark, tags_where, number, bindings, moved.select("path"), came, tags_held)
    _patched(spark, where, number, catalog, batch.touched, batch.updated, held)
    return batch


def follow_catalog(
    events: DataFrame, where: str, checkpoint: str, root: str, *, tags_where: str | None = None, trigger: dict | None = None, on_batch: Callable[[Batch, int], None] | None = None,
) -> StreamingQuery:
    """Keeps the catalog that rescan wrote at `where`, and its tags, up to date with a streaming frame of events.

    on_batch gets what each batch made, once its version holds.
    """

    def step(frame: DataFrame, number: int) -> None:
        rows = stored(frame, "events")
        mine = same_epoch(rows, root)[0] if "root" in rows.columns else rows
        batch = merge_batch(rows.sparkSession, mine, number, where, root, tags_where)
        if batch is not None and on_batch is not None:
            on_batch(batch, number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def settled(found: DataFrame, gap: str = DEBOUNCE, late: str | None = None) -> DataFrame:
    """path, start, end, kind, n_events: the bursts of effects on each path, over once more than `gap` passes without another one.

    A burst ends `gap` after its last effect, whose kind it has. On a stream, with late: a
    watermark; bursts come out when it has passed their end, and effects behind it are left
    out and counted by the query's listener (numRowsDroppedByWatermark).
    """
    timed = found.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if late else timed
    order = F.struct("ts", "event_id", "step")
    bursts = timed.groupBy("path", F.session_window("at", gap).alias("w")).agg(F.max_by("kind", order).alias("kind"), F.count("*").alias("n_events"))
    return bursts.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n_events")


class FeedListener(StreamingQueryListener):
    """Adds up what feeds did, by query id, and keeps it as a JSON file in the shared folder: counts go on after a restart.

    batches, rows, late (dropped behind the watermark), failures, and milliseconds by phase of
    the batches. A query id is its checkpoint's, so a restarted query goes on with its counts.
    """

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where
        self.counts: dict[str, dict] = {}

    def _of(self, query_id) -> dict:
        key = str(query_id)
        if key not in self.counts:
            body = text_file(self.spark, f"{self.where}/{key}.json")
            self.counts[key] = json.loads(body) if body else {"batches": 0, "rows": 0, "late": 0, "failures": 0, "last_batch": -1, "last_error": None, "milliseconds": {}}
        return self.counts[key]

    def _keep(self, query_id) -> None:
        put_text(self.spark, f"{self.where}/{query_id}.json", json.dumps(self._of(query_id)))

    def onQueryStarted(self, event) -> None:
        self._of(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        mine = self._of(p.id)
        if p.batchId <= mine["last_batch"]:
            return  # the same batch again, after a failure
        mine["batches"], mine["rows"], mine["last_batch"] = mine["batches"] + 1, mine["rows"] + p.numInputRows, p.batchId
        mine["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        for phase, ms in p.durationMs.items():
            mine["milliseconds"][phase] = mine["milliseconds"].get(phase, 0) + ms
        self._keep(p.id)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            mine = self._of(event.id)
            mine["failures"], mine["last_error"] = mine["failures"] + 1, str(event.exception)[:500]
            self._keep(event.id)


def progress(query: StreamingQuery) -> list[dict]:
    """The query's recent batches: number, rows, rows a second, milliseconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"], "milliseconds": p["batchDuration"]} for p in query.recentProgress]


def _version_before(spark: SparkSession, catalog_dir: str, number: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(catalog_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith("v=")]
    before = [n for n in done if n < number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{catalog_dir}/v={n}/_SUCCESS"))]
    return spark.read.schema("path string, size long").parquet(f"{catalog_dir}/v={max(before)}") if before else None


def replay_counts(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """window_counts of a finite stream, run to its end; what its sink holds then."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={number}")

    query = window_counts(stream).writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{out}/v={last}")
