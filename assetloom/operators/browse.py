"""Browsing: conjunctive filters, sorts and pick lists over the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

ART_TYPES = ("texture", "model", "audio", "video", "prefab", "scene", "material", "animation")


@dataclass(frozen=True)
class FilterSpec:
    """Every field that is set must hold. Ranges include their ends; a null never lies in one."""

    folder: str | None = None
    search: str = ""
    types: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    size: tuple[int | None, int | None] = (None, None)
    width: tuple[int | None, int | None] = (None, None)
    height: tuple[int | None, int | None] = (None, None)
    vertex_count: tuple[int | None, int | None] = (None, None)
    face_count: tuple[int | None, int | None] = (None, None)
    duration_secs: tuple[float | None, float | None] = (None, None)
    has_alpha: bool | None = None
    color_space: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.folder is not None:
            out &= (F.col("dir") == self.folder) | F.col("path").startswith(self.folder.rstrip("/") + "/")
        needle = self.search.strip().lower()
        if needle:
            out &= F.lower("name").contains(needle) | F.lower("path").contains(needle)
        if self.types:
            out &= F.col("asset_type").isin(*self.types)
        if self.extensions:
            out &= F.lower("extension").isin(*self.extensions)
        for name in ("size", "width", "height", "vertex_count", "face_count", "duration_secs"):
            low, high = getattr(self, name)
            value = F.col(name if name == "size" else f"metadata.{name}")
            if low is not None:
                out &= value >= low
            if high is not None:
                out &= value <= high
        if self.has_alpha is not None:
            out &= F.col("metadata.has_alpha") == self.has_alpha
        if self.color_space is not None:
            out &= F.col("metadata.color_space") == self.color_space
        return out


def browse(assets: DataFrame, spec: FilterSpec) -> DataFrame:
    return assets.where(spec.condition())


def with_all_tags(assets: DataFrame, bindings: DataFrame, tags: list[str]) -> DataFrame:
    """The assets that carry every one of the tags. bindings: path, tag."""
    wanted = sorted(set(tags))
    if not wanted:
        return assets
    whole = bindings.where(F.col("tag").isin(*wanted)).groupBy("path").agg(F.count_distinct("tag").alias("c")).where(F.col("c") == len(wanted))
    return assets.join(whole.select("path"), "path", "left_semi")


def with_status(assets: DataFrame, statuses: DataFrame, wanted: list[str]) -> DataFrame:
    """The assets with one of the version-control statuses; those without a row never match."""
    return assets.join(statuses.where(F.col("status").isin(*wanted)).select("path"), "path", "left_semi")


def status_rollup(statuses: DataFrame) -> DataFrame:
    """Changes in four kinds and in total, ignored files left out."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return statuses.agg(n("new", "untracked").alias("added"), n("modified", "renamed", "typechange").alias("modified"), n("deleted").alias("deleted"), n("conflicted").alias("conflicted"), F.count_if(F.col("status") != "ignored").alias("total"))


def status_of(flags: dict[str, Column]) -> Column:
    """One status from flags, the strongest first."""
    out = F.lit(None).cast("string")
    for name in reversed(("conflicted", "new", "untracked", "modified", "deleted", "renamed", "typechange", "ignored")):
        if name in flags:
            out = F.when(flags[name], F.lit(name)).otherwise(out)
    return out


def sort_value(key: str) -> Column:
    """A sort key by name; missing metadata sorts as 0, dimensions as their product."""
    zero = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(0))
    plain = {"name": F.collate(F.col("name"), "UNICODE"), "type": F.collate(F.col("asset_type"), "UNICODE"), "extension": F.collate(F.col("extension"), "UNICODE"), "size": F.col("size"), "modified": F.col("modified"), "dimensions": zero("width") * zero("height"), "vertices": zero("vertex_count"), "faces": zero("face_count"), "duration": zero("duration_secs")}
    return plain[key]


def sorted_by(assets: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """The catalog by a key, ties in catalog order both ways. A range-partitioned sort."""
    v = sort_value(key)
    return assets.orderBy(v.desc() if descending else v.asc(), F.lower("path"), "path")


def pick_list(assets: DataFrame, column: str) -> DataFrame:
    value = F.lower("extension") if column == "extension" else F.col(column)
    return assets.select(value.alias("value")).distinct().orderBy("value")


def palette(assets: DataFrame, needle: str, k: int = 50) -> DataFrame:
    """The first k matches of a search in catalog order."""
    return browse(assets, FilterSpec(search=needle)).orderBy(F.lower("path"), "path").limit(k).select("path", "name")


def shown_path(assets: DataFrame, root: str) -> DataFrame:
    return assets.select("path", text.relative_path(F.col("path"), root).alias("shown"))


def recent(visits: DataFrame, k: int = 12) -> DataFrame:
    """The k values (value, at) last seen, newest first: value, last_at."""
    return visits.groupBy("value").agg(F.max("at").alias("last_at")).orderBy(F.desc("last_at"), "value").limit(k)
