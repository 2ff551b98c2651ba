"""Statistics and roll-ups over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .prefix import running

#: Half-open size classes: the first bound above the size names it.
SIZE_CLASSES = ((1 << 10, "<1KB"), (10 << 10, "1-10KB"), (100 << 10, "10-100KB"), (1 << 20, "100KB-1MB"), (10 << 20, "1-10MB"))


def counts(assets: DataFrame, *keys: str) -> DataFrame:
    """Files and bytes by the keys."""
    return assets.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("total_size"))


def size_class(size: Column) -> Column:
    out = F.lit(">10MB")
    for bound, name in reversed(SIZE_CLASSES):
        out = F.when(size < bound, name).otherwise(out)
    return out


def size_histogram(assets: DataFrame) -> DataFrame:
    return assets.groupBy(size_class(F.col("size")).alias("size_class")).agg(F.count("*").alias("n"))


def largest(assets: DataFrame, k: int = 10) -> DataFrame:
    """The k largest files, ties in catalog order."""
    return assets.orderBy(F.desc("size"), F.lower("path"), "path").limit(k).select("path", "size")


def top_extensions(assets: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent extensions as written, ties by name."""
    return counts(assets, "extension").orderBy(F.desc("n"), "extension").limit(k)


def type_shares(assets: DataFrame) -> DataFrame:
    """Types by number of files, with their share in percent (two decimals); the window is over the few types only."""
    by_type = counts(assets, "asset_type")
    total = F.greatest(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return by_type.select("asset_type", "n", F.round(F.col("n") * 100 / total, 2).alias("percent")).orderBy(F.desc("n"), "asset_type")


def folder_rollup(assets: DataFrame, root: str, folders: DataFrame | None = None) -> DataFrame:
    """Every directory from root down with all files below it: path, depth, n_files, total_size.

    folders: further directories (path) that may hold no file. Files are summed by their own
    directory first, so what is exploded over ancestors is one row a directory, not a file.
    """
    direct = counts(assets, "dir").withColumnsRenamed({"n": "n_files", "dir": "path"})
    if folders is not None:
        direct = direct.unionByName(folders.select("path", F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("total_size")))
    parts, least = F.split("path", "/", -1), len(root.rstrip("/").split("/"))
    inside = direct.where((F.col("path") == root.rstrip("/")) | F.col("path").startswith(root.rstrip("/") + "/"))
    above = F.transform(F.sequence(F.lit(least), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = inside.select(F.explode(above).alias("path"), "n_files", "total_size")
    return rows.groupBy("path").agg(F.sum("n_files").alias("n_files"), F.sum("total_size").alias("total_size")).withColumn("depth", F.size(F.split("path", "/", -1)) - least)


def vertex_scale(assets: DataFrame) -> DataFrame:
    """The largest vertex count, 1 at least."""
    return assets.agg(F.greatest(F.coalesce(F.max("metadata.vertex_count"), F.lit(0)), F.lit(1)).alias("max_vertices"))


def evicted(files: DataFrame, budget: int, *, buckets: int | None = None) -> DataFrame:
    """The oldest files (path, size, modified) that must go for the total to fit the budget.

    A running total in order of time and path over `buckets` ranges, so files of one time are
    no task's alone. Files without a time count in the total and stay; a null size counts 0.
    """
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    aged = files.where("modified IS NOT NULL").select("path", "size", "modified")
    size = F.coalesce("size", F.lit(0))
    placed = running(aged, [], [F.col("modified"), F.col("path")], {"upto": size}, ranges=buckets)
    return placed.join(F.broadcast(total), F.lit(True)).where(F.col("total") - (F.col("upto") - size) > budget).select("path", "size", "modified")


def report_rows(assets: DataFrame) -> DataFrame:
    """The catalog as lines of a CSV file with guarded cells."""
    side = lambda c: F.coalesce(F.col(f"metadata.{c}").cast("string"), F.lit(""))
    cells = [F.col("path"), F.col("name"), text.capitalised(F.col("asset_type")), F.col("extension"), F.col("size"), side("width"), side("height")]
    return assets.select("path", F.concat_ws(",", *map(text.csv_cell, cells)).alias("line"))


def scan_json(assets: DataFrame) -> DataFrame:
    """path and json of each asset, null fields left out: the lines of a JSON export."""
    return assets.select("path", F.to_json(F.struct(*(F.col(c) for c in assets.columns))).alias("json"))


def scan_summary_json(assets: DataFrame, root: str) -> DataFrame:
    """One row: the head of a JSON export (root, count, bytes, files by type). The few types are gathered, no assets."""
    kinds = counts(assets, "asset_type").agg(F.sort_array(F.collect_list(F.struct("asset_type", "n", "total_size"))).alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"))
    by_type = F.map_from_entries(F.transform("types", lambda t: F.struct(t["asset_type"], t["n"])))
    return kinds.select(F.to_json(F.struct(F.lit(root).alias("root_path"), "total_count", "total_size", by_type.alias("type_counts"))).alias("json"))


def issues_json(issues: DataFrame) -> DataFrame:
    """asset_path, rule_id and json of each issue, null fields left out."""
    return issues.select("asset_path", "rule_id", F.to_json(F.struct(*(F.col(c) for c in issues.columns))).alias("json"))


def localised(issues: DataFrame, templates: DataFrame) -> DataFrame:
    """issues (rule_id, args, message) with title and message by templates (key, value).

    `<rule>.title` and `<rule>.message` are filled from args; an age unit among these is named
    by `duration.<unit>` first. Without a template the rule's id and the message stay. The
    templates are one language's texts; their number is checked before they are sent to every task.
    """
    if templates.count() > 10_000:
        raise ValueError("over 10000 templates")
    one = F.broadcast(templates.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("texts")))
    rows = issues.join(one, F.lit(True))
    noun = F.try_element_at("texts", F.concat(F.lit("duration."), F.try_element_at("args", F.lit("age_unit"))))
    args = F.when(noun.isNotNull(), F.transform_values("args", lambda k, v: F.when(k == "age_unit", noun).otherwise(v))).otherwise(F.col("args"))
    pick = lambda field, plain: F.coalesce(text.render(F.try_element_at("texts", F.concat("rule_id", F.lit(f".{field}"))), args), F.col(plain))
    return rows.withColumns({"title": pick("title", "rule_id"), "message": pick("message", "message")}).drop("texts")


def html_report(assets: DataFrame, issues: DataFrame, *, max_issues: int = 100, max_assets: int = 500, unread: int = 0, ignore_failed: bool = False) -> DataFrame:
    """An HTML page as rows (part, ord, html), to be written in order of part and ord; 0: all rows.

    Cards of the types, bytes by type, files with and without issues, a banner if the scan is
    incomplete, the first issues and assets. The page is never gathered: lists are sorted
    rows, whatever their length.
    """
    from .analysis import pass_count

    spark = assets.sparkSession
    line = lambda cells, tag="td": F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit(f"<{tag}>"), text.html_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit(f"</{tag}>"))), F.lit("</tr>"))
    first = lambda df, n: df.limit(n) if n else df
    none = F.struct(F.lit("").alias("a"), F.lit("").alias("b"))

    def head(part: int, title: str, names: tuple[str, ...]) -> DataFrame:
        body = f"<h2>{title}</h2><table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
        return spark.range(1).select(F.lit(part).alias("part"), none.alias("ord"), F.lit(body).alias("html"))

    def rows(part: int, df: DataFrame, cells: list, a, b) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.struct(a.cast("string").alias("a"), b.cast("string").alias("b")).alias("ord"), line(cells).alias("html"))

    human = text.human_size(F.col("total_size"))
    kinds = counts(assets, "asset_type")
    by_size = F.format_string("%020d", F.lit(10**18).cast("long") - F.col("total_size"))
    by_count = F.format_string("%020d", F.lit(10**18).cast("long") - F.col("n"))
    banner = f"<p>Incomplete scan: {unread} entries unread{', ignore rules unusable' if ignore_failed else ''}</p>" if unread or ignore_failed else ""
    passed = pass_count(assets, issues).select(F.lit(0).alias("part"), none.alias("ord"), F.concat(F.lit(f"<!doctype html><meta charset=utf-8><h1>Assets</h1>{banner}<p>"), F.col("passed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" files without issues</p>")).alias("html"))
    listed = first(assets.orderBy(F.lower("path"), "path"), max_assets)
    found = first(issues.orderBy("rule_id", F.lower("asset_path"), "asset_path"), max_issues)
    parts = [
        passed,
        head(1, "Types", ("type", "files")), rows(2, kinds, [text.capitalised(F.col("asset_type")), F.col("n")], by_count, F.col("asset_type")),
        head(3, "Size by type", ("type", "size")), rows(4, kinds, [text.capitalised(F.col("asset_type")), human], by_size, F.col("asset_type")),
        head(5, "Issues", ("rule", "severity", "path")), rows(6, found, [F.col("rule_id"), F.col("severity"), F.col("asset_path")], F.col("rule_id"), F.lower("asset_path")),
        head(7, "Files", ("path", "type", "size")), rows(8, listed, [F.col("path"), F.col("asset_type"), text.human_size(F.col("size"))], F.lower("path"), F.col("path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def warnings_by_kind(warnings: DataFrame, k: int = 5) -> DataFrame:
    """kind, n, sample (the first k paths in order) and the first path's detail. A top-k by kind, cut down before it is shuffled."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("path"))
    first = warnings.select("kind", "path").distinct().withColumn("r", rank).where(F.col("r") <= k).groupBy("kind").agg(F.array_sort(F.collect_list("path")).alias("sample"))
    return warnings.groupBy("kind").agg(F.count("*").alias("n"), F.min_by("detail", "path").alias("detail")).join(first, "kind").select("kind", "n", "sample", "detail")
