"""The whole analysis: every rule's issues, and summaries of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.config import RuleConfig
from ..sources.storage import stored
from . import cross, rules

#: Order in which the parts of an analysis report.
PHASES = ("asset", "duplicate", "missing_reference", "pbr_set", "dcc_source")


def _issues(rows: DataFrame, rule_id: str, severity: str, path: str, related: Column | None = None, **args: Column) -> DataFrame:
    pairs = [x for k, v in args.items() for x in (F.lit(k), v.cast("string"))]
    related = F.array().cast("array<string>") if related is None else related
    return rows.select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(False).alias("auto_fixable"), F.col(path).alias("asset_path"), related.alias("related_paths"), F.create_map(*pairs).alias("args"))


def analyse(assets: DataFrame, c: RuleConfig = RuleConfig(), *, root: str = "/", files: DataFrame | None = None, refs: DataFrame | None = None, known: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """All issues with their phase. Parts whose input is not given report nothing.

    Ignored assets have no issues of their own and take no part in sets, but their guids still
    count as known. A duplicate issue names the original and the first copy; the whole group is
    in cross.duplicate_members, a row a copy. The catalog is written down once, as every part
    reads it; files may have hashes of their own (fsscan.duplicates). Nothing is collected.
    """
    seen = stored(rules.not_ignored(assets, c.ignore, root), "catalog")
    parts = [(0, rules.asset_issues(seen, c))]
    if c.duplicate and files is not None:
        groups = cross.duplicates(rules.not_ignored(files, c.ignore, root))
        related = F.transform(F.array("original", "anchor"), lambda p: text.relative_path(p, root))
        parts.append((1, _issues(groups, "duplicate", "warning", "anchor", related, count=F.col("n"))))
    if c.missing_reference and refs is not None and known is not None and packages is not None:
        sources = rules.not_ignored(refs.withColumnRenamed("src_path", "path"), c.ignore, root).withColumnRenamed("path", "src_path")
        parts.append((2, _issues(cross.missing_references(sources, known, packages), "missing_reference", "warning", "src_path", guid=F.col("guid"))))
    if c.pbr_set.enabled:
        sets = cross.pbr_sets(seen, c.pbr_set).where("NOT complete")
        parts.append((3, _issues(sets, "pbr_set.incomplete", "warning", "anchor", set=F.col("display"), missing=F.array_join("missing", ", "))))
    if c.dcc_source.enabled:
        stale = cross.stale_exports(seen, c.dcc_source)
        age = text.age(F.col("age_secs"))
        parts.append((4, _issues(stale, "dcc_source.outdated_export", "warning", "source", F.array("export"), age=age, age_n=F.regexp_extract(age, "^[0-9]+", 0), age_unit=F.substring(age, -1, 1))))
    return reduce(DataFrame.unionByName, (p.withColumn("phase", F.lit(n)) for n, p in parts))


def summary(issues: DataFrame) -> DataFrame:
    """Issues by rule and severity, and in total (both null)."""
    return issues.rollup("rule_id", "severity").agg(F.count("*").alias("n"), F.sum(F.col("auto_fixable").cast("long")).alias("n_fixable")).where("grouping(severity) = 0 OR grouping(rule_id) = 1")


def pass_count(assets: DataFrame, issues: DataFrame) -> DataFrame:
    """total assets, assets with issues, and the rest (0 at least)."""
    total = assets.agg(F.count("*").alias("total"))
    bad = issues.agg(F.count_distinct("asset_path").alias("with_issues"))
    return total.join(F.broadcast(bad), F.lit(True)).withColumn("passed", F.greatest(F.col("total") - F.col("with_issues"), F.lit(0)))  # one row each


def by_rule(issues: DataFrame) -> DataFrame:
    """Each rule with the number of its issues and of its distinct assets."""
    return issues.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("asset_path").alias("n_assets"), F.min("asset_path").alias("first_path"))


def in_group_order(issues: DataFrame, assets: DataFrame) -> DataFrame:
    """issues with ord: the order within their rule's group, by phase, then by the catalog's order of the asset.

    A value to sort by (rule_id, ord), not a row number, so no group is gathered.
    """
    return issues.withColumn("ord", F.struct("phase", F.lower("asset_path").alias("low"), "asset_path"))


def groups_in_order(issues: DataFrame) -> DataFrame:
    """The issues by rule, and in each rule in order; a range-partitioned sort."""
    return issues.orderBy("rule_id", "phase", F.lower("asset_path"), "asset_path")


def pruned(issues: DataFrame, gone: DataFrame) -> DataFrame:
    """issues without the duplicate groups of the given anchors (asset_path); summaries are counted from what is left."""
    hit = gone.select(F.col("asset_path").alias("gone_path")).distinct()
    return issues.join(hit, (F.col("asset_path") == F.col("gone_path")) & (F.col("rule_id") == "duplicate"), "left_anti")


def first_and_rest(rows: DataFrame, *order: Column | str, k: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first k rows in order, and one row with the number of the others."""
    rest = rows.agg(F.greatest(F.count("*") - F.lit(k), F.lit(0).cast("long")).alias("n_more"))
    return rows.orderBy(*order).limit(k), rest


def collapse_groups(issues: DataFrame) -> DataFrame:
    """Group issues once each: one row for each first related path, the first by asset path."""
    one = issues.where(F.size("related_paths") > 0).groupBy(F.get("related_paths", F.lit(0)).alias("head")).agg(F.min_by(F.struct(*issues.columns), "asset_path").alias("i"))
    return one.select("i.*")
