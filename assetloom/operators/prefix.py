"""Running totals over ranges: no task sees more than a range, however many rows one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored


def ranged(rows: DataFrame, keys: list, n: int) -> DataFrame:
    """rows cut into n ranges of the keys and stored, with _range; rows of equal keys, too, are dealt out (_tie)."""
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    return stored(rows.repartitionByRange(n, *keys, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], *, ranges: int | None = None) -> DataFrame:
    """rows with, for each name of sums, the total of its column over the rows of the same `by` up to this one.

    The rows are cut into ranges of (by, order), which are summed by themselves; what the
    ranges before hold of a key is added. Only keys that lie in several ranges have such a part:
    at most one such key a border, so that side is at most twice the number of ranges and is
    sent to all. Null keys are a key. Rows that tie in the order are summed in any order, also
    over several ranges. ranges: the session's shuffle partitions, unless told.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    mine = [f"_sum_{name}" for name in sums]
    rows = rows.withColumns(dict(zip(mine, sums.values(), strict=True)))
    cut = ranged(rows, [*by, *order], n)
    totals = cut.groupBy("_range", *by).agg(*(F.sum(m).alias(m) for m in mine))
    spread = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # the keys of several ranges first, by partial aggregates: the window below sees those alone
    wide = totals.groupBy(*by).agg(F.max("_range").alias("_last"), F.min("_range").alias("_first")).where("_last > _first")
    same = F.lit(True)
    for b in by:
        same = same & totals[b].eqNullSafe(wide[b])
    some = totals.join(F.broadcast(wide), same, "left_semi")
    before = spread.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = some.select(F.col("_range").alias("_at"), *(F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)), *(F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_before") for m in mine))
    inside = Window.partitionBy("_range", *by).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    meet = F.col("_range") == F.col("_at")
    for i, b in enumerate(by):
        meet = meet & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
    local = cut.withColumns({m: F.sum(m).over(inside) for m in mine})
    whole = local.join(F.broadcast(carried), meet, "left")
    keep = [c for c in rows.columns if c not in mine and c not in sums]
    return whole.select(*keep, *((F.col(m) + F.coalesce(F.col(f"{m}_before"), F.lit(0))).alias(name) for name, m in zip(sums, mine, strict=True)))
