"""Undo history, request costs and the suggestion cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import stored
from .prefix import running

REQUEST_ASSETS, ASSET_TOKENS, PROMPT_TOKENS, CHARS_PER_TOKEN = 20, 150, 60, 4


def undo_batches(ops: DataFrame) -> DataFrame:
    """Batches of ops (batch_id, op_ord, undone): n_ops, whether all are undone; partial sums only."""
    return ops.groupBy("batch_id").agg(F.count("*").alias("n_ops"), F.bool_and("undone").alias("undone"))


def undo_head(ops: DataFrame) -> DataFrame:
    """The newest batch that is not undone, alone."""
    return undo_batches(ops).where("NOT undone").orderBy(F.desc("batch_id")).limit(1)


def kept_batches(ops: DataFrame, most: int = 50) -> DataFrame:
    """The newest `most` batches."""
    return undo_batches(ops).orderBy(F.desc("batch_id")).limit(most)


def request_cost(requests: DataFrame, prices: DataFrame, shared_tokens: int) -> DataFrame:
    """request_id, input_tokens, output_tokens, cents (rounded up) of tagging requests.

    requests: request_id, model, n_assets, image_tokens (of one asset). The shared prompt is
    paid for every 20 assets. prices: model, input_per_m, output_per_m in micro-dollars per
    million tokens; a model without a price costs nothing and has no tokens.
    """
    known = requests.join(prices, "model", "left")
    n = F.col("n_assets")
    chunks = F.greatest(F.floor((n + REQUEST_ASSETS - 1) / REQUEST_ASSETS), F.lit(1))
    known = known.withColumns({"i": F.when(F.col("input_per_m").isNull(), 0).otherwise(chunks * shared_tokens + n * (F.col("image_tokens") + PROMPT_TOKENS)).cast("long"), "o": F.when(F.col("input_per_m").isNull(), 0).otherwise(n * ASSET_TOKENS).cast("long")})
    micros = F.expr("coalesce(i * input_per_m div 1000000, 0) + coalesce(o * output_per_m div 1000000, 0)")
    return known.select("request_id", F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.floor((micros + 9999) / 10000).cast("long").alias("cents"))


def cache_split(requests: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """path, key (SHA-256 over the parts, joined by NUL) and whether the cache (key) has it."""
    key = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)
    return requests.select("path", key.alias("key")).join(cache.select(F.col("key").alias("c")).distinct(), F.col("key") == F.col("c"), "left").select("path", "key", F.col("c").isNotNull().alias("hit"))


def lenient_json(raw: str, schema: str):
    """A reply as a struct: the text itself if it is JSON, else its first fenced block; null otherwise."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.try_parse_json(F.col(raw)).isNotNull(), F.col(raw)).otherwise(fenced)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def chunks(rows: DataFrame, *order: str, size: int = REQUEST_ASSETS) -> DataFrame:
    """rows with chunk (from 0): consecutive rows of the order, `size` each.

    Row numbers by range partition and the number of rows before it, not by one global window.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(before, "_part").withColumn("chunk", F.expr(f"(_before + _place) div {size}")).drop("_part", "_place", "_before")


def miss_chunks(split: DataFrame, size: int = REQUEST_ASSETS) -> DataFrame:
    """The requests of cache_split that the cache does not have, in chunks by path."""
    return chunks(split.where("NOT hit").select("path", "key"), "path", size=size)


def paired(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """requests (path, ...) with what the replies (path, reply) say of the same path; order and number of the replies do not matter."""
    one = replies.groupBy("path").agg(F.min("reply").alias("reply"))
    return requests.join(one, "path", "left")


def image_tokens(pixels: Column, rule: str) -> Column:
    """Tokens of an image by a model's rule: none, flat (85), or area (a token for each 750 pixels, 1600 at most)."""
    return {"none": F.lit(0), "flat": F.lit(85), "area": F.least(F.ceil(pixels / 750), F.lit(1600)).cast("int")}[rule]


def prompts(assets: DataFrame, tags: DataFrame, used: DataFrame, context: str, most_samples: int = 5) -> DataFrame:
    """chunk and prompt: the context, a line a tag, and a line an asset of each chunk (path, chunk and line of it).

    tags: name, description. A tag without a description shows up to five paths that carry it
    (used: name, path). Tags are few, chunks have a fixed size: nothing grows but the number
    of prompts.
    """
    if tags.count() > 10_000:
        raise ValueError("over 10000 tags")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    some = used.distinct().withColumn("r", rank).where(F.col("r") <= most_samples).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths"))
    shown = tags.join(some, "name", "left").select("name", F.concat(F.lit("- "), F.col("name"), F.coalesce(F.concat(F.lit(": "), F.when(F.trim("description") != "", F.col("description"))), F.concat(F.lit(" (e.g. "), F.col("paths"), F.lit(")")), F.lit(""))).alias("line"))
    listed = shown.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda x: x["line"]), "\n").alias("tags"))
    bodies = assets.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("assets"))
    return bodies.join(F.broadcast(listed), F.lit(True)).select("chunk", F.concat_ws("\n\n", F.lit(context), "tags", "assets").alias("prompt"))


def free_copy_name(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """path and copy: the first of `x copy`, `x copy 2`, ... beside each path that nothing has.

    Directory, stem and number are read off each existing name, so the join is by directory,
    stem and extension, not by directory. The first gap is where a number and its rank part;
    ranks are running counts over ranges, so neither a directory nor a stem is one task's.
    """
    name = text.base_name(F.col("path"))
    key = ["d", "stem", "dot"]
    asked = wanted.select("path").distinct().select("path", text.parent(F.col("path")).alias("d"), text.stem(name).alias("stem"), text.dotted_extension(name).alias("dot"))
    beside = existing.select(text.parent(F.col("path")).alias("d"), F.regexp_extract(text.stem(name), r"^(?s)(.*) copy(?: [1-9][0-9]*)?$", 1).alias("stem"), text.dotted_extension(name).alias("dot"), text.stem(name).alias("whole"))
    tail = F.expr("substring(whole, length(stem) + 6)")
    number = F.when(tail == "", F.lit(1).cast("long")).otherwise(F.trim(tail).try_cast("long"))
    taken = beside.where(F.col("whole").rlike(r"(?s) copy(?: [1-9][0-9]*)?$")).withColumn("k", number).where((F.col("k") > 1) | (tail == "")).select(*key, "k")
    taken = taken.join(asked.select(*key).distinct(), key, "left_semi").distinct()
    ranked = running(taken, key, [F.col("k")], {"r": F.lit(1).cast("long")})
    free = ranked.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("k") != F.col("r"), F.col("r"))), F.max("r") + 1).alias("k"))
    at = F.coalesce("k", F.lit(1).cast("long"))
    made = F.concat("d", F.lit("/"), "stem", F.lit(" copy"), F.when(at > 1, F.concat(F.lit(" "), at.cast("string"))).otherwise(""), "dot")
    return asked.join(free, key, "left").select("path", made.alias("copy"))
