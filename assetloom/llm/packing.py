"""Operator 10: best-fit packing of token pieces into sequences of a fixed capacity.

Lengths are small integers, so the packing is planned on the histogram of piece lengths
(at most `capacity` rows, whatever the corpus): pieces above a third of the capacity are
matched greedily, two a sequence at most; smaller ones fill the remaining gaps best-fit,
in descending length. The plan is a list of runs, each placing a range of a length's ranks;
Spark ranks the pieces within their lengths and looks their places up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import byte_slices, stored, table

RUNS = "length int, rank_from long, rank_to long, first_sequence long, per_sequence int, at int"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, first_sequence, per_sequence, at) that place all pieces.

    Each step uses up a length or a run of equal sequences, and a sequence holds at most
    about sqrt(2 * capacity) different lengths, so the plan is bounded by the capacity.
    """
    left = {k: v for k, v in counts.items() if v and k}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    made = 0

    def put(length: int, first: int, sequences: int, each: int, at: int) -> None:
        runs.append((length, used[length], used[length] + sequences * each, first, each, at))
        used[length] += sequences * each
        left[length] -= sequences * each
        if not left[length]:
            del left[length]

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if a not in left:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - a)
        while k and large[k - 1] not in left:
            large.pop(k - 1)
            k -= 1
        b = large[k - 1] if k else None
        if b == a and left[a] > 1:
            n = left[a] // 2
            put(a, made, n, 2, 0)
            gaps[capacity - 2 * a].append((made, n))
        elif b is not None and b != a:
            n = min(left[a], left[b])
            put(a, made, n, 1, 0)
            put(b, made, n, 1, a)
            gaps[capacity - a - b].append((made, n))
        else:
            n = 1 if b == a else left[a]
            put(a, made, n, 1, 0)
            gaps[capacity - a].append((made, n))
        made += n
    order = sorted(gaps)
    for length in sorted(left, reverse=True):
        while length in left:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first, n = capacity, made, -(-left[length] // (capacity // length))
                made += n
            each = min(gap // length, left[length])
            full = min(n, left[length] // each)
            put(length, first, full, each, capacity - gap)
            rest = [(gap - each * length, first, full), (gap, first + full, n - full)]
            for g, f, m in rest:
                if m and g:
                    if g not in gaps:
                        bisect.insort(order, g)
                    gaps[g].append((f, m))
    return runs


def token_pieces(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", capacity: int = 2048, end_id: int = 0, vocabulary: str = tokens.DEFAULT, with_ids: bool = False) -> DataFrame:
    """The pieces of each row's ids and the end id: doc_id, piece, start, length, ids_crc32 (and ids).

    Only documents longer than the capacity are cut; their first piece is the shorter one.
    Null and empty text: one piece, the end id alone.
    """

    def cut(batches):
        enc = tokens.encoder(vocabulary)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*(enc.ids(text) if text else ()), end_id], "<u4")
                    edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        owner.append(i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                cols = [part.column("id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids).withColumnRenamed("id", "doc_id")


def pack(docs: DataFrame, *, capacity: int = 2048, bucket_rows: int = 50_000, **options) -> DataFrame:
    """token_pieces(docs) with sequence_id and offset, gapless from 0 in each sequence.

    An empty table gives no rows. Repeated rows are packed once each; a null id stays null.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, capacity=capacity, **options), "pieces")
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity), RUNS)
    buckets = -(-max(sum(counts.values()), 1) // bucket_rows)
    # ranks within a length: counted in buckets of a length, so that no length meets in one task
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("local", local).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    # the plan's size is bounded by the capacity (see plan), so it can be broadcast
    runs = F.broadcast(runs.withColumnRenamed("length", "run_length"))
    placed = ranked.join(runs, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per_sequence").cast("long")) * F.col("length")).alias("offset"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
