"""Operator 2: exact top-k inner products on an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks; a block's index has, for each dimension, the rows in order of
the size of their value, cut into segments by quantised size. A block of queries, cut in the
same way, takes pairs of segments by descending impact: only a segment's own rows and queries
are touched. It stops when the bound on all that is
left proves that few vectors can still be among the best, and rescores exactly those. A first
pass over about the square root of the blocks fixes each query's k-th score; the other blocks
need only what can reach it, so the share of postings read falls as the rows grow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LEVELS = 32
#: Posting segments of a dimension in a block and among its queries; rows of a block that meet
#: queries at a time; how often the bound is looked at.
SEGMENTS, QUERY_SEGMENTS, SUB_ROWS, SUB_QUERIES, LOOKS = 8, 4, 4096, 128, 16
#: Vectors in an index block at least and at most, queries in a query block; the share of
#: (query, vector) pairs that may be rescored.
BLOCK_ROWS, MOST_ROWS, QUERY_ROWS, RESCORE = 4096, 32768, 8192, 1 / 64


class Postings:
    """Rows of integers as posting segments: of each dimension the rows by descending size of their value, zeros left out.

    A segment joins whole levels of quantised size, so that segments have about as many
    postings each. rows and values of dimension d, segment j: [cuts[d][j] : cuts[d][j + 1]];
    tops[d][j] is the largest size in it, and 0 after the last one.
    """

    def __init__(self, v: np.ndarray, kind: type, segments: int):
        self.rows, self.values, self.cuts, self.tops = [], [], [], []
        for d in range(v.shape[1]):
            size = np.abs(v[:, d])
            width = max(1, -(-(int(size.max(initial=0)) + 1) // LEVELS))
            order = np.argsort(-size, kind="stable")[: int((size > 0).sum())]
            border = np.flatnonzero(np.diff(size[order] // width)) + 1  # where a level begins
            want = np.arange(1, segments) * len(order) // segments
            inner = border[np.minimum(np.searchsorted(border, want), len(border) - 1)] if len(border) else border
            cuts = np.unique(np.concatenate(([0], inner, [len(order)])))
            self.rows.append(order)
            self.values.append(v[order, d].astype(kind))
            self.cuts.append(cuts)
            self.tops.append(np.append(size[order[cuts[:-1]]] if len(order) else [], 0).astype(np.int64))


class Index:
    """A block of integer vectors (rows of v), its ids ascending, as posting segments."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.blocks: dict[type, list[tuple[int, Postings]]] = {}
        #: Postings read, and components that a plain product would read, for all queries so far.
        self.read = self.pairs = 0

    def _segments(self, kind: type) -> list[tuple[int, Postings]]:
        if kind not in self.blocks:
            self.blocks[kind] = [(a, Postings(self.v[a : a + SUB_ROWS], kind, SEGMENTS)) for a in range(0, len(self.v), SUB_ROWS)]
        return self.blocks[kind]

    def best(self, who: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query id, vector id and score of each query's k best by (score descending, id), its own id left out.

        least: a score that k vectors elsewhere are known to reach; lower ones are left out.
        """
        # products are summed in the narrowest type that holds every sum exactly
        most = int(np.abs(q).sum(axis=1).max(initial=0)) * int(np.abs(self.v).max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        found = []
        for a in range(0, len(q), SUB_QUERIES):
            mine = slice(a, a + SUB_QUERIES)
            asked = Postings(q[mine], kind, QUERY_SEGMENTS)
            known = None if least is None else least[mine].copy()
            for at, part in self._segments(kind):
                query, rows, scores = _ranked(*self._possible(who[mine], q[mine], asked, at, part, k, known, kind), k)
                found.append((a + query, rows, scores))
                # the k-th score of this part holds for the next ones
                full = np.flatnonzero(query[k - 1 :] == query[: max(len(query) - k + 1, 0)])
                if known is None and len(full) == len(q[mine]):
                    known = scores[full + k - 1]
                elif known is not None:
                    known[query[full]] = np.maximum(known[query[full]], scores[full + k - 1])
        query, rows, scores = _ranked(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        return who[query], self.ids[rows], scores

    def _possible(self, who: np.ndarray, q: np.ndarray, asked: Postings, at: int, part: Postings, k: int, known: np.ndarray | None, kind: type):
        """Queries, rows and exact scores of the pairs of this part of the block that may be among the k best.

        Pairs of a dimension's query segment and posting segment are taken by descending
        product of their largest sizes. What is left for a query is at most, summed over the
        dimensions, the size of its component times the largest size of a posting not yet read.
        """
        v = self.v[at : at + SUB_ROWS]
        score = np.zeros((len(v), len(q)), kind)
        own = np.searchsorted(self.ids[at : at + len(v)], who)
        own_query = np.flatnonzero((own < len(v)) & (self.ids[at + np.minimum(own, len(v) - 1)] == who))
        own = own[own_query]
        dims = q.shape[1]
        pairs = sorted(((int(x) * int(y), d, i, j) for d in range(dims) for i, x in enumerate(asked.tops[d][:-1]) for j, y in enumerate(part.tops[d][:-1])), reverse=True)
        # left[d, i]: the largest size of dimension d's postings that query segment i has not met; segment of each query
        left = np.stack([np.full(QUERY_SEGMENTS + 1, part.tops[d][0], np.float64) for d in range(dims)]) if dims else np.zeros((0, 1))
        segment = np.full((len(q), dims), QUERY_SEGMENTS)
        for d in range(dims):
            segment[asked.rows[d], d] = np.repeat(np.arange(len(asked.cuts[d]) - 1), np.diff(asked.cuts[d]))
        size = np.abs(q).astype(np.float64)
        self.pairs += score.size * dims
        every, looked = max(1, len(pairs) // LOOKS), False
        least, reach = known, None
        for n, (_, d, i, j) in enumerate(pairs, 1):
            rows, some = part.rows[d][part.cuts[d][j] : part.cuts[d][j + 1]], asked.rows[d][asked.cuts[d][i] : asked.cuts[d][i + 1]]
            where = rows[:, None], some[None, :]
            score[where] += part.values[d][part.cuts[d][j] : part.cuts[d][j + 1], None] * asked.values[d][None, asked.cuts[d][i] : asked.cuts[d][i + 1]]
            left[d, i] = part.tops[d][j + 1]
            self.read += len(rows) * len(some)
            if n % every or n < len(pairs) // 4 or n == len(pairs):
                continue
            if known is None and len(v) > k + 1:
                # k exact scores give a threshold; who can't reach it is out, by proof
                seen = score.astype(np.float64)
                seen[own, own_query] = -np.inf
                likely = np.argpartition(seen, len(v) - k, axis=0)[len(v) - k :]
                least = (v[likely] * q[None, :, :]).sum(axis=2).min(axis=0)
            if least is None:
                continue
            bound = (size * left[np.arange(dims)[None, :], segment]).sum(axis=1)
            reach = score + (bound * 1.0000001 + 1) >= least[None, :]
            reach[own, own_query] = False
            looked = True
            if reach.sum() <= max(k * len(q), RESCORE * reach.size):
                break
        else:
            looked = False
        if not looked:  # all is read: the scores are exact
            reach = np.ones(score.shape, bool) if least is None else score >= least[None, :]
            reach[own, own_query] = False
        row, query = np.nonzero(reach)
        exact = np.empty(len(query), np.int64)
        for a in range(0, len(query), 1 << 16):
            exact[a : a + (1 << 16)] = (q[query[a : a + (1 << 16)]] * v[row[a : a + (1 << 16)]]).sum(axis=1)
        if least is not None:
            able = exact >= least[query]
            query, row, exact = query[able], row[able], exact[able]
        return query, at + row, exact


def _ranked(query: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by query, score descending and row (rows are in order of ids)."""
    order = np.lexsort((rows, -scores, query))
    query = query[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    order = order[best]
    return query[best], rows[order], scores[order]


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component, of the vectors that take part.

    Null ids, null and empty vectors and those with a null or non-finite component take no
    part; of an id with several vectors the least one counts. Components are expected below
    2**31 / scale in size.
    """
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(F.col(id_col).isNotNull()).where(F.coalesce(whole, F.lit(False))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(ints).alias("v"))


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = t.column("id").to_numpy()
    flat = t.column("v").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    v = flat.flatten().to_numpy().reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], v[order], order


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best vectors of each query, of equal length.

    Both (id, v), ids distinct. Scores are integer inner products (they must stay below
    2**63); ties go to the smaller id; a vector with the query's id is not its candidate. A
    query with fewer than k candidates gets them all. Query blocks are sent to every index
    block: the work is the stated queries against all rows, in blocks; no block or query set
    passes through the driver.
    """
    spark = vectors.sparkSession
    rows, asked_rows = vectors.count(), queries.count()
    block_rows = min(MOST_ROWS, max(BLOCK_ROWS, rows // (2 * spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-rows // block_rows))
    query_blocks = max(1, -(-asked_rows // QUERY_ROWS))
    first = math.isqrt(blocks - 1) + 1  # blocks of the first pass, about their square root

    def pack(t: pa.Table) -> pa.Table:
        ids, v, order = _matrix(t)
        least = t.column("least").combine_chunks()
        blob = least.fill_null(np.iinfo(np.int64).min).to_numpy()[order].tobytes()
        narrow = np.int32 if np.abs(v).max(initial=0) < 1 << 31 else np.int64
        return pa.table({"block": t.column("block").slice(0, 1), "dims": t.column("dims").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "least": pa.array([blob], pa.binary()), "m": pa.array([v.astype(narrow).tobytes()], pa.binary())})

    def packed(df: DataFrame, n: int) -> DataFrame:
        keyed = df.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), "dims": F.size("v")})
        return keyed.select("block", "dims", "id", "v", "least").groupBy("block", "dims").applyInArrow(pack, "block int, dims int, ids binary, least binary, m binary")

    def matrix(blob: bytes, ids: np.ndarray, dims: int) -> np.ndarray:
        return np.frombuffer(blob, np.int32 if len(blob) == 4 * len(ids) * dims else np.int64).reshape(-1, dims).astype(np.int64)

    def search(batches):
        kept: tuple[int, int, Index] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                n = r["dims"]
                if kept is None or kept[:2] != (r["block"], n):
                    ids = np.frombuffer(r["ids"], np.int64)
                    kept = (r["block"], n, Index(ids, matrix(r["m"], ids, n)))
                who = np.frombuffer(r["q_ids"], np.int64)
                least = np.frombuffer(r["q_least"], np.int64)
                # a query without k known scores (none known, or too few vectors) starts from nothing
                for some in (least > np.iinfo(np.int64).min, least == np.iinfo(np.int64).min):
                    if some.any():
                        known = least[some] if least[some][0] > np.iinfo(np.int64).min else None
                        cols = kept[2].best(who[some], matrix(r["q_m"], who, n)[some], k, known)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])

    index = stored(packed(vectors.withColumn("least", F.lit(None).cast("long")), blocks), "index").drop("least")

    def near(asked: DataFrame, among: str) -> DataFrame:
        asked = packed(asked, query_blocks).select("dims", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("least").alias("q_least"), F.expr(f"explode({among})").alias("block"))
        found = index.join(asked, ["block", "dims"]).sortWithinPartitions("block", "dims").mapInArrow(search, "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    # a query block begins with the blocks from its own number on
    begin = f"transform(sequence(0, {first} - 1), i -> CAST(pmod(block + i, {blocks}) AS int))"
    best = near(queries.withColumn("least", F.lit(None).cast("long")), begin)
    if first < blocks:
        best = stored(best, "first-best").drop("rank")
        least = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = near(queries.join(least, queries["id"] == least["query_id"], "left").select("id", "v", "least"), f"transform(sequence({first}, {blocks} - 1), i -> CAST(pmod(block + i, {blocks}) AS int))")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = best.unionByName(rest.drop("rank")).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256), "vectors")
    return top_k(vectors, vectors.where("id % 50 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
