"""Operator 3: near-duplicate documents with SetSketch registers.

A document's set is its distinct 5-word shingles (64-bit hashes). Each of K registers holds
floor(1 - log_b(minimum)) of exponential variates over the set, truncated to [0, q + 1]:
mergeable by max and locality-sensitive. Bands of registers give candidate pairs, a
likelihood estimate over all registers drops hopeless ones, full sets confirm the links.

Documents with equal sets form a class first, so copies are never paired. In a bucket of
up to `all_pairs` classes all pairs are candidates. In a larger one the member with most
company in large buckets, which of many edited copies is the text they came from, is compared
with all others, and links are contracted; members outside the bucket's largest component are
then compared with those of other components by more registers, a block of each at a time.
No bucket is capped, none meets whole in a task, and only pairs that may link leave a block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, apart, byte_slices, flat_bytes, mix64, stored, table, with_group
from .graph import connected


@dataclass(frozen=True)
class NearDup:
    shingle_words: int = 5
    threshold_percent: int = 85
    #: 32 bands of 6: a pair at similarity 0.85 shares no band once in 4 million.
    bands: int = 32
    band_registers: int = 6
    base: float = 1.02
    rate: float = 20.0
    limit: int = 1022
    #: A pair goes on if the threshold's log-likelihood is within this of the best; a pair at
    #: the threshold is further off once in 20 million.
    slack: float = 15.0
    all_pairs: int = 32
    #: Members in a block of a larger bucket, and the registers (bands of 8) they are compared by.
    block_rows: int = 512
    block_bands: int = 96

    @property
    def registers(self) -> int:
        return self.bands * self.band_registers


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each text its sorted distinct shingle hashes (uint64)."""
    low = _LOWER[data]
    word = ~_SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = Rolling(low).ranges(starts, ends)
    bounds = np.searchsorted(starts, offsets)
    factor = np.array([pow(0x9FB21C651E98DF25, j + 1, 1 << 64) for j in range(k)], np.uint64)
    full = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        full += words[j : j + len(full)] * factor[j]
    full = mix64(full)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            whole = (words[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a)
            yield mix64(whole ^ np.uint64(0x5851F42D4C957F2D))
        else:
            yield np.empty(0, np.uint64)


class Sketcher:
    def __init__(self, p: NearDup):
        self.p = p
        seeds = mix64(np.arange(1, 2 * p.registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.a = (seeds[: p.registers] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (seeds[p.registers :] >> np.uint64(32)).astype(np.uint32)

    def registers(self, values: np.ndarray) -> np.ndarray:
        p = self.p
        low = np.full(p.registers, 0xFFFFFFFF, np.uint32)
        x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
        for i in range(0, len(x), 256):
            y = x[i : i + 256, None] * self.a
            y += self.b
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            np.minimum(low, y.min(axis=0), out=low)
        # the least of exponential variates, from the least of uniform ones
        least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / p.rate
        return np.clip(np.floor(1 - np.log(least) / np.log(p.base)), 0, p.limit + 1).astype(np.uint16)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        p = self.p
        grid = registers.reshape(-1, p.bands, p.band_registers).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), grid.shape[:2]).copy()
        for j in range(p.band_registers):
            key = mix64(key * np.uint64(0x9FB21C651E98DF25) + grid[:, :, j])
        return key.view(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(rows: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(id, text) to id, n (set size), digest of the set, bands, registers (null for an empty set)."""

    def run(batches):
        sketcher = Sketcher(p)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                n, digests, registers = [], [], []
                for values in shingle_sets(*flat_bytes(part.column("text")), p.shingle_words):
                    n.append(len(values))
                    digests.append(_digest(values) if len(values) else None)
                    registers.append(sketcher.registers(values) if len(values) else None)
                full = np.array([r for r in registers if r is not None], np.uint16).reshape(-1, p.registers)
                keys = iter(sketcher.band_keys(full))
                bands = [None if r is None else next(keys) for r in registers]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([None if r is None else r.tobytes() for r in registers], pa.binary())],
                    names=["id", "n", "digest", "bands", "registers"],
                )

    return rows.mapInArrow(run, "id long, n long, digest binary, bands array<long>, registers binary")


def _sets(rows: DataFrame, p: NearDup) -> DataFrame:
    """(id, text, digest) to (id, values): the set's hashes, where the text is the one of the digest."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids, values, want = [], [], part.column("digest").to_pylist()
                for i, found in enumerate(shingle_sets(*flat_bytes(part.column("text")), p.shingle_words)):
                    if len(found) and _digest(found) == want[i]:
                        ids.append(i)
                        values.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(ids, pa.int64())), pa.array(values, pa.binary())], names=["id", "values"])

    return rows.mapInArrow(run, "id long, values binary")


def _finer(sets: DataFrame, p: NearDup, fine: NearDup) -> DataFrame:
    """(id, values) to (id, bands by p, registers by fine)."""

    def run(batches):
        coarse, sketcher = Sketcher(p), Sketcher(fine)
        for batch in batches:
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("values")]
            bands = [coarse.band_keys(coarse.registers(v)[None])[0].tobytes() for v in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bands, pa.binary()), pa.array([sketcher.registers(v).tobytes() for v in sets], pa.binary())], names=["id", "bands", "registers"])

    return sets.mapInArrow(run, "id long, bands binary, registers binary")


def joint_likelihood(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float, p: NearDup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated similarity of each pair of register rows, its log-likelihood, and that of `at`."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (p.base - 1) / p.base) / np.log(p.base)

    def value(j):
        up, down = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return more[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))

    grid = most * np.linspace(0, 1, 65)
    found = value(grid)
    best = found.argmax(axis=1)
    rows = np.arange(len(best))
    return grid[rows, best], found[rows, best], value(np.minimum(at, most))[:, 0]


def _likely(pairs: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) that the registers leave possible, as (a, b)."""

    def run(batches):
        at = p.threshold_percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(flat_bytes(batch.column(c))[0], np.uint16).reshape(-1, p.registers) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            j, best, there = joint_likelihood(ra, rb, na, nb, at, p)
            yield batch.select(["a", "b"]).filter(pa.array((j >= at) | (there >= best - p.slack)))

    return pairs.mapInArrow(run, "a long, b long")


def _block_pairs(rows: DataFrame, p: NearDup, fine: NearDup) -> DataFrame:
    """(bucket, l, r, left, id, n, root, bands, registers) to (a, b): pairs of a left and a right row,
    of different roots, that sizes and registers leave possible; each in its first common bucket."""

    def run(group: pa.Table) -> pa.Table:
        at, found = p.threshold_percent / 100, []
        bucket = group.column("bucket")[0].as_py() if group.num_rows else 0
        left = group.column("left").to_numpy().astype(bool)
        ids, n, root = (group.column(c).to_numpy() for c in ("id", "n", "root"))
        grid = np.frombuffer(flat_bytes(group.column("registers"))[0], np.uint16).reshape(-1, fine.registers)
        bands = np.frombuffer(flat_bytes(group.column("bands"))[0], np.int64).reshape(-1, p.bands)
        right = np.flatnonzero(~left)
        for i in np.flatnonzero(left).tolist():
            low, high = np.minimum(n[i], n[right]), np.maximum(n[i], n[right])
            mine = right[(root[right] != root[i]) & (100 * low >= p.threshold_percent * high)]
            mine = mine[bands[i][(bands[mine] == bands[i]).argmax(axis=1)] == bucket]
            if len(mine):
                one = np.broadcast_to(grid[i], (len(mine), fine.registers))
                j, best, there = joint_likelihood(one, grid[mine], np.full(len(mine), float(n[i])), n[mine].astype(float), at, p)
                mine = mine[(j >= at) | (there >= best - p.slack)]
                found.append(np.stack((np.minimum(ids[i], ids[mine]), np.maximum(ids[i], ids[mine]))))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bucket", "l", "r").applyInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b, va, vb) with their intersection and union, where they reach the threshold."""

    def run(batches):
        for batch in batches:
            shared, union = [], []
            for va, vb in zip(batch.column("va"), batch.column("vb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (va, vb))
                n = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(n)
                union.append(len(x) + len(y) - n)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "total"])
            yield out.filter(pa.array(100 * np.array(shared, np.int64) >= p.threshold_percent * np.array(union, np.int64)))

    return pairs.mapInArrow(run, "a long, b long, shared long, total long")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Null, empty and blank texts: n_shingles 0, linked with nothing. A null id takes no part:
    component_id null, kept true. Repeated rows each give a row; of an id with several texts
    the one with the least digest stands for the id. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = stored(sketches(rows, p), "sketches")
    ids = known.where("id IS NOT NULL AND digest IS NOT NULL").groupBy("id").agg(F.min("digest").alias("digest"))
    classes = stored(with_group(ids, "digest", "id", {"rep": ("min", F.col("id"))}, known.count()).select("id", "rep", "digest"), "classes")
    lead = classes.where("id = rep").select("id", F.col("digest").alias("d"))
    sketch = known.join(lead, "id").where("digest = d").select("id", "n", "digest", "bands", "registers").dropDuplicates(["id"])
    sketch = stored(sketch, "class-sketches")
    members = sketch.select("id", "n", F.explode("bands").alias("bucket"))
    # aggregates are stored before they are joined: both sides of the join are then plain tables, and
    # the skew join can split a bucket of very many members
    sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    multi = stored(members.join(sizes, "bucket"), "buckets")
    wanted = multi.select("id").distinct()
    registers = stored(sketch.join(wanted, "id", "left_semi").select("id", "n", "digest", "registers"), "registers")
    sets = stored(_sets(rows.join(registers.select("id", "digest"), "id"), p), "sets")

    def likely(pairs: DataFrame) -> DataFrame:
        one = registers.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
        two = registers.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
        return _likely(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb"), p)

    def links(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col("values").alias("va"))
        two = sets.select(F.col("id").alias("b"), F.col("values").alias("vb"))
        return stored(_confirmed(pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb"), p).select("a", "b"), "links")

    close = f"100 * least(x.n, y.n) >= {p.threshold_percent} * greatest(x.n, y.n)"
    small = multi.where(F.col("size") <= p.all_pairs).groupBy("bucket").agg(F.collect_list(F.struct("id", "n")).alias("m"))
    found = small.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {close}), y -> struct(least(x.id, y.id) AS a, greatest(x.id, y.id) AS b))))")).alias("p"))
    pairs = stored(found.select("p.a", "p.b").distinct(), "pairs")
    edges = links(likely(pairs))
    large = multi.where(F.col("size") > p.all_pairs).select("bucket", "id", "n", "size")
    if not large.isEmpty():
        company = large.groupBy("id").agg(F.sum("size").alias("company"))
        centers = large.join(company, "id").groupBy("bucket").agg(F.max_by(F.struct("id", "n"), F.struct(F.col("company"), -F.col("id"))).alias("c")).select("bucket", F.col("c.id").alias("c"), F.col("c.n").alias("cn"))
        centers = stored(centers, "centers")
        near = (F.col("id") != F.col("c")) & (100 * F.least("n", "cn") >= p.threshold_percent * F.greatest("n", "cn"))
        more = large.join(centers, "bucket").where(near).select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
        edges = edges.unionByName(links(likely(stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs"))))
        roots = connected(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        now = stored(large.join(roots, "id", "left").select("bucket", "id", "n", "size", F.coalesce("root", "id").alias("root")), "members")
        by_root = now.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        mixed = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
        mixed = stored(now.join(stored(mixed, "mixed-sizes"), "bucket"), "mixed")
        finer = replace(p, bands=p.block_bands, band_registers=8)
        rows = mixed.join(stored(_finer(sets.join(mixed.select("id").distinct(), "id", "left_semi"), p, finer), "registers"), "id")
        blocks = lambda n: F.ceil(F.col(n) / p.block_rows).cast("int")
        mine = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        one = rows.where("root <> main").select("bucket", mine("outside").alias("l"), every("size").alias("r"), F.lit(True).alias("left"), "id", "n", "root", "bands", "registers")
        two = rows.select("bucket", every("outside").alias("l"), mine("size").alias("r"), F.lit(False).alias("left"), "id", "n", "root", "bands", "registers")
        rest = stored(_block_pairs(one.unionByName(two), p, finer).distinct(), "pairs")
        edges = edges.unionByName(links(rest))
    roots = connected(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "rep")
    reached = classes.join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("component_id"))
    out = known.select("id", "n").join(reached, "id", "left")
    root = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, p: NearDup = NearDup(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The one document of each component that has the least id, and all that are linked with nothing.

    Rows with a null id stay. Further columns of any name stay as they are.
    """
    rows, names = apart(docs)
    found = near_duplicates(rows, p, id_col=names[id_col], text_col=names[text_col])
    kept = found.where("kept").select(F.col(names[id_col]).alias("kept_id")).distinct()
    return rows.join(kept, F.col(names[id_col]).eqNullSafe(F.col("kept_id")), "left_semi").toDF(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair of different sets that share a shingle, and reachability: for small tables.
OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY z) AS rep FROM (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS z FROM s GROUP BY doc_id)),
x AS (SELECT s.doc_id, s.s FROM s WHERE s.doc_id IN (SELECT rep FROM m)),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
y AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT DISTINCT rep AS id, rep AS root FROM m UNION SELECT y.v, r.root FROM r JOIN y ON y.u = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, documents.doc_id) AS component_id, documents.doc_id = coalesce(c.root, documents.doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN c ON c.id = m.rep
"""
