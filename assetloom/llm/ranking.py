"""Operator 11: ranked lexical search on a bit-sliced impact index.

Documents are dealt into blocks. A block holds, for each of its terms, the places of the
documents with the term and the bits of their impacts, slice by slice. A search takes the rows
of its terms only: a term's slices are multiplied by its weight and the slices of an item's
terms are added with bitwise carry arithmetic, 64 documents a machine word; the best k are
found by going down from the most significant slice of the sum.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, flat_bytes, ragged, stored, table

#: Documents, (document, term) pairs and text bytes after which a block is closed.
BLOCK_DOCS, BLOCK_PAIRS, BLOCK_BYTES = 16384, 2_000_000, 64 << 20
#: Items that one search of a block takes at a time.
ITEM_BATCH = 512
#: Bits of an impact: it stays below 1,000,000.
IMPACT_BITS = 20
#: Documents of a block with a term from which on its dense slices are kept between items.
DENSE = 1024

INDEX_SCHEMA = "block long, term binary, docs int, ids array<long>, places binary, slices binary"

# Bytes of terms, with A-Z as a-z; all others become a space. Bytes from 0x80 on are parts of
# characters that a term may hold.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_IS_TERM = np.frombuffer(_TERM_BYTES, np.uint8) != 32


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of one text, in order."""
    data = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    return data.translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Index:
    """rows: INDEX_SCHEMA, a row a (block, term), and one with null term for the block's documents."""

    rows: DataFrame
    #: Documents with a term, and all their terms.
    n_docs: int
    n_terms: int


def _totals(docs: DataFrame, text_col: str) -> tuple[int, int]:
    def count(batches):
        n_docs = n_terms = 0
        for batch in batches:
            for part in byte_slices(batch, text_col):
                data, offsets = flat_bytes(part.column(text_col))
                inside = _IS_TERM[data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                begins[heads] = inside[heads]
                places = np.flatnonzero(begins)
                found = np.diff(np.searchsorted(places, offsets))
                n_docs, n_terms = n_docs + int((found > 0).sum()), n_terms + len(places)
        yield pa.RecordBatch.from_pydict({"d": [n_docs], "t": [n_terms]}, pa.schema([("d", pa.int64()), ("t", pa.int64())]))

    row = docs.select(text_col).mapInArrow(count, "d long, t long").agg(F.sum("d").alias("d"), F.sum("t").alias("t")).first()
    return row["d"] or 0, row["t"] or 0


def _sliced(value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the values (runs of the given sizes): for each run all lowest bits, then the next ones, ...; bytes and where runs end."""
    ends = np.cumsum(-(-size * IMPACT_BITS // 8))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    total = np.cumsum(size)
    at = 0
    while at < len(size):  # about 2**18 values at a time, their bits take a byte each
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18), "right")))
        lo, hi = (int(total[at - 1]) if at else 0), int(total[end - 1])
        first = int(ends[at - 1]) if at else 0
        begin = 8 * (np.concatenate(([first], ends[at : end - 1])) - first)
        bits = np.zeros(8 * (int(ends[end - 1]) - first), np.uint8)
        n = size[at:end]
        where = ragged(begin, n)
        step = np.repeat(n, n)
        for s in range(IMPACT_BITS):
            bits[where + s * step] = (value[lo:hi] >> s) & 1
        out[first : int(ends[end - 1])] = np.packbits(bits, bitorder="little")
        at = end
    return out, ends


def _blob(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of docs and all terms of their whole texts, stored in the shared folder.

    Null texts and texts without a term are in no posting. Rows with the same id are documents
    of their own; a null id is kept and comes last among equal scores. A very long text makes a
    block by itself at most; no text is cut. An empty table gives an index without rows.
    """
    n_docs, n_terms = _totals(docs, text_col)

    def build(batches):
        number = itertools.count(TaskContext.get().partitionId() << 32)
        ids: list[int | None] = []
        words: list[bytes] = []
        often: list[int] = []
        held: list[int] = []
        lengths: list[int] = []
        n_bytes = 0

        def block() -> pa.RecordBatch:
            # places in order of ids, so that ties of the same score go by place
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            m = 50 + (50 * np.array(lengths, np.int64) * n_docs) // max(n_terms, 1)
            doc = np.repeat(np.arange(len(ids)), held)
            tf = np.array(often, np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            coded = pa.array(words, pa.binary()).dictionary_encode()
            code = coded.indices.to_numpy()
            by = np.lexsort((place[doc], code))
            size = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int64)
            sliced, ends = _sliced(impact[by], size)
            n = len(size)
            columns = [
                pa.array(np.full(n + 1, next(number))), pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.binary())]), pa.array(np.append(size, len(ids)), pa.int32()),
                pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))]),
                pa.concat_arrays([_blob(place[doc][by].astype("<u2").view(np.uint8), np.cumsum(2 * size)), pa.nulls(1, pa.binary())]), pa.concat_arrays([_blob(sliced, ends), pa.nulls(1, pa.binary())]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "term", "docs", "ids", "places", "slices"])

        for batch in batches:
            for who, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = terms_of(data)
                if not found:
                    continue
                if ids and (len(ids) >= BLOCK_DOCS or len(words) >= BLOCK_PAIRS or n_bytes + len(data) > BLOCK_BYTES):
                    yield block()
                    ids, words, often, held, lengths, n_bytes = [], [], [], [], [], 0
                counts = Counter(found)
                ids.append(who)
                words.extend(counts.keys())
                often.extend(counts.values())
                held.append(len(counts))
                lengths.append(len(found))
                n_bytes += len(data)
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, INDEX_SCHEMA)
    return Index(stored(rows, "lexical-index"), n_docs, n_terms)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two sets of numbers, slices first (lowest at 0), with one slice more than the longer one."""
    if len(a) < len(b):
        a, b = b, a
    out = np.empty((len(a) + 1, *a.shape[1:]), np.uint64)
    carry = np.zeros(a.shape[1:], np.uint64)
    for s in range(len(a)):
        if s < len(b):
            either = a[s] ^ b[s]
            out[s] = either ^ carry
            carry = (a[s] & b[s]) | (either & carry)
        else:
            out[s] = a[s] ^ carry
            carry = a[s] & carry
    out[len(a)] = carry
    return out


def _weighted(slices: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each word's numbers times its weight: shifted copies, one for each bit of a weight, are added."""
    out = np.zeros((0, slices.shape[1]), np.uint64)
    for bit in range(int(weight.max(initial=0)).bit_length()):
        some = np.where((weight >> bit) & 1 == 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        shifted = np.concatenate((np.zeros((bit, slices.shape[1]), np.uint64), slices & some))
        out = _added(out, shifted) if len(out) else shifted
    return out


def _highest(total: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest numbers above zero, equal ones by place; all of them, if fewer."""
    may = np.bitwise_or.reduce(total, axis=0)
    sure = np.zeros_like(may)
    if np.bitwise_count(may).sum() > k:
        for bits in total[::-1]:  # the most significant slice first
            more = sure | (may & bits)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                may = may & bits
            else:
                sure, may = more, may & ~bits
                if n == k:
                    return np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    some = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    rest = np.flatnonzero(np.unpackbits(may.view(np.uint8), bitorder="little"))[: k - len(some)]
    return np.concatenate((some, rest))


class Block:
    """One block's rows of the terms asked for, their slices multiplied by the terms' weights."""

    def __init__(self, n_docs: int, weights: np.ndarray, places: list[bytes], slices: list[bytes]):
        self.words = -(-n_docs // 64)
        self.places = [np.frombuffer(p, "<u2").astype(np.int64) for p in places]
        self.at = np.concatenate(([0], np.cumsum([-(-len(p) // 64) for p in self.places]))).astype(np.int64)
        packed = np.zeros((IMPACT_BITS, int(self.at[-1])), np.uint64)
        for t, (p, s) in enumerate(zip(self.places, slices, strict=True)):
            n, width = len(p), int(self.at[t + 1] - self.at[t])
            bits = np.zeros((IMPACT_BITS, 64 * width), np.uint8)
            bits[:, :n] = np.unpackbits(np.frombuffer(s, np.uint8), count=IMPACT_BITS * n, bitorder="little").reshape(IMPACT_BITS, n)
            packed[:, self.at[t] : self.at[t + 1]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.packed = _weighted(packed, np.repeat(weights, np.diff(self.at)))
        self.kept: dict[int, np.ndarray] = {}

    def _dense(self, t: int) -> np.ndarray:
        """A term's slices over all places of the block."""
        if t in self.kept:
            return self.kept[t]
        places = self.places[t]
        bits = np.unpackbits(np.ascontiguousarray(self.packed[:, self.at[t] : self.at[t + 1]]).view(np.uint8), axis=1, bitorder="little")[:, : len(places)]
        byte = places >> 3
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        out = np.zeros((len(bits), 8 * self.words), np.uint8)
        out[:, byte[first]] = np.bitwise_or.reduceat(bits << (places & 7).astype(np.uint8), first, axis=1)
        out = out.view(np.uint64)
        if len(places) >= DENSE:  # at most BLOCK_PAIRS / DENSE terms (and one text's) have so many
            self.kept[t] = out
        return out

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k documents with the highest sums over the terms."""
        sums: list[tuple[int, np.ndarray]] = []  # like a binary counter: equal depths are joined
        for group in range(0, len(terms), 16):
            level = np.stack([self._dense(t) for t in terms[group : group + 16]], axis=1)
            while level.shape[1] > 1:
                half = level.shape[1] // 2
                odd = level[:, 2 * half :]
                level = _added(level[:, :half], level[:, half : 2 * half])
                if odd.shape[1]:
                    level = np.concatenate((level, np.concatenate((odd, np.zeros((len(level) - len(odd), *odd.shape[1:]), np.uint64)))), axis=1)
            depth, total = 0, level[:, 0]
            while sums and sums[-1][0] == depth:
                depth, total = depth + 1, _added(sums.pop()[1], total)
            sums.append((depth, total))
        total = sums.pop()[1]
        while sums:
            total = _added(sums.pop()[1], total)
        total = total[: len(total) - int((~total.any(axis=1))[::-1].cumprod().sum())]  # empty slices at the top
        places = _highest(total, k) if len(total) else np.empty(0, np.int64)
        score = np.zeros(len(places), np.int64)
        for s, bits in enumerate(total):
            score |= ((bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
        return places, score


def search(index: Index, items: DataFrame, k: int = 50, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id (named id_col), rank, doc_id, score: each item's k best documents with a score above zero.

    Rows of one item id (null is an id, too) are one item with the terms of all. Items without
    terms, or whose terms no document has, give no row. Each item meets each block once: the
    work is the stated items against all rows, in blocks, in batches of ITEM_BATCH items. A
    block gives at most k documents an item; they are ranked by item in salted parts, then
    whole.
    """
    spark = index.rows.sparkSession

    def cut(batches):
        for batch in batches:
            for part in byte_slices(batch, "text"):
                who, words = [], []
                for i, text in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = sorted(set(terms_of(text)))
                    who += [i] * len(found)
                    words += found
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(words, pa.binary())], names=["item", "term"])

    asked = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    batches = max(1, -(-asked.select("item").distinct().count() // ITEM_BATCH))
    wanted = stored(asked.mapInArrow(cut, "item long, term binary").distinct(), "asked-terms")
    rows = index.rows
    df = rows.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.n_docs + 2.0)) / (2 * F.col("df") + 1))).cast("long")
    grouped = wanted.withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int")).groupBy("batch", "term").agg(F.collect_list(F.struct("item")).alias("items"))
    weights = stored(grouped.join(df.select("term", weight.alias("weight")), "term").where("weight > 0"), "asked-weights")
    # a term has a row a block: salted, so that no task gets the rows of a frequent one
    blocks = rows.where("term IS NULL").count()
    salts = math.isqrt(blocks) + 1
    salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = rows.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(salted, ["term", "salt"])
    hits = hits.select("block", "batch", "docs", "ids", "places", "slices", "weight", "items")
    heads = rows.where("term IS NULL").select("block", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "docs", "ids", "places", "slices", F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<struct<item:bigint>>").alias("items"))

    def of_block(t: pa.Table) -> pa.Table:
        head = t.column("weight").is_null().to_numpy()
        some = t.filter(pa.array(~head))
        ids = t.filter(pa.array(head)).column("ids").to_pylist()[0]
        out: tuple[list, list, list] = [], [], []
        if some.num_rows:
            block = Block(len(ids), some.column("weight").to_numpy(), some.column("places").to_pylist(), some.column("slices").to_pylist())
            terms: dict[int | None, list[int]] = {}
            for at, who in enumerate(some.column("items").to_pylist()):
                for w in who:
                    terms.setdefault(w["item"], []).append(at)
            for who, mine in terms.items():
                places, scores = block.best(mine, k)
                out[0].extend([who] * len(places))
                out[1].extend(ids[p] for p in places)
                out[2].extend(scores.tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["item", "doc_id", "score"])

    found = heads.unionByName(hits).groupBy("block", "batch").applyInArrow(of_block, "item long, doc_id long, score long")
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, words, len(words) AS n FROM d WHERE len(words) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
t AS (SELECT doc_id, n, unnest(words) AS term FROM n),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
