"""Pieces shared by the corpus operators: tables, shared storage, Arrow text."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass holds at a time; a longer document goes alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where none is set, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="assetloom-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/assetloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application stored; for when its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed by place, and the new names by the old: no name of a stage meets them."""
    names = [f"_column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def with_group(rows: DataFrame, key: str, id_col: str, aggregates: dict[str, tuple[str, Column]], total: int) -> DataFrame:
    """rows and the aggregates (name: min, max or sum, and of what) of all rows with the same key.

    A key of any share of the rows is aggregated and joined in salted parts: partial results by
    (key, salt), then by key, given back to the salts that exist. total: how many rows there
    are at most; with about its square root of salts, no task has more rows of one key than
    that, and no list of salts is longer.
    """
    salts = math.isqrt(total) + 1
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    whole = {"sum": F.sum, "min": F.min, "max": F.max}
    parts = rows.groupBy(key, "_salt").agg(*(whole[how](c).alias(n) for n, (how, c) in aggregates.items()))
    whole_key = parts.groupBy(key).agg(*(whole[how](n).alias(n) for n, (how, _) in aggregates.items()), F.collect_list("_salt").alias("_salts"))
    return rows.join(whole_key.withColumn("_salt", F.explode("_salts")).drop("_salts"), [key, "_salt"]).drop("_salt")


def partitions_for(df: DataFrame, text_col: str, bytes_per_partition: int) -> int:
    """How many partitions hold the column's bytes at the given size each."""
    total = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // bytes_per_partition))


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary column as its bytes and n + 1 offsets; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES):
    """The batch in row slices of about `most` bytes of the text column each."""
    if batch.num_rows == 0:
        return
    _, offsets = flat_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the runs, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out[first] = starts
    out[first[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)


# The constants of a 64-bit finaliser, two primes just below 2**31 (with their
# distance to it) and the keys of a polynomial hash modulo each.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIMES = ((2147483647, 1, 1270415893), (2147483629, 19, 1876543201))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x = x * _MIX_2
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOW = np.uint64((1 << 31) - 1)
_HALF = np.uint64(31)


def _folded(x: np.ndarray, gap: int) -> np.ndarray:
    """x modulo 2**31 - gap, but for one multiple at most; x below 2**62."""
    gap = np.uint64(gap)
    x = (x & _LOW) + (x >> _HALF) * gap
    return (x & _LOW) + (x >> _HALF) * gap


class Rolling:
    """62-bit hashes of any byte ranges of a buffer: polynomials in a key modulo two primes.

    Different ranges of n bytes meet with a chance of about (n / 2**31)**2, whatever regular
    pattern they have. Where equality decides a result, callers compare the bytes as well.
    """

    _tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @classmethod
    def _prepare(cls, n: int) -> None:
        if cls._tables and len(cls._tables[0][1]) >= n:
            return
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for prime, _, key in _PRIMES:
            columns = [BYTE_VALUES % np.uint64(prime)]
            for step in (key, pow(key, -1, prime)):
                powers = np.ones(1, np.uint64)
                while len(powers) < size:  # doubles: the powers so far, times the next one
                    powers = np.concatenate((powers, powers * np.uint64(pow(step, len(powers), prime)) % np.uint64(prime)))
                columns.append(powers[:size])
            tables.append(tuple(columns))
        cls._tables = tables

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        Rolling._prepare(n)
        self.sums = []
        for (_, gap, _), (values, powers, _) in zip(_PRIMES, Rolling._tables, strict=True):
            sums = np.zeros(n, np.uint64)
            np.cumsum(_folded(values[data] * powers[: n - 1], gap), out=sums[1:])
            self.sums.append(sums)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        both = []
        for (prime, gap, _), (_, _, inverse), sums in zip(_PRIMES, Rolling._tables, self.sums, strict=True):
            x = _folded(_folded(sums[ends] - sums[starts], gap) * inverse[starts], gap)
            both.append(np.where(x >= np.uint64(prime), x - np.uint64(prime), x))
        return mix64(((both[0] << np.uint64(32)) | both[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def equal_ranges(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray, other: np.ndarray | None = None, most: int = 1 << 20) -> np.ndarray:
    """Whether data[one:one + size] has the bytes of data (or other)[two:two + size], a bounded number of bytes at a time."""
    other = data if other is None else other
    out = np.ones(len(size), bool)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = size[at:end]
        differ = data[ragged(one[at:end], n)] != other[ragged(two[at:end], n)]
        if differ.any():
            owner = np.repeat(np.arange(at, end), n)
            out[owner[differ]] = False
        at = end
    return out
