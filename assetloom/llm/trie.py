"""Operator 12: the prefix trie of conversations, with totals by leaf-peeling message passing.

A node is a distinct sequence of first turns; it is told by 128 bits of position-wise hashes,
summed over the turns. A conversation owns the nodes of which it is the smallest member: they
are a run, one below the other. Runs hold a counter of the runs that hang below them. Those
without any left send the totals of their subtree to the run they hang on, which counts down;
so rounds go on until only the root's run finishes. A run of any length takes one round.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import running
from .common import stored, table, with_group
from .quality import WS

#: Bytes of ids after which a piece of a list goes on to be hashed.
PIECE_BYTES = 1 << 20
PARTS = ("s1", "s2", "s3", "s4")


def ordered_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, at (from 1), x1, x2, words: each conversation's turns in order, their texts as hashes.

    Null turns come first; equal turns go by role, then by hash. Null role and text are empty.
    Rows with a null conversation take no part. Repeated rows are turns of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("x1"), F.xxhash64(F.lit(1), text, role).alias("x2"),
        F.size(F.filter(F.split(text, WS), lambda w: w != "")).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("x1"), F.col("x2")]
    return running(rows, ["conv_id"], order, {"at": F.lit(1).cast("long")}).select("conv_id", "at", "x1", "x2", "words")


def _node(depth: Column, parts: list[Column]) -> Column:
    return F.struct(depth.cast("long").alias("depth"), *(p.cast("long").alias(n) for n, p in zip(PARTS, parts, strict=True)))


def _ends(ends: DataFrame) -> DataFrame:
    """owner, depth, sha: the hash over the ids of the conversations (owner, depth, conv_id) that end in a node.

    However many they are, ids are sorted over all tasks and become pieces of about a
    megabyte; a node's pieces are read one after the other into its hash, which by its
    definition takes them in order. No list is held.
    """

    def pieces(batches):
        open_node, first, ids, size = None, None, [], 0
        for batch in batches:
            out: tuple[list, list, list, list] = [], [], [], []

            def close(out=out):
                if ids:
                    for c, v in zip(out, (*open_node, first, ",".join(ids).encode()), strict=True):
                        c.append(v)

            for owner, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "conv_id")), strict=True):
                if (owner, depth) != open_node or size > PIECE_BYTES:
                    close()
                    open_node, first, ids, size = (owner, depth), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            close()  # a batch's last piece is not kept open: pieces are in order, whatever their sizes
            open_node, ids, size = None, [], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["owner", "depth", "first", "ids"])

    def hashes(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True))
        out: tuple[list, list, list] = [], [], []
        for (owner, depth), mine in itertools.groupby(rows, lambda r: r[:2]):
            state, comma = hashlib.sha256(), b""
            for _, _, ids in mine:
                state.update(comma + ids)
                comma = b","
            for c, v in zip(out, (owner, depth, state.hexdigest()), strict=True):
                c.append(v)
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(("owner", "depth", "sha"), out, strict=True)))
                out = [], [], []
        if out[0]:
            yield pa.RecordBatch.from_pydict(dict(zip(("owner", "depth", "sha"), out, strict=True)))

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = ends.select("owner", "depth", "conv_id").repartitionByRange(n, "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    cut = cut.mapInArrow(pieces, "owner long, depth long, first long, ids binary")
    return cut.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(hashes, "owner long, depth long, sha string")


def _messages(runs: DataFrame) -> DataFrame:
    """up, at, leaves, saved: what arrives at each node from the runs that hang on it, after the peeling.

    runs: conv_id, up (the run it hangs on; null: the root's), at (the depth there), leaves,
    saved (of its own nodes). Sums are partial before they are shuffled, so a run that very
    many hang on is no task's alone.
    """
    below = runs.where("up IS NOT NULL").groupBy(F.col("up").alias("to")).agg(F.count("*").alias("left"))
    state = stored(runs.join(below, F.col("conv_id") == F.col("to"), "left").drop("to").na.fill(0, ["left"]), "runs")
    sent = []
    while True:
        done = state.where("left = 0 AND up IS NOT NULL").groupBy("up", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n"))
        sent.append(stored(done, "messages"))
        waiting = state.where("left > 0")
        if waiting.isEmpty():
            break
        told = sent[-1].groupBy(F.col("up").alias("to")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("n").alias("n"))
        more = {"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0)), "left": F.col("left") - F.coalesce("n", F.lit(0))}
        state = stored(waiting.join(told, F.col("conv_id") == F.col("to"), "left").withColumns(more).drop("to", "l", "s", "n"), "runs")
    everything = sent[0]
    for more in sent[1:]:
        everything = everything.unionByName(more)
    return everything.groupBy("up", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node.

    turns: as by ordered_turns (`at` orders them, gaps do not matter); members: conv_id of
    every conversation, once, also of those without turns. A node's conv_id is its smallest
    member; the root has depth 0 and no parent. No members: no rows. Sequences are equal
    when 128 bits of hashes over positions, roles and texts are.
    """
    placed = running(turns, ["conv_id"], [F.col("at")], {"depth": F.lit(1).cast("long")})
    hashes = [F.xxhash64("depth", "x1"), F.xxhash64("depth", "x2")]
    halves = [part for h in hashes for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    placed = placed.select("conv_id", "depth", "words", *(p.alias(f"p{n}") for n, p in zip(PARTS, halves, strict=True)))
    rows = running(placed, ["conv_id"], [F.col("depth")], {n: F.col(f"p{n}") for n in PARTS})
    root = _node(F.lit(0), [F.lit(0)] * 4)
    key, up = _node(F.col("depth"), [F.col(n) for n in PARTS]), _node(F.col("depth") - 1, [F.col(n) - F.col(f"p{n}") for n in PARTS])
    rows = rows.select("conv_id", key.alias("key"), up.alias("up"), "words")
    rows = stored(rows.unionByName(members.select("conv_id", root.alias("key"), F.lit(None).cast(rows.schema["up"].dataType).alias("up"), F.lit(0).cast("long").alias("words"))), "prefixes")

    nodes = stored(rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("up").alias("up")), "nodes")
    ends = rows.groupBy("conv_id").agg(F.max("key").alias("key"))  # depth is the key's first part
    # one pass, in salted parts, tells each node its parent's owner and each end its node's
    meet = nodes.select("key", F.lit("node").alias("kind"), "conv_id", "n_convs", "words").unionByName(nodes.where("up IS NOT NULL").select(F.col("up").alias("key"), F.lit("child").alias("kind"), "conv_id", "n_convs", "words"))
    meet = meet.unionByName(ends.select("key", F.lit("end").alias("kind"), "conv_id", F.lit(0).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words")))
    met = stored(with_group(meet, "key", "conv_id", {"owner": ("min", F.when(F.col("kind") == "node", F.col("conv_id")))}, rows.count()), "met")

    child = met.where("kind = 'child'").select("conv_id", (F.col("key.depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"), "n_convs", "words")
    top = met.where("kind = 'node' AND key.depth = 0").select("conv_id", F.col("key.depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "words")
    every = child.unionByName(top)
    kids = child.groupBy(F.col("parent_conv_id").alias("k_conv"), (F.col("depth") - 1).alias("k_depth")).agg(F.count("*").alias("n_children"))
    every = every.join(kids, (F.col("conv_id") == F.col("k_conv")) & (F.col("depth") == F.col("k_depth")), "left").drop("k_conv", "k_depth").na.fill(0, ["n_children"])
    every = stored(every.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saving": (F.col("n_convs") - 1) * F.col("words")}), "trie")

    runs = every.groupBy("conv_id").agg(F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("at"), F.sum("leaf").alias("leaves"), F.sum("saving").alias("saved"))
    heard = _messages(runs).select(F.col("up").alias("m_conv"), F.col("at").alias("m_depth"), "leaves", "saved")
    totals = every.join(heard, (F.col("conv_id") == F.col("m_conv")) & (F.col("depth") == F.col("m_depth")), "left")
    sums = {"n_leaves": F.col("leaf") + F.coalesce("leaves", F.lit(0)), "saved_tokens": F.col("saving") + F.coalesce("saved", F.lit(0))}
    totals = running(totals.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *(c.alias(n) for n, c in sums.items())), ["conv_id"], [F.col("depth").desc()], {n: F.col(n) for n in sums})
    shas = _ends(met.where("kind = 'end'").select("owner", F.col("key.depth").alias("depth"), "conv_id")).select(F.col("owner").alias("e_conv"), F.col("depth").alias("e_depth"), "sha")
    found = totals.join(shas, (F.col("conv_id") == F.col("e_conv")) & (F.col("depth") == F.col("e_depth")), "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    members = turns.where("at = 1").select("conv_id")
    first = turns.where("at <= 3").select(F.col("conv_id").alias("base"), "at", "x1", "x2", "words")
    lent = members.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": h}).join(first, "base").where(F.col("at") <= F.col("h")).select(turns.columns)
    return prefix_trie(turns.where(F.col("at") > h).unionByName(lent), members)


OP12_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(s) + 1), lambda x: CAST(ascii(s[x]) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda y, z: CASE WHEN (y & 1) = 1 THEN xor(y >> 1, CAST(3988292384 AS BIGINT)) ELSE y >> 1 END)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM i),
r AS (SELECT c.conv_id, k, role, text FROM c JOIN o ON o.conv_id = base AND k <= h UNION ALL SELECT o.conv_id, k, role, text FROM o JOIN c ON c.conv_id = o.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS key,
  len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM r),
a AS (SELECT conv_id, depth, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS up, words FROM p UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
n AS (SELECT key, min(conv_id) AS conv_id, min(depth) AS depth, min(up) AS up, count(*) AS n_convs, min(words) AS words FROM a GROUP BY key),
b AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
e AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(key, depth) AS key FROM a GROUP BY conv_id) GROUP BY key),
s AS (SELECT a.key, count(*) FILTER (WHERE b.key IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved FROM n LEFT JOIN b ON b.key = n.key JOIN a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM n LEFT JOIN n m ON m.key = n.up LEFT JOIN b ON b.key = n.key LEFT JOIN e ON e.key = n.key JOIN s ON s.key = n.key
"""
