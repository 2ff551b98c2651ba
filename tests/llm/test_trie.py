"""The conversation trie against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from assetloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_force(rows, lend=True):
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    if lend:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    members, ends = {}, {}
    for c, t in own.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    done = {}
    for n in sorted(members, key=len, reverse=True):
        mine = kids.get(n, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        done[n] = (sum(done[k][0] for k in mine) or 1, sum(done[k][1] for k in mine) + (len(members[n]) - 1) * words)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), *done[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items()
    )


def answer(spark, rows, schema=SCHEMA):
    turns = trie.ordered_turns(spark.createDataFrame(rows, schema))
    got = trie.prefix_trie(turns, turns.where("at = 1").select("conv_id"))
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def feed():
    rng = random.Random(8)
    rows = []
    for c in range(20, 120):
        n = rng.choice([1, 2, 3, 5]) if c != 40 else 90
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a b", "a  c\n", "long words here", None])) for t in range(n)]
    rows += [(c, t, "user", "same words") for c in range(200, 260) for t in range(4)]  # copies
    rows += [(300, None, None, None), (300, 0, "user", "x"), (None, 0, "user", "x"), (301, 5, "user", "x y z" * 20_000)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, feed, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 20)
    extra = [(*r, "x", 1) for r in feed]
    assert answer(spark, extra, SCHEMA + ", key string, depth int") == by_force(feed, lend=False)


def test_query_lends_first_turns(spark, feed, tmp_path):
    spark.createDataFrame(feed, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = trie.op12_conversation_trie(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == by_force(feed)


def test_equal_turns_repeated_rows_and_none(spark):
    """Rows of one turn are all turns, by role; a repeated row is one more turn."""
    rows = [(1, 0, "b", "two"), (1, 0, "a", "one"), (2, 0, "a", "one"), (2, 1, "b", "two"), (3, 0, "a", "one"), (3, 0, "a", "one")]
    assert answer(spark, rows) == by_force([(1, 0, "a", "one"), (1, 1, "b", "two"), (2, 0, "a", "one"), (2, 1, "b", "two"), (3, 0, "a", "one"), (3, 1, "a", "one")], lend=False)
    assert answer(spark, []) == []
