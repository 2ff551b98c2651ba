"""Ranked lexical search against brute force."""

import math
import random
import re

import numpy as np
import pytest

from assetloom.llm import ranking

from .helpers import frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "item_id long, text string, rank int, score long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_force(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, wanted in asked.items():
        scores = []
        for d, w in held:
            m = 50 + (50 * len(w) * n_docs) // n_terms
            s = 0
            for x in wanted:
                tf = w.count(x)
                if tf:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 60), 90) for _ in range(150)]
    rows = [*base, *base[:30], None, "", " .,- ", "ÉCOLE école Straße x_y a1b2", "w1x " * 5000, prose(rng, 30_000, 50_000)]
    return [*enumerate(rows, 2), (3, base[1]), (None, base[2])]


def test_equals_brute_force(spark, docs, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(1, 40), 120)) for i in range(30)]
    items += [(40, None), (41, ""), (42, "nowhere"), (43, "W1X w1x É"), (43, "STRASSE Straße"), (None, "école w5x"), (44, docs[-3][1])]
    for block_docs, batch, k in ((16384, 512, 50), (60, 16, 3)):
        monkeypatch.setattr(ranking, "BLOCK_DOCS", block_docs)
        monkeypatch.setattr(ranking, "ITEM_BATCH", batch)
        built = ranking.build_index(frame(spark, docs))
        got = ranking.search(built, spark.createDataFrame(items, "item_id long, text string"), k)
        assert rows_of(got) == by_force(docs, items, k)


def test_names_and_empty_tables(spark, docs):
    """Columns named like the operator's own are left alone; empty sides give no row."""
    some = [(9, "alpha beta", 1, 5), (10, "beta", 1, 5)]
    items = spark.createDataFrame(some, SCHEMA)
    clash = spark.createDataFrame([(1, "alpha", 1, "x", "y"), (2, "beta beta", 1, "x", "y")], "term long, text string, block int, item string, places string")
    got = ranking.search(ranking.build_index(clash, id_col="term"), items)
    assert rows_of(got) == by_force([(1, "alpha"), (2, "beta beta")], [(9, "alpha beta"), (10, "beta")], 50)
    for d, q in ((frame(spark, docs), items.limit(0)), (clash.limit(0).withColumnRenamed("term", "doc_id"), items)):
        assert ranking.search(ranking.build_index(d), q).collect() == []


def test_carry_arithmetic():
    rng = np.random.default_rng(2)
    for n in (1, 64, 200):
        words = -(-n // 64)
        a, b = rng.integers(0, 1 << 20, n), rng.integers(0, 1 << 12, n)

        def slices(v, depth, words=words, n=n):
            bits = np.zeros((depth, 64 * words), np.uint8)
            bits[:, :n] = (v >> np.arange(depth)[:, None]) & 1
            return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

        def numbers(s, n=n):
            return (np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(np.int64) << np.arange(len(s))[:, None]).sum(axis=0)

        assert (numbers(ranking._added(slices(a, 20), slices(b, 12))) == a + b).all()
        assert (numbers(ranking._weighted(slices(a, 20), np.full(words, 2741))) == a * 2741).all()
        found = ranking._highest(slices(b, 12), 5)
        assert sorted(found, key=lambda i: (-b[i], i)) == [i for i in np.lexsort((np.arange(n), -b)) if b[i] > 0][:5]
