"""The additive quality model: features against plain Python, held-out accuracy, odd input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from assetloom.llm import qualitymodel as qm
from assetloom.llm.common import flat_bytes

from .helpers import frame, prose


def plain(text):
    b = (text or "").encode()
    if not b:
        return [0.0] * len(qm.FEATURES)
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    w, n = max(len(words), 1), len(b)
    share = lambda pattern: len(re.findall(pattern, b)) / n
    symbol = rb"[#*$%&|<>=~^\\{}\[\]_@/+]"
    mark = rb"[^\x20\x09-\x0DA-Za-z0-9\x80-\xff#*$%&|<>=~^\\{}\[\]_@/+]"
    letters, upper = len(re.findall(rb"[A-Za-z]", b)), len(re.findall(rb"[A-Z]", b))
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = b.count(b"\n") + 1
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w, sum(len(x) > 20 for x in words) / w, sum(len(x) <= 3 for x in words) / w, upper / max(letters, 1), share(rb"[0-9]"), share(symbol), share(mark),
        share(rb"[\x80-\xff]"), share(rb"[\x20\x09-\x0D]"), b.count(b",") / w, len(re.findall(rb"[.!?]", b)) / w, lines, n / lines, len(set(words)) / w, 1 - len(set(runs)) / len(runs) if runs else 0,
        max(Counter(words).values(), default=0) / w, float(bool(words) and re.fullmatch(mark, words[-1][-1:]) is not None), sum(x[:1].isupper() and x[:1].isascii() for x in words) / w,
    ]


def test_features_equal_plain_python():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "One two, three. One two, three. One two!", "é ü\n\n###", "x" * 3000, " lead and trail \n", prose(rng, 500), "A B C\tA B C", "0 1 2|3", None, "end"]
    got = qm.features(*flat_bytes(pa.array(texts)))
    assert np.allclose(got, [plain(t) for t in texts])
    assert qm.features(*flat_bytes(pa.array([], pa.string()))).shape == (0, len(qm.FEATURES))


def corpus():
    """Junk by one property each, and one class that only a pair of properties tells."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        text = prose(rng, rng.randrange(20, 80), 300).capitalize() + "."
        kind = i % 6
        if kind == 0:
            text = " ".join(w + rng.choice("###,***,&&&".split(",")) for w in text.split())
        elif kind == 1:
            text = text.upper()
        elif kind == 2:
            text = " ".join(text.split()[:2] * 30)
        rows.append((i, text, int(kind > 2)))
    return rows


RULES = qm.GamRules(rounds=30, pair_rounds=10)


def test_held_out_accuracy_and_inputs(spark):
    rows = corpus()
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i not in held], "doc_id long, quality int, toxic int")
    model = qm.train(docs, labels, RULES)
    got = {r["doc_id"]: r["score"] for r in qm.scored(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i in held]) > 0.98
    # ids, sources and labels don't enter a score
    moved = spark.createDataFrame([(t, i + 5000, "zz") for i, t, _ in rows], "text string, doc_id long, score string")
    assert {r["doc_id"] - 5000: r["score"] for r in qm.scored(moved, model).collect()} == got
    # repeated labels and ids without a text change nothing; the sample's bound holds
    more = labels.union(labels).union(spark.createDataFrame([(None, 1, 0), (99_999, 1, 0), (1, None, 0)], labels.schema))
    again = qm.train(docs, more, RULES)
    assert all(np.array_equal(a, b) for a, b in zip(again.tables, model.tables, strict=True))
    few = qm.train(docs, labels, qm.GamRules(rounds=5, pair_rounds=1, train_rows=100))
    assert all(0 <= r["score"] <= 1 for r in qm.scored(docs, few).collect())


def test_pairs_tell_what_single_features_cannot():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    edges = [np.linspace(0, 1, 17)[1:-1]] * 3
    model = qm.fit(x[:3000], y[:3000], edges, qm.GamRules(rounds=20, pair_rounds=60))
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.95
    alone = qm.fit(x[:3000], y[:3000], edges, qm.GamRules(rounds=20, pairs=0))
    assert np.mean((alone.score(x[3000:]) >= 0.5) == y[3000:]) < 0.65


def test_odd_input(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "x" * 200_000), (3, "again"), (None, "no id")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qm.scored(docs, qm.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    got = qm.scored(docs, qm.train(docs, one)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "None"] and all(r["score"] > 0.99 for r in got)
    assert qm.scored(docs.limit(0), qm.train(docs.limit(0), one)).collect() == []
