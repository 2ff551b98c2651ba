import random

import duckdb
import numpy as np

from assetloom.llm import registry, topk

from ..test_oracle import TABLES, canonical


def brute(v: dict[int, list[int]], k: int):
    out = set()
    for q in v:
        scored = sorted(((-int(np.dot(v[q], v[c])), c) for c in v if c != q), key=lambda x: x)[:k]
        out |= {(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = {i: rng.integers(-300, 300, 8).tolist() for i in range(150)}
    v |= {200 + i: v[3] for i in range(9)} | {300: [0] * 8, 301: [10**6] * 8}
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 30)
    df = spark.createDataFrame(list(v.items()), "id long, v array<long>")
    assert {tuple(r) for r in topk.top_k(df, df).collect()} == brute(v, 5)
    few = df.where("id < 3")
    assert {tuple(r) for r in topk.top_k(few, few).collect()} == brute({i: v[i] for i in range(3)}, 5)


def test_vectors_that_take_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (50, [0.25, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in registry.queries()["op2_exact_top_k"](spark, str(tmp_path)).collect()}
    v = {0: [128, -1], 1: [256, 256], 6: [256, 256], 50: [64, 512]}
    assert got == {x for x in brute(v, 5) if x[0] % 50 == 0}
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert registry.queries()["op2_exact_top_k"](spark, f"{tmp_path}/none").collect() == []


def test_index_stops_early_with_proof():
    rng = random.Random(1)
    v = np.array([[int(1000 * rng.random() ** 8) for _ in range(16)] for _ in range(2000)], np.int64)
    index = topk.Index(np.arange(2000), v)
    who, ids, scores = index.best(np.array([7, 8]), v[[7, 8]], 5)
    for q in (7, 8):
        all_scores = v @ v[q]
        order = sorted((i for i in range(2000) if i != q), key=lambda i: (-all_scores[i], i))[:5]
        assert ids[who == q].tolist() == order and scores[who == q].tolist() == all_scores[order].tolist()
    assert index.read < index.pairs


def test_postings_read_fall_as_rows_grow():
    rng = np.random.default_rng(3)
    shares = []
    for n in (4096, 65536):
        v = np.floor(256 * rng.normal(size=(n, 64)) / 8).astype(np.int64)
        q = v[:64]
        first = topk.Index(np.arange(n // 4), v[: n // 4])
        known = first.best(np.arange(64), q, 5)[2].reshape(64, 5).min(axis=1)
        index = topk.Index(np.arange(n), v)
        index.best(np.arange(64), q, 5, known)
        shares.append(index.read / index.pairs)
    assert shares[1] < shares[0] < 1


def test_sums_of_any_size_are_exact():
    rng = np.random.default_rng(4)
    for most in (50, 10**6, 10**9):
        v = rng.integers(-most, most, (300, 4))
        who, ids, scores = topk.Index(np.arange(300), v).best(np.arange(20), v[:20], 3)
        assert {(int(a), int(b), int(c)) for a, b, c in zip(who, ids, scores, strict=True)} == {(q, c, s) for q, _, c, s in brute({i: v[i].tolist() for i in range(300)}, 3) if q < 20}


def test_queries_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, sf_dir), con.sql(sql)
        assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns), name
