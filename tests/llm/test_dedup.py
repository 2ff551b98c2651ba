import random

import pytest

from assetloom.llm import neardup, pii, quality, suffixdedup
from assetloom.llm.graph import connected

from .helpers import components, corpus, frame, prose, shingles, without_repeats


@pytest.mark.parametrize("options", [neardup.NearDup(), neardup.NearDup(all_pairs=2, block_rows=3)])
def test_near_duplicates_equal_brute_force(spark, options):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    roots = components(sets)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, rows), options).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), roots[i], roots[i] == i)


def test_star_of_edited_copies(spark):
    """Copies of one text that are near it, though often not near each other, and a chain."""
    rng = random.Random(2)
    base = prose(rng, 200).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 6, 12])):
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows), neardup.NearDup(all_pairs=4, block_rows=16)).collect()}
    assert got == components(sets)


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in neardup.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
    rows = neardup.near_duplicates(frame(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    clash = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")]).withColumnsRenamed({"lang": "bucket", "source": "digest"})
    assert [r["doc_id"] for r in neardup.without_near_duplicates(clash).collect()] == [1]


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_modulo_powers_of_two(spark, n):
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rows = [(1, f"{one} c d e f"), (2, f"{two} c d e f"), (3, f"{one} c d e f"), (4, one), (5, two), (6, one + two), (7, two + one)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (1, root) for i, root in components({i: shingles(t) for i, t in rows}).items()}
    want = without_repeats(rows)
    found = suffixdedup.remove_repeats(frame(spark, rows)).selectExpr("doc_id", "_n_bytes", "_n_bytes - octet_length(_kept)", "CAST(size(_spans) / 2 AS INT)", "sha2(_kept, 256)").collect()
    assert all(tuple(r)[1:] == want[r[0]] for r in found)


CLASHING = ["p_id", "_text", "v_id", "k_id", "_id", "_key", "_kept", "_spans", "text_key", "kept", "bucket", "_column_0", "blob", "p_spans", "v_lines", "host", "id", "line", "lost"]


@pytest.mark.parametrize("stage", [pii.redact, quality.apply_quality, neardup.without_near_duplicates, suffixdedup.without_repeats])
def test_stages_take_columns_of_any_name(spark, stage):
    rng = random.Random(31)
    text = prose(rng, 60)
    docs = frame(spark, [(1, f"{text} me@ex.org"), (2, text), (3, prose(rng, 50)), (None, prose(rng, 40)), (4, None)])
    more = docs.selectExpr("*", *(f"concat('{c} ', doc_id) AS `{c}`" for c in CLASHING), "doc_id AS `dotted.name`")
    out = stage(more)
    assert out.columns == more.columns
    got = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert got.keys() == {r["doc_id"] for r in stage(docs).collect()} and len(got) > 1
    assert {i: r["text"] for i, r in got.items()} == {r["doc_id"]: r["text"] for r in stage(docs).collect()}
    assert all(r[c] == (None if i is None else f"{c} {i}") for i, r in got.items() for c in CLASHING)


def test_op3_and_op4_columns(spark, tmp_path):
    rows = corpus(21)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: shingles(t) for i, t in rows}
    roots = components(sets)
    got = neardup.op3_near_duplicates(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[i]), roots[i], roots[i] == i) for i in sets)
    small = [(i, t[:3000] if t else t) for i, t in rows]
    frame(spark, small).write.parquet(f"{tmp_path}/small/documents.parquet")
    got = suffixdedup.op4_suffix_array_dedup(spark, f"{tmp_path}/small").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == without_repeats(small)


def test_registers_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    p = neardup.NearDup()
    sk = neardup.Sketcher(p)
    a, b = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(0, 1 << 63, 500).astype(np.uint64)
    union = np.concatenate((a, b))
    assert (np.maximum(sk.registers(a), sk.registers(b)) == sk.registers(union)).all()
    j, _, _ = neardup.joint_likelihood(sk.registers(a)[None], sk.registers(union)[None], np.array([3000.0]), np.array([3500.0]), 0.85, p)
    assert abs(j[0] - 3000 / 3500) < 0.1


def test_components_reach_the_least_id(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["id"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("bucket_bytes,part_bytes", [(suffixdedup.BUCKET_BYTES, suffixdedup.PART_BYTES), (4000, 6000)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, bucket_bytes, part_bytes):
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(suffixdedup, "PART_BYTES", part_bytes)
    monkeypatch.setattr(suffixdedup, "COUNT_BYTES", part_bytes)
    rows = [(i, t[:4000] if t else t) for i, t in corpus(4)]
    want = without_repeats(rows)
    got = suffixdedup.remove_repeats(frame(spark, rows)).selectExpr("doc_id", "_n_bytes", "_n_bytes - octet_length(_kept)", "CAST(size(_spans) / 2 AS INT)", "sha2(_kept, 256)").collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r[0]] for r in got)


def test_hot_minimisers_are_dealt_string_by_string(spark, monkeypatch):
    """One phrase in many different surroundings: its minimiser has more segments than a part should hold."""
    rng = random.Random(18)
    phrase = "the very same words stand in every text of this small corpus"
    rows = [(i, f"{prose(rng, 4)} {phrase} {rng.choice('ab')} {prose(rng, 4)}") for i in range(120)] + [(500, f"x {phrase} a"), (501, f"x {phrase} a" * 3)]
    monkeypatch.setattr(suffixdedup, "HOT_SEGMENTS", 5)
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffixdedup, "PART_BYTES", 6000)
    want = without_repeats(rows)
    docs = frame(spark, rows)
    got = suffixdedup.remove_repeats(docs).selectExpr("doc_id", "_n_bytes", "_n_bytes - octet_length(_kept)", "CAST(size(_spans) / 2 AS INT)", "sha2(_kept, 256)").collect()
    assert all(tuple(r)[1:] == want[r[0]] for r in got) and any(w[1] for w in want.values())
    keyed = docs.selectExpr("*", "doc_id AS _id", "xxhash64(text) AS _key")
    packed = suffixdedup._packed(keyed, 4)
    shared = suffixdedup._shared(suffixdedup._counted(packed, "text", 2, 50))
    sent = suffixdedup._requests(packed, shared, "text", 2, 6, 50).where("not spans").collect()
    assert any((suffixdedup._unpack(r["blob"])[6] == suffixdedup._ALONE).any() for r in sent)


def test_strings_with_one_hash_are_told_apart(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffixdedup, "range_hashes", lambda grams, start, size: np.zeros(len(start), np.uint64))
    rows = [(i, t[:800] if t else t) for i, t in corpus(5)][:30]
    want = without_repeats(rows)
    import pyarrow as pa

    table = pa.table({"_id": [i for i, _ in rows], "text": [t for _, t in rows], "_key": [0] * len(rows)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    bucket = suffixdedup._Bucket(pa.table({"blob": pa.array([sink.getvalue().to_pybytes()])}), "text", 1, 50)
    out = []
    keep = np.ones(len(bucket.doc), bool)
    suffixdedup._ask(bucket, keep, ~keep, 0, 1, 50, out)
    gone = {i: np.zeros(len((t or "").encode()), bool) for i, t in rows}
    for _, known, blob in out:
        ids, _, doc, start, size = suffixdedup._unpack(blob) if known else suffixdedup._resolve([blob], 50)
        for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
            gone[int(ids[d])][a : a + n] = True
    assert {i: int(g.sum()) for i, g in gone.items()} == {i: w[1] for i, w in want.items()}


def test_spans_known_in_a_bucket_are_spread_over_parts(spark):
    rng = random.Random(17)
    text = prose(rng, 60)
    docs = frame(spark, [(i, text) for i in range(400)])
    keyed = docs.selectExpr("*", "doc_id AS _id", "xxhash64(text) AS _key").coalesce(1)
    packed = suffixdedup._packed(keyed, 20)
    shared = suffixdedup._shared(suffixdedup._counted(packed, "text", 2, 50))
    known = suffixdedup._requests(packed, shared, "text", 2, 40, 50).where("spans").groupBy("part").count().collect()
    assert len(known) == 20 and all(r["count"] == 1 for r in known)


def test_strings_equal_by_hash_only_are_told_apart():
    import numpy as np

    texts = [b"x" * 49 + b"y" + b"z" * 20, b"y" + b"z" * 20 + b"x" * 49, b"x" * 70]
    text, offset, number = suffixdedup.shared_strings(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), 50)
    classes = {}
    for t, o, c in zip(text.tolist(), offset.tolist(), number.tolist(), strict=True):
        classes.setdefault(texts[t][o : o + 50], set()).add(c)
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)
    assert sum(len(t) - 49 for t in texts) == len(text)


def test_suffix_dedup_of_odd_tables(spark):
    assert suffixdedup.remove_repeats(frame(spark, [])).collect() == []
    t = "0123456789" * 6
    got = {(r["doc_id"], r["source"]): bytes(r["_kept"]).decode() for r in suffixdedup.remove_repeats(frame(spark, [(2, t), (1, t), (1, t + "!"), (None, t), (3, None)])).collect()}
    assert got == {(2, "host-a"): "", (1, "host-a"): got[(1, "host-a")], (None, "host-a"): t, (3, "host-a"): ""} and got[(1, "host-a")].startswith(t)
    cut = suffixdedup.without_repeats(frame(spark, [(1, "a" * 49 + "é"), (2, "b" + "a" * 49 + "é"), (3, "c" + "a" * 49 + "è")])).collect()
    # 49 letters and the first byte of é, which è shares, make 50 bytes; cut characters go whole
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut} == {1: ("a" * 49 + "é", 50), 2: ("b", 1), 3: ("c", 1)}
