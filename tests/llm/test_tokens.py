import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assetloom.llm import bpe, packing, tokencount, tokens

from .helpers import corpus, frame

ODD = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "it's WE'LL they're 'tis don't'", "   lead and trail   ", "\n\n\t x\r\n", "日本語テキスト 123456 ١٢٣", "😀👍🏽 family 👨‍👩‍👧", "a b c", "x" * 5000, "\x00\x01�", "é" * 70, "aaaaaaa aaaa aa"]


def rows():
    return [*corpus(9), *enumerate(ODD, 1000)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_counts_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(tokencount, "PART_CHARS", 1 << 10)
    got = {r["doc_id"]: r for r in tokencount.token_counts(frame(spark, rows())).collect()}
    for i, t in rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024), t


def library_counts(name: str, texts: list[str]) -> list[int]:
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    if name.endswith(".json"):
        return [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(enc.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"])
def test_other_vocabularies(spark, name, monkeypatch):
    monkeypatch.setattr(tokencount, "PART_CHARS", 40)
    monkeypatch.setattr(tokencount, "BATCH_BYTES", 3000)
    few = [(i, t) for i, t in rows() if t and len(t) < 3000 and "<|" not in t] + [(5000, "日本語の文章です。もう一つ、そして次。" * 60), (5001, "Ünï cödé, wörds; Кириллица: да! don't, it's." * 50)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(frame(spark, few), vocabulary=name).collect()}
    assert got == dict(zip([i for i, _ in few], library_counts(name, [t for _, t in few]), strict=True))


def test_split_parts_join_to_the_text():
    text = ("word " * 50 + "\n\n  gap ' s ") * 40
    assert "".join(tokens.safe_parts(text, 100)) == text and len(tokens.safe_parts(text, 100)) > 10
    assert tokens.safe_parts("x" * 500, 100) == ["x" * 500]
    chinese = "这是一个很长的句子，没有空格。" * 100
    assert "".join(tokens.safe_parts(chinese, 100)) == chinese and max(map(len, tokens.safe_parts(chinese, 100))) < 120


def test_encoding_and_decoding_equal_the_library(spark, library):
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame(spark, rows()))).collect()}
    for i, t in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, t
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") & 1 else a for i in range(n))


@pytest.mark.parametrize("same_hash", [False, True])
def test_words_are_told_apart_by_their_bytes(library, monkeypatch, same_hash):
    """Words that collide under a hash modulo a power of two, and with any hash at all."""
    import pyarrow as pa

    if same_hash:
        monkeypatch.setattr(bpe, "long_hash", lambda a, b: np.zeros(len(a), np.uint64))
    words = [w for n in (1024, 2048) for w in (thue_morse(n, "a", "b"), thue_morse(n, "b", "a"))]
    texts = [" ".join(words), *words, "internationally internationalise " * 3, "<|endoftext|>" + words[1]]
    voc = bpe.vocabulary("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "byte_slices", lambda batch, name, most=0: (batch.slice(i, 2) for i in range(0, batch.num_rows, 2)))
    out = pa.Table.from_batches(bpe._encode_batch(voc, pa.record_batch({"id": list(range(len(texts))), "text": texts})))
    assert out.column("ids").to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_op5_columns(spark, library, tmp_path):
    texts = {1: "hello world", 2: None, 3: "word " * 1100, 4: "<|endoftext|>"}
    frame(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.op5_token_counts(spark, str(tmp_path)).collect()}
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len((t or "").encode()), n[i], n[i] > 1024) for i, t in texts.items()} and got[3][2]


def test_op10_columns_and_number_of_sequences(spark, library, tmp_path):
    rng = np.random.default_rng(5)
    docs = [(i, "word " * int(n)) for i, n in enumerate([*rng.integers(1, 900, 300), *rng.integers(900, 5000, 40)])]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op10_best_fit_packing(spark, str(tmp_path)).collect()
    assert set(got[0].asDict()) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for i, t in docs[:20]:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        one = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in one) == len(ids) and all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in one)
    # best-fit decreasing, piece by piece, needs about as many
    gaps: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - n)
    made = len({r["sequence_id"] for r in got})
    assert made <= 1.02 * len(gaps) + 1 and made >= -(-sum(r["length"] for r in got) // 2048)


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [50256]), (4, [447]), (5, [10**6])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df).collect()}
    assert got[1] == got[2] == got[5] == "" and got[3] == "<|endoftext|>" and "�" in got[4]
    assert bpe.encode(frame(spark, [])).collect() == [] and tokencount.token_counts(frame(spark, [])).collect() == []


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_gapless_and_whole(spark, library, capacity):
    got = packing.pack(frame(spark, [*rows(), (3000, ""), (3000, "")]), capacity=capacity, bucket_rows=10).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in rows():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // capacity))) and [r["start"] for r in parts[1:]] == [r["start"] + r["length"] for r in parts[:-1]]
        assert all(r["length"] == capacity for r in parts[1:]) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
    assert len(by_doc[3000]) == 2
    total, large = sum(r["length"] for r in got), sum(2 * r["length"] > capacity for r in got)
    assert len(by_sequence) <= 1.25 * max(-(-total // capacity), large) + 1


def test_large_pieces_pair_at_most_twice():
    counts = {700: 10, 900: 3, 1400: 5, 1100: 7, 100: 40, 3: 500}
    placed: dict[int, list[int]] = {}
    for length, a, b, first, each, _ in packing.plan(counts, 2048):
        for rank in range(a, b):
            placed.setdefault(first + (rank - a) // each, []).append(length)
    assert sorted(x for s in placed.values() for x in s) == sorted(k for k, n in counts.items() for _ in range(n))
    assert all(sum(s) <= 2048 and sum(3 * x > 2048 for x in s) <= 2 for s in placed.values())
    assert packing.plan({}, 2048) == []


def test_op7_columns(spark, library, tmp_path):
    frame(spark, [(1, "hello world"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op7_bpe_round_trip(spark, str(tmp_path)).collect()}
    ids = library.encode("hello world", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_tokens"], got[1]["ids_sha256"], got[1]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha("hello world"))
    assert (got[2]["n_tokens"], got[2]["ids_sha256"], got[2]["decoded_sha256"]) == (0, sha(""), sha(""))
