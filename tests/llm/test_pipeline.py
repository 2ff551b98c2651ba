"""The pipeline against a brute-force version, stage by stage, each judged on its own input."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from assetloom.llm import registry
from assetloom.llm.common import stored

from .helpers import components, frame, prose, shingles
from .test_screening import base_spans, counted

BANNER = "Read more of this on our own great site"


def documents():
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(40, 90)) for _ in range(60)]
    shared = prose(rng, 30)
    rows = [f"{BANNER}\n{t}" for t in texts[:30]] + texts[30:] + texts[30:36] + [t + " extra" for t in texts[36:40]] + [f"{prose(rng, 60)} {shared} {prose(rng, 20)}" for _ in range(4)]
    rows += [f"{prose(rng, 30)} mail me@home.example.org or +49 (30) 1234567 {prose(rng, 10)}", prose(rng, 5), "", None, "rep eat " * 40, prose(rng, 2500, 90_000)]
    return list(enumerate(rows, 1))


def drop_repeats(rows, length=50):
    """Texts without bytes that an earlier document has; characters cut in two go as a whole."""
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        b = t.encode()
        for at in range(len(b) - length + 1):
            first.setdefault(b[at : at + length], i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        out.append((i, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def redacted(text):
    out, at = [], 0
    for s, k, e in base_spans(text):
        if s >= at:
            out += [text[at:s], f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_stages_equal_brute_force(spark):
    docs, rows = frame(spark, documents()), documents()
    columns = docs.columns
    by_hand = []
    lines = lambda t: "\n".join(x for x in t.split("\n") if x != BANNER)
    by_hand.append([(i, lines(t)) for i, t in rows if not counted(t)[-1]])
    sets = components({i: shingles(t) for i, t in by_hand[-1]})
    by_hand.append([(i, t) for i, t in by_hand[-1] if sets[i] == i])
    by_hand.append(drop_repeats(by_hand[-1]))
    by_hand.append([(i, redacted(t)) for i, t in by_hand[-1]])
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], by_hand, strict=True):
        docs = stored(stage(spark, docs, ""), name)
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == dict(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert len(by_hand[0]) < len(rows) and len(by_hand[1]) < len(by_hand[0]) and by_hand[2] != by_hand[1] and by_hand[3] != by_hand[2]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total: dict[int, int] = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in by_hand[-1]}


def test_near_copies_from_similarity_80_on_go(spark):
    rng = random.Random(21)
    rows, gone = [], set()
    for i in range(0, 60, 2):
        words = prose(rng, 94 + rng.randrange(0, 27), 10**6).split()
        edited = list(words)
        far = i % 6 == 4  # a third edit takes these below 0.8
        for k in (20, 45, 70)[: 3 if far else 2]:
            edited[k] = f"new{i}at{k}"
        rows += [(i, " ".join(words)), (i + 1, " ".join(edited))]
        one, two = shingles(rows[-2][1]), shingles(rows[-1][1])
        similarity = len(one & two) / len(one | two)
        assert (similarity < 0.8) == far and similarity < 0.85
        gone |= set() if far else {i + 1}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), "").collect()}
    assert kept == {i for i, _ in rows} - gone and len(gone) == 20


def test_pipeline_of_odd_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    frame(spark, [(1, None), (None, "x " * 30), (2, "word " * 3)]).write.parquet(f"{tmp_path}/few/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/few").collect() == []


def test_the_registry_has_all_operators_and_the_pipeline_its_stages():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 5
