"""Small corpora and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows: (doc_id, text); further columns as in `documents`, and some with clashing names."""
    full = [(i, t, "en", "host-a", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed: int = 1) -> list[tuple[int, str | None]]:
    """Unique texts, exact and near copies, shared passages, and odd cases."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(30)]
    passage = prose(rng, 40)
    rows: list[str | None] = [*base, *base[:6], base[0].upper(), None, "", " \n\t ", "one two", "one  two", "é" * 60 + " ünï " + "é" * 60, prose(rng, 30_000, 100_000), "aaaa" * 60, "a" * 300]
    for t in base[:8]:
        words = t.split()
        words[len(words) // 2] = "changed"
        rows.append(" ".join(words))
    rows += [f"{t} {passage}\n{passage}" for t in base[8:12]]
    rng.shuffle(rows)
    return list(enumerate(rows, 3))


def shingles(text: str | None, k: int = 5) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def components(sets: dict[int, frozenset], percent: int = 85) -> dict[int, int]:
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def without_repeats(rows, length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for at in range(len(b) - length + 1):
            first.setdefault(b[at : at + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out
