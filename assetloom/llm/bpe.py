"""Operator 7: byte-level BPE encoding and decoding with a pair occurrence index.

A partition's distinct words are laid out as one array of symbols. The index maps the rank
of each adjacent pair to all positions where the pair stands; ranks are applied in ascending
order, each to all its positions at once, and the lists of the pairs that a merge forms are
added to. Word boundaries, keys and the spreading of ids over documents are array passes; words
are the same where their bytes are.
"""

from __future__ import annotations

import functools
import heapq
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, equal_ranges, flat_bytes, mix64, ragged, table
from .tokens import DEFAULT, vocabulary_path

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_NONE = np.int64(1 << 40)
#: Text bytes that share one pair index, and ids decoded at a time.
INDEX_BYTES, DECODE_IDS = 8 << 20, 1 << 18


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        back = byte_symbols()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec.get("added_tokens") or []}
        self.of_byte = np.zeros(256, np.int64)
        for sign, b in back.items():
            self.of_byte[b] = ids[sign]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right, self.joined = left, right, np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        strings = {i: bytes(back[c] for c in t) for t, i in ids.items() if all(c in back for c in t)}
        strings |= {i: t for t, i in self.special.items()}
        size = max(strings) + 1
        parts = [strings.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.classes = np.full(0x110000, 255, np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or _NONE."""
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def char_classes(self, points: np.ndarray) -> np.ndarray:
        """Space, letter, number or other, as the library's own pre-tokeniser cuts them."""
        out = self.classes[points]
        new = np.unique(points[out == 255])
        if len(new):
            for p in new.tolist():
                alone = [len(self.cutter.pre_tokenize_str(x + chr(p))) == 1 for x in ("a", "1", "!")]
                self.classes[p] = LETTER if alone[0] else NUMBER if alone[1] else OTHER if alone[2] else SPACE
            out = self.classes[points]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(vocabulary_path(name))


def word_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser begins a word; first: where a segment (text, special token) begins."""
    n = len(points)
    ends = np.ones(n, bool)
    ends[:-1] = first[1:]
    blank = points == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = run & (space | ~after_blank)
    # the last of a run of spaces stands alone or goes with the word after it
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:]
    start |= before_word & ~ends
    quote = np.flatnonzero((points == 0x27) & start & ~ends)
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        letter = np.zeros(n + 2, bool)
        letter[:n] = (kind == LETTER) & ~first
        one, two = padded[quote + 1], padded[quote + 2]
        short = letter[quote + 1] & np.isin(one, [ord(c) for c in "stmd"])
        both = letter[quote + 1] & letter[quote + 2] & ~short
        long = both & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            start[at + 1] = False
            rest = at + size
            rest = rest[rest < n]
            start[rest[letter[rest]]] = True
    return start


def merge_words(voc: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words data[offsets[i]:offsets[i + 1]], flat, and how many each has."""
    n = len(data)
    sym = voc.of_byte[data]
    nxt = np.arange(1, n + 1)
    nxt[offsets[1:] - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[offsets[:-1]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        """Puts the pairs that begin at these positions into the index."""
        ranks = voc.rank(sym[at], sym[nxt[at]])
        have = ranks < _NONE
        if not have.any():
            return
        at, ranks = at[have], ranks[have]
        if len(at) > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups, heads = (np.split(at, cuts), ranks[np.concatenate(([0], cuts))].tolist()) if len(cuts) else ([at], [int(ranks[0])])
        else:
            groups, heads = [at], [int(ranks[0])]
        for r, group in zip(heads, groups, strict=True):
            if r in index:
                index[r].append(group)
            else:
                index[r] = [group]
                heapq.heappush(heap, r)

    add(np.flatnonzero(nxt >= 0))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = voc.left[r], voc.right[r]
        to = nxt[at]
        ok = alive[at] & (sym[at] == a) & (to >= 0)
        ok &= sym[to] == b
        at, to = at[ok], to[ok]
        if a == b and len(at) > 1:  # in a run of one symbol the leftmost pairs go first
            taken: set[int] = set()
            keep = np.zeros(len(at), bool)
            for i in np.argsort(at).tolist():
                p, q = int(at[i]), int(to[i])
                if p not in taken:
                    keep[i] = True
                    taken.add(q)
            at, to = at[keep], to[keep]
        if not len(at):
            continue
        after = nxt[to]
        sym[at] = voc.joined[r]
        alive[to] = False
        nxt[at] = after
        follows = after >= 0
        prv[after[follows]] = at[follows]
        before = prv[at]
        touched = np.concatenate((before[before >= 0], at[follows]))
        if len(touched):
            add(np.unique(touched) if a == b else touched)
    counts = np.add.reduceat(alive, offsets[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    return sym[alive], counts


def word_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each word: of up to 7 bytes the bytes and their number, of more a hash with the top bit set."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    short = np.minimum(sizes, 7).astype(np.uint64)
    keys = (eight[starts] & ((np.uint64(1) << (short * np.uint64(8))) - np.uint64(1))) | (short << np.uint64(56))
    long = np.flatnonzero(sizes > 7)
    if len(long):
        at, size = starts[long], sizes[long]
        found = long_hash(eight[at + size - 8], size.astype(np.uint64))
        for j in range(int(size.max()) // 8):
            left = np.flatnonzero(size >= 8 * (j + 1))
            found[left] = long_hash(found[left], eight[at[left] + 8 * j])
        keys[long] = found | np.uint64(1 << 63)
    return keys


def long_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two; words with the same one are told apart by their bytes."""
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


class Slice:
    """The words of some texts: bytes, where each begins, and how many each text has."""

    def __init__(self, voc: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))  # byte of each character
        n = len(points)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, offsets)] = True
        marks = self._special(voc, data, offsets)
        inside = np.zeros(n + 1, bool)
        for begin, end, _ in marks:
            i, j = np.searchsorted(at, (begin, end))
            first[[i, j]] = True
            inside[i + 1 : j] = True
        start = word_starts(points, voc.char_classes(points), first[:n]) if n else np.zeros(0, bool)
        start |= first[:n]
        start &= ~inside[:n]
        starts = at[np.flatnonzero(start)]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        self.per_text = np.diff(np.searchsorted(starts, offsets))
        self.keys = word_keys(data, starts, ends - starts)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        self.forced = {int(np.searchsorted(self.starts, begin)): token for begin, _, token in marks}

    @staticmethod
    def _special(voc: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        out, whole = [], data.tobytes()
        for text, token in voc.special.items():
            i = whole.find(text)
            while i >= 0:
                ends = offsets[np.searchsorted(offsets, i, "right")] if i < offsets[-1] else i
                if i + len(text) <= ends:
                    out.append((i, i + len(text), token))
                    i = whole.find(text, i + len(text))
                else:
                    i = whole.find(text, i + 1)
        return sorted(out)


def encode(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", vocabulary_file: str = DEFAULT) -> DataFrame:
    """One row per row of docs: id and ids (array<int>), without added begin or end tokens.

    Special strings inside a text become their one id, as the library does by default. Null
    and empty text: an empty array. Repeated rows each give a row; a null id stays null;
    other columns are not read.
    """

    def run(batches):
        voc = vocabulary(vocabulary_file)
        for batch in batches:
            for part in byte_slices(batch, "text", INDEX_BYTES):
                yield from _encode_batch(voc, part)

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def _encode_batch(voc: Vocabulary, batch: pa.RecordBatch):
    cut = [(part, Slice(voc, *flat_bytes(part.column("text")))) for part in byte_slices(batch, "text")]
    if not cut:
        return
    # the batch's distinct words, each taken from the first slice that has it
    keys, where, at = [], [], []
    for k, (_, s) in enumerate(cut):
        plain = np.ones(len(s.starts), bool)
        plain[list(s.forced)] = False
        h, i = np.unique(s.keys[plain], return_index=True)
        keys.append(h)
        where.append(np.full(len(h), k))
        at.append(np.flatnonzero(plain)[i])
    words, pick = np.unique(np.concatenate(keys), return_index=True)
    where, at = np.concatenate(where)[pick], np.concatenate(at)[pick]
    order = np.argsort(where, kind="stable")
    texts, lengths = [], []
    for k, (_, s) in enumerate(cut):
        mine = at[order[np.searchsorted(where[order], k) : np.searchsorted(where[order], k, "right")]]
        size = (s.ends[mine] - s.starts[mine]).astype(np.int64)
        texts.append(s.data[ragged(s.starts[mine].astype(np.int64), size)])
        lengths.append(size)
    size = np.concatenate(lengths)
    begin = np.cumsum(size) - size
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    # the word of each place, and words with another one's hash, by their bytes
    data, others, uses = np.concatenate(texts), {}, []
    for _, s in cut:
        which = np.zeros(len(s.starts), np.int64)
        plain = np.ones(len(s.starts), bool)
        plain[list(s.forced)] = False
        if len(words):
            which[plain] = place[np.searchsorted(words, s.keys[plain])]
        long = np.flatnonzero(plain & (s.ends - s.starts > 7))
        n = (s.ends[long] - s.starts[long]).astype(np.int64)
        same = n == size[which[long]]
        same[same] = equal_ranges(s.data, s.starts[long[same]].astype(np.int64), begin[which[long[same]]], n[same], data)
        for i in long[~same].tolist():
            which[i] = len(words) + others.setdefault(s.data[s.starts[i] : s.ends[i]].tobytes(), len(others))
        uses.append(which)
    size = np.concatenate((size, np.array([len(w) for w in others], np.int64)))
    data = np.concatenate((data, np.frombuffer(b"".join(others), np.uint8)))
    flat, counts = merge_words(voc, data, np.concatenate(([0], np.cumsum(size))))
    begins = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    specials = sorted(voc.special.values())
    first_special = len(counts)
    flat, begins, counts = np.concatenate((flat, specials)).astype(np.int32), np.concatenate((begins, len(flat) + np.arange(len(specials)))).astype(np.int64), np.concatenate((counts, np.ones(len(specials), np.int64)))
    for (part, s), which in zip(cut, uses, strict=True):
        for i, token in s.forced.items():
            which[i] = first_special + specials.index(token)
        ids = flat[ragged(begins[which], counts[which])]
        ends = np.concatenate(([0], np.cumsum(counts[which])))[np.concatenate(([0], np.cumsum(s.per_text)))]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["id", "ids"])


def decode(rows: DataFrame, *, ids_col: str = "ids", vocabulary_file: str = DEFAULT) -> DataFrame:
    """rows and a column `decoded`: the text of the ids, special tokens kept.

    Null ids: empty text. Bytes that are no UTF-8 (ids cut inside a character) become
    U+FFFD. An id outside the vocabulary gives no bytes. An existing `decoded` is replaced.
    """
    rows = rows.drop("decoded")

    def run(batches):
        voc = vocabulary(vocabulary_file)
        lengths, starts = np.append(voc.lengths, 0), np.append(voc.starts, 0)
        for whole in batches:
            sizes = whole.column(ids_col).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODE_IDS, "right")) - 1)
                batch = whole.slice(at, to - at)
                flat = batch.column(ids_col).flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = np.where((flat >= 0) & (flat < len(voc.lengths)), flat, len(voc.lengths))
                texts = []
                for i in range(at, to):
                    ids = flat[ends[i] - ends[at] : ends[i + 1] - ends[at]]
                    texts.append(voc.bytes[ragged(starts[ids], lengths[ids])].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
                at = to

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents"))
    return decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
