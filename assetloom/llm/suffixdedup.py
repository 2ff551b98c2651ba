"""Operator 4: removal of byte strings that an earlier document holds.

Every string of `length` bytes has a minimiser, the least hash of the 16-byte strings in it;
neighbouring strings with one minimiser form a segment. Documents are dealt into buckets. The
buckets' minimisers are counted first, and only segments whose minimiser several documents
have are sent on, to the part of their minimiser, so that all copies of a string meet there.
Segments of a minimiser that very many segments have are sent as single strings of `length`
bytes by their own hash, so that no part has to hold them all.

In a part the different segments become one Burrows-Wheeler transform: of its whole suffix
order, intervals of suffixes are extended backward, breadth first, which derives the common
prefixes of neighbouring suffixes by increasing value, and stops at `length`; what is then
undivided is one string, and its least document keeps it. Before that, copies of a segment
(told by their bytes) are only counted together: in a bucket, later documents lose what an
earlier one of the bucket has at once, and one segment with the least document goes on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, byte_slices, equal_ranges, flat_bytes, mix64, ragged, table

GRAM = 16
#: Bytes that segments in a part can have at most on average, bytes of minimisers in a part,
#: text bytes in a bucket of documents, bytes in one transform.
PART_BYTES, COUNT_BYTES, BUCKET_BYTES, TRANSFORM_BYTES = 24 << 20, 4 << 20, 12 << 20, 1 << 20
#: Different segments of a minimiser (counted once a bucket) above which it is dealt string by string.
HOT_SEGMENTS = 8192
_MOST_WINDOWS = 256
_ALONE = 255  # in place of a minimiser's place: the segment is one string, dealt by its own hash


# --- packed arrays -----------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2).tolist()
    out, at = [], 8 + 16 * n
    for size, count in head:
        out.append(np.frombuffer(raw, {1: np.uint8, 4: np.uint32, 8: np.int64}[size], count, at))
        at += size * count
    return out


# --- segments ----------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


# Odd multipliers that spread 8 bytes over 64 bits.
_SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    data = np.ascontiguousarray(data)
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,)) if len(data) > 7 else np.empty(0, "<u8")
    x = eight[:-8] * _SPREAD[0]
    x ^= x >> np.uint64(32)
    x *= _SPREAD[1]
    x += eight[8:] * _SPREAD[2]
    return mix64(x)


def range_hashes(grams: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range (of GRAM bytes at least), from the hashes of its grams."""
    out = grams[start + size - GRAM] + size.astype(np.uint64)
    for j in range(int(size.max(initial=0)) // GRAM):
        out = np.where(size >= (j + 1) * GRAM, mix64(out * _SPREAD[0] + grams[start + np.minimum(j * GRAM, size - GRAM)]), out)
    return out


def segments(data: np.ndarray, offsets: np.ndarray, length: int, grams: np.ndarray):
    """Runs of `length`-byte strings with one minimiser: text, start in the buffer, bytes, minimiser."""
    size = np.diff(offsets)
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    least = _sliding_min(grams, length - GRAM + 1)
    # the strings of a text begin from its start up to a stop; a stop ends the run before it
    own = size >= length
    begin, stop = offsets[:-1][own], offsets[1:][own] - length + 1
    if not len(begin):
        return segments(data[:0], offsets[:1], length, grams)
    cut = np.zeros(len(least) + 1, bool)
    cut[1:-1] = least[1:] != least[:-1]
    gap = np.append(0, stop)
    cut[ragged(gap, np.append(begin, len(cut)) - gap)] = False
    cut[begin] = True
    cut[stop] = True
    first = np.flatnonzero(cut)
    runs = np.ones(len(first), bool)
    runs[np.searchsorted(first, stop)] = False
    windows = np.diff(first, append=0)[runs]
    first = first[runs]
    if windows.max() > _MOST_WINDOWS:
        cuts = -(-windows // _MOST_WINDOWS)
        step = ragged(np.zeros(len(cuts), np.int64), cuts) * _MOST_WINDOWS
        first, windows = np.repeat(first, cuts) + step, np.minimum(np.repeat(windows, cuts) - step, _MOST_WINDOWS)
    return np.searchsorted(offsets, first, "right") - 1, first, windows + length - 1, least[first]


def _minimiser_places(grams: np.ndarray, starts: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """Where in each segment its minimiser first stands."""
    out = np.zeros(len(starts), np.int64)
    left = np.arange(len(starts))
    for j in range(length - GRAM + 1):
        found = grams[starts[left] + j] == least[left]
        out[left[found]] = j
        left = left[~found]
    return out


class _Bucket:
    """The texts of a bucket as one buffer, with their segments; minimisers sorted by part and value. Their places in the segments only if wanted."""

    def __init__(self, table: pa.Table, text_col: str, parts: int, length: int, places: bool = True):
        none = np.empty(0, np.int64)
        ids, keys, data, found = [none], [none], [np.empty(0, np.uint8)], [(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)]
        texts = filled = 0
        for blob in table.column("blob").to_pylist():
            for batch in pa.ipc.open_stream(blob):
                batch = batch.filter(batch.column("_id").is_valid())
                for part in byte_slices(batch, text_col):
                    raw, offsets = flat_bytes(part.column(text_col))
                    grams = gram_hashes(raw)
                    text, start, size, least = segments(raw, offsets, length, grams)
                    found.append((text + texts, start - offsets[text], start + filled, size, least, range_hashes(grams, start, size), _minimiser_places(grams, start, least, length) if places else none))
                    ids.append(part.column("_id").to_numpy())
                    keys.append(part.column("_key").to_numpy())
                    data.append(raw)
                    texts, filled = texts + part.num_rows, filled + len(raw)
        self.ids, self.keys, self.data = np.concatenate(ids), np.concatenate(keys), np.concatenate(data)
        self.doc, self.start, self.at, self.size, least, self.name, self.where = (np.concatenate(x) for x in zip(*found, strict=True))
        self.unique, self.which = np.unique(least, return_inverse=True)
        self.part = (self.unique % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(self.part, kind="stable")
        self.cuts = np.searchsorted(self.part[self.order], np.arange(parts + 1))

    def several(self) -> np.ndarray:
        """Whether two ids of this bucket have the minimiser."""
        ids = self.ids[self.doc]
        low = np.full(len(self.unique), np.iinfo(np.int64).max)
        high = np.full(len(self.unique), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        return low < high

    def contents(self) -> np.ndarray:
        """How many different segments the minimiser has in this bucket."""
        order = np.lexsort((self.name, self.which))
        which, name = self.which[order], self.name[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (which[1:] != which[:-1]) | (name[1:] != name[:-1])
        return np.bincount(which[fresh], minlength=len(self.unique))


def _counted(packed: DataFrame, text_col: str, parts: int, length: int) -> DataFrame:
    """(bucket, blob of documents) to (part, bucket, hashes, several, contents): a bucket's minimisers by part."""

    def run(group: pa.Table) -> pa.Table:
        bucket, out = _Bucket(group, text_col, parts, length, places=False), []
        several, contents = bucket.several(), np.minimum(bucket.contents(), 0xFFFF).astype(np.uint16)
        for p in np.flatnonzero(np.diff(bucket.cuts)).tolist():
            mine = bucket.order[bucket.cuts[p] : bucket.cuts[p + 1]]
            out.append((p, bucket.unique[mine].tobytes(), np.packbits(several[mine]).tobytes(), contents[mine].tobytes()))
        where = group.column("bucket")[0].as_py() if group.num_rows else 0
        return pa.table({
            "part": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([where] * len(out), pa.int32()),
            **{n: pa.array([x[k] for x in out], pa.binary()) for k, n in enumerate(("hashes", "several", "contents"), 1)},
        })

    return packed.groupBy("bucket").applyInArrow(run, "part int, bucket int, hashes binary, several binary, contents binary")


def _shared(counted: DataFrame) -> DataFrame:
    """_counted to (bucket, part, shared, hot): bits for each of the bucket's hashes."""

    def run(group: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(group.column("several").to_pylist(), hashes, strict=True)]
        if not hashes:
            return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "shared": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())})
        unique, which, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        several = count > 1  # a bucket has each hash once
        several[which[np.concatenate(flags)]] = True
        total = np.bincount(which, np.concatenate([np.frombuffer(x, np.uint16) for x in group.column("contents").to_pylist()]), len(unique))
        ends = np.cumsum([len(h) for h in hashes])
        bits = [[np.packbits(x[which[e - len(h) : e]]).tobytes() for h, e in zip(hashes, ends, strict=True)] for x in (several, total > HOT_SEGMENTS)]
        return pa.table({"bucket": group.column("bucket"), "part": group.column("part"), "shared": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary())})

    return counted.groupBy("part").applyInArrow(run, "bucket int, part int, shared binary, hot binary")


def _requests(packed: DataFrame, shared: DataFrame, text_col: str, count_parts: int, parts: int, length: int) -> DataFrame:
    """Documents and shared minimisers by bucket to (part, spans, blob): segments by part, or spans known to go at once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, bool, bytes]] = []
        bucket = _Bucket(left, text_col, count_parts, length)
        flags = np.zeros((2, len(bucket.unique)), bool)
        for p, *bits in zip(*(right.column(c).to_pylist() for c in ("part", "shared", "hot")), strict=True):
            mine = bucket.order[bucket.cuts[p] : bucket.cuts[p + 1]]
            flags[:, mine] = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(mine)).astype(bool) for x in bits]
        if flags[0].any():
            _ask(bucket, flags[0][bucket.which], flags[1][bucket.which], left.column("bucket")[0].as_py(), parts, length, out)
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "spans": pa.array([x[1] for x in out], pa.bool_()), "blob": pa.array([x[2] for x in out], pa.binary())})

    return packed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(run, "part int, spans boolean, blob binary")


def _leads(data: np.ndarray, name: np.ndarray, at: np.ndarray, size: np.ndarray, who: np.ndarray) -> np.ndarray:
    """For each range the first one, of the least id, that has the same bytes."""
    order = np.argsort(name)
    fresh = np.ones(len(order), bool)
    fresh[1:] = name[order][1:] != name[order][:-1]
    group = np.cumsum(fresh) - 1
    low = np.minimum.reduceat(who[order], np.flatnonzero(fresh)) if len(order) else who
    lead_of = np.full(len(low), len(name))
    at_low = who[order] == low[group]
    np.minimum.at(lead_of, group[at_low], order[at_low])
    lead = np.empty(len(name), np.int64)
    lead[order] = lead_of[group]
    other = np.flatnonzero(lead != np.arange(len(lead)))
    same = size[other] == size[lead[other]]
    same[same] = equal_ranges(data, at[other[same]], at[lead[other[same]]], size[other[same]])
    lead[other[~same]] = other[~same]  # one hash, different bytes: stands for itself
    return lead


def _ask(bucket: _Bucket, keep: np.ndarray, hot: np.ndarray, number: int, parts: int, length: int, out: list) -> None:
    """The kept segments of a bucket as rows of `out`."""
    ids, keys, data = bucket.ids, bucket.keys, bucket.data
    columns = [x[keep] for x in (bucket.doc, bucket.start, bucket.at, bucket.size, bucket.name, bucket.where)]
    to, hot = bucket.unique[bucket.which[keep]], hot[keep]
    lead = _leads(data, columns[4], columns[2], columns[3], ids[columns[0]])
    later = ids[columns[0]] > ids[columns[0][lead]]
    known = [tuple(x[later] for x in columns[:2]) + (columns[3][later],)]
    if hot.any():  # cut into single strings, and these folded again
        cut = np.flatnonzero(hot & ~later)
        n = columns[3][cut] - length + 1
        step = ragged(np.zeros(len(n), np.int64), n)
        doc, start, at = (np.repeat(x[cut], n) + y for x, y in ((columns[0], 0), (columns[1], step), (columns[2], step)))
        size = np.full(len(doc), length)
        name = np.empty(len(doc), np.uint64)
        for a in range(0, len(doc), 1 << 16):
            b = at[a : a + (1 << 16)]
            low, high = int(b.min()), int(b.max()) + length
            name[a : a + (1 << 16)] = range_hashes(gram_hashes(data[low:high]), b - low, size[a : a + (1 << 16)])
        first = _leads(data, name, at, size, ids[doc])
        gone = ids[doc] > ids[doc[first]]
        known.append((doc[gone], start[gone], size[gone]))
        keys_of = np.full(len(doc), _ALONE)
        rest = ~hot
        base, cut_rest = int(rest.sum()), np.cumsum(rest) - 1
        lead = np.concatenate((cut_rest[lead[rest]], base + first))  # a segment and its lead share a minimiser
        later = np.concatenate((later[rest], gone))
        columns = [np.concatenate((x[rest], y)) for x, y in zip(columns, (doc, start, at, size, name, keys_of), strict=True)]
        to = np.concatenate((to[rest], name))
    doc, start, at, size, _, where = columns
    d, s, n = (np.concatenate(x) for x in zip(*known, strict=True))
    if len(d):
        own = np.unique(d)
        # to another part for each bucket: there are at least as many parts as buckets
        out.append((number % parts, True, _pack(ids[own], keys[own], np.searchsorted(own, d).astype(np.uint32), s.astype(np.uint32), n.astype(np.uint32))))
    to = (to % np.uint64(parts)).astype(np.int64)
    sent = np.flatnonzero(~later)
    sent = sent[np.argsort(to[sent], kind="stable")]
    cuts = np.searchsorted(to[sent], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        mine = sent[cuts[p] : cuts[p + 1]]
        leads, content = np.unique(lead[mine], return_inverse=True)
        own = np.unique(doc[mine])
        out.append((p, False, _pack(ids[own], keys[own], np.searchsorted(own, doc[mine]).astype(np.uint32), start[mine].astype(np.uint32), content.astype(np.uint32), size[leads].astype(np.uint32), where[leads].astype(np.uint8), data[ragged(at[leads], size[leads])])))


# --- the transform -----------------------------------------------------------------------


def suffix_order(symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes of texts in full lexicographic order; symbol 0, at `ends`, closes a text.

    Of suffixes that are equal up to their ends the earlier text's comes first. Prefix
    doubling (by threes): only suffixes that are still undivided are sorted again.
    """
    n = len(symbol)
    have = 7
    # seven symbols as one key, none after a text's end, from keys of one, two and four
    one, alive = symbol, symbol > 0

    def joined(a: np.ndarray, on: np.ndarray, b: np.ndarray, gone: int, bits: int) -> np.ndarray:
        out, m = a << bits, max(n - gone, 0)
        out[:m] |= np.where(on[:m], b[gone:], 0)
        return out

    def both(on: np.ndarray, b: np.ndarray, gone: int) -> np.ndarray:
        out, m = np.zeros(n, bool), max(n - gone, 0)
        out[:m] = on[:m] & b[gone:]
        return out

    two, alive_two = joined(one, alive, one, 1, 9), both(alive, alive, 1)
    four, alive_four = joined(two, alive_two, two, 2, 18), both(alive_two, alive_two, 2)
    six, alive_six = joined(four, alive_four, two, 4, 18), both(alive_four, alive_two, 4)
    key = joined(six, alive_six, one, 6, 9)
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    closed = np.flatnonzero((ranked & 511) == 0)  # these end within the symbols: in order of text
    if len(closed):
        group = np.cumsum(fresh)[closed]
        order[closed] = order[closed][np.argsort((group << 32) | order[closed])]
        fresh[closed] = True
    rank = np.zeros(n + 3 * int(np.diff(ends, prepend=-1).max(initial=1)) + 21, np.int64)
    slot = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # of suffixes in groups of several
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    threes = n < 1 << 21
    while len(slot):
        at = order[slot]
        key = (rank[at] << 42) | (rank[at + have] << 21) | rank[at + 2 * have] if threes else (rank[at] << 31) | rank[at + have]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slot] = at
        fresh = np.ones(len(slot), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(fresh, slot, 0))
        slot = slot[~(fresh & np.append(fresh[1:], True))]
        have *= 3 if threes else 2
    return order


def shared_strings(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of `length` bytes in texts: text, offset and the number of its class of equal strings.

    data: the texts, one after the other. Classes are the intervals of the sorted suffixes
    that backward extension up to length - 1 leaves undivided.
    """
    ends = np.cumsum(sizes + 1) - 1
    n = len(data) + len(sizes)
    symbol = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    symbol[inside] = data.astype(np.int64) + 1
    order = suffix_order(symbol, ends)
    # the transform: whether the text goes on before each suffix in order, and where the suffix
    # that begins one symbol earlier lies; those with one first symbol lie together
    goes_on = (symbol[order - 1] > 0) & (order > 0)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    step_back = place[order - 1]
    head = symbol[order]
    split = np.ones(n + 1, bool)
    split[1:n] = head[1:] != head[:-1]
    divided = np.zeros(n + 1, bool)
    divided[[0, n]] = True
    mark = np.full(n, -1, np.int32)
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        wide = high - low
        at = ragged(low, wide)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), wide)
        on = goes_on[at]
        to, owner = step_back[at[on]], owner[on]
        if not len(to):
            break
        if len(to) > n >> 5:  # in order by place: by a pass over all, or by sorting these
            mark[to] = owner
            to = np.flatnonzero(mark >= 0)
            owner = mark[to]
            mark[to] = -1
        else:
            by = np.argsort(to)
            to, owner = to[by].astype(np.int64), owner[by]
        cut = np.ones(len(to) + 1, bool)
        cut[1:-1] = split[to[1:]] | (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1])
        low, high = to[cut[:-1]], to[cut[1:]] + 1
        new = ~divided[high]
        low, high = low[new], high[new]
        divided[high] = True
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(n) - (ends - sizes)[text]
    whole = (offset + length <= sizes[text])[order]
    number = np.cumsum(divided[:n])
    return text[order[whole]], offset[order[whole]], number[whole]


def _resolve(blobs: list[bytes], length: int):
    """ids, keys, doc, start, bytes of the spans to remove, from the segments of one part."""
    ids, keys, ref_doc, ref_start, ref_content, sizes, data, names, group = [], [], [], [], [], [], [], [], []
    docs = contents = 0
    for blob in blobs:
        i, k, d, s, c, n, w, raw = _unpack(blob)
        ids.append(i), keys.append(k), ref_start.append(s.astype(np.int64)), sizes.append(n.astype(np.int64)), data.append(raw)
        ref_doc.append(d.astype(np.int64) + docs), ref_content.append(c.astype(np.int64) + contents)
        docs, contents = docs + len(i), contents + len(n)
        n = n.astype(np.int64)
        starts = np.cumsum(n) - n
        grams = gram_hashes(raw)
        names.append(range_hashes(grams, starts, n))
        group.append(np.where(w == _ALONE, names[-1], grams[np.minimum(starts + w, len(grams) - 1)]))
    ids, keys, ref_doc, ref_start, ref_content, sizes, data, names, group = map(np.concatenate, (ids, keys, ref_doc, ref_start, ref_content, sizes, data, names, group))
    begins = np.cumsum(sizes) - sizes
    # segments of several buckets with the same bytes become one text of the transform
    content = _leads(data, names, begins, sizes, np.arange(len(sizes)))[ref_content]
    owner = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(owner, content, ids[ref_doc])  # least document of each content
    heads = np.unique(content)
    heads = heads[np.argsort(group[heads], kind="stable")]
    fresh = np.ones(len(heads) + 1, bool)
    fresh[1:-1] = group[heads][1:] != group[heads][:-1]
    total = np.cumsum(sizes[heads])
    by = np.argsort(content, kind="stable")  # references in order of content
    ref_cuts = np.searchsorted(content[by], np.arange(len(sizes) + 1))
    out = [(np.empty(0, np.int64),) * 3]
    at = 0
    while at < len(heads):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TRANSFORM_BYTES)))
        while not fresh[min(end, len(heads))]:
            end += 1
        mine = heads[at:end]
        at = end
        text, offset, number = shared_strings(data[ragged(begins[mine], sizes[mine])], sizes[mine], length)
        least = np.full(int(number[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, owner[mine[text]])
        windows = sizes[mine] - length + 1
        place = np.cumsum(windows) - windows
        low = np.empty(int(windows.sum()), np.int64)
        low[place[text] + offset] = least[number]
        refs = by[ragged(ref_cuts[mine], ref_cuts[mine + 1] - ref_cuts[mine])]
        of = np.repeat(np.arange(len(mine)), ref_cuts[mine + 1] - ref_cuts[mine])
        for a in range(0, len(refs), 1 << 14):
            some, k = refs[a : a + (1 << 14)], of[a : a + (1 << 14)]
            which = np.repeat(np.arange(len(some)), windows[k])
            off = ragged(np.zeros(len(some), np.int64), windows[k])
            gone = low[place[k][which] + off] < ids[ref_doc[some]][which]
            which, off = which[gone], off[gone]
            if len(which):
                new = (which[1:] != which[:-1]) | (off[1:] != off[:-1] + 1)
                first, last = np.flatnonzero(np.concatenate(([True], new))), np.flatnonzero(np.concatenate((new, [True])))
                out.append((ref_doc[some[which[first]]], ref_start[some[which[first]]] + off[first], off[last] - off[first] + length))
    return ids, keys, *(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(requests: DataFrame, buckets: int, length: int) -> DataFrame:
    """(part, spans, blob) to (bucket, blob): spans to remove, packed by bucket of documents."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        known = [_unpack(b) for b, s in zip(group.column("blob").to_pylist(), group.column("spans").to_pylist(), strict=True) if s]
        asked = [b for b, s in zip(group.column("blob").to_pylist(), group.column("spans").to_pylist(), strict=True) if not s]
        for ids, keys, doc, start, size in [*known, *([_resolve(asked, length)] if asked else [])]:
            if not len(doc):
                continue
            doc, start, size = doc.astype(np.int64), start.astype(np.int64), size.astype(np.int64)
            bucket = _bucket(ids, buckets)[doc]
            order = np.lexsort((start, doc, bucket))
            doc, start, size, bucket = doc[order], start[order], size[order], bucket[order]
            heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, b in zip(heads, [*heads[1:], len(bucket)], strict=True):
                own = np.unique(doc[a:b])
                out.append((int(bucket[a]), _pack(ids[own], keys[own], np.searchsorted(own, doc[a:b]).astype(np.uint32), start[a:b].astype(np.uint32), size[a:b].astype(np.uint32))))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    return requests.groupBy("part").applyInArrow(run, "bucket int, blob binary")


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


# --- documents ---------------------------------------------------------------------------


def _packed(rows: DataFrame, buckets: int) -> DataFrame:
    """rows to (bucket, blob): whole rows in Arrow's stream format, compressed, by bucket of the id."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("_id").fill_null(0).to_numpy()
            bucket = _bucket(ids, buckets)
            order = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0)))
            for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
                part = batch.take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[order[a]])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "blob"])

    return rows.mapInArrow(run, "bucket int, blob binary")


def merge_spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of the union of spans; touching spans make one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + size)[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, as_text: bool = False) -> DataFrame:
    """docs with _n_bytes, _spans (array of start, end, start, end ... in bytes) and _kept (the bytes left).

    as_text: _kept is a string, without the remains of characters that a span cuts in two.

    Removed is each byte covered by a string of `length` bytes that also begins in a document
    with a smaller id, judged on the input. Null text: no bytes, _kept empty. A row with a
    null id neither loses bytes nor makes others lose any. Repeated rows, and rows that share
    an id, take nothing from each other. An empty table gives no rows. Further columns of any
    name stay as they are.
    """
    rows, names = apart(docs)
    found = _without(rows, names[id_col], names[text_col], length, as_text)
    return found.toDF(*docs.columns, "_n_bytes", "_spans", "_kept")


def _without(docs: DataFrame, id_col: str, text_col: str, length: int, as_text: bool) -> DataFrame:
    """remove_repeats for columns that have none of the names used here."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    # segments have 3.7 bytes for each of the text if all are sent, minimisers 0.45
    parts = max(1, -(-int(total) * 37 // 10 // PART_BYTES))
    count_parts = max(1, -(-int(total) * 45 // 100 // COUNT_BYTES))
    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(text_col)})
    packed = _packed(keyed, buckets)
    shared = _shared(_counted(packed, text_col, count_parts, length))
    spans = _spans(_requests(packed, shared, text_col, count_parts, parts, length), buckets, length)
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_bytes", T.LongType()), T.StructField("_spans", T.ArrayType(T.LongType())), T.StructField("_kept", T.StringType() if as_text else T.BinaryType())])
    names = docs.columns

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        gone: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for blob in right.column("blob").to_pylist():
            ids, keys, doc, start, size = _unpack(blob)
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i, who in enumerate(zip(ids.tolist(), keys.tolist(), strict=True)):
                gone.setdefault(who, []).append((start[cuts[i] : cuts[i + 1]], size[cuts[i] : cuts[i + 1]]))
        tables = []
        for blob in left.column("blob").to_pylist():
            for batch in pa.ipc.open_stream(blob):
                data, offsets = flat_bytes(batch.column(text_col))
                spans, kept = [], []
                for i, who in enumerate(zip(batch.column("_id").to_pylist(), batch.column("_key").to_pylist(), strict=True)):
                    own = data[offsets[i] : offsets[i + 1]]
                    if who in gone:
                        a, b = merge_spans(*(np.concatenate(x).astype(np.int64) for x in zip(*gone[who], strict=True)))
                        edge = np.zeros(len(own) + 1, np.int8)
                        edge[a] += 1
                        edge[b] -= 1
                        own = own[np.cumsum(edge[:-1]) == 0]
                        spans.append(np.stack((a, b), 1).ravel())
                    else:
                        spans.append(np.empty(0, np.int64))
                    kept.append(own.tobytes().decode("utf-8", "ignore") if as_text else own.tobytes())
                out = [*(batch.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string() if as_text else pa.binary())]
                tables.append(pa.Table.from_arrays([pa.chunked_array([x]) for x in out], names=schema.names))
        if not tables:
            return _empty(schema)
        return pa.concat_tables(tables)

    return packed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(assemble, schema)


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """docs with the repeated bytes taken out of the text; characters cut in two go as a whole."""
    rows, names = apart(docs)
    text = names[text_col]
    rows = _without(rows, names[id_col], text, length, True).withColumn(text, F.when(F.col(text).isNotNull(), F.col("_kept")))
    if "n_chars" in names:
        rows = rows.withColumn(names["n_chars"], F.length(text).cast("long"))
    return rows.select(*names.values()).toDF(*docs.columns)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        (F.col("_n_bytes") - F.octet_length("_kept")).cast("long").alias("n_removed"),
        (F.size("_spans") / 2).cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


#: Every string of 50 bytes by itself, in hexadecimal digits: for small tables.
OP4_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, length(h) // 2 AS n FROM t),
w AS (SELECT doc_id, i, hash(h[2 * i - 1 : 2 * i + 98]) AS g FROM (SELECT doc_id, h, unnest(generate_series(1, n - 49)) AS i FROM p WHERE n >= 50)),
f AS (SELECT doc_id, i FROM w QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
e AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) + 50 AS fresh FROM f),
k AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY ALL),
o AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before FROM s),
q AS (SELECT o.doc_id, string_agg(h[2 * before - 1 : 2 * a - 2], '' ORDER BY a) AS head, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans FROM o JOIN p USING (doc_id) GROUP BY o.doc_id)
SELECT p.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN q.doc_id IS NULL THEN h ELSE coalesce(head, '') || h[2 * last - 1 :] END)) AS kept_sha256 FROM p LEFT JOIN q USING (doc_id)
"""
