"""Operator 13: quality scores by a generalised additive model with pairwise interactions.

Features of whole texts are put into bins at quantiles. Boosting goes over the features in
turn, a shallow tree on one feature's bins at a time, each added to that feature's lookup
table; then over the pairs of features that explain most of what is left. A score is the sum
of the looked-up values: a few vectorised additions a batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, flat_bytes, stored, table

#: Names of the features, in order of the columns that `features` gives.
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "upper_share", "digit_share", "symbol_share", "mark_share", "wide_share", "space_share", "comma_rate", "stop_rate",
    "lines", "line_bytes", "distinct_words", "repeated_runs", "top_word", "ends_with_mark", "capital_words",
)


@dataclass(frozen=True)
class GamRules:
    #: Labelled rows that the tables are fitted on at most; labels beyond it are left out by hash of the id.
    train_rows: int = 65_536
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 10
    rate: float = 0.1
    #: Least rows of a leaf, and the weight that draws leaves to zero.
    leaf_rows: int = 8
    ridge: float = 2.0


@dataclass
class Gam:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    base: float
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of rows of features."""
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
            for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
                total += values[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


# Classes of ASCII bytes.
_CLASS = np.zeros(256, np.uint8)
_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK, _WIDE = range(1, 8)
for _c in range(256):
    _CLASS[_c] = (
        _SPACE if _c in b" \t\n\v\f\r" else _UPPER if 65 <= _c <= 90 else _LOWER if 97 <= _c <= 122 else _DIGIT if 48 <= _c <= 57 else _SYMBOL if _c in b"#*$%&|<>=~^\\{}[]_@/+" else _WIDE if _c >= 128 else _MARK
    )


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of the flat bytes; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kind = _CLASS[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    some = np.maximum(size, 1)
    heads = offsets[:-1][size > 0]
    inside = kind != _SPACE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[offsets[1:][size > 0] - 1] = inside[offsets[1:][size > 0] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length = stop - start
    at = np.searchsorted(start, offsets)  # words of text i: at[i] to at[i + 1]
    words = np.diff(at).astype(np.float64)
    w = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(at))

    def over_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=flags, minlength=n)

    # a word's hash: sum over its bytes of a value by byte and place, modulo 2**64
    value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    place = np.zeros(len(data), np.int64)
    place[inside] = np.flatnonzero(inside) - np.repeat(start, length)
    value = np.where(inside, (value ^ (value >> np.uint64(29))) * (2 * place.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9)), np.uint64(0))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    word = (sums[stop] - sums[start]) ^ length.astype(np.uint64)
    # runs of three words, those that cross texts left out
    run = np.zeros(0, np.uint64)
    run_owner = np.zeros(0, np.int64)
    if len(word) >= 3:
        same = owner[2:] == owner[:-2]
        run = (word[:-2] * np.uint64(3) + word[1:-1] * np.uint64(0x94D049BB133111EB) + word[2:] * np.uint64(0xD6E8FEB86659FD93))[same]
        run_owner = owner[2:][same]

    def different(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different keys of each text, and its most frequent key's count."""
        order = np.lexsort((key, who))
        key, who = key[order], who[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        where = np.flatnonzero(first)
        most = np.zeros(n)
        np.maximum.at(most, who[where], np.diff(np.append(where, len(key))))
        return np.bincount(who[where], minlength=n).astype(np.float64), most

    kinds, most = different(word, owner)
    runs_kinds, _ = different(run, run_owner)
    n_runs = np.bincount(run_owner, minlength=n).astype(np.float64)
    letters = per_text((kind == _UPPER) | (kind == _LOWER))
    lines = per_text(data == 10) + (size > 0)
    last = np.zeros(n)
    full = np.flatnonzero(words > 0)
    last[full] = kind[stop[at[full + 1] - 1] - 1] == _MARK
    upper = per_text(kind == _UPPER)
    columns = [
        np.log1p(size), np.log1p(words), over_words(length) / w, over_words(length > 20) / w, over_words(length <= 3) / w, upper / np.maximum(letters, 1), per_text(kind == _DIGIT) / some,
        per_text(kind == _SYMBOL) / some, per_text(kind == _MARK) / some, per_text(kind == _WIDE) / some, per_text(kind == _SPACE) / some, per_text(data == ord(",")) / w, per_text((data == ord(".")) | (data == ord("!")) | (data == ord("?"))) / w,
        lines, size / np.maximum(lines, 1), kinds / w, np.where(n_runs > 0, 1 - runs_kinds / np.maximum(n_runs, 1), 0), most / w, last, over_words(kind[start] == _UPPER) / w,
    ]
    out = np.stack(columns, axis=1)
    out[size == 0] = 0
    return out


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, rules: GamRules, cuts: int = 2) -> np.ndarray:
    """The values of a shallow tree on ordered bins: up to `cuts` best cuts, a Newton step a leaf."""
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + rules.ridge)
    sums = [np.concatenate(([0.0], np.cumsum(x))) for x in (g, h, n)]
    for _ in range(cuts):
        best = (1e-9, None)
        for k, (lo, hi) in enumerate(parts):
            m = np.arange(lo + 1, hi)
            if not len(m):
                continue
            (gl, gr), (hl, hr), (nl, nr) = (((s[m] - s[lo]), (s[hi] - s[m])) for s in sums)
            won = np.where((nl >= rules.leaf_rows) & (nr >= rules.leaf_rows), gain(gl, hl) + gain(gr, hr) - gain(gl + gr, hl + hr), -1)
            if won.max() > best[0]:
                best = (won.max(), (k, int(m[won.argmax()])))
        if best[1] is None:
            break
        k, m = best[1]
        lo, hi = parts[k]
        parts[k : k + 1] = [(lo, m), (m, hi)]
    out = np.zeros(len(g))
    if len(parts) > 1:
        for lo, hi in parts:
            out[lo:hi] = -(sums[0][hi] - sums[0][lo]) / (sums[1][hi] - sums[1][lo] + rules.ridge)
    return out


def _corners(g: np.ndarray, h: np.ndarray, n: np.ndarray, rules: GamRules) -> tuple[np.ndarray, float]:
    """The values of a tree on two features, one cut of each: four corners, and its gain."""
    cum = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h, n)]
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    boxes = []
    for c in cum:
        ll, l_, _l = c[a, b], c[a, -1], c[-1, b]
        boxes.append(np.stack([ll, l_ - ll, _l - ll, c[-1, -1] - l_ - _l + ll]))
    score = (boxes[0] ** 2 / (boxes[1] + rules.ridge)).sum(0)
    rows, columns = boxes[2][0] + boxes[2][1], boxes[2][0] + boxes[2][2]
    score = np.where((rows >= rules.leaf_rows) & (columns >= rules.leaf_rows) & (boxes[2][0] + boxes[2][3] >= 1), score, -1)
    i, j = np.unravel_index(score.argmax(), score.shape)
    if score[i, j] <= 0:
        return np.zeros(g.shape), 0.0
    v = -boxes[0][:, i, j] / (boxes[1][:, i, j] + rules.ridge)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(score[i, j] - cum[0][-1, -1] ** 2 / (cum[1][-1, -1] + rules.ridge))


def fit(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rules: GamRules) -> Gam:
    """Lookup tables by cyclic boosting on rows of features x with labels y (0 or 1)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    counts = [np.bincount(b, minlength=len(e) + 1).astype(float) for b, e in zip(bins, edges, strict=True)]
    total = np.full(len(y), model.base)
    for _ in range(rules.rounds):
        for f, b in enumerate(bins):  # the features in turn
            p = 1 / (1 + np.exp(-total))
            size = len(edges[f]) + 1
            step = rules.rate * _leaves(np.bincount(b, p - y, size), np.bincount(b, p * (1 - p), size), counts[f], rules)
            model.tables[f] += step
            total += step[b]
    steps = [max(1, -(-len(e) // (rules.pair_bins - 1))) for e in edges]
    model.pair_edges = [e[step // 2 :: step] for e, step in zip(edges, steps, strict=True)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]

    def grids(i: int, j: int, p: np.ndarray):
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        cell = coarse[i] * shape[1] + coarse[j]
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p), np.ones(len(y)))]

    p = 1 / (1 + np.exp(-total))
    able = [f for f, e in enumerate(model.pair_edges) if len(e)]
    gains = sorted(((_corners(*grids(i, j, p), rules)[1], i, j) for k, i in enumerate(able) for j in able[k + 1 :]), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[: rules.pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(rules.pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = rules.rate * _corners(*grids(i, j, p), rules)[0]
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, x (FEATURES) of every row's whole text, in Arrow batches; null texts are empty."""

    def compute(batches):
        for batch in batches:
            for part in byte_slices(batch, "text"):
                x = features(*flat_bytes(part.column("text")))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), flat], names=["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(compute, "id long, x array<double>")


def train_on(rows: DataFrame, labels: DataFrame, rules: GamRules = GamRules(), *, id_col: str = "doc_id", label_col: str = "quality") -> Gam:
    """The model of the labelled ones of rows (as by feature_rows; read several times).

    labels: id_col and label_col, 0 or 1; null ids or labels take no part, of several labels of
    an id the least counts. Bins are quantiles over all labelled documents. The tables are
    fitted on at most rules.train_rows of them (by hash of the id; the sample alone passes the
    driver). Without labels of both classes every text has the score of the labels' share (one
    half, if there are none).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min(F.col(label_col)).cast("int").alias("y"))
    rows = stored(rows.join(known, F.col("id") == F.col("label_id")).select("id", "x", "y"), "labelled-features")
    cuts = [i / rules.bins for i in range(1, rules.bins)]
    found = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(F.get("x", F.lit(f)), cuts, 10_000).alias(f"q{f}") for f in range(len(FEATURES)))).first()
    edges = [np.unique(np.array(found[f"q{f}"] or [], np.float64)) for f in range(len(FEATURES))]
    share = min(1.0, rules.train_rows / max(found["n"], 1))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = some.select("x", "y").orderBy(F.xxhash64("id"), F.xxhash64("x")).limit(rules.train_rows).toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample.column("y").to_numpy().astype(np.float64), edges, rules)


def train(docs: DataFrame, labels: DataFrame, rules: GamRules = GamRules(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """train_on over the features of docs."""
    return train_on(stored(feature_rows(docs, id_col, text_col), "features"), labels, rules, id_col=id_col, label_col=label_col)


def score_rows(rows: DataFrame, model: Gam, *, id_col: str = "doc_id") -> DataFrame:
    """id_col, score: one row per row of rows (as by feature_rows)."""

    def add(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], names=["id", "score"])

    return rows.select("id", "x").mapInArrow(add, "id long, score double").withColumnRenamed("id", id_col)


def scored(docs: DataFrame, model: Gam, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score: one row per row of docs. Null and empty texts have features of zero."""
    return score_rows(feature_rows(docs, id_col, text_col), model, id_col=id_col)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once: what the model learns from and what it scores are the stored features."""
    rows = stored(feature_rows(table(spark, sf_dir, "documents"), "doc_id", "text"), "features")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train_on(rows, table(spark, sf_dir, "labels").where(~held_out))
    return score_rows(rows, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
