"""Operator 8: quality rules with cross-document line frequency, in DataFrame functions only.

Words are runs of bytes other than space and \\t..\\r. A document fails the base rules with
under 20 words, or when over 30 of 100 words stand in repeated 8-word windows. Beyond that,
lines that many documents of one host share are counted by hash (documents with different
texts, so exact copies count once), taken out, and documents that lose most of their words are
rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, stored, table

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    window_words: int = 8
    max_repeat_percent: int = 30
    #: A line is boilerplate in more distinct texts of a host than this, however large the host.
    line_min_texts: int = 20
    #: Without its boilerplate a document keeps at least min_words words and this share of them.
    kept_share: float = 0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def line_key(line: Column) -> Column:
    """Hash of a line: lower case, runs of white space as one space, none at the ends."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, WS, " "))))


SYMBOL = "[#*$%&|<>]"


def base_counts(text: Column, words: Column | None = None) -> dict[str, Column]:
    """The counts of one text (and its words, if they are at hand); null reads as empty."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text) if words is None else words
    lines = lines_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.when(text.rlike(SYMBOL), F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).otherwise(0).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, n: int) -> Column:
    """Words that stand in an n-word window found twice or more among a text's words."""

    def windows(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) > n, F.transform(places, lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<long>"))

    def repeated(pairs: Column) -> Column:
        """Places, in order, of the windows that stand beside an equal one."""
        same = lambda x, j, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        found = F.filter(pairs, lambda x, j: ((j > 0) & same(x, j, j - 1)) | same(x, j, j + 1))
        return F.array_sort(F.transform(found, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def count(hashes: Column) -> Column:
        # only texts with an equal pair of windows get past the size test
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(_let(pairs, repeated))).otherwise(F.lit(0))

    def joined(items: Column, apart: int) -> Column:
        """Each item with the one `apart` places on; null at the end."""
        return F.zip_with(items, F.slice(items, F.lit(apart + 1), F.size(items)), lambda x, y: x.bitwiseXOR(F.shiftleft(y, apart)))

    def may_repeat(hashes: Column) -> Column:
        """A window that comes again brings n - 3 runs of four words that came before; few texts have so many."""
        return _let(joined(hashes, 1), lambda pairs: _let(joined(pairs, 2), lambda runs: F.size(runs) - F.size(F.array_distinct(runs)) >= n - 3))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: F.when(may_repeat(h), _let(windows(h), count)).otherwise(F.lit(0))).cast("long")


def line_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, text_key, host, place, line (hash, as by line_key), words of every line that holds a word.

    White space is made one space over the whole text at once; what is left of a line then has
    one space between two words.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), F.trim), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.struct(F.xxhash64(F.lower(x)).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(host_col).alias("host"), F.posexplode(parts).alias("place", "part"))
    return lines.select("id", "text_key", "host", "place", "part.line", "part.words")


def frequent_lines(lines: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Lines of line_table above the limit: host, line, n_texts. A null host is a host of its own.

    Counted are documents with different texts: if each copy of a page counted, all lines of
    a page with many copies would be frequent, and the page with all its copies would go.
    """
    return lines.select("host", "text_key", "line").distinct().groupBy("host", "line").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > rules.line_min_texts)


def lost_words(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """id, text_key, host, lost (words in frequent lines), lines (their hashes), for documents that have some."""
    frequent = frequent.select(F.col("host").alias("h"), F.col("line").alias("l"))
    hit = lines.join(frequent, (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    once = hit.groupBy("id", "text_key", "host", "place").agg(F.first("line").alias("line"), F.first("words").alias("words"))  # a repeated row counts once
    return once.groupBy("id", "text_key", "host").agg(F.sum("words").alias("lost"), F.collect_set("line").alias("lines"))


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: id, text_key, host, the counts, base_failed, n_lost_words, lost_lines, kept.

    Null and empty text: no words, so base_failed. A null id or host is a value like others;
    repeated rows each give the same row. An empty table gives no rows. The texts are cut into
    lines once, and once more into words for the counts.
    """
    lines = stored(line_table(docs, id_col=id_col, text_col=text_col, host_col=host_col), "lines")
    # stored before the join, where a line of very many documents can then be split
    lost = lost_words(lines, stored(frequent_lines(lines, rules), "frequent"))
    only = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    only = only.withColumn("w", words_of(F.coalesce("text", F.lit(""))))  # used twice, so Spark keeps it apart
    counts = only.select("id", F.xxhash64("text").alias("text_key"), "host", *(c.alias(k) for k, c in base_counts(F.col("text"), F.col("w")).items()), repeat_words(F.col("w"), rules.window_words).alias("n_repeat_words"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("text_key").alias("lost_key"), F.col("host").alias("lost_host"), "lost", "lines")
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_key") == F.col("lost_key")) & F.col("host").eqNullSafe(F.col("lost_host"))
    rows = counts.withColumn("base_failed", failed).join(lost, same, "left")
    left = F.col("n_words") - F.col("lost")
    depleted = F.coalesce((left < rules.min_words) | (left < rules.kept_share * F.col("n_words")), F.lit(False))
    return rows.select(
        F.col("id").alias(id_col), "text_key", F.col("host").alias(host_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_lost_words"), F.col("lines").alias("lost_lines"), (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def apply_quality(docs: DataFrame, rules: QualityRules = QualityRules(), *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep, without their frequent lines; columns as they were, whatever their names."""
    rows, names = apart(docs)
    key, text, host = names[id_col], names[text_col], names[host_col]
    # stored before the filter, which would otherwise be moved below and compute the counts again
    verdicts = stored(quality(rows, rules, id_col=key, text_col=text, host_col=host).select(key, "text_key", host, "lost_lines", "kept"), "quality")
    verdicts = verdicts.where("kept").select(F.col(key).alias("v_id"), F.col("text_key").alias("v_key"), F.col(host).alias("v_host"), F.col("lost_lines").alias("v_lines")).dropDuplicates(["v_id", "v_key", "v_host"])
    rows = rows.join(verdicts, F.col(key).eqNullSafe(F.col("v_id")) & (F.xxhash64(text) == F.col("v_key")) & F.col(host).eqNullSafe(F.col("v_host")))
    bad = F.col("v_lines")
    clean = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(bad, line_key(x)))), "\n")
    out = rows.withColumn(text, F.when(bad.isNull(), F.col(text)).otherwise(clean))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(text).cast("long"))
    return out.select(*names.values()).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(generate_series(1, len(words) - 7)) AS i, words FROM w WHERE len(words) > 8),
h AS (SELECT doc_id, i, hash(words[i:i+7]) AS h FROM p),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, generate_series(0, 7) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(lines) AS line FROM w),
n AS (SELECT doc_id, source, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS k FROM l),
f AS (SELECT source, line FROM n GROUP BY ALL HAVING count(DISTINCT text) > 20),
g AS (SELECT n.doc_id, sum(k) AS lost FROM n JOIN f ON f.line = n.line AND f.source IS NOT DISTINCT FROM n.source GROUP BY ALL),
b AS (SELECT w.doc_id, len(words) AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(g.lost, 0) AS lost FROM w LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (lost = 0 OR NOT (n_words - lost < 20 OR n_words - lost < 0.3 * n_words)) AS kept, CAST(lost AS BIGINT) AS n_lost_words FROM v
"""
