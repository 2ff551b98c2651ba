"""Operator 1: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IPs, card and phone numbers; these seed a graph of
lexical patterns (the words or the label before a value) and instances (the values). Pattern
and instance scores are computed from each other in rounds: instances of confident patterns
are the seeds of the next round's. Patterns of high confidence mark the values that stand in
their place but match no base pattern. Base spans always stay. Work on one text grows with
n log n of its spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, stored, table

KINDS = ("email", "ip", "card", "phone")
_S = r"\x20\x09-\x0D"
# The base patterns, with possessive repeats where what follows cannot match
# a shorter one, and starts only where a leftmost match can start; so each is linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_VALID = {
    "email": "true",
    "ip": f"x.t RLIKE r'{_IP}'",
    "card": "length(regexp_replace(x.t, '[^0-9]', '')) BETWEEN 12 AND 19 AND luhn_check(regexp_replace(x.t, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.t, '[^0-9]', '')) BETWEEN 9 AND 15",
}
#: A label with its value (`mail: x`, `tel=x`), and two words before a value with a digit or an at
#: sign; of these the first word is the match and the rest stands in a group, so that matches overlap.
_LABEL = r"(?<![A-Za-z0-9_-])-*+[A-Za-z][A-Za-z_-]++\x20?[:=#]\x20?[\"']?[^" + _S + r"\"'<>,;]{2,}+"
_LABEL_HEAD = r"^[A-Za-z_-]+\x20?[:=#]\x20?[\"']?"
_WORDS = rf"(?<![^{_S}])[^{_S}]++(?=(\x20[^{_S}]++\x20(?=[^{_S}]*[0-9@])[^{_S}]++))"
_WORDS_HEAD = rf"^[^{_S}]++\x20[^{_S}]++\x20[(\[<\"']*"
SPAN = "array<struct<s:int,k:int,e:int>>"


@dataclass(frozen=True)
class Bootstrap:
    #: Rounds at most; None: until one finds no new instance and the scores stand.
    rounds: int | None = None
    #: Distinct seeds that a pattern needs, the confidence that lets it mark values, and the
    #: instances of no kind that every pattern is taken to have beside its own.
    min_seeds: int = 3
    confidence: float = 0.8
    prior: float = 0.5
    #: Characters of a marked value at least. The shortest identifiers of a base form have five
    #: (`a@b.c`); a shorter one tells hardly anybody apart, and is most often a count or a unit.
    min_chars: int = 4


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with value computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _scan(items: str, combine: str) -> str:
    """SQL for the running combination (of x and the earlier y, null before the first) of an array, by doubling."""
    steps = f"sequence(0, CAST(ceil(log2(greatest(size({items}), 1))) AS int))"
    return f"aggregate({steps}, {items}, (acc, step) -> transform(acc, (x, i) -> transform(array(get(acc, i - shiftleft(1, step))), y -> {combine})[0]))"


def _located(pattern: str, needed: str, kind: int = 0, group: int = 0) -> str:
    """SQL for the pattern's leftmost matches in `_text`, with the group after them: array of (s, k, e, t), code points."""
    p = _sql(pattern)
    none = "CAST(array() AS array<struct<s:int,k:int,e:int,t:string>>)"
    parts = f"split(_text, {p}, -1), regexp_extract_all(_text, {p}, 0)" + f", regexp_extract_all(_text, {p}, {group})" * bool(group)
    found = f"filter(arrays_zip({parts}), x -> x.`1` IS NOT NULL)"
    ends = _scan("transform(m, x -> length(x.`0`) + length(x.`1`))", "x + coalesce(y, 0)")
    more, whole = ("+ length(x.`2`)", "concat(x.`1`, x.`2`)") if group else ("", "x.`1`")
    each = f"transform(m, (x, i) -> named_struct('s', ends[i] - length(x.`1`), 'k', {kind}, 'e', ends[i] {more}, 't', {whole}))"
    return f"CASE WHEN _text RLIKE {_sql(needed)} THEN {_let('m', found, _let('ends', ends, each))} ELSE {none} END"


def with_base_spans(rows: DataFrame) -> DataFrame:
    """rows (with a string column _text), _full: (s, k, e, t) in order of start, then kind, and _base: SPAN, the same."""
    parts = [f"filter({_located(BASE[k], _NEEDED[k], i)}, x -> {_VALID[k]})" for i, k in enumerate(KINDS)]
    rows = rows.withColumn("_full", F.expr(f"array_sort(concat({', '.join(parts)}))"))
    return rows.withColumn("_base", F.expr("transform(_full, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"))


def _with_candidates(rows: DataFrame) -> DataFrame:
    """rows with _cand: array of (s, e, pattern, value, kind of the base span that the value meets)."""

    def part(regex: str, needed: str, head: str, name: str, group: int) -> str:
        h = _sql(head)
        lead = f"regexp_extract(x.t, {h}, 0)"
        value = f"regexp_replace(substr(x.t, length({lead}) + 1), r'[.,;:!?)\\]>\"\\x27]+$', '')"
        return (
            f"transform({_located(regex, needed, 0, group)}, x -> named_struct('s', x.s + length({lead}), 'e', x.s + length({lead}) + length({value}), "
            f"'pattern', concat('{name}', lower(regexp_replace({lead}, r'[\\s\"\\x27(<\\[]+', ' '))), 'value', lower({value})))"
        )

    both = f"concat({part(_LABEL, r'[:=#]', _LABEL_HEAD, 'label ', 0)}, {part(_WORDS, r'[0-9@]', _WORDS_HEAD, 'words ', 1)})"
    rows = rows.withColumn("_cand", F.expr(f"filter({both}, c -> c.e > c.s)"))
    # a value that meets a base span stands for the whole span: `+1` for the number it begins. In
    # order of place, the spans that begin before a value ends precede it; the farthest of these counts
    span = "struct<e:int,s:int,k:int,t:string>"
    starts = f"transform(_full, b -> named_struct('at', b.s, 'i', -1, 'b', CAST(named_struct('e', b.e, 's', b.s, 'k', b.k, 't', b.t) AS {span})))"
    values = f"transform(_cand, (c, i) -> named_struct('at', c.e - 1, 'i', i + size(_full), 'b', CAST(NULL AS {span})))"
    reached = f"transform(arrays_zip(ev, {_scan('transform(ev, v -> v.b)', 'greatest(x, y)')}), v -> named_struct('i', v.ev.i, 'b', v.`1`))"
    met = f"transform(array_sort(filter({reached}, v -> v.i >= 0), (l, r) -> l.i - r.i), v -> v.b)"
    met = f"CASE WHEN size(_full) = 0 OR size(_cand) = 0 THEN transform(_cand, c -> CAST(NULL AS {span})) ELSE {_let('ev', f'array_sort(concat({starts}, {values}), (l, r) -> CASE WHEN l.at <> r.at THEN l.at - r.at ELSE l.i - r.i END)', met)} END"
    rows = rows.withColumn("_met", F.expr(met))
    meets = "x._met IS NOT NULL AND x._met.e > x._cand.s"
    value = f"CASE WHEN {meets} THEN lower(x._met.t) ELSE x._cand.value END"
    return rows.withColumn("_cand", F.expr(f"transform(arrays_zip(_cand, _met), x -> named_struct('s', x._cand.s, 'e', x._cand.e, 'pattern', x._cand.pattern, 'value', {value}, 'kind', CASE WHEN {meets} THEN x._met.k END))"))


def confident_patterns(candidates: DataFrame, b: Bootstrap = Bootstrap()) -> DataFrame:
    """(pattern, value, kind or null) occurrences to (pattern, kind, confidence) above the limit.

    Edges are distinct (pattern, instance) pairs. A pattern's confidence for a kind is the sum
    of its instances' scores over their number plus the prior; a seed's score is 1, another
    instance's the best of its patterns'. Instances that reach the limit are the seeds of the
    next round, and so make patterns eligible that no base span stands in. Scores only grow, and
    stay below 1, so rounds go on until one finds no new instance and the scores grow by less
    than a millionth each. Sums are pre-aggregated, so no pattern meets whole.
    """
    edges = stored(candidates.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= b.min_seeds), "pii-sizes")
    gained = edges.where("kind IS NOT NULL").select("pattern", "kind", F.lit(1.0).alias("score"))
    known, done = (0, 0.0), 0
    while True:
        sums = gained.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("seeds")).where(F.col("seeds") >= b.min_seeds)
        rated = sizes.join(sums, "pattern").select("pattern", "kind", F.least(F.lit(1.0), F.col("sum") / (F.col("n") + F.lit(b.prior))).alias("confidence"))
        rated = stored(rated.where(F.col("confidence") >= b.confidence), "pii-patterns")
        done += 1
        if done == b.rounds:
            break
        # (value, kind, score) of instances that are no base spans, found by confident patterns
        scores = edges.where("kind IS NULL").select("pattern", "value").join(rated, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        found = stored(scores.where(F.col("score") >= b.confidence), "pii-instances")
        before, known = known, tuple(found.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first())
        if known[0] == before[0] and known[1] - before[1] <= 1e-6 * known[0]:
            break
        gained = edges.where("kind IS NOT NULL").select("pattern", "kind", F.lit(1.0).alias("score"))
        gained = gained.unionByName(edges.where("kind IS NULL").select("pattern", "value").join(found, "value").select("pattern", "kind", "score"))
    return rated


def personal_data(docs: DataFrame, b: Bootstrap = Bootstrap(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text_key, base and spans (SPAN, both in order of start and kind).

    spans holds the base spans and those the confident patterns add. Null text: no spans. A
    null id is a value like others; repeated rows each give the same row. An empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = _with_candidates(with_base_spans(rows)).select("id", "text_key", F.col("_base").alias("base"), F.col("_cand").alias("cand"))
    found = stored(found, "pii-spans")
    each = found.select("id", "text_key", F.explode("cand").alias("c")).select("id", "text_key", "c.s", "c.e", "c.pattern", "c.value", "c.kind")
    patterns = confident_patterns(each.select("pattern", "value", "kind"), b).select("pattern", F.col("kind").alias("k"))
    fresh = each.where(f"kind IS NULL AND e - s >= {b.min_chars}").join(patterns, "pattern").select(F.col("id").alias("f_id"), F.col("text_key").alias("f_key"), F.struct("s", F.col("k").cast("int").alias("k"), "e").alias("span"))
    fresh = fresh.groupBy("f_id", "f_key").agg(F.collect_set("span").alias("more"))
    rows = found.select("id", "text_key", "base").join(fresh, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return rows.select(F.col("id").alias(id_col), "text_key", "base", spans.alias("spans"))


def span_list(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)), ',')")


#: Characters of a block that a replaced text is put together from.
_BLOCK = 1024


def _between(a: str, b: str) -> str:
    """SQL for the characters from a to b (not included) of the text whose blocks are `blocks`."""
    piece = f"substr(blocks[j], greatest({a} - j * {_BLOCK}, 0) + 1, least({b} - j * {_BLOCK}, {_BLOCK}) - greatest({a} - j * {_BLOCK}, 0))"
    return f"CASE WHEN {b} > {a} THEN array_join(transform(sequence({a} div {_BLOCK}, ({b} - 1) div {_BLOCK}), j -> {piece}), '') ELSE '' END"


def redact(docs: DataFrame, b: Bootstrap = Bootstrap(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans as one.

    Null and empty text stay. Repeated rows are treated alike; a null id is a value like
    others. Further columns of any name stay as they are.
    """
    rows, names = apart(docs)
    key, text = names[id_col], names[text_col]
    spans = personal_data(rows, b, id_col=key, text_col=text).where(F.size("spans") > 0).select(F.col(key).alias("p_id"), F.col("text_key").alias("p_key"), F.col("spans").alias("p_spans")).dropDuplicates(["p_id", "p_key"])
    rows = rows.join(spans, F.col(key).eqNullSafe(F.col("p_id")) & (F.xxhash64(text) == F.col("p_key")), "left")
    kinds = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    # `until`: where the spans up to here end; a span that begins there or later is a new run
    parts = f"transform(p_spans, (x, i) -> transform(array(coalesce(get(until, i - 1), 0)), z -> CASE WHEN x.s < z THEN '' ELSE concat({_between('z', 'x.s')}, element_at(array({kinds}), x.k + 1)) END)[0])"
    last = f"transform(array(until[size(until) - 1]), z -> {_between('z', f'length({text})')})[0]"
    until = _scan("transform(p_spans, x -> x.e)", "greatest(x, y)")
    whole = _let("blocks", f"regexp_extract_all({text}, '(?s).{{1,{_BLOCK}}}', 0)", _let("until", until, f"concat(array_join({parts}, ''), {last})"))
    rows = rows.withColumn(text, F.expr(f"CASE WHEN p_spans IS NULL THEN {text} ELSE {whole} END"))
    if "n_chars" in names:
        rows = rows.withColumn(names["n_chars"], F.length(text).cast("long"))
    return rows.select(*names.values()).toDF(*docs.columns)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"), added)
