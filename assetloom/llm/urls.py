"""Operator 9: URL filtering by host and path rules, and gradient-boosted trees beyond them.

The rules decide the URLs they fit; these are also the labelled URLs from which the trees
learn lexical features: lengths, depth, digit ratio, entropy, parameter counts and the
smoothed block rate of host suffixes, which for a URL that the trees learn from is counted
over all other URLs, without its own label. All of it is DataFrame functions and Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: rule (host/path): verdict
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens", "entropy", "n_params", "has_fragment", "is_https", "host_rate", "suffix_rate")


@dataclass(frozen=True)
class UrlModel:
    #: Labelled URLs used to fit the trees, and for nothing else (a fixed hash order picks them), trees, and their depth.
    train_rows: int = 20_000
    trees: int = 20
    depth: int = 4
    #: Labels that a suffix is given beside its own, at the overall rate.
    smoothing: float = 5.0
    threshold: float = 0.5
    seed: int = 7


def host_of(url: Column) -> Column:
    tail = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(tail, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last that fits is the longest
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_features(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with the lexical features but the suffix rates, and host suffixes."""
    url = F.coalesce("url", F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return rows.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "host_labels": F.size(labels).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / length,
        "hyphens": (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double"),
        "entropy": F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0)),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "has_fragment": url.contains("#").cast("double"),
        "is_https": url.startswith("https://").cast("double"),
        **_suffixes(F.col("host")),
    })


def _suffixes(host: Column) -> dict[str, Column]:
    labels = F.split(host, r"\.")
    return {"host_tail": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."), "tld": F.element_at(labels, -1)}


def _sample(labelled: DataFrame, n: int, blocked: int, rows: int) -> DataFrame:
    """At most `rows` of the n labelled URLs, in the order of a hash: each class by its share, the rarer by 1 in 20 at least."""
    if n <= rows:
        return labelled
    rare, count = (1.0, blocked) if 2 * blocked <= n else (0.0, n - blocked)
    few = min(count, max(1, rows // 20, round(rows * count / n)))
    parts = [labelled.where(F.col("label") == x).orderBy(F.xxhash64("url"), "url").limit(k) for x, k in ((rare, few), (1.0 - rare, max(1, rows - few)))]
    return parts[0].unionByName(parts[1])


def _rate(blocked: Column, n: Column, overall: float, m: UrlModel) -> Column:
    return (blocked + m.smoothing * overall) / (n + m.smoothing)


def _with_rate(train: DataFrame, out: DataFrame, counts: DataFrame, key: str, name: str, overall: float, m: UrlModel) -> tuple[DataFrame, DataFrame]:
    """Both with the smoothed block rate of their key: train's without each URL's own label (folds of one)."""
    whole = stored(counts.groupBy(key).agg(F.sum("label").alias("blocked"), F.count("*").alias("n")), f"urls-{name}")
    train = train.join(whole, key).withColumn(name, _rate(F.col("blocked") - F.col("label"), F.col("n") - 1, overall, m)).drop("blocked", "n")
    rates = whole.select(key, _rate(F.col("blocked"), F.col("n"), overall, m).alias(name))
    return train, out.join(rates, key, "left").withColumn(name, F.coalesce(name, F.lit(overall)))


def judge(labelled: DataFrame, rows: DataFrame, m: UrlModel = UrlModel()) -> DataFrame:
    """rows (url, host, path) and score: the block probability by trees learnt from labelled (url, host, path, label 0 or 1).

    Where the labels have one class, or none, the score is that class's (0, if none).
    """
    # distinct URLs, all of them: rates and classes are counted over these
    labelled = stored(labelled.groupBy("url", "host", "path").agg(F.max("label").alias("label")), "urls-labelled")
    seen = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    rate = (seen["blocked"] or 0.0) / max(seen["n"], 1)
    if rate in (0.0, 1.0):
        return rows.withColumn("score", F.lit(rate))
    out = with_features(rows)
    train = stored(with_features(_sample(labelled, seen["n"], int(seen["blocked"]), m.train_rows)), "urls-train")
    counts = labelled.select("label", *(c.alias(k) for k, c in _suffixes(F.col("host")).items()))
    for key, name in (("host_tail", "host_rate"), ("tld", "suffix_rate")):
        train, out = _with_rate(train, out, counts, key, name, rate, m)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=m.trees, maxDepth=m.depth, seed=m.seed, maxBins=64).fit(assemble.transform(train).select("features", "label").coalesce(2))
    return model.transform(assemble.transform(out)).withColumn("score", vector_to_array("probability")[1])


def filter_urls(pages: DataFrame, m: UrlModel = UrlModel(), rules: dict[str, str] = RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, score (the trees' block probability).

    A null url, or one without ://, has host and path ''. Where no rule fits, the trees
    decide; where the labels have one class or none, that class (allow, if none). Repeated
    rows each give a row; a null id stays null. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.element_at(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)), F.col("rule"))
    labelled = rows.where("rule IS NOT NULL").select("url", "host", "path", (by_rule == "block").cast("double").alias("label"))
    out = judge(labelled, rows, m)
    learned = F.when(F.col("score") > m.threshold, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, learned).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
