"""The library's queries over the test tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis, browse, cross, engines, graph, history, rules, snapshot, stats, tagging
from ..sources import catalog as src
from ..sources import fsscan, gitstatus, ignores, rescan, storage, versioned
from ..streaming import watch
from . import config, samples

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
A, R, K, D = src.ASSETS_SQL, src.REFERENCES_SQL, src.KNOWN_SQL, src.DOCUMENT_FILES_SQL
assets = src.asset_view


def query(name: str, sql: str | None = None):
    def add(f):
        FOUND[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def over_assets(name: str, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"WITH {A} {sql}")(lambda spark, sf_dir: build(assets(spark, sf_dir)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- statistics ---------------------------------------------------------------------------

over_assets("stats_type", "SELECT asset_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM a GROUP BY ALL", lambda a: stats.counts(a, "asset_type"))
over_assets("stats_ext", "SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM a GROUP BY ALL", lambda a: stats.counts(a, "extension"))
over_assets("stats_dir", "SELECT dir, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM a GROUP BY ALL", lambda a: stats.counts(a, "dir"))
over_assets("stats_size_by_type", "SELECT upper(asset_type[1]) || asset_type[2:] AS type_name, CAST(sum(size) AS BIGINT) AS total_size FROM a GROUP BY ALL", lambda a: a.groupBy(text.capitalised(F.col("asset_type")).alias("type_name")).agg(F.sum("size").alias("total_size")))
over_assets(
    "stats_size_hist",
    "SELECT CASE WHEN size < 1024 THEN '<1KB' WHEN size < 10240 THEN '1-10KB' WHEN size < 102400 THEN '10-100KB' WHEN size < 1048576 THEN '100KB-1MB' WHEN size < 10485760 THEN '1-10MB' ELSE '>10MB' END AS size_class, count(*) AS n FROM a GROUP BY ALL",
    stats.size_histogram,
)
over_assets("stats_type_share", "SELECT asset_type, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM a GROUP BY ALL", stats.type_shares)
over_assets("stats_totals", "SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM a", lambda a: a.agg(F.count("*").alias("n"), F.sum("size").alias("total_size")))
over_assets("top_files", "SELECT path, size FROM a ORDER BY size DESC, lower(path), path LIMIT 10", stats.largest)
over_assets("top_ext", "SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM a GROUP BY ALL ORDER BY n DESC, extension LIMIT 8", stats.top_extensions)
over_assets("vertex_scale", "SELECT greatest(coalesce(max(vertex_count), 0), 1) AS max_vertices FROM a", stats.vertex_scale)
over_assets(
    "dir_rollup",
    """, p AS (SELECT string_split(dir, '/') AS s, size FROM a), e AS (SELECT unnest(list_transform(generate_series(2, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS path, size FROM p)
    SELECT path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size, len(string_split(path, '/')) - 2 AS depth FROM e GROUP BY ALL""",
    lambda a: stats.folder_rollup(a, src.ROOT).withColumn("depth", F.col("depth").cast("long")),
)
over_assets(
    "cache_evict",
    "SELECT path, size FROM (SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY modified, path ROWS UNBOUNDED PRECEDING) - size AS prior FROM a) WHERE total - prior > 50000000",
    lambda a: stats.evicted(a, 50_000_000).select("path", "size"),
)
over_assets(
    "csv_export",
    """, c AS (SELECT path, list_transform([path, name, upper(asset_type[1]) || asset_type[2:], extension, CAST(size AS VARCHAR), coalesce(CAST(width AS VARCHAR), ''), coalesce(CAST(height AS VARCHAR), '')],
      lambda x: '"' || replace(CASE WHEN regexp_matches(x, '^[=+\\-@\\t\\r]') THEN chr(39) || x ELSE x END, '"', '""') || '"') AS cells FROM a)
    SELECT path, array_to_string(cells, ',') AS line FROM c""",
    stats.report_rows,
)
over_assets(
    "human_size",
    "SELECT path, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024) || ' KB' WHEN size < 1073741824 THEN printf('%.1f', size / 1048576) || ' MB' ELSE printf('%.2f', size / 1073741824) || ' GB' END AS human FROM a",
    lambda a: a.select("path", text.human_size(F.col("size")).alias("human")),
)


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_escape(F.col("html")).alias("escaped"))


# --- browsing -----------------------------------------------------------------------------


def browsing(name: str, where: str, spec: browse.FilterSpec) -> None:
    over_assets(name, f"SELECT path, size FROM a WHERE {where}", lambda a: browse.browse(a, spec).select("path", "size"))


browsing("browse_scope", "dir = '/proj/Large' OR starts_with(path, '/proj/Large/')", browse.FilterSpec(folder="/proj/Large"))
browsing("browse_search", "contains(lower(name), 'tree') OR contains(lower(path), 'tree')", browse.FilterSpec(search="  Tree "))
browsing("browse_type", "asset_type IN ('texture', 'audio')", browse.FilterSpec(types=("texture", "audio")))
browsing("browse_ext", "ext IN ('png', 'obj')", browse.FilterSpec(extensions=("png", "obj")))
browsing("browse_ranges", "size BETWEEN 1000 AND 1000000 AND width >= 64 AND width <= 1024 AND height <= 1024", browse.FilterSpec(size=(1000, 1_000_000), width=(64, 1024), height=(None, 1024)))
browsing("browse_model_ranges", "vertex_count >= 40000 AND face_count <= 150000", browse.FilterSpec(vertex_count=(40_000, None), face_count=(None, 150_000)))
browsing("browse_alpha", "has_alpha = false", browse.FilterSpec(has_alpha=False))
browsing("browse_color_space", "color_space = 'Linear'", browse.FilterSpec(color_space="Linear"))
browsing("browse_art", f"asset_type IN {browse.ART_TYPES}", browse.FilterSpec(types=browse.ART_TYPES))
over_assets("picklist_ext", "SELECT DISTINCT ext AS value FROM a", lambda a: browse.pick_list(a, "extension"))
over_assets("palette_top50", "SELECT path, name FROM a WHERE contains(lower(path), 'armor') ORDER BY lower(path), path LIMIT 50", lambda a: browse.palette(a, "armor"))
over_assets(
    "browse_sort_dims",
    "SELECT path, coalesce(width, 0) * coalesce(height, 0) AS area FROM a ORDER BY 2 DESC, lower(path), path LIMIT 100",
    lambda a: browse.sorted_by(a, "dimensions", True).limit(100).select("path", browse.sort_value("dimensions").alias("area")),
)
def _sorted_query(name: str, key: str, sql: str, descending: bool) -> None:
    order = "DESC" if descending else "ASC"
    over_assets(f"browse_sort_{name}", f"SELECT path, {sql} AS value FROM a ORDER BY {sql} {order}, lower(path), path LIMIT 100", lambda a: browse.sorted_by(a, key, descending).limit(100).select("path", browse.sort_value(key).alias("value")))


for _name, _key, _sql, _descending in [
    ("size", "size", "size", True), ("size_up", "size", "size", False), ("modified", "modified", "modified", True), ("vertices", "vertices", "coalesce(vertex_count, 0)", True),
    ("faces", "faces", "coalesce(face_count, 0)", False), ("duration", "duration", "coalesce(duration_secs, 0)", True),
]:
    _sorted_query(_name, _key, _sql, _descending)
over_assets(
    "relative_path",
    "SELECT path, path[7:] AS shown FROM a",
    lambda a: browse.shown_path(a, src.ROOT),
)


def _doc_tags(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("path", F.concat(F.lit("/proj/docs/"), F.col("doc_id")))
    return labels.select("path", F.explode(F.array(F.concat(F.lit("quality:"), F.col("quality")), F.concat(F.lit("toxic:"), F.col("toxic")))).alias("tag"))


@query("browse_tags_all", "SELECT DISTINCT '/proj/docs/' || doc_id AS path FROM labels WHERE quality = 1 AND toxic = 0")
def browse_tags_all(spark, sf_dir):
    tags = _doc_tags(spark, sf_dir)
    return browse.with_all_tags(tags.select("path").distinct(), tags, ["quality:1", "toxic:0"])


_STATUS = ["new", "untracked", "modified", "renamed", "typechange", "deleted", "conflicted", "ignored"]


def _statuses(spark, sf_dir):
    k = F.col("o_orderkey") % 8
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("/proj/f"), F.col("o_orderkey")).alias("path"), F.element_at(F.array(*map(F.lit, _STATUS)), (k + 1).cast("int")).alias("status"))


@query("git_rollup", "SELECT count(*) FILTER (o_orderkey % 8 IN (0, 1)) AS added, count(*) FILTER (o_orderkey % 8 IN (2, 3, 4)) AS modified, count(*) FILTER (o_orderkey % 8 = 5) AS deleted, count(*) FILTER (o_orderkey % 8 = 6) AS conflicted, count(*) FILTER (o_orderkey % 8 <> 7) AS total FROM orders")
def git_rollup(spark, sf_dir):
    return browse.status_rollup(_statuses(spark, sf_dir))


@query("browse_git", "SELECT '/proj/f' || o_orderkey AS path FROM orders WHERE o_orderkey % 8 IN (2, 6)")
def browse_git(spark, sf_dir):
    s = _statuses(spark, sf_dir)
    return browse.with_status(s.select("path"), s, ["modified", "conflicted"])


@query("recents", "SELECT event_type AS value, max(event_id) AS last_at FROM events GROUP BY ALL ORDER BY last_at DESC, value LIMIT 12")
def recents(spark, sf_dir):
    return browse.recent(table(spark, sf_dir, "events").select(F.col("event_type").alias("value"), F.col("event_id").alias("at")))


# --- rules --------------------------------------------------------------------------------

STRICT = config.RuleConfig(
    naming=config.Naming(max_length=24, texture_prefix="T_", case_style="snake_case"), texture=config.Texture(enabled=True, max_size=2048, min_size=8, warn_non_square=True, max_file_size=5_000_000),
    model=config.Model(enabled=True, max_vertices=150_000, max_faces=120_000, max_materials=8), audio=config.Audio(enabled=True, max_sfx_duration=25.0, max_file_size=10_000_000, warn_stereo_sfx=True),
    pbr_set=config.PbrSet(enabled=True), dcc_source=config.DccSource(enabled=True), ignore=("**/Brand3/*", "Large/**/crate*.png"),
)
_BAD = r"[ !#$%^&*()+=<>:\"|?]"
_POT = "({0} > 0 AND ({0} & ({0} - 1)) = 0)"
_SFX = "(regexp_matches(lower(stem), '(^|[^a-z0-9])(sfx|sound|effect|hit|click|ui)([^a-z0-9]|$)'))"


def _rules_sql(case: str = "regexp_matches(stem, '^[\\p{Ll}\\p{N}_]*$')") -> str:
    suffix = " ".join(f"WHEN ends_with(lower(stem), '{s}') THEN '{s}'" for s in rules.DATA_SUFFIXES)
    return f"""i0 AS (
      SELECT path, CASE WHEN length(name) > 24 THEN 'naming.length' WHEN regexp_matches(name, '{_BAD}') THEN 'naming.forbidden_char' WHEN asset_type = 'texture' AND NOT starts_with(name, 'T_') AND dcc_source_kind IS NULL THEN 'naming.prefix' WHEN NOT {case} THEN 'naming.case' END AS rule_id,
        CASE WHEN length(name) > 24 THEN CAST(length(name) AS VARCHAR) WHEN regexp_matches(name, '{_BAD}') THEN regexp_extract(name, '{_BAD}') ELSE '' END AS arg FROM a
      UNION ALL SELECT path, CASE WHEN NOT {_POT.format('width')} OR NOT {_POT.format('height')} THEN 'texture.pot' WHEN width > 2048 OR height > 2048 THEN 'texture.max_size' WHEN width < 8 OR height < 8 THEN 'texture.min_size' WHEN width <> height THEN 'texture.non_square' WHEN size > 5000000 THEN 'texture.file_size' WHEN mipmap_count <= 1 AND (width >= 512 OR height >= 512) THEN 'texture.no_mipmaps' END,
        CASE WHEN NOT {_POT.format('width')} OR NOT {_POT.format('height')} THEN CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) ELSE '' END FROM a WHERE asset_type = 'texture'
      UNION ALL SELECT path, CASE {suffix.replace("THEN '", "THEN 'texture.color_space#")} END, CASE {suffix} END FROM a WHERE asset_type = 'texture' AND color_space = 'sRGB'
      UNION ALL SELECT path, CASE WHEN vertex_count > 150000 THEN 'model.vertices' WHEN face_count > 120000 THEN 'model.faces' WHEN material_count > 8 THEN 'model.materials' END,
        CASE WHEN vertex_count > 150000 THEN CAST(vertex_count AS VARCHAR) WHEN face_count > 120000 THEN CAST(face_count AS VARCHAR) ELSE CAST(material_count AS VARCHAR) END FROM a WHERE asset_type = 'model'
      UNION ALL SELECT path, CASE WHEN sample_rate NOT IN (44100, 48000) THEN 'audio.sample_rate' WHEN {_SFX} AND duration_secs > 25 THEN 'audio.sfx_duration' WHEN {_SFX} AND channels > 1 THEN 'audio.stereo_sfx' WHEN size > 10000000 THEN 'audio.file_size' END,
        CASE WHEN sample_rate NOT IN (44100, 48000) THEN CAST(sample_rate AS VARCHAR) ELSE '' END FROM a WHERE asset_type = 'audio' AND has_meta
    ), i1 AS (SELECT path AS asset_path, split_part(rule_id, '#', 1) AS rule_id, arg FROM i0 WHERE rule_id IS NOT NULL),
    i AS (SELECT *, CASE WHEN rule_id IN ('naming.case', 'texture.min_size', 'texture.non_square', 'texture.no_mipmaps', 'audio.sample_rate', 'audio.stereo_sfx') THEN 'info' ELSE 'warning' END AS severity, rule_id IN ('naming.forbidden_char', 'naming.prefix', 'naming.case') AS auto_fixable FROM i1)"""


I = _rules_sql("regexp_matches(CASE WHEN asset_type = 'texture' AND starts_with(stem, 'T_') THEN stem[3:] ELSE stem END, '^[\\p{Ll}\\p{N}_]*$')")


def _flat(issues: DataFrame) -> DataFrame:
    a = F.col("args")
    side = F.concat(a["width"], F.lit("x"), a["height"])
    arg = F.when(F.col("rule_id") == "naming.length", a["length"]).when(F.col("rule_id") == "texture.pot", side).otherwise(F.coalesce(a["char"], a["suffix"], a["count"], a["rate"], F.lit("")))
    return issues.select("asset_path", "rule_id", "severity", "auto_fixable", arg.alias("arg"))


def _strict(a: DataFrame) -> DataFrame:
    return rules.asset_issues(a, STRICT)


_RULE_IDS = ["naming.length", "naming.forbidden_char", "naming.prefix", "naming.case", "texture.pot", "texture.max_size", "texture.min_size", "texture.file_size", "texture.no_mipmaps", "texture.color_space", "model.vertices", "model.faces", "model.materials", "audio.sample_rate", "audio.sfx_duration", "audio.stereo_sfx", "audio.file_size"]


def _one_rule(rule_id: str) -> None:
    where = f"rule_id = '{rule_id}'"
    over_assets("rule_" + rule_id.replace(".", "_"), f", {I} SELECT asset_path, rule_id, severity, auto_fixable, arg FROM i WHERE {where}", lambda a: _flat(_strict(a)).where(where))


for _rule_id in _RULE_IDS:
    _one_rule(_rule_id)
def _case_query(style: str, pattern: str) -> None:
    only = config.RuleConfig(naming=config.Naming(forbidden_chars=(), case_style=style), texture=config.Texture(color_space=False))
    over_assets(f"rule_case_{style.split('_')[0].split('-')[0].lower()}", f"SELECT path FROM a WHERE NOT regexp_matches(stem, '{pattern}')", lambda a: rules.asset_issues(a, only).where("rule_id = 'naming.case'").select(F.col("asset_path").alias("path")))


for _style, _pattern in [("PascalCase", "^(\\p{Lu}[^_]*)?$"), ("camelCase", "^(\\p{Ll}[^_]*)?$"), ("kebab-case", "^[\\p{Ll}\\p{N}-]*$")]:
    _case_query(_style, _pattern)
over_assets("analysis_summary", f", {I} SELECT rule_id, severity, count(*) AS n, CAST(sum(CAST(auto_fixable AS INT)) AS BIGINT) AS n_fixable FROM i GROUP BY GROUPING SETS ((rule_id, severity), ())", lambda a: analysis.summary(_strict(a)))
over_assets("issues_by_rule", f", {I} SELECT rule_id, count(*) AS n, count(DISTINCT asset_path) AS n_assets, min(asset_path) AS first_path FROM i GROUP BY ALL", lambda a: analysis.by_rule(_strict(a)))
over_assets("pass_count", f", {I} SELECT (SELECT count(*) FROM a) AS total, count(DISTINCT asset_path) AS with_issues, greatest((SELECT count(*) FROM a) - count(DISTINCT asset_path), 0) AS passed FROM i", lambda a: analysis.pass_count(a, _strict(a)))
over_assets("issues_warning", f", {I} SELECT asset_path, rule_id FROM i WHERE severity = 'warning'", lambda a: _strict(a).where("severity = 'warning'").select("asset_path", "rule_id"))
over_assets("rule_non_square", "SELECT path AS asset_path, 'texture.non_square' AS rule_id FROM a WHERE asset_type = 'texture' AND width <> height AND width BETWEEN 4 AND 4096 AND height BETWEEN 4 AND 4096", lambda a: rules.asset_issues(a, config.RuleConfig(naming=config.Naming(enabled=False), texture=config.Texture(enabled=True, require_pot=False, warn_non_square=True, color_space=False))).where("rule_id = 'texture.non_square'").select("asset_path", "rule_id"))
_IGNORED = "regexp_matches(path[7:], '^(.*/)?Brand3/.*$') OR regexp_matches(path[7:], '^Large/(.*/)?crate.*\\.png$')"
over_assets("ignore_globs", f"SELECT path FROM a WHERE NOT ({_IGNORED})", lambda a: rules.not_ignored(a, STRICT.ignore, src.ROOT).select("path"))
over_assets(
    "fix_preview",
    f""", n AS (SELECT *, stem AS s0, CASE WHEN extension = '' THEN '' ELSE '.' || extension END AS dot, trim(regexp_replace(regexp_replace(stem, '{_BAD}', '_', 'g'), '_+', '_', 'g'), '_') AS clean FROM a)
    SELECT path, CASE WHEN length(name) > 64 THEN NULL WHEN regexp_matches(name, '{_BAD}') THEN clean || dot WHEN asset_type = 'texture' AND NOT starts_with(name, 'T_') AND dcc_source_kind IS NULL THEN 'T_' || name END AS new_name FROM n""",
    lambda a: a.select("path", rules.fix_name(config.Naming(max_length=64, texture_prefix="T_")).alias("new_name")),
)
over_assets(
    "fix_collisions",
    ", n AS (SELECT path, dir, lower(name[1:3]) || '.x' AS new_name FROM a) SELECT path, new_name, count(*) OVER (PARTITION BY lower(dir), lower(new_name)) > 1 AS collides FROM n",
    lambda a: rules.with_collisions(a.select("path", F.concat(F.lower(F.substring("name", 1, 3)), F.lit(".x")).alias("new_name"))),
)
over_assets(
    "rename_validate",
    """, n AS (SELECT path, CASE size % 6 WHEN 0 THEN '' WHEN 1 THEN 'a/b' WHEN 2 THEN 'end.' WHEN 3 THEN 'con.' || ext WHEN 4 THEN name ELSE 'COM1' END AS new_name FROM a)
    SELECT path, CASE WHEN new_name IN ('', '.', '..') THEN 'empty' WHEN contains(new_name, '/') OR contains(new_name, chr(92)) THEN 'separator' WHEN new_name[-1] IN (' ', '.') THEN 'ending' WHEN upper(split_part(new_name, '.', 1)) IN ('CON', 'COM1') THEN 'reserved' END AS problem FROM n""",
    lambda a: _named(a).select("path", text.name_problem(F.col("new_name")).alias("problem")),
)


def _named(a: DataFrame) -> DataFrame:
    """New names of every kind, by the file's size."""
    k = F.col("size") % 6
    return a.select("path", F.when(k == 0, "").when(k == 1, "a/b").when(k == 2, "end.").when(k == 3, F.concat(F.lit("con."), F.lower("extension"))).when(k == 4, F.col("name")).otherwise("COM1").alias("new_name"))


_RENAMES = {
    "find_replace": (("find_replace", "_", "."), "replace(name, '_', '.')"),
    "add_prefix": (("add_prefix", "SM_"), "'SM_' || name"),
    "add_suffix": (("add_suffix", "_v2"), "stem || '_v2.' || extension"),
    "remove_prefix": (("remove_prefix", "Rock"), "CASE WHEN starts_with(name, 'Rock') THEN name[5:] ELSE name END"),
    "remove_suffix": (("remove_suffix", "_sfx"), "CASE WHEN ends_with(stem, '_sfx') THEN stem[:-5] ELSE stem END || '.' || extension"),
    "lowercase": (("lowercase",), "lower(name)"),
    "uppercase": (("uppercase",), "upper(name)"),
    "title_case": (("title_case",), "array_to_string(list_transform(regexp_split_to_array(name, '[_ -]'), lambda w: upper(w[1]) || w[2:]), '_')"),
}


def _one_rename(op: str, args: tuple, sql: str) -> None:
    over_assets(f"rename_{op}", f"SELECT path, {sql} AS new_name, ({sql}) <> name AS will_change FROM a", lambda a: a.select("path", rules.renamed(F.col("name"), *args).alias("new_name"), (rules.renamed(F.col("name"), *args) != F.col("name")).alias("will_change")))


for _op, (_args, _sql) in _RENAMES.items():
    _one_rename(_op, _args, _sql)


# --- rules across assets ------------------------------------------------------------------


_DUPLICATES = "dup AS (SELECT size, sha256(content) AS sha256, count(*) AS n, list(path ORDER BY lower(path), path)[1] AS original, list(path ORDER BY lower(path), path)[2] AS anchor FROM f GROUP BY ALL HAVING count(*) > 1)"


@query("dup_groups", f"WITH {D}, {_DUPLICATES} SELECT size, sha256, n, original, anchor FROM dup")
def dup_groups(spark, sf_dir):
    return cross.duplicates(src.document_files(spark, sf_dir))


@query("dup_redundant", f"WITH {D}, g AS (SELECT path, row_number() OVER w AS r, first_value(path) OVER w AS original FROM f WINDOW w AS (PARTITION BY size, sha256(content) ORDER BY lower(path), path)) SELECT original, path FROM g WHERE r > 1")
def dup_redundant(spark, sf_dir):
    return cross.duplicate_members(src.document_files(spark, sf_dir))


_NULL = f"guid NOT IN ('', '{'0' * 32}', '{cross.BUILTIN_GUIDS[0]}', '{cross.BUILTIN_GUIDS[1]}')"


def _graph(f):
    return lambda spark, sf_dir: f(src.references(spark, sf_dir), src.known_assets(spark, sf_dir), src.packages(spark, sf_dir))


query("missing_refs", f"WITH {R}, {K} SELECT DISTINCT src_path, guid FROM r WHERE {_NULL} AND guid NOT IN (SELECT guid FROM known) AND guid NOT IN (SELECT guid FROM packs)")(_graph(cross.missing_references))
query("unused", f"WITH {R}, {K} SELECT path, guid FROM known WHERE asset_type <> 'scene' AND guid NOT IN (SELECT guid FROM r)")(_graph(lambda r, k, p: cross.unused_assets(k, r)))
query("graph_edges", f"WITH {R} SELECT src_guid AS src, guid AS dst FROM r WHERE {_NULL}")(_graph(lambda r, k, p: graph.edges(r)))
query(
    "graph_nodes",
    f"""WITH {R}, {K}, u AS (SELECT DISTINCT guid FROM r WHERE {_NULL} AND guid NOT IN (SELECT guid FROM known))
    SELECT guid AS id, 'asset' AS kind, max(path) AS label FROM known GROUP BY ALL
    UNION ALL SELECT u.guid, CASE WHEN package IS NULL THEN 'unresolved' ELSE 'package' END, coalesce(package, u.guid) FROM u LEFT JOIN packs ON packs.guid = u.guid""",
)(_graph(graph.nodes))
query(
    "graph_2hop",
    f"""WITH RECURSIVE {R}, e AS (SELECT DISTINCT src_guid AS s, guid AS t FROM r WHERE {_NULL}),
    st AS (SELECT id FROM (SELECT s AS id FROM e UNION SELECT t FROM e) WHERE starts_with(id, '00')),
    fw AS (SELECT id, 0 AS hop FROM st UNION SELECT e.t, fw.hop + 1 FROM fw JOIN e ON e.s = fw.id WHERE fw.hop < 2),
    bw AS (SELECT id, 0 AS hop FROM st UNION SELECT e.s, bw.hop + 1 FROM bw JOIN e ON e.t = bw.id WHERE bw.hop < 2)
    SELECT id, min(hop) AS hop, 'forward' AS direction FROM fw GROUP BY id UNION ALL SELECT id, min(hop), 'backward' FROM bw GROUP BY id""",
)(_graph(lambda r, k, p: graph.neighbourhood(graph.edges(r), F.col("id").startswith("00"))))
_TWO_HOPS = f"""WITH RECURSIVE {R}, {K}, e AS (SELECT DISTINCT src_guid AS s, guid AS t FROM r WHERE {_NULL}),
    st AS (SELECT id FROM (SELECT s AS id FROM e UNION SELECT t FROM e) WHERE starts_with(id, '00')),
    fw AS (SELECT id, 0 AS hop FROM st UNION SELECT e.t, fw.hop + 1 FROM fw JOIN e ON e.s = fw.id WHERE fw.hop < 2 AND fw.id IN (SELECT guid FROM known)),
    bw AS (SELECT id, 0 AS hop FROM st UNION SELECT e.s, bw.hop + 1 FROM bw JOIN e ON e.t = bw.id WHERE bw.hop < 2 AND bw.id IN (SELECT guid FROM known))"""


def _two_hops(r, k):
    return graph.neighbourhood(graph.edges(r), F.col("id").startswith("00"), assets=k.select(F.col("guid").alias("id")))


query("graph_2hop_assets", f"{_TWO_HOPS} SELECT id, min(hop) AS hop, 'forward' AS direction FROM fw GROUP BY id UNION ALL SELECT id, min(hop), 'backward' FROM bw GROUP BY id")(_graph(lambda r, k, p: _two_hops(r, k)))
query("graph_2hop_edges", f"{_TWO_HOPS}, n AS (SELECT id FROM fw UNION SELECT id FROM bw) SELECT s AS src, t AS dst FROM e WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)")(_graph(lambda r, k, p: graph.reached_edges(graph.edges(r), _two_hops(r, k))))
query("ref_mentions", f"WITH {R}, t AS (SELECT DISTINCT guid, src_path FROM r WHERE guid <> src_guid) SELECT guid AS target, src_path AS path, row_number() OVER (PARTITION BY guid ORDER BY NOT ends_with(src_path, '/s3.unity'), lower(src_path), src_path) AS place FROM t")(
    _graph(lambda r, k, p: graph.mentions(r.select(F.col("guid").alias("target"), F.col("src_path").alias("path"), F.col("src_guid").alias("self")), "s3.unity").select("target", "path", F.row_number().over(Window.partitionBy("target").orderBy("ord")).cast("long").alias("place")))
)
query("reverse_refs", f"WITH {R} SELECT guid, count(*) AS n_files, min(src_path) AS first_file FROM (SELECT DISTINCT guid, src_path FROM r WHERE {_NULL} AND guid <> src_guid) GROUP BY ALL")(_graph(lambda r, k, p: graph.reverse_references(r)))
query("ref_totals", f"WITH {R}, t AS (SELECT guid, count(DISTINCT src_path) AS n FROM r WHERE {_NULL} AND guid <> src_guid GROUP BY guid) SELECT count(*) AS n_targets, CAST(sum(n) AS BIGINT) AS n_files FROM t")(_graph(lambda r, k, p: graph.reverse_references(r).agg(F.count("*").alias("n_targets"), F.sum("n_files").alias("n_files"))))


@query("page_links", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS target FROM pages")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), 1))).alias("target"))


@query("page_lang", "SELECT page_id, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_lang(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1).alias("lang"))


_PBR = """, s AS (SELECT path, dir, regexp_extract(stem, '^(.+)_[^_]*$', 1) AS base, lower(regexp_extract(stem, '_([^_]*)$', 1)) AS suffix FROM a WHERE asset_type = 'texture'),
    t AS (SELECT *, CASE suffix WHEN 'basecolor' THEN ['basecolor'] WHEN 'normal' THEN ['normal'] WHEN 'height' THEN ['height'] WHEN 'orm' THEN ['ao', 'roughness', 'metallic'] END AS roles FROM s WHERE base <> '' AND suffix IN ('basecolor', 'normal', 'height', 'orm')),
    g AS (SELECT dir, lower(base) AS key, min_by(base, (lower(path), path)) AS display, min_by(path, (suffix <> 'basecolor', lower(path), path)) AS anchor, list_sort(list_distinct(flatten(list(roles)))) AS roles FROM t GROUP BY ALL)"""
over_assets(
    "pbr_sets",
    f"{_PBR} SELECT dir, key, display, anchor, array_to_string(roles, ',') AS channels, NOT list_contains(roles, 'normal') AS incomplete FROM g WHERE list_contains(roles, 'basecolor')",
    lambda a: cross.pbr_sets(a).select("dir", "key", "display", "anchor", F.array_join("channels", ",").alias("channels"), (~F.col("complete")).alias("incomplete")),
)
_DCC = """, m AS (SELECT unnest([{'s': 'blend', 'e': ['fbx', 'glb', 'gltf', 'obj', 'dae']}, {'s': 'ma', 'e': ['fbx', 'obj']}, {'s': 'psd', 'e': ['png', 'jpg', 'tga', 'webp']}]) AS m),
    c AS (SELECT a.path, a.modified, lower(a.stem) AS stem, m.e, CASE WHEN ends_with(dir, '/src') THEN [dir, dir[:-5], dir[:-5] || '/sources', dir[:-5] || '/_source'] ELSE [dir] END AS dirs FROM a JOIN m ON a.ext = m.s),
    d AS (SELECT path, modified, stem, e, unnest(dirs) AS dir, generate_subscripts(dirs, 1) AS rank FROM c),
    p AS (SELECT d.path AS source, d.modified AS st, x.path AS export, x.modified AS et, row_number() OVER (PARTITION BY d.path ORDER BY x.modified DESC, d.rank) AS r FROM d JOIN a x ON x.dir = d.dir AND lower(x.stem) = d.stem AND list_contains(d.e, x.ext))"""
over_assets(
    "dcc_stale",
    f"{_DCC} SELECT source, export, st - et AS age_secs FROM p WHERE r = 1 AND st - et > 30",
    lambda a: cross.stale_exports(a, config.DccSource(mtime_tolerance_secs=30)),
)


_SEEN = A.replace("a AS (SELECT *, lower(extension) AS ext", "every_a AS (SELECT *, lower(extension) AS ext") + f", a AS (SELECT * FROM every_a WHERE NOT ({_IGNORED}))"
_ANALYSIS = f"""WITH {_SEEN}, {I}, {D}, {R}, {K}, {_DUPLICATES}{_PBR}{_DCC.replace(' m AS (', ' dcc AS (').replace('m.m', 'm.m').replace('FROM a JOIN m ON', 'FROM a JOIN dcc AS m ON')}
  SELECT 0 AS phase, rule_id, severity, asset_path, 0 AS n_related FROM i UNION ALL SELECT 1, 'duplicate', 'warning', anchor, 2 FROM dup
  UNION ALL SELECT 2, 'missing_reference', 'warning', src_path, 0 FROM (SELECT DISTINCT src_path, guid FROM r WHERE {_NULL} AND guid NOT IN (SELECT guid FROM known) AND guid NOT IN (SELECT guid FROM packs))
  UNION ALL SELECT 3, 'pbr_set.incomplete', 'warning', anchor, 0 FROM g WHERE list_contains(roles, 'basecolor') AND NOT list_contains(roles, 'normal')
  UNION ALL SELECT 4, 'dcc_source.outdated_export', 'warning', source, 1 FROM p WHERE r = 1 AND st - et > {STRICT.dcc_source.mtime_tolerance_secs}"""


def _all_issues(spark, sf_dir):
    return analysis.analyse(assets(spark, sf_dir), STRICT, root=src.ROOT, files=src.document_files(spark, sf_dir), refs=src.references(spark, sf_dir), known=src.known_assets(spark, sf_dir), packages=src.packages(spark, sf_dir))


@query("analysis_all", _ANALYSIS)
def analysis_all(spark, sf_dir):
    return _all_issues(spark, sf_dir).select("phase", "rule_id", "severity", "asset_path", F.size("related_paths").alias("n_related"))


@query("issues_first", f"SELECT * FROM ({_ANALYSIS}) ORDER BY rule_id, phase, lower(asset_path), asset_path LIMIT 100")
def issues_first(spark, sf_dir):
    return analysis.groups_in_order(_all_issues(spark, sf_dir)).limit(100).select("phase", "rule_id", "severity", "asset_path", F.size("related_paths").alias("n_related"))


@query("issues_pruned", f"WITH x AS ({_ANALYSIS}) SELECT rule_id, severity, count(*) AS n, CAST(sum(CAST(rule_id IN ('naming.forbidden_char', 'naming.prefix', 'naming.case') AS INT)) AS BIGINT) AS n_fixable FROM x WHERE rule_id <> 'duplicate' OR asset_path NOT LIKE '%1.txt' GROUP BY GROUPING SETS ((rule_id, severity), ())")
def issues_pruned(spark, sf_dir):
    found = _all_issues(spark, sf_dir)
    return analysis.summary(analysis.pruned(found, found.where("asset_path LIKE '%1.txt'")))


@query("issues_collapsed", f"WITH {D}, {_DUPLICATES} SELECT min(anchor) AS asset_path, original[7:] AS head FROM dup GROUP BY original")
def issues_collapsed(spark, sf_dir):
    found = _all_issues(spark, sf_dir).where("rule_id = 'duplicate'")
    return analysis.collapse_groups(found).select("asset_path", F.get("related_paths", F.lit(0)).alias("head"))


over_assets(
    "sibling_textures",
    f""", d AS (SELECT path AS model, unnest({[d and "/" + d for d in engines.BESIDE]}) AS sub, generate_subscripts({engines.BESIDE}, 1) AS rank, dir FROM a WHERE asset_type = 'model'
      UNION ALL SELECT path, unnest({["/" + d for d in engines.ABOVE]}), 100 + generate_subscripts({engines.ABOVE}, 1), regexp_replace(dir, '/[^/]*$', '') FROM a WHERE asset_type = 'model')
    SELECT model, lower(t.name) AS name, min_by(t.path, (rank, t.path)) AS texture FROM d JOIN a t ON t.dir = d.dir || d.sub WHERE t.ext IN {tuple(engines.TEXTURE_EXTENSIONS)} GROUP BY ALL""",
    lambda a: engines.sibling_textures(a.where("asset_type = 'model'"), a),
)
over_assets(
    "godot_unused",
    "SELECT path FROM a WHERE asset_type <> 'scene' AND size % 3 <> 0",
    lambda a: engines.godot_unused(a, a.where("size % 3 = 0").select(engines.res_path(F.col("path"), src.ROOT).alias("target")), src.ROOT),
)
over_assets(
    "godot_nodes",
    "SELECT 'res://' || path[7:] AS id, 'asset' AS kind FROM a UNION ALL SELECT DISTINCT 'res://gone/' || (size % 7), 'missing' FROM a",
    lambda a: engines.godot_graph(a, a.select("path", F.concat(F.lit("res://gone/"), F.col("size") % 7).alias("target")), a, src.ROOT)[0],
)


over_assets(
    "godot_edges",
    "SELECT 'res://' || path[7:] AS src, 'res://gone/' || (size % 7) AS dst FROM a",
    lambda a: engines.godot_graph(a, a.select("path", F.concat(F.lit("res://gone/"), F.col("size") % 7).alias("target")), a, src.ROOT)[1],
)
over_assets(
    "godot_kinds",
    """, t AS (SELECT CASE size % 3 WHEN 0 THEN path WHEN 1 THEN '/proj/notes/' || (size % 11) || '.md' ELSE '/proj/gone/' || (size % 5) END AS p FROM a)
    SELECT 'res://' || path[7:] AS id, 'asset' AS kind FROM a UNION ALL SELECT DISTINCT 'res://' || p[7:], CASE WHEN starts_with(p, '/proj/notes/') THEN 'unscanned' ELSE 'missing' END FROM t WHERE p NOT IN (SELECT path FROM a)""",
    lambda a: engines.godot_graph(a, a.select("path", engines.res_path(_pointed(), src.ROOT).alias("target")), a.sparkSession.range(11).selectExpr("concat('/proj/notes/', id, '.md') AS path"), src.ROOT)[0],
)
over_assets(
    "godot_paths",
    "SELECT path, 'res://' || path[7:] AS res, path AS back FROM a UNION ALL SELECT '/else' || path, NULL, NULL FROM a",
    lambda a: a.select("path").union(a.select(F.concat(F.lit("/else"), "path"))).select("path", engines.res_path(F.col("path"), src.ROOT).alias("res"), engines.absolute_path(engines.res_path(F.col("path"), src.ROOT), src.ROOT).alias("back")),
)


def _pointed():
    k = F.col("size") % 3
    return F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("/proj/notes/"), (F.col("size") % 11).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("/proj/gone/"), (F.col("size") % 5).cast("string")))


# --- snapshots ----------------------------------------------------------------------------


def _epochs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/proj/o"), F.col("o_orderkey"))
    size = F.floor("o_totalprice").cast("long")
    fresh = F.when(F.col("o_orderkey") % 7 == 0, F.lit(1).cast("long"))
    before = o.where("o_orderkey % 11 <> 0").select(path.alias("path"), F.col("o_orderkey").alias("modified_nanos"), size.alias("size"), F.lit(None).cast("long").alias("meta_modified_nanos"))
    return before, o.where("o_orderkey % 13 <> 0").select(path.alias("path"), F.col("o_orderkey").alias("modified_nanos"), size.alias("size"), fresh.alias("meta_modified_nanos"))


_CHANGE = "CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 THEN 'added' WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'same' END"
_EPOCHS = "FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 13 <> 0"


@query("snapshot_diff", f"SELECT '/proj/o' || o_orderkey AS path, {_CHANGE} AS change {_EPOCHS}")
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(*_epochs(spark, sf_dir))


@query("incr_stats", f"SELECT count(*) FILTER (c <> 'removed') AS total, count(*) FILTER (c = 'same') AS cached, count(*) FILTER (c IN ('added', 'changed')) AS rescanned, count(*) FILTER (c = 'removed') AS removed FROM (SELECT {_CHANGE} AS c {_EPOCHS})")
def incr_stats(spark, sf_dir):
    return snapshot.stats(snapshot.diff(*_epochs(spark, sf_dir)))


@query("snapshot_merge", "SELECT '/proj/o' || o_orderkey AS path, o_orderkey AS modified_nanos, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE -1 END AS BIGINT) AS meta_modified_nanos FROM orders WHERE o_orderkey % 13 <> 0")
def snapshot_merge(spark, sf_dir):
    before, now = _epochs(spark, sf_dir)
    wanted = snapshot.diff(before, now).where("change IN ('added', 'changed')").select("path")
    return snapshot.merge(before, now, now.join(wanted, "path", "left_semi")).withColumn("meta_modified_nanos", F.coalesce("meta_modified_nanos", F.lit(-1).cast("long")))


def _hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_type", "user_id", F.date_trunc("hour", "ts").cast("string").alias("hour"), F.concat(F.lit("/proj/e"), F.col("event_id")).alias("path"))


@query("identity_match", """WITH e AS (SELECT event_type, user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, '/proj/e' || event_id AS path FROM events),
  g AS (SELECT user_id, hour, min(path) AS from_path FROM e WHERE event_type IN ('error', 'purchase') GROUP BY ALL HAVING count(*) = 1), c AS (SELECT user_id, hour, min(path) AS to_path FROM e WHERE event_type NOT IN ('error', 'purchase') GROUP BY ALL HAVING count(*) = 1)
  SELECT user_id, hour, from_path, to_path FROM g JOIN c USING (user_id, hour)""")
def identity_match(spark, sf_dir):
    e = _hourly(spark, sf_dir)
    return snapshot.moved(e.where("event_type IN ('error', 'purchase')"), e.where("event_type NOT IN ('error', 'purchase')"), ("user_id", "hour"))


over_assets(
    "rekey_dir",
    "SELECT CASE WHEN starts_with(path, '/proj/SMALL/') THEN '/proj/Tiny' || path[12:] ELSE path END AS path, CASE WHEN starts_with(path, '/proj/SMALL/') THEN '/proj/Tiny' || dir[12:] ELSE dir END AS dir, name, extension, asset_type, size FROM a",
    lambda a: snapshot.rekeyed(a, "/proj/SMALL", "/proj/Tiny").select("path", "dir", "name", "extension", "asset_type", "size"),
)


# --- tags ---------------------------------------------------------------------------------

_STOPS = "(" + ", ".join(f"'{w}'" for w in tagging.WORD_STOPS) + ")"
_TOKENS = f"""tk AS (SELECT DISTINCT path, unnest(list_filter(string_split_regex(translate(regexp_replace(stem, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[_\\-. ]+'),
    lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^\\p{{N}}+$') AND NOT regexp_matches(w, '^v[0-9]{{1,3}}$') AND w NOT IN {_STOPS})) AS token FROM a)"""
_DIMS = """td AS (SELECT path, CAST(CAST(1 AS BIGINT) << (length(bin(greatest(width, height))) - 1) AS VARCHAR) || CASE lower(regexp_extract(stem, '_([^_]*)$', 1)) WHEN 'basecolor' THEN ' BaseColor' WHEN 'normal' THEN ' Normal' WHEN 'orm' THEN ' ORM' WHEN 'height' THEN ' Height' ELSE '' END AS token FROM a WHERE asset_type = 'texture' AND greatest(width, height) >= 256)"""
_FOLDERS = """tp AS (SELECT DISTINCT path, unnest(list_filter(string_split(dir, '/')[3:], lambda s: lower(s) NOT IN ('assets', 'content', 'src', 'source', 'sources', 'resources', 'data', 'files', 'project', 'projects', 'import', 'imports'))) AS token FROM a)"""
over_assets("tag_tokens", f", {_TOKENS} SELECT token, count(DISTINCT path) AS n FROM tk GROUP BY ALL HAVING count(DISTINCT path) >= 3", lambda a: tagging.token_counts(tagging.name_tokens(a), 3))
over_assets("tag_dims", f", {_DIMS} SELECT token, count(DISTINCT path) AS n FROM td GROUP BY ALL HAVING count(DISTINCT path) >= 5", lambda a: tagging.token_counts(tagging.side_classes(a), 5))
over_assets("tag_paths", f", {_FOLDERS} SELECT token, count(DISTINCT path) AS n FROM tp GROUP BY ALL HAVING count(DISTINCT path) >= 3", lambda a: tagging.token_counts(tagging.folder_tokens(a, src.ROOT), 3))
over_assets(
    "tag_groups_raw",
    f""", {_TOKENS}, {_DIMS}, {_FOLDERS}, al AS (SELECT token, path, 0 AS pass FROM tk WHERE token IN (SELECT token FROM tk GROUP BY ALL HAVING count(DISTINCT path) >= 3)
      UNION ALL SELECT token, path, 1 FROM td WHERE token IN (SELECT token FROM td GROUP BY ALL HAVING count(DISTINCT path) >= 5) UNION ALL SELECT token, path, 2 FROM tp WHERE token IN (SELECT token FROM tp GROUP BY ALL HAVING count(DISTINCT path) >= 3)),
    n AS (SELECT upper(token[1]) || token[2:] AS name, path, pass FROM al)
    SELECT name, ['filename', 'dimension', 'folder'][min(pass) + 1] AS hint, count(DISTINCT path) AS n, min(path) AS first_path, round(count(DISTINCT path) / (SELECT count(*) FROM a), 5) AS confidence FROM n GROUP BY name""",
    lambda a: tagging.group_sizes(tagging.raw_groups(a, src.ROOT), a.count()).select("name", "hint", "n", "first_path", F.round(F.col("n") / F.lit(a.count()), 5).alias("confidence")),
)
query("tag_groups_merged")(lambda spark, sf_dir: tagging.merged_groups(assets(spark, sf_dir), src.ROOT))
_LEARNED = [(0, "token", "tree", ["Nature", "Wood"], 0.9), (1, "prefix", "PROMO/", ["Promo"], 0.8), (2, "segment", "brand3", ["Third"], 0.7), (3, "regex", r"_(Normal|ORM)\.", ["Maps", "Nature"], 0.95)]


@query("learned_rules", f"""WITH {A}, m AS (
  SELECT path, unnest(['Nature', 'Wood']) AS tag, 0.9 AS confidence, 0 AS ord FROM a WHERE contains(lower(name), 'tree') UNION ALL SELECT path, 'Promo', 0.8, 1 FROM a WHERE starts_with(path[7:], 'PROMO/')
  UNION ALL SELECT path, 'Third', 0.7, 2 FROM a WHERE list_contains(string_split(lower(path[7:]), '/'), 'brand3') UNION ALL SELECT path, unnest(['Maps', 'Nature']), 0.95, 3 FROM a WHERE regexp_matches(path[7:], '_(Normal|ORM)\\.'))
  SELECT tag, count(DISTINCT path) AS n, CAST(max(confidence) AS DOUBLE) AS confidence, CAST(min_by(ord, (-confidence, lower(path), path, ord)) AS INTEGER) AS rule FROM m GROUP BY tag""")
def learned_rules(spark, sf_dir):
    learned = spark.createDataFrame(_LEARNED, "ord int, kind string, pattern string, tags array<string>, confidence double")
    return tagging.learned_groups(tagging.learned_matches(assets(spark, sf_dir), learned, src.ROOT))


over_assets(
    "sampler",
    """, n AS (SELECT dir, asset_type, path, row_number() OVER (PARTITION BY dir, asset_type ORDER BY md5(path), path) AS rn FROM a)
    SELECT dir, asset_type, path, rn FROM n QUALIFY row_number() OVER (PARTITION BY dir ORDER BY rn, asset_type) <= 6""",
    lambda a: tagging.stratified_sample(a, 6, F.md5("path")),
)


@query("sampler_seeded")
def sampler_seeded(spark, sf_dir):
    """Picks in the order of the seeded rank; its hash has no form in SQL."""
    return tagging.stratified_sample(assets(spark, sf_dir), 6, text.seeded_rank(F.col("path")))


@query("tag_lookup", "SELECT '/proj/docs/' || doc_id AS path, array_to_string(list_sort(list_distinct(list('q' || quality))), ',') AS tags FROM labels WHERE quality = 1 GROUP BY doc_id")
def tag_lookup(spark, sf_dir):
    bindings = table(spark, sf_dir, "labels").select(F.concat(F.lit("/proj/docs/"), F.col("doc_id")).alias("path"), F.col("quality").cast("long").alias("tag_id"))
    tags = spark.createDataFrame([(1, "q1")], "id long, name string")
    return tagging.tags_of(bindings, tags).select("path", F.array_join("tags", ",").alias("tags"))


# --- costs, cache, history ----------------------------------------------------------------


@query("llm_cost", """WITH q AS (SELECT c_custkey AS request_id, CASE c_nationkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model, c_custkey % 97 AS n, 85 AS image FROM customer),
  t AS (SELECT q.*, p.i AS ip, p.o AS op, CASE WHEN p.i IS NULL THEN 0 ELSE greatest((n + 19) // 20, 1) * 700 + n * (image + 60) END AS i, CASE WHEN p.i IS NULL THEN 0 ELSE n * 150 END AS o FROM q LEFT JOIN (VALUES ('small', 150000, 600000), ('large', 3000000, 15000000)) p(m, i, o) ON p.m = q.model)
  SELECT request_id, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST((coalesce(i * ip // 1000000, 0) + coalesce(o * op // 1000000, 0) + 9999) // 10000 AS BIGINT) AS cents FROM t""")
def llm_cost(spark, sf_dir):
    requests = table(spark, sf_dir, "customer").selectExpr("c_custkey AS request_id", "CASE c_nationkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model", "c_custkey % 97 AS n_assets", "85 AS image_tokens")
    prices = spark.createDataFrame([("small", 150_000, 600_000), ("large", 3_000_000, 15_000_000)], "model string, input_per_m long, output_per_m long")
    return history.request_cost(requests, prices, 700)


@query("cache_split", "WITH q AS (SELECT '/proj/o' || o_orderkey AS path, sha256('m' || chr(0) || CAST(o_custkey AS VARCHAR) || chr(0) || o_orderpriority) AS key, o_orderkey % 3 = 0 AS c FROM orders) SELECT path, key, key IN (SELECT key FROM q WHERE c) AS hit FROM q")
def cache_split(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/proj/o"), F.col("o_orderkey")).alias("path"), F.lit("m").alias("model"), "o_custkey", "o_orderpriority")
    parts = ["model", "o_custkey", "o_orderpriority"]
    none = spark.createDataFrame([], "key string")
    return history.cache_split(q, history.cache_split(q.where("o_orderkey % 3 = 0"), none, parts).select("key"), parts)


def _ops(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("op_ord"), (F.col("conv_id") % 5 == 4).alias("undone"))


_BATCHES = "SELECT conv_id AS batch_id, count(*) AS n_ops, bool_and(conv_id % 5 = 4) AS undone FROM conversations GROUP BY conv_id"
query("undo_head", f"SELECT * FROM ({_BATCHES}) WHERE NOT undone ORDER BY batch_id DESC LIMIT 1")(lambda spark, sf_dir: history.undo_head(_ops(spark, sf_dir)))
query("undo_keep", f"{_BATCHES} ORDER BY batch_id DESC LIMIT 50")(lambda spark, sf_dir: history.kept_batches(_ops(spark, sf_dir)))


# --- exports ------------------------------------------------------------------------------

over_assets("export_scan_json", "SELECT path, '{\"path\":\"' || path || '\",\"size\":' || size || ',\"asset_type\":\"' || asset_type || '\"}' AS json FROM a", lambda a: stats.scan_json(a.select("path", "size", "asset_type")))
over_assets(
    "export_scan_head",
    """, t AS (SELECT asset_type, count(*) AS n, sum(size) AS s FROM a GROUP BY ALL)
    SELECT '{"root_path":"/proj","total_count":' || sum(n) || ',"total_size":' || CAST(sum(s) AS BIGINT) || ',"type_counts":{' || string_agg('"' || asset_type || '":' || n, ',' ORDER BY asset_type) || '}}' AS json FROM t""",
    lambda a: stats.scan_summary_json(a, src.ROOT),
)
over_assets(
    "export_issues_json",
    f", {I} SELECT asset_path, rule_id, '{{\"rule_id\":\"' || rule_id || '\",\"severity\":\"' || severity || '\",\"auto_fixable\":' || auto_fixable || ',\"asset_path\":\"' || asset_path || '\"}}' AS json FROM i",
    lambda a: stats.issues_json(_strict(a).select("rule_id", "severity", "auto_fixable", "asset_path")),
)
_TEXTS = [("texture.pot.title", "Zweierpotenz"), ("texture.pot.message", "{{ width }} mal {{height}} {{nichts}}"), ("dcc_source.outdated_export.message", "{{age_n}} {{age_unit}} alt"), ("duration.s", "Sekunden"), ("duration.m", "Minuten"), ("duration.h", "Stunden"), ("duration.d", "Tage")]
over_assets(
    "issues_localised",
    f""", {I} SELECT asset_path, 'Zweierpotenz' AS title, replace(arg, 'x', ' mal ') || ' {{{{nichts}}}}' AS message FROM i WHERE rule_id = 'texture.pot'
    UNION ALL SELECT asset_path, rule_id, 'plain' FROM i WHERE rule_id <> 'texture.pot'""",
    lambda a: stats.localised(_strict(a).withColumn("message", F.lit("plain")), a.sparkSession.createDataFrame(_TEXTS, "key string, value string")).select("asset_path", "title", "message"),
)
over_assets(
    "ages_localised",
    f"""{_DCC}, o AS (SELECT source, st - et AS age FROM p WHERE r = 1 AND st - et > {STRICT.dcc_source.mtime_tolerance_secs})
    SELECT source AS asset_path, CASE WHEN age < 60 THEN age || ' Sekunden' WHEN age < 3600 THEN age // 60 || ' Minuten' WHEN age < 86400 THEN age // 3600 || ' Stunden' ELSE age // 86400 || ' Tage' END || ' alt' AS message FROM o""",
    lambda a: stats.localised(analysis.analyse(a, config.RuleConfig(naming=config.Naming(enabled=False), texture=config.Texture(color_space=False), dcc_source=STRICT.dcc_source)).withColumn("message", F.lit("plain")), a.sparkSession.createDataFrame(_TEXTS, "key string, value string")).where("rule_id = 'dcc_source.outdated_export'").select("asset_path", "message"),
)
_ROW = lambda *cells: "'<tr>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"
_HUMAN = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f', {0} / 1024) || ' KB' WHEN {0} < 1073741824 THEN printf('%.1f', {0} / 1048576) || ' MB' ELSE printf('%.2f', {0} / 1073741824) || ' GB' END"
over_assets(
    "html_report",
    f""", {I}, k AS (SELECT upper(asset_type[1]) || asset_type[2:] AS type_name, count(*) AS n, CAST(sum(size) AS BIGINT) AS s FROM a GROUP BY ALL)
    SELECT part, html, row_number() OVER (PARTITION BY part ORDER BY o1, o2) AS place FROM (SELECT 0 AS part, '' AS o1, '' AS o2, '<!doctype html><meta charset=utf-8><h1>Assets</h1><p>Incomplete scan: 2 entries unread</p><p>' || ((SELECT count(*) FROM a) - (SELECT count(DISTINCT asset_path) FROM i)) || ' of ' || (SELECT count(*) FROM a) || ' files without issues</p>' AS html
    UNION ALL SELECT 1, '', '', '<h2>Types</h2><table><tr><th>type</th><th>files</th></tr>' UNION ALL SELECT 2, printf('%020d', 1000000000000000000 - n), type_name, {_ROW('type_name', 'n')} FROM k
    UNION ALL SELECT 3, '', '', '<h2>Size by type</h2><table><tr><th>type</th><th>size</th></tr>' UNION ALL SELECT 4, printf('%020d', 1000000000000000000 - s), type_name, {_ROW('type_name', _HUMAN.format('s'))} FROM k
    UNION ALL SELECT 5, '', '', '<h2>Issues</h2><table><tr><th>rule</th><th>severity</th><th>path</th></tr>' UNION ALL SELECT 6, rule_id, lower(asset_path), {_ROW('rule_id', 'severity', 'asset_path')} FROM (SELECT * FROM i ORDER BY rule_id, lower(asset_path), asset_path LIMIT 100)
    UNION ALL SELECT 7, '', '', '<h2>Files</h2><table><tr><th>path</th><th>type</th><th>size</th></tr>' UNION ALL SELECT 8, lower(path), path, {_ROW('path', 'asset_type', _HUMAN.format('size'))} FROM (SELECT * FROM a ORDER BY lower(path), path LIMIT 500))""",
    lambda a: stats.html_report(a, _strict(a), unread=2).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("ord")).cast("long")).drop("ord"),
)


@query("warning_samples", """WITH w AS (SELECT event_type AS kind, '/proj/e' || event_id AS path, CAST(user_id AS VARCHAR) AS detail FROM events)
  SELECT kind, count(*) AS n, array_to_string(list(path ORDER BY path)[1:5], ',') AS sample, min_by(detail, path) AS detail FROM w GROUP BY kind""")
def warning_samples(spark, sf_dir):
    w = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("/proj/e"), F.col("event_id")).alias("path"), F.col("user_id").cast("string").alias("detail"))
    return stats.warnings_by_kind(w).withColumn("sample", F.array_join("sample", ","))


query("unused_first", f"WITH {R}, {K} SELECT path, guid FROM known WHERE asset_type <> 'scene' AND guid NOT IN (SELECT guid FROM r) ORDER BY lower(path), path LIMIT 200")(_graph(lambda r, k, p: analysis.first_and_rest(cross.unused_assets(k, r), F.lower("path"), "path")[0]))
query("unused_more", f"WITH {R}, {K} SELECT greatest(count(*) - 5, 0) AS n_more FROM known WHERE asset_type <> 'scene' AND guid NOT IN (SELECT guid FROM r)")(_graph(lambda r, k, p: analysis.first_and_rest(cross.unused_assets(k, r), F.lower("path"), "path", k=5)[1]))

# --- more of tags and requests ------------------------------------------------------------

over_assets(
    "tag_samples",
    f""", {_FOLDERS}, k AS (SELECT token, path FROM tp WHERE token IN (SELECT token FROM tp GROUP BY ALL HAVING count(DISTINCT path) >= 3))
    SELECT upper(token[1]) || token[2:] AS name, array_to_string(list(DISTINCT path ORDER BY path)[1:3], '|') AS samples FROM k GROUP BY ALL""",
    lambda a: tagging.samples(_folder_groups(a)).select("name", F.array_join("samples", "|").alias("samples")),
)


def _folder_groups(a: DataFrame) -> DataFrame:
    tokens = tagging.folder_tokens(a, src.ROOT)
    return tokens.distinct().join(tagging.token_counts(tokens, 3).select("token"), "token", "left_semi").select(text.capitalised(F.col("token")).alias("name"), "path").distinct()


over_assets(
    "tag_unsuggested",
    f", {_FOLDERS}, k AS (SELECT upper(token[1]) || token[2:] AS name FROM tp GROUP BY token HAVING count(DISTINCT path) >= 3) SELECT DISTINCT name FROM k WHERE name NOT IN ('Brand3', 'LARGE', 'SRC')",
    lambda a: tagging.unsuggested(_folder_groups(a).select("name").distinct(), a.sparkSession.createDataFrame([("Brand3 (suggested)",), ("LARGE (suggested)",), ("SRC (suggested)",), ("Brand4",)], "name string")),
)


@query("learned_samples", f"""WITH {A}, m AS (SELECT 'Third' AS tag, path, stem FROM a WHERE list_contains(string_split(lower(path[7:]), '/'), 'brand3') UNION SELECT 'Promo', path, stem FROM a WHERE starts_with(path[7:], 'PROMO/')
  UNION SELECT unnest(['Maps', 'Nature']), path, stem FROM a WHERE regexp_matches(path[7:], '_(Normal|ORM)\\.') UNION SELECT unnest(['Nature', 'Wood']), path, stem FROM a WHERE contains(lower(name), 'tree'))
  SELECT tag, array_to_string(list(stem ORDER BY lower(path), path)[1:3], '|') AS samples FROM m GROUP BY tag""")
def learned_samples(spark, sf_dir):
    learned = spark.createDataFrame(_LEARNED, "ord int, kind string, pattern string, tags array<string>, confidence double")
    return tagging.learned_samples(tagging.learned_matches(assets(spark, sf_dir), learned, src.ROOT)).select("tag", F.array_join("samples", "|").alias("samples"))


@query("tag_update", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS name, CASE WHEN n_nationkey % 3 <> 0 THEN 'old' WHEN n_nationkey % 2 = 0 THEN 'text' END AS description FROM nation UNION ALL SELECT 100, 'made', NULL")
def tag_update(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    new = nation.where("id % 3 = 0").select("id", F.concat(F.lit("new "), "name").alias("name"), F.when(F.col("id") % 2 == 0, "text").otherwise("  ").alias("description"))
    made = spark.createDataFrame([(100, "made", "")], "id long, name string, description string")
    return tagging.put_tags(nation.withColumn("description", F.lit("old")), new.unionByName(made))


@query("tag_assets", "SELECT DISTINCT 'q' || quality AS tag, '/proj/docs/' || doc_id AS path FROM labels WHERE quality = 1")
def tag_assets(spark, sf_dir):
    bindings = table(spark, sf_dir, "labels").select(F.concat(F.lit("/proj/docs/"), F.col("doc_id")).alias("path"), F.col("quality").cast("long").alias("tag_id"))
    return tagging.assets_of(bindings, spark.createDataFrame([(1, "q1")], "id long, name string"))


over_assets("request_chunks", "SELECT path, (row_number() OVER (ORDER BY path) - 1) // 20 AS chunk FROM a", lambda a: history.chunks(a.select("path"), "path"))
over_assets(
    "request_replies",
    "SELECT path, CASE WHEN size % 4 <> 0 THEN 'tag ' || (size % 7) END AS reply FROM a",
    lambda a: history.paired(a.select("path"), a.where("size % 4 <> 0").select("path", F.concat(F.lit("tag "), (F.col("size") % 7).cast("string")).alias("reply")).orderBy(F.desc("size"))),
)
over_assets(
    "request_prompts",
    """, c AS (SELECT path, name, (row_number() OVER (ORDER BY path) - 1) // 20 AS chunk FROM a), u AS (SELECT array_to_string(list(DISTINCT path ORDER BY path)[1:5], ', ') AS p FROM a WHERE asset_type = 'audio')
    SELECT chunk, 'Context' || chr(10) || chr(10) || '- Known: as written' || chr(10) || '- Sound' || coalesce(' (e.g. ' || nullif((SELECT p FROM u), '') || ')', '') || chr(10) || chr(10) || string_agg(name, chr(10) ORDER BY path) AS prompt FROM c GROUP BY chunk""",
    lambda a: history.prompts(
        history.chunks(a.select("path", F.col("name").alias("line")), "path"), a.sparkSession.createDataFrame([("Sound", " "), ("Known", "as written")], "name string, description string"),
        a.where("asset_type = 'audio'").select(F.lit("Sound").alias("name"), "path"), "Context",
    ),
)
over_assets(
    "copy_names",
    """, x AS (SELECT path, dir, stem, extension, size % 5 AS n FROM a),
    there AS (SELECT path FROM a UNION ALL SELECT dir || '/' || stem || ' copy' || CASE WHEN i = 1 THEN '' ELSE ' ' || i END || '.' || extension FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM x) WHERE i <> 3),
    asked AS (SELECT *, unnest(generate_series(1, 7)) AS i FROM x), named AS (SELECT path, i, dir || '/' || stem || ' copy' || CASE WHEN i = 1 THEN '' ELSE ' ' || i END || '.' || extension AS made FROM asked)
    SELECT path, min_by(made, i) AS copy FROM named WHERE made NOT IN (SELECT path FROM there) GROUP BY path""",
    lambda a: history.free_copy_name(a.select("path"), _copies(a)),
)


def _copies(a: DataFrame) -> DataFrame:
    """Every file with up to four copies beside it; the third is always free."""
    stem, dot = text.stem(F.col("name")), text.dotted_extension(F.col("name"))
    i = F.explode(F.filter(F.sequence(F.lit(1), F.greatest((F.col("size") % 5).cast("int"), F.lit(1))), lambda k: (k != 3) & (k <= F.col("size") % 5)))
    made = a.select("dir", stem.alias("stem"), dot.alias("dot"), i.alias("i"))
    return a.select("path").unionByName(made.select(F.concat("dir", F.lit("/"), "stem", F.lit(" copy"), F.when(F.col("i") > 1, F.concat(F.lit(" "), F.col("i").cast("string"))).otherwise(""), "dot").alias("path")))


over_assets(
    "rename_checked",
    ", n AS (SELECT path, dir, lower(name[1:3]) || '.x' AS new_name, size % 3 <> 0 AS included FROM a) SELECT path, included AND count(*) FILTER (included) OVER (PARTITION BY lower(dir), lower(new_name)) > 1 AS collides FROM n",
    lambda a: rules.checked_again(a.select("path", F.concat(F.lower(F.substring("name", 1, 3)), F.lit(".x")).alias("new_name"), (F.col("size") % 3 != 0).alias("included"))).select("path", "collides"),
)

# --- texts of the engines, over contents made of the tables ---------------------------------

_FLAGS = {"conflicted": 11, "new": 7, "untracked": 5, "modified": 3, "deleted": 4, "renamed": 2, "typechange": 13, "ignored": 1}


@query("status_flags", "SELECT o_orderkey, CASE " + " ".join(f"WHEN o_orderkey % {n} = 0 THEN '{k}'" for k, n in _FLAGS.items()) + " END AS status FROM orders")
def status_flags(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", browse.status_of({k: F.col("o_orderkey") % n == 0 for k, n in reversed(_FLAGS.items())}).alias("status"))


_XY = ["M ", " M", "MM", "A ", "AM", "??", "!!", " D", "D ", "R ", "UU", "AA", " T"]


@query("git_statuses", f"""SELECT '/proj/o' || o_orderkey || '.png' AS path, ['modified', 'modified', 'modified', 'new', 'new', 'untracked', 'ignored', 'deleted', 'deleted', 'renamed', 'conflicted', 'conflicted', 'typechange'][o_orderkey % {len(_XY)} + 1] AS status FROM orders WHERE o_orderkey % 7 <> 0""")
def git_statuses(spark, sf_dir):
    """A line of a status listing an order, quoted for some; every seventh is of no known form."""
    k = F.col("o_orderkey")
    xy = F.element_at(F.array(*map(F.lit, _XY)), (k % len(_XY) + 1).cast("int"))
    name = F.concat(F.when(k % 5 == 0, F.concat(F.lit('"'), F.lit("o"), k, F.lit('.png"'))).otherwise(F.concat(F.lit("o"), k, F.lit(".png"))))
    line = F.when(k % 7 == 0, F.concat(F.lit("#"), name)).otherwise(F.concat(xy, F.lit(" "), F.when(xy == "R ", F.concat(F.lit("was"), k, F.lit(".png -> "))).otherwise(""), name))
    return gitstatus.statuses(table(spark, sf_dir, "orders").select(line.alias("value")), src.ROOT)


_YAML = "concat('%YAML guid: ffffffffffffffffffffffffffffffff', chr(10), '--- !u!1 &', p_partkey, chr(10), '  m: {fileID: ', p_partkey * 3, ', guid: ', upper(md5(CAST(p_size AS STRING))), ', type: ', p_partkey % 4, '}', chr(10), '--- !u!', CASE p_partkey % 3 WHEN 0 THEN '4' WHEN 1 THEN '114' ELSE '99999' END, ' &2', chr(10), '# guid: ', md5('x'), chr(10), 'guid: short', chr(10), 'n: {guid: ', md5('y'), '}')"


def _yaml(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("concat('/proj/p', p_partkey, '.prefab') AS path", f"{_YAML} AS content")


@query("unity_references", "SELECT '/proj/p' || p_partkey || '.prefab' AS path, md5(CAST(p_size AS VARCHAR)) AS guid, CAST(p_partkey * 3 AS BIGINT) AS file_id, CAST(p_partkey % 4 AS INTEGER) AS ref_type FROM part UNION ALL SELECT '/proj/p' || p_partkey || '.prefab', md5('y'), NULL, NULL FROM part")
def unity_references(spark, sf_dir):
    return graph.yaml_references(_yaml(spark, sf_dir))


@query("unity_components", "SELECT '/proj/p' || p_partkey || '.prefab' AS path, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'GameObject,MonoBehaviour,Transform' ELSE 'GameObject,Transform' END WHEN 1 THEN 'GameObject,MonoBehaviour' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'GameObject,MonoBehaviour' ELSE 'GameObject' END END AS components FROM part")
def unity_components(spark, sf_dir):
    more = F.when(F.col("path").rlike("[05].prefab$"), F.concat("content", F.lit("\n  m_Script: {fileID: 1, guid: 0}"))).otherwise(F.col("content"))
    return engines.unity_components(_yaml(spark, sf_dir).withColumn("content", more)).withColumn("components", F.array_join("components", ","))


@query("unity_packages", "SELECT md5(CAST(s_suppkey AS VARCHAR)) AS guid, 'com.n' || s_nationkey AS package, 'f' || s_suppkey || '.cs' AS file_name FROM supplier WHERE s_suppkey % 3 <> 0")
def unity_packages(spark, sf_dir):
    meta = table(spark, sf_dir, "supplier").selectExpr(
        "concat(CASE WHEN s_suppkey % 3 = 0 THEN '/proj/Assets' ELSE '/proj/Library/PackageCache' END, '/com.n', s_nationkey, '@1.0.', s_suppkey % 7, '/sub/f', s_suppkey, '.cs.meta') AS path",
        "encode(concat('fileFormatVersion: 2', chr(10), 'guid: ', md5(CAST(s_suppkey AS STRING)), chr(10)), 'UTF-8') AS content",
    )
    return engines.package_index(meta, "/proj/Library/PackageCache")


@query("unity_versions", "SELECT '/proj/' || n_nationkey AS path, '6000.' || n_nationkey AS version, CASE WHEN n_nationkey % 2 = 0 THEN '6000.' || n_nationkey || ' (abc)' END AS with_revision FROM nation WHERE n_nationkey % 5 <> 0")
def unity_versions(spark, sf_dir):
    body = "concat(CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('m_EditorVersion: 6000.', n_nationkey, chr(10)) END, CASE WHEN n_nationkey % 2 = 0 THEN concat('m_EditorVersionWithRevision: 6000.', n_nationkey, ' (abc)') ELSE '' END)"
    return engines.unity_version(table(spark, sf_dir, "nation").selectExpr("concat('/proj/', n_nationkey) AS path", f"{body} AS content"))


def _ini(spark, sf_dir):
    body = """concat('; made', chr(10), 'config_version=', CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 4 END, chr(10), '[application]', chr(13), chr(10), 'config/name="Game ', c_custkey, '"', chr(10), '# no=1', chr(10), 'run/main_scene = "res://m', c_custkey, '.tscn"', chr(10),
      '[autoload]', chr(10), 'A="*res://a', c_nationkey, '.gd"', chr(10), 'B="res://b.gd"', chr(10), '[input]', chr(10), 'jump={}')"""
    return fsscan.ini(table(spark, sf_dir, "customer").selectExpr("concat('/proj/', c_custkey, '/project.godot') AS path", f"encode({body}, 'UTF-8') AS content"))


@query("ini_lines", """WITH c AS (SELECT '/proj/' || c_custkey || '/project.godot' AS path, c_custkey AS k, c_nationkey AS n FROM customer)
  SELECT path, '' AS section, 'config_version' AS key, CASE WHEN k % 2 = 0 THEN '5' ELSE '4' END AS value FROM c UNION ALL SELECT path, 'application', 'config/name', '"Game ' || k || '"' FROM c UNION ALL SELECT path, 'application', 'run/main_scene', '"res://m' || k || '.tscn"' FROM c
  UNION ALL SELECT path, 'autoload', 'A', '"*res://a' || n || '.gd"' FROM c UNION ALL SELECT path, 'autoload', 'B', '"res://b.gd"' FROM c UNION ALL SELECT path, 'input', 'jump', '{}' FROM c""")
def ini_lines(spark, sf_dir):
    return _ini(spark, sf_dir)


@query("godot_projects", """SELECT '/proj/' || c_custkey || '/project.godot' AS path, 'Game ' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN '4.x' ELSE '3.x' END AS version, 'res://m' || c_custkey || '.tscn' AS main_scene, 'A>res://a' || c_nationkey || '.gd>true|B>res://b.gd>false' AS autoloads, 'jump' AS actions FROM customer""")
def godot_projects(spark, sf_dir):
    shown = F.array_join(F.transform("autoloads", lambda x: F.concat_ws(">", x["name"], x["path"], x["singleton"].cast("string"))), "|")
    return engines.godot_project(_ini(spark, sf_dir)).select("path", "name", "version", "main_scene", shown.alias("autoloads"), F.array_join("input_actions", ",").alias("actions"))


@query("godot_resources", "SELECT '/proj/s' || s_suppkey || '.tscn' AS path, 'res://n' || s_nationkey || '.png' AS target FROM supplier UNION ALL SELECT '/proj/s' || s_suppkey || '.tscn', 'res://' || s_suppkey || ' x.gd' FROM supplier")
def godot_resources(spark, sf_dir):
    return graph.resource_references(table(spark, sf_dir, "supplier").selectExpr("concat('/proj/s', s_suppkey, '.tscn') AS path", "concat('a=\"res://n', s_nationkey, '.png\" b=\"res://', s_suppkey, ' x.gd\" c=\"res://n', s_nationkey, '.png\" res://bare') AS content"))


@query("uproject_parts", """SELECT '/proj/' || n_nationkey || '.uproject' AS path, 'plugin' AS kind, 'P' || n_nationkey AS name, n_nationkey % 2 = 0 AS enabled FROM nation WHERE n_nationkey % 7 <> 0 UNION ALL SELECT '/proj/' || n_nationkey || '.uproject', 'module', 'M', NULL FROM nation WHERE n_nationkey % 7 <> 0""")
def uproject_parts(spark, sf_dir):
    body = """concat(CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE '{' END, '"Plugins": [{"Name": "P', n_nationkey, '", "Enabled": ', n_nationkey % 2 = 0, '}, {"Enabled": 3}, "bad"], "Modules": [{"Name": "M"}]}')"""
    return fsscan.uproject(table(spark, sf_dir, "nation").selectExpr("concat('/proj/', n_nationkey, '.uproject') AS path", f"encode({body}, 'UTF-8') AS content"))


@query("project_types", "SELECT CASE WHEN bool_or(n_nationkey = 3) THEN 'unreal' ELSE 'generic' END AS project_type FROM nation")
def project_types(spark, sf_dir):
    return fsscan.project_type(table(spark, sf_dir, "nation").selectExpr("CASE WHEN n_nationkey = 3 THEN '/proj/g.uproject' WHEN n_nationkey = 4 THEN '/proj/a/project.godot' ELSE concat('/proj/f', n_nationkey) END AS path"), src.ROOT)


@query("unread_entries", "SELECT CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN user_id ELSE 0 END) AS BIGINT) AS unread, bool_or(event_type = 'error') AS ignore_failed FROM events")
def unread_entries(spark, sf_dir):
    kind = "CASE event_type WHEN 'view' THEN 'tree_walk_failed' WHEN 'click' THEN 'asset_unreadable' WHEN 'error' THEN 'ignore_rules_unusable' ELSE 'other' END AS kind"
    return engines.unread_entries(table(spark, sf_dir, "events").selectExpr(kind, "user_id AS count"))


@query("tag_changes", "WITH b AS (SELECT DISTINCT doc_id AS path, quality AS tag_id FROM labels UNION SELECT DISTINCT doc_id, 2 FROM labels WHERE toxic = 1) SELECT 'd' || path AS path, CAST(tag_id AS BIGINT) AS tag_id FROM b WHERE NOT (tag_id = 1 AND path % 2 = 0) AND tag_id <> 0")
def tag_changes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("path", F.concat(F.lit("d"), F.col("doc_id")))
    old = labels.select("path", F.col("quality").cast("long").alias("tag_id"))
    tags = spark.createDataFrame([(0, "bad"), (1, "good"), (2, "toxic")], "id long, name string")
    added = tagging.bind(old, labels.where("toxic = 1").selectExpr("path", "explode(array(2L, 9L)) AS tag_id"), tags)
    fewer = tagging.unbind(added, labels.where("doc_id % 2 = 0").select("path", F.lit(1).cast("long").alias("tag_id")))
    return tagging.drop_tags(tags, fewer, spark.createDataFrame([(0,)], "id long"))[1]


over_assets(
    "tag_moves",
    "SELECT DISTINCT CASE WHEN starts_with(path, '/proj/PROMO/') THEN '/proj/Large/' || path[13:] ELSE path END AS path, size % 3 AS tag_id FROM a",
    lambda a: tagging.move_bindings(a.select("path", (F.col("size") % 3).alias("tag_id")), "/proj/PROMO", "/proj/Large"),
)
over_assets(
    "tag_new_labels",
    "SELECT DISTINCT split_part(stem, '_', 1) AS label FROM a WHERE lower(split_part(stem, '_', 1)) NOT IN ('rock1', 'crate2', 'wall-tile')",
    lambda a: tagging.new_labels(a.select(F.substring_index(text.stem(F.col("name")), "_", 1).alias("label")), a.sparkSession.createDataFrame([("ROCK1",), ("crate2",), ("Wall-Tile",)], "name string")),
)
over_assets(
    "plan_apply",
    """, s AS (SELECT path, asset_type AS label, ['kind', 'use'][CAST(size % 2 AS INT) + 1] AS category, CASE WHEN size % 3 = 0 THEN 'old' END AS source FROM a)
    SELECT coalesce(source, 'new') AS source, category, label, array_to_string(list(DISTINCT path ORDER BY path), '|') AS paths FROM s WHERE starts_with(path, '/proj/Large/') AND category = 'use' GROUP BY ALL""",
    lambda a: engines.apply_plan(_suggested(a), a.where("path LIKE '/proj/Large/%'"), _suggested(a).where("category = 'use'").select("path", "label", "category")).withColumn("paths", F.array_join("paths", "|")),
)


def _suggested(a: DataFrame) -> DataFrame:
    return a.select("path", F.col("asset_type").alias("label"), F.when(F.col("size") % 2 == 0, "kind").otherwise("use").alias("category"), F.when(F.col("size") % 3 == 0, "old").alias("source"))


query("rename_guard", f"WITH {R}, {K}, c AS (SELECT known.path, count(DISTINCT src_path) AS n FROM known JOIN r USING (guid) WHERE length(path) % 2 = 0 GROUP BY known.path) SELECT count(*) AS n_renamed, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_files FROM c")(
    _graph(lambda r, k, p: engines.guarded_renames(k.select("path", (F.length("path") % 2 == 0).alias("will_change")), k.select("path", "guid").join(r.select("guid", "src_path"), "guid").select("path", "src_path")))
)


@query("learning_cost", """WITH q AS (SELECT c_custkey AS request_id, CASE c_nationkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model, c_custkey * 11 AS b, c_custkey % 9 AS s, c_custkey % 5 AS t FROM customer),
  u AS (SELECT request_id, model, CASE WHEN model = 'unknown' THEN 0 ELSE b // 4 END AS i, CASE WHEN model = 'unknown' THEN 0 ELSE 600 + 30 * t + 40 * s END AS o, CASE model WHEN 'small' THEN 150000 ELSE 3000000 END AS ip, CASE model WHEN 'small' THEN 600000 ELSE 15000000 END AS op FROM q)
  SELECT request_id, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST((i * ip // 1000000 + o * op // 1000000 + 9999) // 10000 AS BIGINT) AS cents FROM u""")
def learning_cost(spark, sf_dir):
    requests = table(spark, sf_dir, "customer").selectExpr("c_custkey AS request_id", "CASE c_nationkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model", "c_custkey * 11 AS prompt_bytes", "c_custkey % 9 AS n_samples", "c_custkey % 5 AS n_tags")
    return engines.learning_cost(requests, spark.createDataFrame([("small", 150_000, 600_000), ("large", 3_000_000, 15_000_000)], "model string, input_per_m long, output_per_m long"))


@query("lenient_replies", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN conv_id WHEN 1 THEN conv_id + 1 END AS n FROM conversations")
def lenient_replies(spark, sf_dir):
    raw = "CASE turn % 3 WHEN 0 THEN concat('{\"n\": ', conv_id, '}') WHEN 1 THEN concat('So:', chr(10), '```json', chr(10), '{\"n\": ', conv_id + 1, '}', chr(10), '```') ELSE text END AS raw"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", raw).select("conv_id", "turn", history.lenient_json("raw", "n long")["n"].alias("n"))


@query("ages", "SELECT event_id, CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN event_id // 60 || 'm' WHEN event_id < 86400 THEN event_id // 3600 || 'h' ELSE event_id // 86400 || 'd' END AS age FROM events")
def ages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.age(F.col("event_id")).alias("age"))


over_assets(
    "rule_naming_chinese",
    "SELECT path FROM a WHERE size % 4 = 1",
    lambda a: rules.asset_issues(a.withColumn("name", F.when(F.col("size") % 4 == 1, F.concat(F.lit("木_"), "name")).otherwise(F.col("name"))), config.RuleConfig(naming=config.Naming(forbidden_chars=(), forbid_chinese=True), texture=config.Texture(color_space=False))).where("rule_id = 'naming.chinese'").select(F.col("asset_path").alias("path")),
)
over_assets(
    "colours",
    f"""SELECT path, {tagging.PALETTE}[list_reduce(list_transform(string_split(regexp_replace(hex(encode(name)), '(..)', '\\1 ', 'g')[:-2], ' '), lambda x: CAST(('0x' || x) AS BIGINT)), lambda h, b: CAST((xor(h, b) * 16777619) & 4294967295 AS BIGINT), CAST(2166136261 AS BIGINT)) % {len(tagging.PALETTE)} + 1] AS color FROM a""",
    lambda a: a.select("path", text.stable_colour(F.col("name"), tagging.PALETTE).alias("color")),
)

# --- a scanned tree -----------------------------------------------------------------------


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that files are made of: one small file, so they are dealt out before the work."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """`supplier` as files in the shared folder: pictures, sounds and models by key, sidecars, and ignore files."""
    import os
    import struct

    root = storage.scratch(spark, "tree").removeprefix("file:")
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0) + b"\0\0\0\0"

    def write(batches):
        for batch in batches:
            for k, n in zip(batch["s_suppkey"], batch["s_nationkey"], strict=True):
                folder = f"{root}/_n{n}/" + ("out" if k % 10 == 7 else "in")
                os.makedirs(folder, exist_ok=True)
                name, body = {
                    0: (f"s{k}.png", png(k, k + 1)), 1: (f"s{k}.gif", b"GIF89a" + struct.pack("<HH", k % 65536, 7)), 2: (f"s{k}.obj", b"f 1 2 3 4\n" * (k % 5 + 1)),
                    3: (f"s{k}.wav", b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + struct.pack("<HHIIHH", 1, 1, 1, 1, 1, 8) + b"data" + struct.pack("<I", k)), 4: (f".hidden{k}.png", b"x"),
                }[k % 5]
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(body)
                with open(f"{folder}/{name}.meta", "w") as f:
                    f.write(f"version: 2\nguid: g{k}\n")
            yield batch

    _dealt(spark, sf_dir).mapInPandas(write, "s_suppkey long, s_nationkey long").count()
    os.makedirs(f"{root}/_n0", exist_ok=True)
    for where, body in ((f"{root}/.gitignore", "# made\nout/\n*.wav\n"), (f"{root}/_n0/.gitignore", "!*.wav\n")):
        with open(where, "w") as f:
            f.write(body)
    return root


_TREE = """t AS (SELECT s_suppkey AS k, '_n' || s_nationkey || '/in/s' || s_suppkey || ['.png', '.gif', '.obj', '.wav'][s_suppkey % 5 + 1] AS path FROM supplier WHERE s_suppkey % 10 <> 7 AND s_suppkey % 5 <> 4 AND (s_suppkey % 5 <> 3 OR s_nationkey = 0))"""


@query("scan_tree", f"""WITH {_TREE} SELECT path, ['texture', 'texture', 'model', 'audio'][k % 5 + 1] AS asset_type, 'g' || k AS guid, CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k % 65536 END AS width, CAST(CASE k % 5 WHEN 0 THEN k + 1 WHEN 1 THEN 7 END AS BIGINT) AS height,
  CAST(CASE k % 5 WHEN 2 THEN 2 * (k % 5 + 1) END AS BIGINT) AS face_count, CASE k % 5 WHEN 3 THEN CAST(k AS DOUBLE) END AS duration_secs FROM t""")
def scan_tree(spark, sf_dir):
    root = _tree(spark, sf_dir)
    found = fsscan.scan(spark, root, respect_ignores=True)
    return found.select(F.substring("path", len(root) + 2, 1 << 30).alias("path"), "asset_type", F.col("unity_guid").alias("guid"), "metadata.width", "metadata.height", "metadata.face_count", "metadata.duration_secs")


@query("scan_copies", """WITH t AS (SELECT s_suppkey AS k, '_n' || s_nationkey || '/' || CASE WHEN s_suppkey % 10 = 7 THEN 'out' ELSE 'in' END || '/s' || s_suppkey || '.obj' AS path, 10 * (s_suppkey % 5 + 1) AS size FROM supplier WHERE s_suppkey % 5 = 2) SELECT path, CAST(size AS BIGINT) AS size FROM t WHERE (SELECT count(*) FROM t) > 1""")
def scan_copies(spark, sf_dir):
    root = _tree(spark, sf_dir)
    found = fsscan.duplicates(fsscan.listing(spark, root))
    return found.select(F.substring("path", len(root) + 2, 1 << 30).alias("path"), "size")


_HEADERS = """SELECT p_partkey AS k, CAST(CASE WHEN n <> 7 THEN s END AS BIGINT) AS width, CAST(CASE n WHEN 0 THEN s + 1 WHEN 1 THEN s + 2 WHEN 2 THEN s + 3 WHEN 3 THEN s + 4 WHEN 4 THEN s + 4 WHEN 5 THEN s + 5 WHEN 6 THEN s + 6 WHEN 8 THEN s + 8 END AS BIGINT) AS height,
    CASE WHEN n IN (0, 1) THEN true WHEN n = 2 THEN p_partkey % 3 > 0 WHEN n IN (3, 4, 8) THEN false END AS has_alpha, CAST(CASE WHEN n = 2 THEN greatest(s % 4, 1) END AS BIGINT) AS mipmap_count, CASE WHEN n IN (3, 4) THEN CASE WHEN p_partkey % 2 = 1 OR n = 4 THEN 'sRGB' ELSE 'Linear' END END AS color_space,
    CASE n WHEN 5 THEN s / 2 WHEN 6 THEN s / 2 END AS duration_secs, CASE n WHEN 5 THEN 'V_VP9' WHEN 6 THEN 'avc1' END AS video_codec, CAST(CASE WHEN n = 7 THEN s + 2 END AS BIGINT) AS vertex_count, CAST(CASE WHEN n = 7 THEN s END AS BIGINT) AS face_count
    FROM (SELECT *, p_partkey % 9 AS n, p_size AS s FROM part)"""


@query("media_headers", _HEADERS)
def media_headers(spark, sf_dir):
    """A small file a part, of eight kinds, and what the header readers say of it."""

    def write(batches):
        for batch in batches:
            made = [samples.media(int(k), int(s)) for k, s in zip(batch["p_partkey"], batch["p_size"], strict=True)]
            yield batch.assign(path=[f"/m/{k}.{e}" for k, (e, _) in zip(batch["p_partkey"], made, strict=True)], content=[b for _, b in made])[["path", "content"]]

    found = fsscan.headers(table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(write, "path string, content binary"))
    return found.select(F.regexp_extract("path", "([0-9]+)[.]", 1).cast("long").alias("k"), *(f"metadata.{c}" for c in ("width", "height", "has_alpha", "mipmap_count", "color_space", "duration_secs", "video_codec", "vertex_count", "face_count")))


over_assets(
    "ignore_matcher",
    """SELECT path FROM a WHERE path NOT LIKE '%/Brand1/%' AND (extension <> 'tga' OR name LIKE '%1.tga') AND NOT starts_with(path, '/proj/SMALL/')""",
    lambda a: ignores.kept(a.select("path"), ignores.matcher(a.sparkSession, src.ROOT, {".gitignore": "Brand1/\n*.tga\n!*1.tga\n"}, "/SMALL\n"), src.ROOT),
)
over_assets(
    "sampler_clamped",
    """, n AS (SELECT dir, asset_type, path, row_number() OVER (PARTITION BY dir, asset_type ORDER BY md5(path), path) AS rn FROM a)
    SELECT dir, asset_type, path, rn FROM n QUALIFY row_number() OVER (PARTITION BY dir ORDER BY rn, asset_type) <= 3""",
    lambda a: tagging.stratified_sample(a, 1, F.md5("path")),
)


@query("gltf_counts", "SELECT p_partkey, CAST(6 * p_size + 7 AS BIGINT) AS vertex_count, CAST(2 * p_size + greatest(3 * p_size - 2, 0) AS BIGINT) AS face_count, CAST(p_partkey % 3 AS BIGINT) AS material_count FROM part WHERE p_partkey % 11 <> 0")
def gltf_counts(spark, sf_dir):
    """A model a part: text for even keys, the binary form for odd ones; every eleventh is cut short."""
    doc = F.format_string(
        '{"accessors": [{"count": %d}, {"count": %d}, {"count": 7}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 5}]}, {"primitives": [{"attributes": {"POSITION": 2}, "mode": 1}]}], "materials": [%s], "asset": {"note": "\u00e9"}}',
        3 * F.col("p_size"), 6 * F.col("p_size"), F.array_join(F.array_repeat(F.lit('{"name": "m"}'), (F.col("p_partkey") % 3).cast("int")), ", "),
    )
    body = F.col("body")
    size = F.lpad(F.hex(F.octet_length(body)), 8, "0")
    length = F.unhex(F.concat(*(F.substring(size, i, 2) for i in (7, 5, 3, 1))))
    binary = F.concat(F.lit(b"glTF\2\0\0\0\0\0\0\0"), length, F.lit(b"JSON"), body, F.lit(b"\0\1\2\3"))
    content = F.when(F.col("p_partkey") % 11 == 0, body.substr(F.lit(1), F.lit(40))).when(F.col("p_partkey") % 2 == 0, body).otherwise(binary)
    # the keys of a million models are one small file, so they are dealt out before the work
    keys = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    files = keys.select("p_partkey", F.encode(doc, "UTF-8").alias("body")).select("p_partkey", content.alias("content"))
    models = files.select("p_partkey", fsscan.gltf_metadata(F.col("content")).alias("m"))
    return models.where("m IS NOT NULL").select("p_partkey", "m.vertex_count", "m.face_count", "m.material_count")


def _rescanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tree scanned, then changed (files removed, pictures and sidecars rewritten), then scanned again by what differs."""
    import os
    import struct

    root, where = _tree(spark, sf_dir), storage.scratch(spark, "last-scan")
    rescan.rescan(spark, root, where, buckets=32, respect_ignores=True)

    def change(batches):
        for batch in batches:
            for k, n in zip(batch["s_suppkey"], batch["s_nationkey"], strict=True):
                name = f"{root}/_n{n}/" + ("out" if k % 10 == 7 else "in") + f"/s{k}" + (".png", ".gif", ".obj", ".wav")[k % 5 % 4]
                if k % 5 == 4:
                    continue
                if k % 4 == 1:
                    os.remove(name)
                    os.remove(f"{name}.meta")
                elif k % 4 == 2 and k % 5 == 0:
                    with open(name, "wb") as f:
                        f.write(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", k + 7, 3, 8, 6, 0, 0, 0) + b"more")
                    os.utime(name, ns=(1, 1))
                elif k % 4 == 3:
                    with open(f"{name}.meta", "w") as f:
                        f.write(f"version: 2\nguid: h{k}\n")
                    os.utime(f"{name}.meta", ns=(1, 1))
            yield batch

    _dealt(spark, sf_dir).mapInPandas(change, "s_suppkey long, s_nationkey long").count()
    found, counts = rescan.rescan(spark, root, where, buckets=32, respect_ignores=True)
    return found.select(F.substring("path", len(root) + 2, 1 << 30).alias("path"), "metadata.width", F.col("unity_guid").alias("guid")), counts


@query("incr_rescan", f"""WITH {_TREE} SELECT path, CAST(CASE WHEN k % 5 = 0 AND k % 4 = 2 THEN k + 7 WHEN k % 5 = 0 THEN k WHEN k % 5 = 1 THEN k % 65536 END AS BIGINT) AS width, CASE WHEN k % 4 = 3 THEN 'h' ELSE 'g' END || k AS guid FROM t WHERE k % 4 <> 1""")
def incr_rescan(spark, sf_dir):
    return _rescanned(spark, sf_dir)[0]


@query("incr_rescan_counts", f"""WITH {_TREE} SELECT count(*) FILTER (WHERE k % 4 <> 1) AS total, count(*) FILTER (WHERE k % 4 = 0 OR (k % 4 = 2 AND k % 5 <> 0)) AS cached, count(*) FILTER (WHERE k % 4 = 3 OR (k % 4 = 2 AND k % 5 = 0)) AS rescanned, count(*) FILTER (WHERE k % 4 = 1) AS removed FROM t""")
def incr_rescan_counts(spark, sf_dir):
    return _rescanned(spark, sf_dir)[1]


# --- change feeds -------------------------------------------------------------------------

_KINDS = {"signup": "create", "view": "modify", "click": "touch", "error": "remove", "purchase": "rename"}


def _feed(events: DataFrame) -> DataFrame:
    """Renames have a second path, touches come on sidecars, and a few events are below a hidden directory."""
    kinds = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))
    file = lambda n: F.concat(F.lit("/proj/u"), F.col("user_id"), F.lit("/f"), n % 3, F.lit(".png"))
    path = F.when(F.col("event_id") % 50 == 0, "/proj/.git/x.lock").otherwise(F.concat(file(F.col("event_id")), F.when(F.col("event_type") == "click", ".meta").otherwise("")))
    to = F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 50 == 0, "/proj/.git/y.lock").otherwise(file(F.col("event_id") + F.when(F.col("event_id") % 7 == 0, 0).otherwise(1))))
    return events.select("event_id", "ts", kinds[F.col("event_type")].alias("kind"), path.alias("path"), to.alias("to_path"), F.floor(F.col("value") * 100).cast("long").alias("size"))


_FEED = f"""e AS (SELECT event_id, ts, CASE event_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _KINDS.items())} END AS kind,
      CASE WHEN event_id % 50 = 0 THEN '/proj/.git/x.lock' ELSE '/proj/u' || user_id || '/f' || (event_id % 3) || '.png' || CASE WHEN event_type = 'click' THEN '.meta' ELSE '' END END AS path,
      CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN '/proj/.git/y.lock' ELSE '/proj/u' || user_id || '/f' || ((event_id + CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END) % 3) || '.png' END END AS to_path,
      CAST(floor(value * 100) AS BIGINT) AS size FROM events)"""
_EFFECTS = """fx AS (SELECT event_id, ts, 0 AS step, regexp_replace(path, '\\.meta$', '') AS path, CASE WHEN kind = 'remove' THEN 'remove' ELSE 'upsert' END AS kind, size, NULL AS from_path FROM e WHERE kind <> 'rename' AND path NOT LIKE '/proj/.%'
      UNION ALL SELECT event_id, ts, 0, path, 'remove', size, NULL FROM e WHERE kind = 'rename' AND path <> to_path AND path NOT LIKE '/proj/.%'
      UNION ALL SELECT event_id, ts, 1, to_path, 'upsert', size, path FROM e WHERE kind = 'rename' AND path <> to_path AND path NOT LIKE '/proj/.%')"""


def _events(spark, sf_dir):
    return _feed(table(spark, sf_dir, "events"))


@query("fs_routes", f"WITH {_FEED} SELECT kind, CASE WHEN kind <> 'rename' THEN 'single' WHEN path = to_path OR path LIKE '/proj/.%' THEN 'drop' ELSE 'rename' END AS route, count(*) AS n FROM e GROUP BY ALL")
def fs_routes(spark, sf_dir):
    return watch.routed(_events(spark, sf_dir), src.ROOT).groupBy("kind", "route").agg(F.count("*").alias("n"))


@query("fs_effects", f"WITH {_FEED}, {_EFFECTS} SELECT event_id, step, path, kind, from_path FROM fx")
def fs_effects(spark, sf_dir):
    return watch.effects(_events(spark, sf_dir), src.ROOT).select("event_id", "step", "path", "kind", "from_path")


@query("fs_delta", f"WITH {_FEED}, {_EFFECTS} SELECT path, CAST(date_trunc('day', ts) AS VARCHAR) AS day, max_by(kind, (ts, event_id, step)) AS kind, max_by(size, (ts, event_id, step)) AS size, count(*) AS n_events FROM fx GROUP BY ALL")
def fs_delta(spark, sf_dir):
    found = watch.effects(_events(spark, sf_dir), src.ROOT)
    return watch.net_changes(found.withColumn("day", F.date_trunc("day", "ts")), "day").select("path", F.col("day").cast("string").alias("day"), "kind", "size", "n_events")


@query("fs_debounced", f"WITH {_FEED}, {_EFFECTS} SELECT path, CAST(date_trunc('hour', ts) AS VARCHAR) AS batch, max_by(kind, (ts, event_id, step)) AS kind, count(*) AS n_events FROM fx GROUP BY ALL")
def fs_debounced(spark, sf_dir):
    return watch.batches(watch.effects(_events(spark, sf_dir), src.ROOT), "1 hour").select("path", F.col("batch").cast("timestamp_ntz").cast("string").alias("batch"), "kind", "n_events")


@query("fs_apply", f"WITH {_FEED}, {_EFFECTS}, l AS (SELECT path, max_by(kind, (ts, event_id, step)) AS kind, max_by(size, (ts, event_id, step)) AS size FROM fx GROUP BY ALL) SELECT path, size FROM l WHERE kind <> 'remove'")
def fs_apply(spark, sf_dir):
    found = watch.effects(_events(spark, sf_dir), src.ROOT)
    return watch.apply_changes(found.select("path", F.lit(0).cast("long").alias("size")).distinct(), watch.net_changes(found))


@query(
    "fs_rename_chains",
    f"""WITH RECURSIVE {_FEED}, {_EFFECTS}, n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM e WHERE path NOT LIKE '/proj/.%' AND (to_path IS NULL OR path <> to_path)),
    hit AS (SELECT regexp_replace(path, '\\.meta$', '') AS h, k, CASE kind WHEN 'rename' THEN 'move' WHEN 'remove' THEN 'drop' ELSE 'put' END AS act, to_path, size FROM n UNION ALL SELECT to_path, k, 'over', NULL, size FROM n WHERE kind = 'rename'),
    seq AS (SELECT *, coalesce(lag(k) OVER w, 0) AS since, lag(act) OVER w AS earlier FROM hit WINDOW w AS (PARTITION BY h ORDER BY k)),
    t AS (SELECT DISTINCT path AS origin, path, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS size FROM fx UNION ALL SELECT NULL, h, k, size FROM seq WHERE act = 'put' UNION ALL SELECT NULL, to_path, k, size FROM seq WHERE act = 'move' AND earlier IN ('drop', 'move')
      UNION ALL SELECT origin, seq.to_path, seq.k, coalesce(seq.size, t.size) FROM t JOIN seq ON h = path AND t.k >= since AND t.k < seq.k WHERE act = 'move')
    SELECT path, size, origin FROM t WHERE NOT EXISTS (SELECT 1 FROM seq WHERE h = t.path AND seq.k > t.k)""",
)
def fs_rename_chains(spark, sf_dir):
    events = _events(spark, sf_dir)
    return watch.apply_batch(_paths_catalog(events), events, src.ROOT).catalog.select("path", "size", "origin")


@query(
    "fs_quiet",
    f"""WITH {_FEED}, {_EFFECTS}, g AS (SELECT *, CAST(ts AS TIMESTAMP) - lag(CAST(ts AS TIMESTAMP)) OVER w > INTERVAL 1 HOUR AS fresh FROM fx WINDOW w AS (PARTITION BY path ORDER BY ts, event_id, step)),
    n AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY path ORDER BY ts, event_id, step) AS burst FROM g)
    SELECT path, CAST(min(CAST(ts AS TIMESTAMP)) AS VARCHAR) AS start, CAST(max(CAST(ts AS TIMESTAMP)) + INTERVAL 1 HOUR AS VARCHAR) AS end, max_by(kind, (ts, event_id, step)) AS kind, count(*) AS n_events FROM n GROUP BY path, burst""",
)
def fs_quiet(spark, sf_dir):
    return watch.settled(watch.effects(_events(spark, sf_dir), src.ROOT), "1 hour").withColumns({c: F.col(c).cast("timestamp_ntz").cast("string") for c in ("start", "end")})


def _paths_catalog(events: DataFrame) -> DataFrame:
    paths = watch.effects(events, src.ROOT).select("path").distinct()
    return paths.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.lit("png").alias("extension"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("modified"), F.col("path").alias("origin"))


@query("fs_feed_catalog", SQL["fs_rename_chains"])
def fs_feed_catalog(spark, sf_dir):
    """The same by two batches of the live feed, on a catalog in buckets."""
    events, where, n = _events(spark, sf_dir), storage.scratch(spark, "feed"), 16
    versioned.replace_buckets(_paths_catalog(events).withColumn("_bucket", watch.bucket_of(F.col("path"), n)), where, list(range(n)), n_buckets=n)
    half = events.agg(F.percentile_approx("event_id", 0.5).alias("x")).first()["x"]
    first = F.col("ts") <= F.lit(events.where(F.col("event_id") == half).first()["ts"])
    for number, part in enumerate((first, ~first)):
        watch.merge_batch(spark, events.where(part), number, where, src.ROOT)
    return versioned.read(spark, where).select("path", "size", "origin")


@query("fs_epoch", f"WITH {_FEED}, r AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN '/old' ELSE '/proj' END AS root FROM e) SELECT root, count(*) AS n_dropped FROM r WHERE root <> '/proj' GROUP BY ALL")
def fs_epoch(spark, sf_dir):
    return watch.same_epoch(_events(spark, sf_dir).withColumn("root", F.when(F.col("event_id") % 9 == 0, "/old").otherwise("/proj")), src.ROOT)[1]


over_assets(
    "fs_probe",
    """, p AS (SELECT path, dir FROM a WHERE size % 3 <> 0), c AS (SELECT path FROM a WHERE size % 4 = 0 UNION SELECT DISTINCT dir FROM a WHERE size % 5 = 0)
    SELECT path, 'upsert' AS kind FROM p WHERE path IN (SELECT path FROM c) OR dir IN (SELECT path FROM c) OR regexp_replace(dir, '/src$', '') IN (SELECT path FROM c)
    UNION ALL SELECT path, 'remove' FROM c WHERE path NOT IN (SELECT path FROM p) AND path NOT IN (SELECT dir FROM p) AND path NOT IN (SELECT regexp_replace(dir, '/src$', '') FROM p)""",
    lambda a: watch.probed(a.where("size % 4 = 0").select("path").union(a.where("size % 5 = 0").select("dir")), a.where("size % 3 <> 0")).select("path", "kind"),
)


def _batch_events(a: DataFrame) -> DataFrame:
    """One directory renamed, one removed; by size, files renamed, removed, or moved elsewhere (gone here, there in Moved)."""
    k = F.col("size") % 10
    small = F.col("path").startswith("/proj/SMALL/")
    event = lambda kind, path, to=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), path.alias("path"), to.alias("to_path"))
    made = F.when(k == 1, F.array(event("rename", F.col("path"), F.concat("dir", F.lit("/ren_"), "name")))).when(k == 2, F.array(event("remove", F.col("path")))).when(k == 3, F.array(event("remove", F.col("path")), event("create", F.concat(F.lit("/proj/Moved/"), "name"))))
    files = a.where(~small).select("size", "modified", F.explode(made).alias("e")).select(F.col("modified").alias("ts"), F.col("size").alias("event_id"), "size", "modified", "e.kind", "e.path", "e.to_path")
    whole = a.sparkSession.createDataFrame([(0, 0, None, None, "rename", "/proj/SMALL", "/proj/Tiny"), (0, 1, None, None, "remove", "/proj/PROMO/Brand1", None)], files.schema)
    return files.unionByName(whole)


def _after(a: DataFrame) -> watch.Batch:
    """The catalog is made once, for the batch and for its events."""
    kept = storage.stored(a, "catalog")
    return watch.delta(kept, _batch_events(kept), src.ROOT)


_BATCH = """, m AS (SELECT *, CASE WHEN starts_with(path, '/proj/SMALL/') THEN 'dir' WHEN size % 10 = 1 THEN 'ren' WHEN size % 10 = 2 THEN 'rm' WHEN size % 10 = 3 THEN 'mv' ELSE 'keep' END AS act, starts_with(path, '/proj/PROMO/Brand1/') AS brand FROM a),
    up AS (SELECT '/proj/Moved/' || name AS path, name, max_by(size, (modified, size)) AS size, max(modified) AS modified, max_by(asset_type, (modified, size)) AS asset_type FROM m WHERE act = 'mv' GROUP BY ALL),
    nw AS (SELECT '/proj/Tiny' || path[12:] AS path, size, asset_type FROM m WHERE act = 'dir' UNION ALL SELECT path, size, asset_type FROM m WHERE act = 'keep' AND NOT brand
      UNION ALL SELECT dir || '/ren_' || name, size, asset_type FROM m WHERE act = 'ren' UNION ALL SELECT path, size, asset_type FROM up),
    lost AS (SELECT path, name, size, modified FROM m WHERE act IN ('rm', 'mv') OR (act = 'keep' AND brand)),
    j AS (SELECT l.name, l.size, l.modified, count(DISTINCT l.path) AS nl, min(l.path) AS from_path, count(DISTINCT up.path) AS nc, min(up.path) AS to_path FROM lost l JOIN up USING (name, size, modified) GROUP BY ALL),
    mv AS (SELECT path AS from_path, '/proj/Tiny' || path[12:] AS to_path FROM m WHERE act = 'dir' UNION ALL SELECT path, dir || '/ren_' || name FROM m WHERE act = 'ren' UNION ALL SELECT from_path, to_path FROM j WHERE nl = 1 AND nc = 1),
    dead AS (SELECT path FROM lost WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.name = lost.name AND up.size = lost.size AND up.modified = lost.modified))"""
over_assets("fs_batch_catalog", f"{_BATCH} SELECT path, size, asset_type FROM nw", lambda a: _after(a).catalog.select("path", "size", "asset_type"))
over_assets("fs_batch_updated", f"{_BATCH} SELECT '/proj/Tiny' || path[12:] AS path FROM m WHERE act = 'dir' UNION ALL SELECT dir || '/ren_' || name FROM m WHERE act = 'ren' UNION ALL SELECT path FROM up", lambda a: _after(a).updated.select("path"))
over_assets("fs_batch_removed", f"{_BATCH} SELECT path FROM m WHERE act IN ('dir', 'ren', 'rm', 'mv') OR brand", lambda a: _after(a).removed)
over_assets("fs_batch_renamed", f"{_BATCH} SELECT '/proj/SMALL' AS from_path, '/proj/Tiny' AS to_path, true AS is_dir WHERE EXISTS (SELECT 1 FROM m WHERE act = 'dir') UNION ALL SELECT from_path, to_path, false FROM mv WHERE NOT starts_with(to_path, '/proj/Tiny/')", lambda a: _after(a).renamed)
over_assets(
    "fs_batch_tags",
    f"{_BATCH} SELECT DISTINCT coalesce(to_path, path) AS path, size % 4 AS tag_id FROM m LEFT JOIN mv ON mv.from_path = m.path WHERE path NOT IN (SELECT path FROM dead)",
    lambda a: watch.follow_tags(a.select("path", (F.col("size") % 4).alias("tag_id")), _after(a)),
)
over_assets("fs_batch_totals", f"{_BATCH} SELECT asset_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM nw GROUP BY ALL", lambda a: watch.totals(_after(a).catalog, src.ROOT)[1])
over_assets(
    "fs_batch_tree",
    f"""{_BATCH}, p AS (SELECT string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS s, size FROM nw), t AS (SELECT unnest(list_transform(generate_series(2, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS path, size FROM p)
    SELECT path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_size FROM t GROUP BY ALL""",
    lambda a: watch.totals(_after(a).catalog, src.ROOT)[2].select("path", "n_files", "total_size"),
)


@query("fs_counts_stream", f"WITH {_FEED} SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, kind, count(*) AS n FROM e GROUP BY ALL")
def fs_counts_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events*.parquet").parquet(path if _is_folder(spark, path) else sf_dir)
    out = storage.scratch(spark, "fs-counts")
    return watch.replay_counts(_feed(stream), f"{out}/rows", f"{out}/checkpoint").withColumn("start", F.col("start").cast("timestamp_ntz").cast("string"))


def _is_folder(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
