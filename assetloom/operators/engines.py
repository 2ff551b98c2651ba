"""What is peculiar to an engine: Unity texts and packages, Godot projects and graphs, textures beside a model."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.catalog import order_key

# Unity's class numbers, texture extensions, and directories searched beside a model.
UNITY_CLASSES = {
    1: "GameObject", 2: "Component", 3: "LevelGameManager", 4: "Transform", 20: "Camera", 21: "Material", 23: "MeshRenderer", 25: "Renderer", 28: "Texture2D", 33: "MeshFilter", 43: "Mesh", 48: "Shader",
    54: "Rigidbody", 56: "Collider", 64: "MeshCollider", 65: "BoxCollider", 82: "AudioSource", 83: "AudioClip", 84: "RenderTexture", 91: "AnimationClip", 95: "Animator", 102: "TextMesh", 104: "RenderSettings",
    108: "Light", 114: "MonoBehaviour", 115: "MonoScript", 120: "LineRenderer", 128: "Font", 137: "PhysicMaterial", 142: "AssetBundle", 150: "PreloadData", 156: "Terrain", 157: "TerrainCollider",
    158: "TerrainData", 184: "AudioBehaviour", 195: "NavMeshAgent", 196: "NavMeshSettings", 212: "SpriteRenderer", 213: "Sprite", 221: "AnimatorController", 222: "Canvas", 223: "CanvasGroup",
    224: "RectTransform", 225: "CanvasRenderer", 226: "TextMeshPro",
}
TEXTURE_EXTENSIONS = "png jpg jpeg tga bmp gif dds hdr exr tif tiff webp psd".split()
BESIDE = ["", "Textures", "textures", "Texture", "texture", "Materials", "materials", "Material", "material", "Maps", "maps", "Tex", "tex", "Images", "images"]
ABOVE = ["Textures", "textures", "Texture", "texture", "Materials", "materials", "Maps", "maps"]
GODOT_METADATA = ("import", "uid", "godot", "cfg")
GODOT_SOURCES = ("tscn", "tres", "gd", "cs")


@F.pandas_udf(T.StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Unicode's composed form; Spark has no function for it."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def unquoted(value: Column) -> Column:
    """A value without the matching quotes around it."""
    v = F.trim(value)
    return F.when(v.rlike("^\".*\"$|^'.*'$") & (F.length(v) >= 2), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


# --- Unity --------------------------------------------------------------------------------


def unity_components(files: DataFrame, content: str = "content") -> DataFrame:
    """path and the sorted names of the components that a scene or prefab text declares; unknown numbers are left out.

    A script's line with a guid makes a MonoBehaviour, whether its number is declared or not.
    """
    names = F.create_map(*(F.lit(x) for kv in UNITY_CLASSES.items() for x in kv))
    found = F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(r"(?m)^[ \t]*---.*?!u!([0-9]{1,9})(?![0-9])"), 1))
    named = F.transform(found, lambda c: names[c.cast("int")])
    script = F.when(F.col(content).rlike(r"(?m)^[ \t]*m_Script:.*guid:"), F.array(F.lit("MonoBehaviour"))).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.array_sort(F.array_distinct(F.concat(F.array_compact(named), script))).alias("components"))


def package_index(metas: DataFrame, cache_dir: str) -> DataFrame:
    """guid, package, file_name of the sidecars below a package cache; of a guid the last path counts.

    metas: path, content (binary). The package is the directory below the cache up to its @;
    only the first 256 bytes are looked at, and only guids of 32 hex digits count.
    """
    head = F.decode(F.substring("content", 1, 256), "UTF-8")
    guid = F.regexp_extract(head, r"(?m)^guid:\s*([0-9A-Fa-f]{32})\s*$", 1)
    below = F.substring("path", len(cache_dir.rstrip("/")) + 2, 1 << 30)
    rows = metas.where(F.col("path").startswith(cache_dir.rstrip("/") + "/") & F.col("path").endswith(".meta"))
    rows = rows.select("path", guid.alias("guid"), F.substring_index(F.substring_index(below, "/", 1), "@", 1).alias("package"), F.regexp_replace(text.base_name(F.col("path")), r"\.meta$", "").alias("file_name"))
    last = rows.where("guid <> ''").groupBy("guid").agg(F.max_by(F.struct("package", "file_name"), order_key()).alias("m"))
    return last.select("guid", "m.package", "m.file_name")


def unity_version(files: DataFrame, content: str = "content") -> DataFrame:
    """path, version, with_revision (null if absent) of version files that name a version."""
    line = lambda key: F.nullif(F.trim(F.regexp_extract(content, rf"(?m)^{key}:(.*)$", 1)), F.lit(""))
    return files.select("path", line("m_EditorVersion").alias("version"), line("m_EditorVersionWithRevision").alias("with_revision")).where("version IS NOT NULL")


# --- Godot --------------------------------------------------------------------------------


def godot_array(value: Column) -> Column:
    """The items of PackedStringArray(...) or [...], cut at commas; empty ones and other forms give none."""
    inner = F.regexp_extract(F.trim(value), r"(?s)^(?:PackedStringArray\((.*)\)|\[(.*)\])$", 1)
    other = F.regexp_extract(F.trim(value), r"(?s)^\[(.*)\]$", 1)
    items = F.transform(F.split(F.when(inner != "", inner).otherwise(other), ","), unquoted)
    return F.filter(items, lambda x: x != "")


def godot_project(ini: DataFrame) -> DataFrame:
    """One row a project file (rows of fsscan.ini): name, version, main_scene, renderer, autoloads, input_actions."""
    at = lambda section, key: F.max(F.when((F.col("section") == section) & (F.col("key") == key), F.col("value")))
    path = F.regexp_replace(unquoted(F.col("value")), r"^\*", "")
    auto = F.when(F.col("section") == "autoload", F.struct(F.col("key").alias("name"), path.alias("path"), unquoted(F.col("value")).startswith("*").alias("singleton")))
    rows = ini.groupBy("path").agg(
        F.coalesce(unquoted(at("application", "config/name")), F.lit("Unknown")).alias("name"), unquoted(at("application", "run/main_scene")).alias("main_scene"), at("application", "config/features").alias("features"),
        F.coalesce(at("gd_resource", "config_version"), at("", "config_version")).alias("config_version"),
        unquoted(F.coalesce(at("rendering", "renderer/rendering_method"), at("rendering", "quality/driver/driver_name"))).alias("renderer"),
        F.array_sort(F.collect_set(auto)).alias("autoloads"), F.array_sort(F.collect_set(F.when((F.col("section") == "input") & ~F.col("key").contains("/"), F.col("key")))).alias("input_actions"),
    )
    numbered = F.get(F.filter(godot_array(F.col("features")), lambda f: f.rlike(r"^[0-9].*\.|^[0-9]\.")), F.lit(0))
    version = F.coalesce(numbered, F.when(F.col("config_version") == "5", "4.x").when(F.col("config_version") == "4", "3.x"))
    return rows.select("path", "name", version.alias("version"), "main_scene", "renderer", "autoloads", "input_actions")


def res_path(path: Column, root: str) -> Column:
    """res:// form of a path below root; null outside."""
    r = root.rstrip("/") + "/"
    return F.when(path.startswith(r), F.concat(F.lit("res://"), F.substring(path, len(r) + 1, 1 << 30)))


def absolute_path(res: Column, root: str) -> Column:
    """The path of a res:// name; null for others and for res:// alone."""
    return F.when(res.startswith("res://") & (F.length(res) > 6), F.concat(F.lit(root.rstrip("/") + "/"), F.substring(res, 7, 1 << 30)))


def _resources(assets: DataFrame, root: str) -> DataFrame:
    return assets.where(~F.lower("extension").isin(*GODOT_METADATA)).withColumn("id", res_path(F.col("path"), root)).where("id IS NOT NULL")


def godot_unused(assets: DataFrame, targets: DataFrame, root: str) -> DataFrame:
    """path of the assets, but scenes and metadata, that no target (res:// names, autoloads too) names; composed forms compare."""
    used = targets.select(nfc("target").alias("key")).distinct()
    rows = _resources(assets, root).where("asset_type <> 'scene'").select("path", nfc("id").alias("key"))
    return rows.join(used, "key", "left_anti").select("path")


def godot_graph(assets: DataFrame, refs: DataFrame, listed: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind: asset, unscanned, missing) and edges (src, dst) of refs (path, target).

    Names compare as they are written. An unknown target is unscanned if the listing (path)
    has its file. Edges are not made distinct.
    """
    known = _resources(assets, root).select("id")
    edges = refs.select(res_path(F.col("path"), root).alias("src"), F.col("target").alias("dst")).where("src IS NOT NULL")
    unknown = edges.select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
    there = listed.select(F.col("path").alias("p")).distinct()
    found = unknown.withColumn("abs", absolute_path(F.col("id"), root)).join(there, F.col("abs") == F.col("p"), "left")
    kinds = found.select("id", F.when(F.col("p").isNull(), "missing").otherwise("unscanned").alias("kind"))
    return known.select("id", F.lit("asset").alias("kind")).unionByName(kinds), edges


# --- textures beside a model --------------------------------------------------------------


def sibling_textures(models: DataFrame, listed: DataFrame) -> DataFrame:
    """model, name (lower case), texture: for each name the first found in the directories around the model.

    The model's own directory, its usual texture directories, then those beside it. Of equal
    names in one directory the first path counts. Models of one directory share their textures,
    so these are found once a directory; only the last join makes a row for each model, and
    nothing is sorted or sent after it. The sides grow with the tables: none is broadcast.
    """
    here = text.parent(F.col("path"))
    folder = F.col("folder")
    inside = [folder if not d else F.concat(folder, F.lit("/" + d)) for d in BESIDE]
    places = F.array(*inside, *(F.concat(text.parent(folder), F.lit("/" + d)) for d in ABOVE))
    within = models.select(F.col("path").alias("model"), here.alias("folder")).distinct()
    asked = within.select("folder").distinct().select("folder", F.posexplode(places).alias("rank", "dir"))
    name = text.base_name(F.col("path"))
    textures = listed.where(F.lower(text.extension(name)).isin(*TEXTURE_EXTENSIONS)).groupBy(here.alias("dir"), F.lower(name).alias("name")).agg(F.min("path").alias("texture"))
    found = asked.join(textures.hint("merge"), "dir").groupBy("folder", "name").agg(F.min_by("texture", "rank").alias("texture"))
    return within.join(found.hint("merge"), "folder").select("model", "name", "texture")


# --- plans and reports --------------------------------------------------------------------


def apply_plan(suggestions: DataFrame, requested: DataFrame, accepted: DataFrame) -> DataFrame:
    """source, category, label with the sorted paths that a set of accepted suggestions tags.

    suggestions: path, label, category, source (null: new). Paths outside the request and
    labels that were not accepted (path, label, category) are left out.
    """
    rows = suggestions.join(requested.select("path"), "path", "left_semi").join(accepted, ["path", "label", "category"], "left_semi")
    return rows.withColumn("source", F.coalesce("source", F.lit("new"))).groupBy("source", "category", "label").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def unread_entries(warnings: DataFrame) -> DataFrame:
    """One row: entries that a scan could not read, and whether its ignore rules failed. warnings: kind, count."""
    unread = F.sum(F.when(F.col("kind").isin("tree_walk_failed", "asset_unreadable"), F.col("count")).otherwise(0))
    return warnings.agg(F.coalesce(unread, F.lit(0)).cast("long").alias("unread"), F.coalesce(F.bool_or(F.col("kind") == "ignore_rules_unusable"), F.lit(False)).alias("ignore_failed"))


def guarded_renames(plan: DataFrame, references: DataFrame) -> DataFrame:
    """One row: changed names that other files refer to, and how many files do. plan: path, will_change; references: path, src_path.

    Only references to changed names are sent, once, by path: repeats and counts need no other shuffle.
    """
    changed = plan.where("will_change").select("path")
    rows = references.join(changed, "path", "left_semi").select("path", "src_path").repartition("path").distinct()
    counts = rows.groupBy("path").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_renamed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def learning_cost(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """request_id, input_tokens, output_tokens, cents (rounded up) of learning runs.

    requests: request_id, model, prompt_bytes, n_samples, n_tags; prices as for tagging.
    """
    rows = requests.join(prices, "model", "left").withColumns({"i": F.expr("CASE WHEN input_per_m IS NULL THEN 0L ELSE prompt_bytes div 4 END"), "o": F.expr("CASE WHEN input_per_m IS NULL THEN 0L ELSE 600L + 30 * n_tags + 40 * n_samples END")})
    micros = F.expr("coalesce(i * input_per_m div 1000000, 0) + coalesce(o * output_per_m div 1000000, 0)")
    return rows.select("request_id", F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.floor((micros + 9999) / 10000).cast("long").alias("cents"))
