"""The asset catalog and the relations around it, and the views that stand in for them in queries.

A catalog row: path, name, dir, extension, asset_type, size, modified, metadata (struct, may be
null), unity_guid. Order is by lower-case path, then path; `first` always means in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

METADATA = {
    "width": "long", "height": "long", "has_alpha": "boolean", "vertex_count": "long", "face_count": "long", "material_count": "long", "duration_secs": "double",
    "sample_rate": "long", "channels": "long", "bit_depth": "long", "framerate": "float", "video_codec": "string", "color_space": "string", "mipmap_count": "long", "dcc_source_kind": "string",
}


def order_key(path: str = "path") -> Column:
    """The catalog's order as a value: for min_by, max_by and sorts without a global row number."""
    return F.struct(F.lower(path), F.col(path))


def catalog(listing: DataFrame) -> DataFrame:
    """A listing (path, size, modified; perhaps metadata, unity_guid) as catalog rows.

    Directories, sidecars and files without an extension are not assets. An authoring file
    gets its tool in metadata even where nothing else is known of it.
    """
    name = text.base_name(F.col("path"))
    rows = listing.withColumns({"name": name, "dir": text.parent(F.col("path")), "extension": text.extension(name)})
    # on one bound name: the terms of a filter are moved below the columns, and each would make the name anew
    rows = rows.where(F.exists(F.array("name"), lambda n: (text.extension(n) != "") & ~text.is_sidecar(n)))
    if "metadata" not in rows.columns:
        rows = rows.withColumn("metadata", F.lit(None).cast("struct<" + ",".join(f"{k}:{v}" for k, v in METADATA.items()) + ">"))
    if "unity_guid" not in rows.columns:
        rows = rows.withColumn("unity_guid", F.lit(None).cast("string"))
    tool = text.dcc_tool(F.col("extension"))
    rows = rows.withColumn("metadata", F.when(tool.isNotNull(), F.struct(*(F.col(f"metadata.{k}") if k != "dcc_source_kind" else tool.alias(k) for k in METADATA))).otherwise(F.col("metadata")))
    return rows.withColumn("asset_type", text.asset_type(F.col("extension"))).select("path", "name", "dir", "extension", "asset_type", "size", "modified", "metadata", "unity_guid")


# --- views over the warehouse tables ------------------------------------------------------

# The view's lists. Neighbours in EXTENSIONS make source and export pairs.
EXTENSIONS = ["blend", "fbx", "ma", "obj", "psd", "png", "tga", "jpg", "wav", "mp3", "prefab", "unity", "mat", "cs", "json", "mp4", "dds"]
SUFFIXES = ["_BaseColor", "_Normal", "_ORM", "", "", "_sfx", "_Height"]
WORDS = ["Rock", "oak Tree", "crate", "wall-tile", "HeroArmor", "ui#panel", "Sword", "lampPost"]
SEPARATORS = ["_", " ", "-"]
FOLDERS = ["STANDARD", "PROMO", "Large", "SMALL", "MEDIUM", "Economy"]
FACTORS = [1, 37, 1024, 15000, 40000, 7]
ROOT = "/proj"


def _pick(items: list, index: str, duck: bool) -> str:
    inside = ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in items)
    return f"[{inside}][CAST({index} AS INT) + 1]" if duck else f"element_at(array({inside}), CAST({index} AS INT) + 1)"


def _asset_columns(duck: bool) -> dict[str, str]:
    k, g = "p_partkey", "p_partkey // 7" if duck else "p_partkey div 7"
    pick = lambda items, index: _pick(items, index, duck)
    ext = pick(EXTENSIONS, f"({k} % 7 + ({g})) % 17") if duck else "_ext"
    kind = "_kind" if not duck else f"CASE WHEN {ext} IN ('psd', 'png', 'tga', 'jpg', 'dds') THEN 't' WHEN {ext} IN ('blend', 'fbx', 'ma', 'obj') THEN 'm' WHEN {ext} IN ('wav', 'mp3') THEN 'a' ELSE 'o' END"
    side = pick([1 << i for i in range(13)], "p_size % 13")
    group = f"({g})"
    deep = f"CASE WHEN {k} % 7 = 3 AND {group} % 2 = 0 THEN '/src' ELSE '' END"
    folder = f"'{ROOT}/' || {pick(FOLDERS, f'({group} // 10) % 6' if duck else f'({group} div 10) % 6')} || '/Brand' || CAST({group} % 25 AS STRING) || {deep}"
    name = f"{pick(WORDS, f'{group} % 8')} || {pick(SEPARATORS, f'{group} % 3')} || CAST({group} AS STRING) || {pick(SUFFIXES, f'{k} % 7')} || '.' || CASE WHEN {k} % 11 = 0 THEN upper({ext}) ELSE {ext} END"
    on = lambda letter, value: f"CASE WHEN {kind} = '{letter}' AND {k} % 13 <> 0 THEN {value} END"
    return {
        "k": f"CAST({k} AS BIGINT)",
        "path": f"{folder} || '/' || {name}",
        "size": f"CAST(floor(p_retailprice) AS BIGINT) * {pick(FACTORS, f'{k} % 6')}",
        "modified": f"CAST(1700000000 + ({k} * 37) % 100000 AS BIGINT)",
        "unity_guid": f"CASE WHEN {k} % 9 <> 4 THEN md5(CAST({k} AS STRING)) END",
        "width": on("t", f"CAST({side} + CASE WHEN {k} % 5 = 0 THEN 1 ELSE 0 END AS BIGINT)"),
        "height": on("t", f"CAST({side} AS BIGINT)"),
        "has_alpha": on("t", f"({k} % 3 = 0)"),
        "vertex_count": on("m", "CAST(p_size * 4000 AS BIGINT)"),
        "face_count": on("m", "CAST(p_size * 3900 AS BIGINT)"),
        "material_count": on("m", "CAST(p_size % 14 AS BIGINT)"),
        "duration_secs": on("a", "CAST(p_size AS DOUBLE) / 2 + 10"),
        "sample_rate": on("a", f"CAST({pick([44100, 48000, 22050], f'{k} % 3')} AS BIGINT)"),
        "channels": on("a", f"CAST(1 + {k} % 2 AS BIGINT)"),
        "mipmap_count": f"CASE WHEN {ext} = 'dds' AND {k} % 13 <> 0 THEN CAST(1 + {k} % 3 AS BIGINT) END",
        "color_space": on("t", f"{pick(['sRGB', 'Linear'], f'{k} % 2')}"),
        "has_meta": f"{k} % 13 <> 0",
    }


def asset_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as a catalog; every path is of its own at any scale.

    A few columns of `part` are a small file, whatever it takes to make a catalog of them, so
    the keys are dealt out before the work; `inline` keeps filters over made columns, such as
    the one of `catalog`, from being moved below that. Extension and kind are made once a row.
    """
    cols = _asset_columns(False)
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    keys = keys.selectExpr("inline(array(struct(p_partkey, p_size, p_retailprice)))")
    made = keys.selectExpr("*", f"{_pick(EXTENSIONS, '(p_partkey % 7 + (p_partkey div 7)) % 17', False)} AS _ext")
    made = made.selectExpr("*", "CASE WHEN _ext IN ('psd', 'png', 'tga', 'jpg', 'dds') THEN 't' WHEN _ext IN ('blend', 'fbx', 'ma', 'obj') THEN 'm' WHEN _ext IN ('wav', 'mp3') THEN 'a' ELSE 'o' END AS _kind")
    plain = made.selectExpr(*(f"{v} AS {c}" for c, v in cols.items()))
    known = [F.col(c).alias(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in METADATA.items()]
    listing = plain.select("path", "size", "modified", "unity_guid", F.when(F.col("has_meta"), F.struct(*known)).alias("metadata"))
    return catalog(listing)


def _case(column: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {column} IN ({', '.join(repr(e) for e in exts.split())}) THEN '{name}'" for name, exts in table.items())
    return f"CASE {whens} ELSE {default} END"


def _assets_sql() -> str:
    base = ", ".join(f"{v} AS {c}" for c, v in _asset_columns(True).items())
    return f"""
    a0 AS (SELECT {base} FROM part),
    a1 AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS dir FROM a0),
    a2 AS (SELECT *, regexp_extract(name, '\\.([^.]*)$', 1) AS extension, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM a1),
    a AS (SELECT *, lower(extension) AS ext, {_case('lower(extension)', text.ASSET_TYPES, "'other'")} AS asset_type, {_case('lower(extension)', text.DCC_TOOLS, 'NULL')} AS dcc_source_kind FROM a2)"""


#: DuckDB: common table expression `a`, the flat form of asset_view.
ASSETS_SQL = _assets_sql()


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as text files: path, size, modified, content (binary)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(F.concat(F.lit("/proj/docs/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


DOCUMENT_FILES_SQL = "f AS (SELECT '/proj/docs/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, ''))) AS size, coalesce(text, '') AS content FROM documents)"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset references: src_path, src_guid, src_extension, guid. Scenes use parts; every part uses the one at half its key; materials use customers."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    scenes = lines.selectExpr("concat('/proj/scenes/s', l_orderkey, '.unity') AS src_path", "md5(concat('s', l_orderkey)) AS src_guid", "'unity' AS src_extension", "md5(CAST(l_partkey AS STRING)) AS guid")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    nested = parts.selectExpr("concat('/proj/prefabs/p', p_partkey, '.prefab') AS src_path", "md5(CAST(p_partkey AS STRING)) AS src_guid", "'prefab' AS src_extension", "CASE WHEN p_partkey % 40 = 1 THEN '' ELSE md5(CAST(p_partkey div 2 AS STRING)) END AS guid")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    materials = orders.selectExpr("concat('/proj/mats/o', o_orderkey, '.mat') AS src_path", "md5(concat('o', o_orderkey)) AS src_guid", "'mat' AS src_extension", "md5(concat('c', o_custkey)) AS guid")
    return scenes.unionByName(nested).unionByName(materials)


REFERENCES_SQL = """r AS (
    SELECT '/proj/scenes/s' || l_orderkey || '.unity' AS src_path, md5('s' || l_orderkey) AS src_guid, 'unity' AS src_extension, md5(CAST(l_partkey AS VARCHAR)) AS guid FROM lineitem
    UNION ALL SELECT '/proj/prefabs/p' || p_partkey || '.prefab', md5(CAST(p_partkey AS VARCHAR)), 'prefab', CASE WHEN p_partkey % 40 = 1 THEN '' ELSE md5(CAST(p_partkey // 2 AS VARCHAR)) END FROM part
    UNION ALL SELECT '/proj/mats/o' || o_orderkey || '.mat', md5('o' || o_orderkey), 'mat', md5('c' || o_custkey) FROM orders)"""


def known_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, guid and kind of the assets that the project holds: parts, and customers as materials."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 10 <> 0").selectExpr("concat('/proj/prefabs/p', p_partkey, '.prefab') AS path", "md5(CAST(p_partkey AS STRING)) AS guid", "CASE WHEN p_partkey % 6 = 5 THEN 'scene' ELSE 'prefab' END AS asset_type")
    return parts.unionByName(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('/proj/mats/c', c_custkey, '.mat') AS path", "md5(concat('c', c_custkey)) AS guid", "CASE WHEN c_custkey % 6 = 5 THEN 'scene' ELSE 'material' END AS asset_type"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """guid and package of the parts that packages bring."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 20 = 0").selectExpr("md5(CAST(p_partkey AS STRING)) AS guid", "concat('com.pack.', p_partkey % 5) AS package")


KNOWN_SQL = """known AS (SELECT '/proj/prefabs/p' || p_partkey || '.prefab' AS path, md5(CAST(p_partkey AS VARCHAR)) AS guid, CASE WHEN p_partkey % 6 = 5 THEN 'scene' ELSE 'prefab' END AS asset_type FROM part WHERE p_partkey % 10 <> 0
      UNION ALL SELECT '/proj/mats/c' || c_custkey || '.mat', md5('c' || c_custkey), CASE WHEN c_custkey % 6 = 5 THEN 'scene' ELSE 'material' END FROM customer),
    packs AS (SELECT md5(CAST(p_partkey AS VARCHAR)) AS guid, 'com.pack.' || (p_partkey % 5) AS package FROM part WHERE p_partkey % 20 = 0)"""
