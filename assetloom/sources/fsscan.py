"""Scanning a file tree: listing, ignore rules, headers, guids and engine texts.

Directories are listed in Spark tasks, which go down as far as they get, so hidden files, links
and names that Spark's own file index leaves out (`_x`) are told apart here. Contents are
read in tasks too: of the kinds that have a header reader, and only as much as it needs.
Local folders and the stores that pyarrow knows (file, s3, gs, hdfs) can be scanned.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..operators.graph import resource_references, yaml_references
from . import ignores
from .catalog import METADATA, catalog
from .headers import HEAD_BYTES, MOST_BYTES, READERS, WHOLE, material_library, material_names, read_header
from .storage import stored

_META = T.StructType([T.StructField(k, {"long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType()}[v]) for k, v in METADATA.items()])
ENTRY = "path string, is_dir boolean, size long, modified long, modified_nanos long, error string"
#: Directories that a task is given, entries after which it gives back what it has not opened,
#: and the first bytes that two files of one size are compared by.
TASK_DIRS, TASK_ENTRIES, PREFIX_BYTES = 200, 20_000, 8192
#: Rows that a task makes before it sends them on, and the bytes of contents (a file at least).
SEND_ROWS, SEND_BYTES = 1000, 1 << 20


def _made(rows: DataFrame, of, schema: str | T.StructType) -> DataFrame:
    """The tuples that `of` makes in tasks of an iterator over those of `rows`. They are sent on by SEND_ROWS, however many come in, so that a task's Python stays as large at any size."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = to_arrow_schema(schema)

    def tuples(batches):
        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):  # one at a time: a row may hold a file
                yield tuple(c[i].as_py() for c in columns)

    def sent(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)], schema=types)

    def run(batches):
        out, size = [], 0
        for row in of(tuples(batches)):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, bytes))
            if len(out) >= SEND_ROWS or size >= SEND_BYTES:
                yield sent(out)
                out, size = [], 0
        if out:
            yield sent(out)

    return rows.mapInArrow(run, schema)


def _store(path: str):
    """The store of a path with a scheme and the path in it; None for local ones."""
    if "://" not in path or path.startswith("file:"):
        return None, path.removeprefix("file://").removeprefix("file:")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _children(folder: str) -> Iterator[tuple]:
    """Rows of ENTRY for what a directory holds, links left out; one with an error if it can't be read."""
    try:
        store, where = _store(folder)
        if store is None:
            for e in os.scandir(where):
                if not e.is_symlink():
                    is_dir, st = e.is_dir(), e.stat()
                    yield f"{where.rstrip('/')}/{e.name}", is_dir, st.st_size, int(st.st_mtime), st.st_mtime_ns, None
        else:
            from pyarrow import fs

            scheme = folder.split("://", 1)[0]
            for f in store.get_file_info(fs.FileSelector(where)):
                nanos = f.mtime_ns or 0
                yield f"{scheme}://{f.path}", f.type == fs.FileType.Directory, f.size or 0, nanos // 10**9, nanos, None
    except OSError as e:
        yield folder, False, None, None, None, str(e)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """ENTRY of everything below root that is not hidden, and of ignore files; a row with an error for what can't be listed.

    A task goes down the directories it was given, level by level, until it has listed about
    TASK_ENTRIES entries; what it has not opened by then is dealt out anew. So the number of
    jobs grows with the entries a task is left with, not with the depth of the tree, and a
    large directory below a small one is not one task's.
    """

    def run(folders):
        waiting, seen = deque(f for f, in folders), 0
        while waiting and seen < TASK_ENTRIES:
            for row in _children(waiting.popleft()):
                name = row[0].rsplit("/", 1)[1]
                if name.startswith(".") and name not in (".gitignore", ".ignore") and row[5] is None:
                    continue
                seen += 1
                yield *row, False
                if row[1]:
                    waiting.append(row[0])
        for folder in waiting:
            yield folder, True, None, None, None, None, True

    level, parts = spark.range(1).select(F.lit(root.rstrip("/") or "/").alias("path")), None
    while True:
        n = level.count()
        tasks = min(max(-(-n // TASK_DIRS), min(n, spark.sparkContext.defaultParallelism)), 10_000)
        found = stored(_made(level.repartition(max(tasks, 1)), run, f"{ENTRY}, waiting boolean"), "walk")
        entries = found.where("NOT waiting").drop("waiting")
        parts = entries if parts is None else parts.unionByName(entries)
        level = found.where("waiting").select("path")
        if level.isEmpty():
            return parts


def _read(path: str, most: int | None) -> bytes | None:
    try:
        store, where = _store(path)
        with open(where, "rb") if store is None else store.open_input_stream(where) as f:
            return f.read() if most is None else f.read(most)
    except OSError:
        return None


def with_content(found: DataFrame, most: Column | None = None) -> DataFrame:
    """found (path, ...) with the first `most` bytes of each file (null: all); null if unreadable. Read in tasks."""
    rows = found.withColumn("_most", (F.lit(None) if most is None else most).cast("long"))
    at = found.columns.index("path")

    def run(rows):
        for *row, n in rows:
            yield *row, _read(row[at], n)

    return _made(rows, run, T.StructType([*found.schema.fields, T.StructField("content", T.BinaryType())]))


def _read_as(found: DataFrame, most: Column | None, of, schema: str | T.StructType) -> DataFrame:
    """The path of each file of found and what of(path, content) says of it.

    One Python worker of a task reads a file and looks at it: contents are not sent, and one
    is held at a time. Content that one worker read and another looked at would take two.
    """

    def run(rows):
        for path, n in rows:
            yield path, of(path, _read(path, n))

    return _made(found.select("path", (F.lit(None) if most is None else most).cast("long").alias("_most")), run, schema)


def ignore_rules(spark: SparkSession, root: str, entries: DataFrame, global_text: str = "", parents: bool = True) -> DataFrame:
    """Rules of the ignore files in a walk, of the repository's exclude list, of a global list, and of the directories above. The files of the walk are read and parsed in tasks."""
    top, files = root.rstrip("/"), [(root.rstrip("/"), 0, global_text)]
    above = []
    for folder in ([top[:i] for i in range(1, len(top)) if top[i] == "/" and "://" not in top[i - 1 : i + 2]] if parents else []):
        above += [(folder, n) for n in (1, 2, 3)]
    for folder, n in [*above, (top, 1)]:
        body = _read(f"{folder}/{ignores.FILES[n - 1]}", None)
        if body:
            files.append((folder, n, body.decode("utf-8", "replace")))
    name = text.base_name(F.col("path"))
    own = entries.where(name.isin(".gitignore", ".ignore") & ~F.col("is_dir")).select("path")

    def rules(rows):
        for path, in rows:
            folder, kind = path.rsplit("/", 1)
            yield from ignores.rules_of([(folder, ignores.FILES.index(kind) + 1, (_read(path, None) or b"").decode("utf-8", "replace"))])

    return ignores.rows(spark, ignores.rules_of(files)).unionByName(_made(own, rules, ignores.RULES))


def listing(spark: SparkSession, root: str, *, respect_ignores: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """path, size, modified (seconds), modified_nanos of the files below root but hidden ones; by the ignore rules, if wanted."""
    entries = walk(spark, root) if entries is None else entries
    rows = entries.where(~F.col("is_dir") & F.col("error").isNull() & ~text.base_name(F.col("path")).startswith(".")).select("path", "size", "modified", "modified_nanos")
    return ignores.kept(rows, ignore_rules(spark, root, entries), root) if respect_ignores else rows


def unreadable(entries: DataFrame) -> DataFrame:
    """kind, path, detail of what a walk could not list."""
    return entries.where("error IS NOT NULL").select(F.lit("tree_walk_failed").alias("kind"), "path", F.col("error").alias("detail"))


def files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, size, modified (seconds), content of all files below root but hidden ones, by a glob over their names."""
    rows = listing(spark, root).drop("modified_nanos")
    if glob:
        rows = rows.where(text.base_name(F.col("path")).rlike("^" + fnmatch.translate(glob).removeprefix("(?s:").replace(")\\Z", "$").replace(")\\z", "$")))
    return with_content(rows)


def _extension() -> Column:
    return F.lower(text.extension(text.base_name(F.col("path"))))


_HEADER = T.StructType([T.StructField("path", T.StringType()), T.StructField("metadata", _META)])


def _metadata(path: str, content: bytes | None) -> dict | None:
    return read_header(path.rsplit(".", 1)[-1], content) or None


def headers(found: DataFrame) -> DataFrame:
    """path and metadata of the files (path, content) that have a header reader; null if unreadable."""

    def run(rows):
        for path, content in rows:
            yield path, _metadata(path, content)

    return _made(found.where(_extension().isin(*READERS)).select("path", "content"), run, _HEADER)


GLTF = ("gltf", "glb")
_GLTF_SCHEMA = "accessors array<struct<count:bigint>>, meshes array<struct<primitives:array<struct<attributes:struct<POSITION:int>,indices:int,mode:int>>>>, materials array<struct<name:string>>"


def _bound(value: Column, of) -> Column:
    """of(value), the value made once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def gltf_metadata(content: Column) -> Column:
    """The metadata of a glTF file's bytes, in column expressions: the JSON text, or the JSON chunk of the binary form.

    Vertices are the positions of all primitives; faces are a third of the corners of
    triangles, two less than those of strips and fans, and none of points and lines. Null if the
    text is no JSON, or a primitive has no positions or names an accessor that is not there.
    The bytes, the text and the parts are bound once each: used several times as expressions,
    they would be made anew for every use.
    """
    return _bound(content, lambda c: _bound(_gltf_text(c), _gltf_of_text))


def _gltf_text(content: Column) -> Column:
    size = F.conv(F.hex(F.concat(*(F.substring(content, i, 1) for i in (16, 15, 14, 13)))), 16, 10).cast("int")
    body = F.when(F.substring(content, 1, 4) == F.lit(b"glTF"), content.substr(F.lit(21), size)).otherwise(content)
    return F.decode(body, "UTF-8")


def _gltf_of_text(body: Column) -> Column:
    count = lambda d, i: F.get(d["accessors"], i)["count"]

    def parts_of(d: Column) -> Column:
        return F.flatten(F.transform(F.coalesce(d["meshes"], F.array().cast("array<struct<primitives:array<struct<attributes:struct<POSITION:int>,indices:int,mode:int>>>>")), lambda m: F.coalesce(m["primitives"], F.array().cast("array<struct<attributes:struct<POSITION:int>,indices:int,mode:int>>"))))

    def counted(x: Column) -> Column:
        corners = lambda p: F.when(p["indices"].isNull(), count(x, p["attributes"]["POSITION"])).otherwise(count(x, p["indices"]))
        mode = lambda p: F.coalesce(p["mode"], F.lit(4))
        faces = lambda p: F.when(mode(p) == 4, F.floor(corners(p) / 3)).when(mode(p).isin(5, 6), F.when(corners(p) > 2, corners(p) - 2).when(corners(p).isNotNull(), 0)).when(corners(p).isNotNull(), 0).cast("long")
        total = lambda of: F.aggregate(x["parts"], F.lit(0).cast("long"), lambda n, p: n + of(p))
        made = {"vertex_count": total(lambda p: count(x, p["attributes"]["POSITION"])), "face_count": total(faces), "material_count": x["materials"].cast("long")}
        return F.struct(*(v.alias(n) for n, v in made.items()))

    def whole(m: Column) -> Column:
        row = F.struct(*((m[f.name] if f.name in ("vertex_count", "face_count", "material_count") else F.lit(None)).cast(f.dataType).alias(f.name) for f in _META.fields))
        return F.when(m["vertex_count"].isNotNull() & m["face_count"].isNotNull(), row)

    read = lambda d: F.struct(d["accessors"].alias("accessors"), parts_of(d).alias("parts"), F.size(F.coalesce(d["materials"], F.array().cast("array<struct<name:string>>"))).alias("materials"))
    found = _bound(F.from_json(body, _GLTF_SCHEMA), lambda d: _bound(read(d), lambda x: _bound(counted(x), whole)))
    return F.when(F.try_parse_json(body).isNotNull(), found)


def read_headers(found: DataFrame) -> DataFrame:
    """path and metadata of a listing's files (path, size) that have a header reader.

    Kinds that need the whole file are read up to MOST_BYTES, and have no header beyond;
    of the others HEAD_BYTES are read. Files of other kinds are not opened.
    """
    ext = _extension()
    wanted = found.where(ext.isin(*READERS) & (~ext.isin(*WHOLE) | (F.col("size") <= MOST_BYTES))).select("path")
    models = with_content(wanted.where(ext.isin(*GLTF))).select("path", gltf_metadata(F.col("content")).alias("metadata"))
    return _read_as(wanted.where(~ext.isin(*GLTF)), F.when(~ext.isin(*WHOLE), F.lit(HEAD_BYTES)), _metadata, _HEADER).unionByName(models)


def obj_materials(found: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """path and material_count of the OBJ files of a listing (or of `wanted`) whose material library can be read. Only libraries that one names are opened."""

    models = (found if wanted is None else wanted).where(_extension() == "obj").select("path")
    named = _read_as(models, F.lit(HEAD_BYTES), lambda _, c: None if c is None else material_library(c), "path string, library string")
    named = stored(named.withColumn("mtl", F.concat(text.parent(F.col("path")), F.lit("/"), F.regexp_replace("library", r"^\./", ""))), "libraries")
    asked = found.where((_extension() == "mtl") & (F.col("size") <= MOST_BYTES)).select("path").join(named.select(F.col("mtl").alias("path")), "path", "left_semi")
    counted = _read_as(asked, None, lambda _, c: None if c is None else len(material_names(c)), "mtl string, material_count long")
    return named.join(counted, "mtl").select("path", "material_count")


def guids(found: DataFrame) -> DataFrame:
    """path and unity_guid: the first guid line of each file's .meta sidecar."""
    body = F.decode("content", "UTF-8")
    rows = found.where(F.col("path").endswith(".meta")).select(F.regexp_replace("path", r"\.meta$", "").alias("path"), F.trim(F.regexp_extract(body, r"(?m)^guid:\s*(.*)$", 1)).alias("unity_guid"))
    return rows.where("unity_guid <> ''")


def parsed(found: DataFrame, wanted: DataFrame, with_headers: bool = True) -> DataFrame:
    """The catalog rows of `wanted` (path, size, modified), a part of the listing `found`: only they, their sidecars and libraries are opened."""
    sidecars = found.where(F.col("path").endswith(".meta")).select("path").join(wanted.select(F.concat("path", F.lit(".meta")).alias("path")), "path", "left_semi")
    rows = wanted.join(guids(with_content(sidecars, F.lit(HEAD_BYTES))), "path", "left")
    if with_headers:
        made = obj_materials(found, wanted)
        rows = rows.join(read_headers(wanted), "path", "left").join(made, "path", "left")
        count = F.coalesce("metadata.material_count", "material_count")
        rows = rows.withColumn("metadata", F.when(F.col("metadata").isNotNull(), F.col("metadata").withField("material_count", count))).drop("material_count")
    return catalog(rows)


def scan(spark: SparkSession, root: str, *, with_headers: bool = True, respect_ignores: bool = False) -> DataFrame:
    """The catalog of a file tree, with headers and guids joined by path."""
    found = stored(listing(spark, root, respect_ignores=respect_ignores), "listing")
    return parsed(found, found.select("path", "size", "modified"), with_headers)


def duplicates(found: DataFrame) -> DataFrame:
    """path, size, sha256 of the files of a listing (path, size) that others may equal; equal ones share size and hash.

    By size first, then by the first PREFIX_BYTES, and only what is still together is read
    whole, a piece at a time. Sizes and prefixes of any share of the files meet as counts.
    """

    def digests(most: int | None):
        def run(batches):
            for batch in batches:
                out = []
                for path in batch["path"]:
                    try:
                        store, where = _store(path)
                        with open(where, "rb") if store is None else store.open_input_stream(where) as f:
                            h = hashlib.sha256(f.read(most) if most else b"")
                            while not most and (piece := f.read(1 << 20)):
                                h.update(piece)
                        out.append(h.hexdigest())
                    except OSError:
                        out.append(None)
                yield batch.assign(sha256=out)

        return run

    def together(rows: DataFrame, *key: str) -> DataFrame:
        some = stored(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "together")
        return rows.join(some, list(key), "left_semi")

    same_size = together(found.select("path", "size"), "size").select("path", "size")
    same_start = together(stored(same_size.mapInPandas(digests(PREFIX_BYTES), "path string, size long, sha256 string"), "prefixes").where("sha256 IS NOT NULL"), "size", "sha256")
    whole = same_start.select("path", "size").mapInPandas(digests(None), "path string, size long, sha256 string")
    return together(stored(whole.where("sha256 IS NOT NULL"), "digests"), "size", "sha256").select("path", "size", "sha256")


def unity_project_root(root: str) -> str | None:
    """The nearest directory at or above root with ProjectSettings; above, only if root lies in its Assets."""
    here = root.rstrip("/")
    if os.path.isdir(f"{here}/ProjectSettings"):
        return here
    above = here
    while "/" in above.lstrip("/"):
        above = above.rsplit("/", 1)[0]
        if os.path.isdir(f"{above}/ProjectSettings") and (here + "/").startswith(f"{above}/Assets/"):
            return above
    return None


def path_status(paths: list[str]) -> list[tuple[str, str]]:
    """Each path, repeats too, as ok, missing, not_a_directory or unreadable."""

    def status(path: str) -> str:
        try:
            if not os.path.isdir(path):
                os.stat(path)
                return "not_a_directory"
            next(os.scandir(path), None)
        except FileNotFoundError:
            return "missing"
        except OSError:
            return "unreadable"
        return "ok"

    return [(p, status(p)) for p in paths]


def project_type(found: DataFrame, root: str) -> DataFrame:
    """One row: unity, unreal, godot or generic, by the marker files of a listing (path)."""
    below = F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = found.agg(has(below.startswith("ProjectSettings/")).alias("u"), has(below.rlike(r"^[^/]*\.uproject$")).alias("e"), has(below == "project.godot").alias("g"))
    return seen.select(F.when(F.col("u"), "unity").when(F.col("e"), "unreal").when(F.col("g"), "godot").otherwise("generic").alias("project_type"))


def ini(found: DataFrame) -> DataFrame:
    """path, section, key, value of INI texts; `;` and `#` begin comments, keys before a section have ''.

    Sections are cut by a split, so no window over lines is needed.
    """
    body = F.regexp_replace(F.decode("content", "UTF-8"), r"\r", "")
    parts = found.select("path", F.explode(F.split(F.concat(F.lit("[]\n"), body), r"(?m)^\[")).alias("part"))
    rows = parts.select("path", F.regexp_extract("part", r"^([^\]\n]*)\]", 1).alias("section"), F.explode(F.split("part", "\n")).alias("line"))
    pair = r"^\s*([^;#=\[\]][^=]*?)\s*=\s*(.*?)\s*$"
    return rows.where(F.col("line").rlike(pair)).select("path", "section", F.regexp_extract("line", pair, 1).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))


def uproject(found: DataFrame) -> DataFrame:
    """path, kind (plugin, module), name, enabled of project JSON; malformed entries drop out one by one."""
    doc = F.try_parse_json(F.decode("content", "UTF-8"))
    parts = found.select("path", doc.alias("d"))
    one = lambda field, kind: parts.select("path", F.lit(kind).alias("kind"), F.explode(F.try_variant_get("d", f"$.{field}", "array<variant>")).alias("x"))
    rows = one("Plugins", "plugin").unionByName(one("Modules", "module"))
    rows = rows.select("path", "kind", F.try_variant_get("x", "$.Name", "string").alias("name"), F.try_variant_get("x", "$.Enabled", "boolean").alias("enabled"))
    return rows.where("name IS NOT NULL")


def references(found: DataFrame) -> DataFrame:
    """Unity references of text assets: path, guid, file_id, ref_type."""
    return yaml_references(found.select("path", F.decode("content", "UTF-8").alias("content")))


def resources(found: DataFrame) -> DataFrame:
    """Quoted res:// paths of scene, resource and script texts: path, target."""
    wanted = F.lower(text.extension(text.base_name(F.col("path")))).isin("tscn", "tres", "gd", "cs", "godot")
    return resource_references(found.where(wanted).select("path", F.decode("content", "UTF-8").alias("content")))
