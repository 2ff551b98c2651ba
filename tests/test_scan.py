import json
import os
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from assetloom.plans import queries
from assetloom.sources import fsscan, ignores, keep
from assetloom.sources.headers import read_header


def png(w, h, kind=6, *chunks):
    body = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + body(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + b"".join(body(n, d) for n, d in chunks) + body(b"IDAT", b"") + body(b"IEND", b"")


def dds(w, h, mips, four=b"DXT5", flags=4):
    head = bytearray(128)
    head[:4] = b"DDS "
    struct.pack_into("<II", head, 12, h, w)
    struct.pack_into("<I", head, 28, mips)
    struct.pack_into("<I4s", head, 80, flags, four)
    return bytes(head)


def icc(kind, n, value=b""):
    profile = bytearray(128) + struct.pack(">I", 1) + struct.pack(">4sII", b"rTRC", 144, 14) + kind + b"\0" * 4 + struct.pack(">I", n) + value
    return b"name\0\0" + zlib.compress(bytes(profile))


def test_image_headers():
    assert read_header("PNG", png(3, 5, 2)) == {"width": 3, "height": 5, "has_alpha": False}
    assert read_header("png", png(3, 5, 6, (b"sRGB", b"\0")))["color_space"] == "sRGB"
    assert read_header("png", png(3, 5, 6, (b"iCCP", icc(b"curv", 0))))["color_space"] == "Linear"
    assert read_header("png", png(3, 5, 6, (b"iCCP", icc(b"curv", 1, b"\x02\x33"))))["color_space"] == "sRGB"
    assert read_header("dds", dds(64, 32, 0)) == {"width": 64, "height": 32, "has_alpha": True, "mipmap_count": 1}
    assert read_header("dds", dds(64, 32, 7, b"DXT1"))["has_alpha"] is False
    assert read_header("svg", b'<?xml?><svg width="10px" height="20"/>')["height"] == 20
    assert read_header("svg", b'<svg width="50%" height="20" viewBox="0 0 7 9"/>')["width"] == 7
    assert read_header("gif", b"GIF89a\x05\0\x06\0")["height"] == 6
    assert read_header("tga", bytes(12) + b"", ) == {} and read_header("jpg", b"\xff\xd8\xff\xc0\0\x11\x08\0\x20\0\x10\x03\0")["width"] == 16
    assert read_header("png", b"broken") == {} and read_header("txt", b"x") == {}


def test_model_and_sound_headers():
    doc = {"accessors": [{"count": 9}, {"count": 6}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 5}, {"attributes": {"POSITION": 0}, "mode": 1}]}], "materials": [{}]}
    assert read_header("gltf", json.dumps(doc).encode()) == {"vertex_count": 27, "face_count": 9, "material_count": 1}
    assert read_header("obj", b"v 0 0 0\nf 1 2 3 4\nf 1 2 5\n") == {"vertex_count": 5, "face_count": 3}
    wav = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 352800)
    assert read_header("wav", wav) == {"channels": 2, "sample_rate": 44100, "bit_depth": 16, "duration_secs": 2.0}


def test_scan_of_a_tree(spark, tmp_path):
    put = lambda p, b: ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_bytes(b))
    put("Assets/a b+%.png", png(8, 8))
    put("Assets/a b+%.png.meta", b"fileFormatVersion: 2\nguid: abc123\nother: 1\n")
    put("Assets/x.blend", b"?")
    put("Assets/.git/y.png", png(1, 1))
    put("Assets/README", b"?")
    put("ProjectSettings/ProjectVersion.txt", b"m_EditorVersion: 6000.0.1f1\n")
    put("project.godot", b'key=0\n[application]\n; no\nconfig/name="Game"\n[autoload]\nA="*res://a.gd"\n')
    put("g.uproject", json.dumps({"Plugins": [{"Name": "A", "Enabled": True}, {"Enabled": 3}, "bad"], "Modules": [{"Name": "M"}]}).encode())
    root = str(tmp_path)
    rows = {r["name"]: r for r in fsscan.scan(spark, root).collect()}
    assert {"a b+%.png", "x.blend", "ProjectVersion.txt"} <= set(rows) and not {"y.png", "README", "a b+%.png.meta"} & set(rows)
    assert rows["a b+%.png"]["unity_guid"] == "abc123" and rows["a b+%.png"]["metadata"]["width"] == 8 and rows["x.blend"]["metadata"]["dcc_source_kind"] == "blender"
    assert fsscan.project_type(fsscan.listing(spark, root), root).first()[0] == "unity"
    got = {(r["section"], r["key"], r["value"]) for r in fsscan.ini(fsscan.files(spark, root, "*.godot")).collect()}
    assert got == {("", "key", "0"), ("application", "config/name", '"Game"'), ("autoload", "A", '"*res://a.gd"')}
    assert {r["target"] for r in fsscan.resources(fsscan.files(spark, root, "*.godot")).collect()} == set()
    assert {(r["kind"], r["name"], r["enabled"]) for r in fsscan.uproject(fsscan.files(spark, root, "*.uproject")).collect()} == {("plugin", "A", True), ("module", "M", None)}


def test_names_and_links_of_a_tree(spark, tmp_path):
    put = lambda p, b=b"x": ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_bytes(b))
    for p in ("_Project/_a.png", "b.png", ".hidden/c.png", "d/e/f/g.png", "d/.x.png"):
        put(p)
    (tmp_path / "link.png").symlink_to(tmp_path / "b.png")
    (tmp_path / "loop").symlink_to(tmp_path)
    got = {r["path"].removeprefix(f"{tmp_path}/") for r in fsscan.listing(spark, str(tmp_path)).collect()}
    assert got == {"_Project/_a.png", "b.png", "d/e/f/g.png"}
    assert fsscan.unreadable(fsscan.walk(spark, f"{tmp_path}/none")).first()["kind"] == "tree_walk_failed"


def test_ignore_files(spark, tmp_path):
    put = lambda p, b="x": ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_text(b))
    rules = {".gitignore": "# note\n*.tmp\n/top.png\nbuild/\n!keep.tmp\nart/**/old?.png\n\\#x.png\n[ab]1.png\n", "art/.gitignore": "!*.tmp\n/own.png\n", ".ignore": "seen.png\n", "art/.ignore": "!seen.png\n", ".git/info/exclude": "secret.png\n"}
    for p, b in rules.items():
        put(p, b)
    files = ["a.tmp", "keep.tmp", "top.png", "art/top.png", "build/x.png", "art/build/y.png", "build.png", "art/z/w/old1.png", "art/old2.png", "art/old22.png", "#x.png", "a1.png", "c1.png", "art/b.tmp", "art/own.png", "art/z/own.png", "seen.png", "art/seen.png", "secret.png", "fine.png"]
    for p in files:
        put(p)
    got = {r["path"].removeprefix(f"{tmp_path}/") for r in fsscan.listing(spark, str(tmp_path), respect_ignores=True).collect()}
    assert got == {"keep.tmp", "art/top.png", "build.png", "art/old22.png", "c1.png", "art/b.tmp", "art/z/own.png", "art/seen.png", "fine.png"}
    one = ignores.matcher(spark, "/p", {".gitignore": "out/\n*.log"}, "*.bak")
    df = spark.createDataFrame([("/p/out/a.png",), ("/p/x.log",), ("/p/y.bak",), ("/p/z.png",)], "path string")
    assert {r["path"] for r in ignores.kept(df, one, "/p").collect()} == {"/p/z.png"}


def test_copies_by_size_start_and_whole(spark, tmp_path):
    body = bytes(range(256)) * 64
    for name, b in {"a": body, "b": body, "c": body[:-1] + b"!", "d": b"?" + body[1:], "e": body + b"x", "f": b"", "g": b""}.items():
        (tmp_path / f"{name}.bin").write_bytes(b)
    got = {r["path"].rsplit("/", 1)[1] for r in fsscan.duplicates(fsscan.listing(spark, str(tmp_path))).collect()}
    assert got == {"a.bin", "b.bin", "f.bin", "g.bin"}


def test_large_files_have_no_header(spark, tmp_path, monkeypatch):
    (tmp_path / "a.obj").write_bytes(b"mtllib a.mtl\nf 1 2 3\n")
    (tmp_path / "a.mtl").write_bytes(b"newmtl one\nKd 1 1 1\nnewmtl two\n")
    (tmp_path / "b.png").write_bytes(png(4, 4))
    rows = {r["name"]: r["metadata"] for r in fsscan.scan(spark, str(tmp_path)).collect()}
    assert rows["a.obj"]["face_count"] == 1 and rows["a.obj"]["material_count"] == 2 and rows["b.png"]["width"] == 4
    monkeypatch.setattr(fsscan, "MOST_BYTES", 10)
    rows = {r["name"]: r["metadata"] for r in fsscan.scan(spark, str(tmp_path)).collect()}
    assert rows["a.obj"] is None and rows["b.png"]["width"] == 4


def element(name: bytes, body: bytes) -> bytes:
    return name + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body


def fbx_node(name: bytes, props: bytes = b"", n: int = 0, inner: bytes = b"", at: int = 0) -> bytes:
    size = 13 + len(name) + len(props) + len(inner)
    return struct.pack("<IIIB", at + size, n, len(props), len(name)) + name + props + inner


def test_more_headers():
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 3) + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 257, 4, 1, 480) + struct.pack("<HHIHH", 277, 3, 1, 4, 0)
    assert read_header("tif", tiff) == {"width": 640, "height": 480, "has_alpha": True}
    exr = b"\x76\x2f\x31\x01\2\0\0\0" + b"channels\0chlist\0" + struct.pack("<I", 19) + b"A\0" + bytes(16) + b"\0" + b"dataWindow\0box2i\0" + struct.pack("<I4i", 16, 0, 0, 99, 49) + b"\0"
    assert read_header("exr", exr) == {"width": 100, "height": 50, "has_alpha": True}
    info = element(b"\x15\x49\xa9\x66", element(b"\x2a\xd7\xb1", (1_000_000).to_bytes(3, "big")) + element(b"\x44\x89", struct.pack(">d", 2500.0)))
    video = element(b"\xe0", element(b"\xb0", (320).to_bytes(2, "big")) + element(b"\xba", (200).to_bytes(2, "big")))
    tracks = element(b"\x16\x54\xae\x6b", element(b"\xae", element(b"\x83", b"\2") + element(b"\x86", b"A_OPUS")) + element(b"\xae", element(b"\x83", b"\1") + element(b"\x86", b"V_VP9") + video))
    assert read_header("webm", element(b"\x1a\x45\xdf\xa3", b"") + element(b"\x18\x53\x80\x67", info + tracks)) == {"duration_secs": 2.5, "video_codec": "V_VP9", "width": 320, "height": 200}
    flac = b"fLaC\0\0\0\x22" + bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + bytes(16)
    assert read_header("flac", flac) == {"sample_rate": 44100, "channels": 2, "bit_depth": 16, "duration_secs": 2.0}
    page = lambda position, body: b"OggS\0\0" + struct.pack("<q", position) + bytes(12) + bytes([1, len(body)]) + body
    assert read_header("ogg", page(0, b"\x01vorbis" + bytes(4) + b"\2" + struct.pack("<I", 8000) + bytes(14)) + page(16000, b"")) == {"channels": 2, "sample_rate": 8000, "duration_secs": 2.0}
    mp3 = b"ID3\3\0\0\0\0\0\5xxxxx" + b"\xff\xfb\x90\x00" + bytes(16000 - 4)
    assert read_header("mp3", mp3) == {"sample_rate": 44100, "channels": 2, "duration_secs": 1.0}
    aiff = b"FORM\0\0\0\0AIFFCOMM" + struct.pack(">IhIhHQ", 18, 1, 16000, 16, 16383 + 12, 8000 << 51)
    assert read_header("aiff", aiff) == {"channels": 1, "bit_depth": 16, "sample_rate": 8000, "duration_secs": 2.0}
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    trak = box(b"trak", box(b"tkhd", bytes(76) + struct.pack(">II", 64 << 16, 32 << 16)) + box(b"mdia", box(b"hdlr", bytes(8) + b"vide") + box(b"mdhd", bytes(12) + struct.pack(">II", 600, 1200)) + box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, 0, 50)) + box(b"stsd", bytes(12) + b"avc1")))))
    got = read_header("mp4", box(b"moov", box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2000)) + trak))
    assert got == {"duration_secs": 2.0, "width": 64, "height": 32, "video_codec": "avc1", "framerate": 25.0}


def test_fbx_counts():
    array = lambda kind, values, packed: kind + struct.pack("<III", len(values), packed, len(data := zlib.compress(raw := struct.pack(f"<{len(values)}{kind.decode()}", *values)) if packed else struct.pack(f"<{len(values)}{kind.decode()}", *values))) + data  # noqa: E731, F841
    at = 27 + 13 + len(b"Objects")
    inner = at + 13 + len(b"Geometry")
    vertices = fbx_node(b"Vertices", array(b"d", [0.0] * 12, 1), 1, at=inner)
    corners = fbx_node(b"PolygonVertexIndex", array(b"i", [0, 1, -3, 0, 2, -4], 0), 1, at=inner + len(vertices))
    geometry = fbx_node(b"Geometry", inner=vertices + corners, at=at)
    material = fbx_node(b"Material", at=at + len(geometry))
    body = fbx_node(b"Objects", inner=geometry + material, at=27)
    assert read_header("fbx", b"Kaydara FBX Binary  \0\x1a\0" + struct.pack("<I", 7400) + body + bytes(13)) == {"vertex_count": 4, "face_count": 2, "material_count": 1}
    assert read_header("fbx", b"; FBX 7.4.0 project file") == {}


def test_kept_files(spark, tmp_path):
    rules, warning = keep.learned_rules(spark, f"{tmp_path}/none.toml")
    assert (rules, warning) == (None, None)
    (tmp_path / "r.toml").write_text('prompt_version = 1\n[[rules]]\nkind = "token"\npattern = "tree"\ntags = ["Nature"]\nconfidence = 0.9\n')
    rules, warning = keep.learned_rules(spark, f"{tmp_path}/r.toml")
    assert [tuple(r) for r in rules.collect()] == [(0, "token", "tree", ["Nature"], 0.9)] and warning is None
    (tmp_path / "bad.toml").write_text("[[rules]\n")
    assert keep.learned_rules(spark, f"{tmp_path}/bad.toml")[1].startswith("rules_unreadable")
    (tmp_path / "t.json").write_text(json.dumps({"tags": [{"id": "1", "name": "a", "color": "#fff"}], "asset_tags": {"/x": ["1", "2"]}}))
    tags, bindings = keep.load_tags(spark, f"{tmp_path}/t.json")
    assert [tuple(r) for r in tags.collect()] == [("1", "a", "#fff", None)] and {tuple(r) for r in bindings.collect()} == {("/x", "1"), ("/x", "2")}
    (tmp_path / "c.json").write_text("{")
    assert keep.load_tags(spark, f"{tmp_path}/c.json")[0].count() == 0 and (tmp_path / "c.json.corrupt").exists() and not (tmp_path / "c.json").exists()


def test_snapshots_have_a_version_and_a_root(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("/p/a", 1)], "path string, size long")
    keep.save_snapshot(df, f"{tmp_path}/s", "/p/")
    keep.save_snapshot(df.unionByName(df), f"{tmp_path}/s", "/p")
    assert keep.load_snapshot(spark, f"{tmp_path}/s", "/p").count() == 2 and [x.name for x in tmp_path.iterdir()] == ["s"]
    assert keep.load_snapshot(spark, f"{tmp_path}/s", "/q") is None and keep.load_snapshot(spark, f"{tmp_path}/none", "/p") is None
    monkeypatch.setattr(keep, "VERSION", 8)
    assert keep.load_snapshot(spark, f"{tmp_path}/s", "/p") is None


def test_roots_and_path_status(tmp_path):
    (tmp_path / "game/ProjectSettings").mkdir(parents=True)
    (tmp_path / "game/Assets/Art").mkdir(parents=True)
    (tmp_path / "game/Other").mkdir()
    (tmp_path / "file").write_text("x")
    game = f"{tmp_path}/game"
    assert [fsscan.unity_project_root(p) for p in (game, f"{game}/Assets/Art", f"{game}/Other")] == [game, game, None]
    paths = [game, f"{tmp_path}/file", f"{tmp_path}/none", game]
    assert fsscan.path_status(paths) == [(game, "ok"), (paths[1], "not_a_directory"), (paths[2], "missing"), (game, "ok")]


def test_gltf_columns_equal_the_reader(spark):
    """Every topology, missing parts, and files that are no models: the expressions say what the reader of one file says."""
    base = {"accessors": [{"count": n} for n in (9, 4, 3, 0)], "materials": [{}, {}]}
    prim = lambda **p: {"meshes": [{"primitives": [p]}]}
    docs = [base, *({**base, **prim(attributes={"POSITION": i}, mode=m, **x)} for i in range(4) for m in range(7) for x in ({}, {"indices": 1}, {"indices": 3})), {**base, **prim(attributes={"POSITION": 0})}, {**base, **prim(attributes={})}, {**base, **prim(attributes={"POSITION": 9})}, {"meshes": []}, {}]
    bodies = [json.dumps(d).encode() for d in docs] + [b"", b"{", b"glTF", b"[1]"]
    bodies += [b"glTF" + struct.pack("<II", 2, 0) + struct.pack("<I", len(b)) + b"JSON" + b + b"rest\xff" for b in bodies[:4]]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, bodies))), "k int, content binary").select("k", fsscan.gltf_metadata(F.col("content")).alias("m"))
    got = {r["k"]: None if r["m"] is None else (r["m"]["vertex_count"], r["m"]["face_count"], r["m"]["material_count"]) for r in rows.collect()}
    for k, b in enumerate(bodies):
        if b == b"[1]":  # JSON, but no model: nothing to count
            assert got[k] in (None, (0, 0, 0))
            continue
        m = read_header("gltf", b)
        assert got[k] == (None if not m else (m["vertex_count"], m["face_count"], m["material_count"])), b[:200]


def test_a_walk_takes_as_many_jobs_as_it_needs(spark, tmp_path, monkeypatch):
    """A deep tree is one job; with few entries a task the same rows come from more of them."""
    folder = tmp_path
    for depth in range(30):
        folder = folder / f"d{depth}"
        folder.mkdir()
        for i in range(3):
            (folder / f"f{i}.png").write_bytes(b"x")
        (folder / ".hidden").mkdir()
        (folder / ".hidden" / "no.png").write_bytes(b"x")
    (tmp_path / ".gitignore").write_text("")
    jobs = []
    real = fsscan.stored
    monkeypatch.setattr(fsscan, "stored", lambda df, name: (jobs.append(name), real(df, name))[1])
    rows = lambda: sorted((r["path"], r["is_dir"], r["size"]) for r in fsscan.walk(spark, str(tmp_path)).collect() if not r["is_dir"] or r["size"] is not None)
    one = rows()
    assert len(one) == 30 * 4 + 1 and len(jobs) == 1
    monkeypatch.setattr(fsscan, "TASK_ENTRIES", 50)
    assert rows() == one and 2 <= len(jobs) - 1 <= 4


def test_times_are_exact_where_a_task_gives_directories_back(spark, tmp_path, monkeypatch):
    """A task's last rows hold directories without times beside files with them."""
    monkeypatch.setattr(fsscan, "TASK_ENTRIES", 2)
    for i in range(4):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"f{i}.png").write_bytes(b"x")
        os.utime(tmp_path / f"f{i}.png", ns=(1, 1_700_000_000_123_456_789 + i))
    found = fsscan.listing(spark, str(tmp_path))
    assert {(r["path"].rsplit("/", 1)[1], r["modified_nanos"]) for r in found.collect()} == {(f"f{i}.png", 1_700_000_000_123_456_789 + i) for i in range(4)}


def test_gltf_bytes_are_made_once_and_in_many_tasks(spark, sf_dir):
    rows = spark.createDataFrame([("7B7D",)], "h string").select(fsscan.gltf_metadata(F.unhex("h")).alias("m"))
    assert rows._jdf.queryExecution().analyzed().toString().count("unhex(") == 1 and rows.first()["m"]["vertex_count"] == 0
    assert queries.gltf_counts(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def python_steps(plan: str) -> int:
    """The most Python steps that a stage of a physical plan runs in each task."""
    most, above = 0, []
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [a for a in above if a[0] < indent]
        n = 0 if "Exchange" in line else (above[-1][1] if above else 0) + bool(re.search("MapIn(Pandas|Arrow)|Scan ExistingRDD|EvalPython", line))
        above.append((indent, n))
        most = max(most, n)
    return most


def test_a_task_of_a_scan_runs_one_python(spark, tmp_path, monkeypatch):
    os.makedirs(f"{tmp_path}/p/a")
    for name, body in {"a/x.png": png(3, 4), "a/x.png.meta": b"guid: g1\n", "y.obj": b"mtllib y.mtl\nf 1 2 3\n", "y.mtl": b"newmtl m\n", "no.wav": b"", ".gitignore": b"*.wav\n"}.items():
        with open(f"{tmp_path}/p/{name}", "wb") as f:
            f.write(body)
    plans, real = [], fsscan.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(fsscan, "stored", stored)
    found = fsscan.scan(spark, f"{tmp_path}/p", respect_ignores=True)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {(r["name"], r["unity_guid"], r["metadata"] and r["metadata"]["width"], r["metadata"] and r["metadata"]["material_count"]) for r in found.collect()} == {("x.png", "g1", 3, None), ("y.obj", None, None, 1), ("y.mtl", None, None, None)}
    assert max(map(python_steps, plans)) == 1 and not any("ExistingRDD" in p for p in plans)


def test_a_task_sends_on_what_it_has_made():
    """Few rows, few bytes and no more than one file above them at a time, however many come in."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    run = fsscan._made(Rows(), lambda rows: ((b"x" * n,) for n, in rows), "content binary")
    sent = lambda *sizes: [b.num_rows for b in run([pa.record_batch({"n": list(sizes)})])]
    assert sent(*[1] * 2500) == [1000, 1000, 500] and sent() == []
    assert sent(600_000, 600_000, 3 << 20, 0, 5) == [2, 1, 2]


def test_the_tree_is_made_in_many_tasks(spark, sf_dir):
    assert queries._dealt(spark, sf_dir).select(F.spark_partition_id()).distinct().count() > 4


def test_a_tree_of_many_keys_has_its_sounds(spark, tmp_path):
    """A sound's length in bytes is 32 bits: 32,000 a key were too many from key 134,218 on."""
    spark.createDataFrame([(400_003, 0)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [(r["path"], r["duration_secs"]) for r in queries.scan_tree(spark, str(tmp_path)).collect()] == [("_n0/in/s400003.wav", 400003.0)]
