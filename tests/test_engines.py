import unicodedata

from pyspark.sql import functions as F

from assetloom.operators import engines
from assetloom.sources import fsscan
from assetloom.sources.catalog import asset_view, catalog


def paths(spark, *names):
    return catalog(spark.createDataFrame([(n, 1, 1) for n in names], "path string, size long, modified long"))


def texts(spark, *rows):
    return spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary")


def test_unity_texts(spark):
    body = "%YAML\n--- !u!1 &100\n--- !u!4 &2\n--- !u!114 &3\n--- !u!4 &5\n--- !u!9999 &6\nx --- !u!20 &1"
    df = spark.createDataFrame([("/a", body)], "path string, content string")
    assert engines.unity_components(df).first()["components"] == ["GameObject", "MonoBehaviour", "Transform"]
    v = spark.createDataFrame([("/v", "m_EditorVersionWithRevision: 6000.1 (abc)\nm_EditorVersion: 6000.1\n"), ("/w", "m_EditorVersion:\n"), ("/x", "m_EditorVersion: 5\n")], "path string, content string")
    assert {tuple(r) for r in engines.unity_version(v).collect()} == {("/v", "6000.1", "6000.1 (abc)"), ("/x", "5", None)}
    g = "0123456789abcdef0123456789abcdef"
    metas = texts(spark, ("/p/Library/com.a@1.0/Lit.shader.meta", f"x: 1\nguid: {g}\n"), ("/p/Library/com.b@2/Z.cs.meta", f"guid: {g}\n"), ("/p/Library/com.b@2/Bad.cs.meta", f"guid: {g}0\n"), ("/p/Library/com.b@2/Late.cs.meta", "#" * 256 + f"\nguid: {g[::-1]}\n"))
    assert [tuple(r) for r in engines.package_index(metas, "/p/Library").collect()] == [(g, "com.b", "Z.cs")]


def test_godot_project(spark):
    ini = fsscan.ini(texts(spark, ("/p/project.godot", 'config_version=5\n[application]\nconfig/name="My Game"\nrun/main_scene="res://m.tscn"\nconfig/features=PackedStringArray("Mobile", "4.2")\n[autoload]\nA="*res://a.gd"\nB="res://b.gd"\n[input]\njump={x}\njump/dead=1\n[rendering]\nquality/driver/driver_name="GLES2"'), ("/q/project.godot", "config_version=4\n")))
    got = {r["path"]: r for r in engines.godot_project(ini).collect()}
    p = got["/p/project.godot"]
    assert (p["name"], p["version"], p["main_scene"], p["renderer"], p["input_actions"]) == ("My Game", "4.2", "res://m.tscn", "GLES2", ["jump"])
    assert [tuple(a) for a in p["autoloads"]] == [("A", "res://a.gd", True), ("B", "res://b.gd", False)]
    assert (got["/q/project.godot"]["name"], got["/q/project.godot"]["version"]) == ("Unknown", "3.x")
    odd = spark.createDataFrame([("[a, 'b', ]",), ("plain",), ('"',), ("PackedStringArray()",)], "v string")
    assert [r[0] for r in odd.select(engines.godot_array(F.col("v"))).collect()] == [["a", "b"], [], [], []]


def test_godot_graph_and_unused(spark):
    nfd = unicodedata.normalize("NFD", "é")
    assets = paths(spark, f"/p/{nfd}.png", "/p/a.gd", "/p/b.png", "/p/main.tscn", "/p/x.cfg", "/out/z.png")
    targets = spark.createDataFrame([("res://é.png",), ("res://a.gd",)], "target string")
    assert {r["path"] for r in engines.godot_unused(assets, targets, "/p").collect()} == {"/p/b.png"}
    refs = spark.createDataFrame([("/p/main.tscn", "res://a.gd"), ("/p/main.tscn", "res://é.png"), ("/p/main.tscn", "res://disk.bin"), ("/p/main.tscn", "res://a.gd")], "path string, target string")
    nodes, edges = engines.godot_graph(assets, refs, spark.createDataFrame([("/p/disk.bin",)], "path string"), "/p")
    kinds = {r["id"]: r["kind"] for r in nodes.collect()}
    assert kinds["res://é.png"] == "missing" and kinds["res://disk.bin"] == "unscanned" and kinds["res://a.gd"] == "asset" and "res://x.cfg" not in kinds and edges.count() == 4
    one = spark.createDataFrame([("res://a/b",), ("res://",), ("x",)], "r string").select(engines.absolute_path(F.col("r"), "/p/"))
    assert [r[0] for r in one.collect()] == ["/p/a/b", None, None]


def test_sibling_textures_by_place(spark):
    models = spark.createDataFrame([("/p/m/tree.fbx",)], "path string")
    listed = spark.createDataFrame([(x,) for x in ("/p/m/Maps/Bark.png", "/p/m/Textures/bark.PNG", "/p/textures/leaf.tga", "/p/m/leaf.txt", "/p/other/no.png", "/p/Maps/leaf.tga", "/p/m/own.png")], "path string")
    got = {(r["name"], r["texture"]) for r in engines.sibling_textures(models, listed).collect()}
    assert got == {("bark.png", "/p/m/Textures/bark.PNG"), ("leaf.tga", "/p/textures/leaf.tga"), ("own.png", "/p/m/own.png")}



def test_sibling_textures_are_found_once_a_directory(spark):
    """Every model of a directory gets the same rows, no side is broadcast, and nothing is sorted by model and name."""
    models = spark.createDataFrame([("/p/m/tree.fbx",), ("/p/m/oak.fbx",), ("/p/m/oak.fbx",)], "path string")
    listed = spark.createDataFrame([("/p/m/A.png",), ("/p/m/a.png",), ("/p/m/tex/a.png",), ("/p/tex/no.png",)], "path string")
    found = engines.sibling_textures(models, listed)
    assert sorted(map(tuple, found.collect())) == [("/p/m/oak.fbx", "a.png", "/p/m/A.png"), ("/p/m/tree.fbx", "a.png", "/p/m/A.png")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_plans_and_reports(spark):
    s = spark.createDataFrame([("/a", "Tree", "kind", None), ("/b", "Tree", "kind", "new"), ("/x", "Tree", "kind", None), ("/a", "Old", "kind", "existing")], "path string, label string, category string, source string")
    accepted = s.select("path", "label", "category")
    got = {(r["source"], r["label"]): r["paths"] for r in engines.apply_plan(s, spark.createDataFrame([("/a",), ("/b",)], "path string"), accepted).collect()}
    assert got == {("new", "Tree"): ["/a", "/b"], ("existing", "Old"): ["/a"]}
    w = spark.createDataFrame([("tree_walk_failed", 2), ("asset_unreadable", 3), ("cache_not_saved", 9), ("ignore_rules_unusable", 1)], "kind string, count long")
    assert tuple(engines.unread_entries(w).first()) == (5, True) and tuple(engines.unread_entries(w.where("false")).first()) == (0, False)
    plan = spark.createDataFrame([("/a", True), ("/b", True), ("/c", False)], "path string, will_change boolean")
    refs = spark.createDataFrame([("/a", "/s1"), ("/a", "/s2"), ("/a", "/s1"), ("/c", "/s1")], "path string, src_path string")
    assert tuple(engines.guarded_renames(plan, refs).first()) == (1, 2)
    cost = engines.learning_cost(spark.createDataFrame([(1, "m", 4003, 10, 5), (2, "none", 4003, 10, 5)], "request_id long, model string, prompt_bytes long, n_samples long, n_tags long"), spark.createDataFrame([("m", 1_000_000, 5_000_000)], "model string, input_per_m long, output_per_m long"))
    assert {tuple(r) for r in cost.collect()} == {(1, 1000, 1150, 1), (2, 0, 0, 0)}


def test_guarded_renames_send_references_to_changed_names_only(spark):
    plan = spark.createDataFrame([("/a", True), ("/b", False)], "path string, will_change boolean")
    refs = spark.createDataFrame([("/a", "/s1"), ("/a", "/s2"), ("/a", "/s1"), ("/b", "/s1")], "path string, src_path string")
    found = engines.guarded_renames(plan, refs)
    assert tuple(found.first()) == (1, 2)
    sent = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(" in x]
    assert sent and not [x for x in sent if "src_path" in x.split("hashpartitioning(")[1].split(")")[0]]  # by path alone, so counts need no other shuffle


def test_keys_of_the_view_are_dealt_out_before_the_work(spark, sf_dir):
    """Filters over made columns, too, come after: below the exchange they would be one task's."""
    plan = asset_view(spark, sf_dir).select("path")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "Filter" in above and "Filter" not in below and "substring_index" not in below
    assert asset_view(spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
