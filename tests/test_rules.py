import itertools

import pytest
from pyspark.sql import functions as F

from assetloom.functions import text
from assetloom.operators import cross, rules
from assetloom.plans import config
from assetloom.sources.catalog import METADATA, catalog

META = "struct<" + ",".join(f"{k}:{v}" for k, v in METADATA.items()) + ">"


def listing(spark, rows):
    """rows: path, size, modified and a dict of metadata or None."""
    full = [(p, s, m, None if d is None else tuple(d.get(k) for k in METADATA)) for p, s, m, d in rows]
    return catalog(spark.createDataFrame(full, f"path string, size long, modified long, metadata {META}"))


def issues(df, c):
    return {(r["asset_path"], r["rule_id"]) for r in rules.asset_issues(df, c).collect()}


def test_catalog_drops_sidecars_and_names_tools(spark):
    df = listing(spark, [("/p/a.png", 1, 1, None), ("/p/a.png.meta", 1, 1, None), ("/p/README", 1, 1, None), ("/p/.hidden", 1, 1, None), ("/p/x.PSD", 1, 1, None)])
    rows = {r["path"]: r for r in df.collect()}
    assert set(rows) == {"/p/a.png", "/p/x.PSD"}
    assert rows["/p/a.png"]["metadata"] is None and rows["/p/x.PSD"]["metadata"]["dcc_source_kind"] == "photoshop" and rows["/p/x.PSD"]["extension"] == "PSD"


def test_texture_rules_in_order(spark):
    side = lambda w, h=None, **k: {"width": w, "height": h or w, **k}
    rows = [("/p/odd.png", 1, 1, side(100)), ("/p/big.png", 1, 1, side(8192)), ("/p/tiny.png", 1, 1, side(2)), ("/p/wide.png", 1, 1, side(512, 256)), ("/p/heavy.png", 11 << 20, 1, side(512)), ("/p/plain.dds", 1, 1, side(512, mipmap_count=1)), ("/p/zero.png", 1, 1, side(0, 4)), ("/p/nodims.tga", 11 << 20, 1, None)]
    found = issues(listing(spark, rows), config.RuleConfig(texture=config.Texture(enabled=True, warn_non_square=True)))
    want = {"/p/odd.png": "texture.pot", "/p/big.png": "texture.max_size", "/p/tiny.png": "texture.min_size", "/p/wide.png": "texture.non_square", "/p/heavy.png": "texture.file_size", "/p/plain.dds": "texture.no_mipmaps", "/p/zero.png": "texture.pot", "/p/nodims.tga": "texture.file_size"}
    assert found == set(want.items())


def test_audio_words_are_whole(spark):
    long = {"duration_secs": 40.0, "sample_rate": 44100, "channels": 2}
    rows = [("/p/white_noise.wav", 1, 1, long), ("/p/UIClick.wav", 1, 1, long), ("/p/orchestral_build.wav", 1, 1, long), ("/p/door-hit.wav", 1, 1, long), ("/p/big.wav", 30 << 20, 1, None)]
    assert issues(listing(spark, rows), config.RuleConfig(audio=config.Audio(enabled=True))) == {("/p/UIClick.wav", "audio.sfx_duration"), ("/p/door-hit.wav", "audio.sfx_duration")}


def test_color_space_follows_suffix_list(spark):
    rows = [("/p/a_normal.png", 1, 1, {"color_space": "sRGB"}), ("/p/a_r.png", 1, 1, {"color_space": "sRGB"}), ("/p/b_n.png", 1, 1, {"color_space": "Linear"}), ("/p/c.png", 1, 1, {"color_space": "sRGB"})]
    assert issues(listing(spark, rows), config.RuleConfig()) == {("/p/a_normal.png", "texture.color_space")}


NAMES = ["hero armor.png", "  x.png", "###.png", "T_ok.png", "SomeThing.png", "SOME_THING.png", "a-b c.png", "file.name.png", "木.png", "plain.png", "x" * 70 + ".png", "_.png"]


@pytest.mark.parametrize("style,prefix", list(itertools.product(["any", "PascalCase", "snake_case", "camelCase", "kebab-case"], [None, "T_"])))
def test_fix_removes_its_issue_and_is_stable(spark, style, prefix):
    c = config.Naming(max_length=64, case_style=style, texture_prefix=prefix, forbid_chinese=True)
    df = listing(spark, [(f"/p/{n}", 1, 1, None) for n in NAMES])
    first = {r["name"]: r["new"] for r in df.select("name", rules.fix_name(c).alias("new")).collect()}
    assert first["x" * 70 + ".png"] is None
    fixed = [n for n in first.values() if n]
    again = listing(spark, [(f"/q{i}/{n}", 1, 1, None) for i, n in enumerate(fixed)])
    before = {p.rsplit("/", 1)[1]: r for p, r in issues(df, config.RuleConfig(naming=c, texture=config.Texture(color_space=False)))}
    after = {p: r for p, r in issues(again, config.RuleConfig(naming=c, texture=config.Texture(color_space=False)))}
    for old, new in first.items():
        if new:
            assert before[old] not in {r for p, r in after.items() if p.endswith("/" + new)}


def test_renames(spark):
    df = spark.createDataFrame([("hero armor-v2.PNG",), ("noext",)], "name string")
    new = lambda *a: [r[0] for r in df.select(rules.renamed(F.col("name"), *a)).collect()]
    assert new("find_replace", "", "x") == ["hero armor-v2.PNG", "noext"]
    assert new("find_replace", ".", "!") == ["hero armor-v2!PNG", "noext"]
    assert new("add_suffix", "_a") == ["hero armor-v2_a.PNG", "noext_a"]
    assert new("title_case") == ["Hero_Armor_V2.PNG", "Noext"]
    assert new("remove_suffix", "-v2") == ["hero armor.PNG", "noext"]
    with pytest.raises(ValueError):
        new("reverse")


def test_name_problems_and_text(spark):
    got = spark.createDataFrame([(n,) for n in ("", "..", "a/b", "a ", "con.png", "LPT9", "console.png")], "n string").select(text.name_problem(F.col("n"))).collect()
    assert [r[0] for r in got] == ["empty", "empty", "separator", "ending", "reserved", "reserved", None]
    one = spark.createDataFrame([('=1+"x"', 2675 * 1024 // 1000)], "c string, n long")
    assert one.select(text.csv_cell(F.col("c")), text.human_size(F.col("n")), text.age(F.lit(7300))).first()[:] == ('"\'=1+""x"""', "2.7 KB", "2h")
    words = spark.createDataFrame([("HeroArmor_v2-木box",)], "n string").select(text.tag_words(F.col("n")), text.sound_words(F.lit("white_noise.UIClick"))).first()
    assert words[0] == ["hero", "armor", "v2", "木", "box"] and words[1] == ["white", "noise", "ui", "click"]


def test_config_is_strict_and_globs_cross_folders(spark):
    c = config.load('[texture]\nenabled = true\nmax_size = 64\n[ignore]\npatterns = ["*.tmp", "Art/**/old_?.{png,tga}"]')
    assert c.texture.max_size == 64 and c.texture.min_size == 4 and c.ignore[0] == "*.tmp"
    with pytest.raises(ValueError):
        config.load("[texture]\nmax_sise = 1")
    for bad in ("a[", "{a", "a}"):
        with pytest.raises(ValueError):
            config.glob_regex(bad)
    df = spark.createDataFrame([(p,) for p in ("/r/a/b.tmp", "/r/Art/x/y/old_1.png", "/r/Art/old_2.tga", "/r/Art/old_22.tga", "/r/art/old_1.png")], "path string")
    assert {r[0] for r in rules.not_ignored(df, c.ignore, "/r").collect()} == {"/r/Art/old_22.tga", "/r/art/old_1.png"}


def test_pbr_sets(spark):
    rows = [(f"/p/{n}.png", 1, 1, None) for n in ("Rock_BaseColor", "rock_normal", "Wood_Albedo", "Iron_BaseColor", "Iron_Normal", "Iron_ORM", "Lone_Normal", "odd")] + [("/q/Rock_Normal.png", 1, 1, None)]
    sets = {r["key"]: r for r in cross.pbr_sets(listing(spark, rows)).collect()}
    assert set(sets) == {"rock", "wood", "iron"}
    assert sets["rock"]["complete"] and sets["rock"]["display"] == "Rock" and sets["wood"]["missing"] == ["normal"] and sets["iron"]["channels"] == ["ao", "basecolor", "metallic", "normal", "roughness"]


def test_stale_exports_look_upward(spark):
    rows = [("/p/src/Tree.blend", 1, 1000, None), ("/p/tree.FBX", 1, 100, None), ("/p/sources/tree.obj", 1, 200, None), ("/p/rock.ma", 1, 100, None), ("/p/rock.fbx", 1, 50, None), ("/p/late.psd", 1, 500, None), ("/p/late.png", 1, 400, None), ("/p/deep/late.png", 1, 1, None)]
    got = {(r["source"], r["export"], r["age_secs"]) for r in cross.stale_exports(listing(spark, rows)).collect()}
    assert got == {("/p/src/Tree.blend", "/p/sources/tree.obj", 800), ("/p/late.psd", "/p/late.png", 100)}
    folders = spark.createDataFrame([("/a/_source/b/src",)], "d string").select(cross.candidate_dirs(F.col("d"), config.DccSource())).first()[0]
    assert folders == ["/a/_source/b/src", "/a/_source/b", "/a/_source/b/sources", "/a/_source/b/_source", "/a", "/a/sources", "/a/src"]


def test_duplicates(spark):
    rows = [("/p/B.bin", 3, b"abc"), ("/p/a.bin", 3, b"abc"), ("/p/c.bin", 3, b"abd"), ("/p/e1", 0, b""), ("/p/e2", 0, b""), ("/p/e3", 0, b""), ("/p/null", 3, None)]
    files = spark.createDataFrame(rows, "path string, size long, content binary")
    assert {(r["n"], r["original"], r["anchor"]) for r in cross.duplicates(files).collect()} == {(2, "/p/a.bin", "/p/B.bin"), (3, "/p/e1", "/p/e2")}
    assert {tuple(r) for r in cross.duplicate_members(files).collect()} == {("/p/a.bin", "/p/B.bin"), ("/p/e1", "/p/e2"), ("/p/e1", "/p/e3")}


def test_default_forbidden_characters(spark):
    df = listing(spark, [(f"/p/a{c}b.txt", 1, 1, None) for c in "; @~,'!<?"])
    assert {p for p, r in issues(df, config.RuleConfig()) if r == "naming.forbidden_char"} == {f"/p/a{c}b.txt" for c in " !<?"}


def test_missing_and_unused(spark):
    guid = lambda c: c * 32
    refs = spark.createDataFrame([("/a.prefab", guid("1"), "prefab", guid("9")), ("/a.prefab", guid("1"), "prefab", guid("2")), ("/a.prefab", guid("1"), "PREFAB", guid("9")), ("/b.spriteatlas", guid("5"), "spriteatlas", guid("3")), ("/a.prefab", guid("1"), "prefab", guid("0")), ("/a.prefab", guid("1"), "prefab", None), ("/a.prefab", guid("1"), "prefab", guid("7"))], "src_path string, src_guid string, src_extension string, guid string")
    known = spark.createDataFrame([(f"/{c}.x", guid(c), "scene" if c == "4" else "prefab") for c in "12346"], "path string, guid string, asset_type string")
    packs = spark.createDataFrame([(guid("7"), "com.x")], "guid string, package string")
    assert {tuple(r) for r in cross.missing_references(refs, known, packs).collect()} == {("/a.prefab", guid("9"))}
    assert {r["path"] for r in cross.unused_assets(known, refs).collect()} == {"/1.x", "/6.x"}
    assert cross.missing_references(refs, known.where("false"), packs).count() == 0
