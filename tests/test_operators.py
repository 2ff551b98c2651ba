import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetloom.functions import text
from assetloom.operators import browse, graph, history, snapshot, stats, tagging
from assetloom.streaming import watch


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, size long, modified long")


def test_folder_rollup_counts_all_below(spark):
    df = spark.createDataFrame([("/p", 1), ("/p/a", 2), ("/p/a/b", 4), ("/q", 8)], "dir string, size long")
    empty = spark.createDataFrame([("/p/a/none",)], "path string")
    got = {(r["path"], r["depth"], r["n_files"], r["total_size"]) for r in stats.folder_rollup(df, "/p", empty).collect()}
    assert got == {("/p", 0, 3, 7), ("/p/a", 1, 2, 6), ("/p/a/b", 2, 1, 4), ("/p/a/none", 2, 0, 0)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=30), st.integers(0, 300))
def test_eviction_is_oldest_first(spark, rows, budget):
    rows = [(f"/f{i:02}", s, m) for i, (s, m) in enumerate(rows)]
    left, want = sum(s for _, s, _ in rows), set()
    for p, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if left > budget:
            want.add(p)
            left -= s
    assert {r["path"] for r in stats.evicted(files(spark, rows), budget, buckets=4).collect()} == want


def test_filters_leave_nulls_out(spark):
    df = spark.createDataFrame([("/p/a.png", "a.png", "/p", "png", "texture", 5, (None, None)), ("/p/sub/B_50%.png", "B_50%.png", "/p/sub", "PNG", "texture", 9, (64, False))], "path string, name string, dir string, extension string, asset_type string, size long, metadata struct<width:long,has_alpha:boolean>")
    names = lambda **k: {r["name"] for r in browse.browse(df, browse.FilterSpec(**k)).collect()}
    assert names(width=(1, None)) == {"B_50%.png"} and names(has_alpha=False) == {"B_50%.png"} and names(search=" _50% ") == {"B_50%.png"}
    assert names(folder="/p") == {"a.png", "B_50%.png"} and names(folder="/p/su") == set() and names(extensions=("png",)) == {"a.png", "B_50%.png"}


def test_neighbourhood_keeps_direction(spark):
    edge = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("x", "z")], "src string, dst string")
    got = {(r["id"], r["direction"], r["hop"]) for r in graph.neighbourhood(edge, F.col("id") == "a").collect()}
    assert got == {("a", "forward", 0), ("b", "forward", 1), ("c", "forward", 2), ("a", "backward", 0), ("x", "backward", 1)}


def test_yaml_references(spark):
    g = "0123456789abcdef0123456789ABCDEF"
    body = f"%YAML\n  m: {{fileID: 12, guid: {g}, type: 3}}\n  m: {{fileID: 12, guid: {g}, type: 3}}\n  n: {{fileID: -1, guid: {g}0, type: 2}}\n# guid: {g}\n  k: {{guid: short, guid: {g}}}"
    got = [tuple(r) for r in graph.yaml_references(spark.createDataFrame([("/a", body)], "path string, content string")).collect()]
    assert got == [("/a", g.lower(), 12, 3)]
    res = spark.createDataFrame([("/a", 'x("res://a.tscn") "res://b" "res://b" \'res://c\'')], "path string, content string")
    assert {r["target"] for r in graph.resource_references(res).collect()} == {"res://a.tscn", "res://b"}


def test_incremental_equals_full_scan(spark):
    rng, kind = random.Random(3), "path string, modified_nanos long, size long, meta_modified_nanos long"
    make = lambda n: [(f"/f{i}", rng.randrange(3), rng.randrange(3), rng.choice([None, 1])) for i in range(60) if rng.random() < n]
    before, now = spark.createDataFrame(make(0.7), kind), spark.createDataFrame(make(0.7), kind)
    wanted = snapshot.diff(before, now).where("change IN ('added', 'changed')").select("path")
    merged = snapshot.merge(before, now, now.join(wanted, "path", "left_semi"))
    assert sorted(merged.collect(), key=str) == sorted(now.collect(), key=str)


def test_identity_needs_one_on_each_side(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, name string, size long")
    got = snapshot.moved(f([("/a/x", "x", 1), ("/a/y", "y", 1), ("/b/y", "y", 1)]), f([("/n/x", "x", 1), ("/n/y", "y", 1)]), ("name", "size")).collect()
    assert [(r["from_path"], r["to_path"]) for r in got] == [("/a/x", "/n/x")]


def test_sample_takes_types_in_turn(spark):
    rows = [("/d", t, f"/d/{t}{i}") for t, n in (("audio", 1), ("model", 5), ("texture", 9)) for i in range(n)]
    got = tagging.stratified_sample(spark.createDataFrame(rows, "dir string, asset_type string, path string"), 5, F.md5("path"))
    assert sorted(r["asset_type"] for r in got.collect()) == ["audio", "model", "model", "texture", "texture"]


def test_near_equal_groups_fold(spark):
    rows = [(f"/p/a/tree_{i}.png", f"tree_{i}.png", "/p/a", "png", "texture", 1, None) for i in range(20)] + [(f"/p/a/trees_{i}.png", f"trees_tree_{i}.png", "/p/a", "png", "texture", 1, None) for i in range(100)]
    df = spark.createDataFrame(rows, "path string, name string, dir string, extension string, asset_type string, size long, metadata struct<width:long,height:long>")
    got = {r["name"]: r for r in tagging.merged_groups(df, "/p").collect()}
    assert "Tree" in got and "Trees" not in got and got["Tree"]["n"] == 120 and got["Tree"]["color"] in tagging.PALETTE


def test_tags(spark):
    b = spark.createDataFrame([("/a/x", 1), ("/b/x", 1), ("/b/x", 2)], "path string, tag_id long")
    tags = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    assert {tuple(r) for r in tagging.move_bindings(b, "/a", "/b").collect()} == {("/b/x", 1), ("/b/x", 2)}
    assert tagging.bind(b, spark.createDataFrame([("/a/x", 1), ("/a/x", 9)], "path string, tag_id long"), tags).count() == 3
    assert {r["path"]: r["tags"] for r in tagging.tags_of(b, tags).collect()}["/b/x"] == ["one", "two"]


def test_copy_names_and_lenient_json(spark):
    f = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {r["path"]: r["copy"] for r in history.free_copy_name(f("/a/x.png", "/a/y"), f("/a/x copy.png", "/a/x copy 2.png")).collect()}
    assert got == {"/a/x.png": "/a/x copy 3.png", "/a/y": "/a/y copy"}
    raw = spark.createDataFrame([('{"n": 1}',), ('text\n```json\n{"n": 2}\n```',), ("none",)], "raw string")
    assert [r[0] and r[0]["n"] for r in raw.select(history.lenient_json("raw", "n int")).collect()] == [1, 2, None]


def test_stream_equals_batch_fold(spark, tmp_path):
    rng, kinds = random.Random(5), ["create", "modify", "remove"]
    rows = [(i, f"2024-01-01 00:00:{i:02}", rng.choice(kinds), f"/p/d{rng.randrange(3)}/f{rng.randrange(4)}.png", i) for i in range(40)]
    rows += [(40, "2024-01-01 00:00:40", "remove", "/p/d1", 0), (41, "2024-01-01 00:00:41", "create", "/p/d1/new.png", 7), (42, "2024-01-01 00:00:42", "create", "/p/.git/x", 7)]
    schema = "event_id long, ts string, kind string, path string, size long"
    want: dict[str, int] = {}
    for k in range(0, 43, 10):
        last = {}
        for _, _, kind, path, size in rows[k : k + 10]:
            last[path] = (kind, size)
        gone = [p for p, (kind, _) in last.items() if kind == "remove"]
        want = {p: s for p, s in want.items() if not any(p == g or p.startswith(g + "/") for g in gone)}
        want |= {p: s for p, (kind, s) in last.items() if kind != "remove" and "/." not in p}
        spark.createDataFrame(rows[k : k + 10], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = watch.follow(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/cat", f"{tmp_path}/cp", "/p", trigger={"availableNow": True})
        q.awaitTermination()
    final = max(int(p.name[2:]) for p in (tmp_path / "cat").iterdir() if p.name.startswith("v="))
    assert {r["path"]: r["size"] for r in spark.read.parquet(f"{tmp_path}/cat/v={final}").collect()} == want


def sequential_fold(groups: dict[str, set]) -> dict[str, set]:
    """Groups one after the other by size and name, each into the first kept one that is near."""
    kept: dict[str, set] = {}
    for name in sorted(groups, key=lambda x: (-len(groups[x]), x)):
        for other, files in kept.items():
            a, b, both = name.lower(), other.lower(), len(groups[name] & files)
            near = min(len(groups[name]), len(files)) / max(len(groups[name]), len(files)) > 0.8 and both / (len(groups[name]) + len(files) - both) > 0.8
            if (a.startswith(b) or b.startswith(a)) and near:
                kept[other] = files | groups[name]
                break
        else:
            kept[name] = set(groups[name])
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_folded_groups_equal_a_sequential_fold(spark, seed):
    rng = random.Random(seed)
    words = ["tree", "trees", "treesa", "rock", "rocks", "wall", "walls", "wallsb"]
    names = ["_".join(w for w in words if rng.random() < (0.95 if w.startswith(("tree", "wall")) else 0.5)) + f"_{i}" for i in range(120)]
    rows = [(f"/p/a/{n}.png", f"{n}.png", "/p/a", "png", "texture", 1, None) for n in names]
    df = spark.createDataFrame(rows, "path string, name string, dir string, extension string, asset_type string, size long, metadata struct<width:long,height:long>")
    raw: dict[str, set] = {}
    for r in tagging.raw_groups(df, "/p").collect():
        raw.setdefault(r["name"], set()).add(r["path"])
    want = {n: len(f) for n, f in sequential_fold(raw).items()}
    assert {r["name"]: r["n"] for r in tagging.merged_groups(df, "/p").collect()} == dict(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:12])


def test_merged_groups_equal_brute_force_on_the_view(spark, sf_dir):
    from assetloom.plans import queries
    from assetloom.sources import catalog

    raw: dict[str, set] = {}
    for r in tagging.raw_groups(catalog.asset_view(spark, sf_dir), catalog.ROOT).collect():
        raw.setdefault(r["name"], set()).add(r["path"])
    folded = sequential_fold(raw)
    want = sorted(folded, key=lambda n: (-len(folded[n]), n))[:12]
    got = {r["name"]: r for r in queries.FOUND["tag_groups_merged"](spark, sf_dir).collect()}
    assert {n: (r["n"], r["samples"]) for n, r in got.items()} == {n: (len(folded[n]), sorted(folded[n])[:3]) for n in want}


def test_rename_events_move_files_and_tags(spark):
    catalog = [("/p/a/x.png", 5, 1), ("/p/a/y.png", 6, 2), ("/p/dir/one.png", 7, 3), ("/p/dir/sub/two.wav", 8, 4), ("/p/gone/z.png", 9, 5), ("/p/far/w.png", 4, 6)]
    rows = [(p, p.rsplit("/", 1)[1], p.rsplit(".", 1)[1], s, m, f"meta {p}") for p, s, m in catalog]
    assets = spark.createDataFrame(rows, "path string, name string, extension string, size long, modified long, note string")
    events = [
        (1, "rename", "/p/a/x.png", "/p/a/x2.PNG", None, None), (2, "rename", "/p/a/y.png", "/p/a/y.jpg", 60, 20), (3, "rename", "/p/dir", "/p/moved", None, None), (4, "remove", "/p/gone", None, None, None),
        (5, "remove", "/p/far/w.png", None, None, None), (6, "create", "/p/near/w.png", None, 4, 6), (7, "rename", "/p/q.png.meta", "/p/r.png.meta", 3, 3), (8, "rename", "/p/same.png", "/p/same.png", 1, 1),
        (9, "rename", "/p/.git/a", "/p/.git/b", 1, 1), (10, "create", "/p/noext", None, 1, 1),
    ]
    feed = spark.createDataFrame([(i, i, *rest) for i, *rest in events], "ts long, event_id long, kind string, path string, to_path string, size long, modified long")
    b = watch.apply_batch(assets, feed, "/p")
    got = {r["path"]: (r["size"], r["modified"], r["note"]) for r in b.catalog.collect()}
    assert got == {
        "/p/a/x2.PNG": (5, 1, "meta /p/a/x.png"), "/p/a/y.jpg": (60, 20, None), "/p/moved/one.png": (7, 3, "meta /p/dir/one.png"), "/p/moved/sub/two.wav": (8, 4, "meta /p/dir/sub/two.wav"),
        "/p/near/w.png": (4, 6, None), "/p/q.png": (3, 3, None), "/p/r.png": (3, 3, None),
    }
    assert {tuple(r) for r in b.renamed.collect()} == {("/p/a/x.png", "/p/a/x2.PNG", False), ("/p/a/y.png", "/p/a/y.jpg", False), ("/p/dir", "/p/moved", True), ("/p/far/w.png", "/p/near/w.png", False)}
    assert {r[0] for r in b.reap.collect()} == {"/p/gone/z.png"}
    assert {r[0] for r in b.removed.collect()} == {"/p/a/x.png", "/p/a/y.png", "/p/dir/one.png", "/p/dir/sub/two.wav", "/p/gone/z.png", "/p/far/w.png"}
    tags = spark.createDataFrame([("/p/a/x.png", 1), ("/p/dir/sub/two.wav", 2), ("/p/gone/z.png", 3), ("/p/far/w.png", 4), ("/p/near/w.png", 4)], "path string, tag_id long")
    assert {tuple(r) for r in watch.follow_tags(tags, b).collect()} == {("/p/a/x2.PNG", 1), ("/p/moved/sub/two.wav", 2), ("/p/near/w.png", 4)}


def test_safe_saves_and_ambiguous_moves_keep_tags(spark):
    assets = spark.createDataFrame([("/p/a.png", "a.png", "png", 1, 1), ("/p/one/c.png", "c.png", "png", 2, 2), ("/p/two/c.png", "c.png", "png", 2, 2)], "path string, name string, extension string, size long, modified long")
    events = [(1, 1, "rename", "/p/a.png", "/p/a.bak.png", None, None), (2, 2, "create", "/p/a.png", None, 9, 9), (3, 3, "remove", "/p/one", None, None, None), (3, 4, "remove", "/p/two", None, None, None), (4, 5, "create", "/p/new/c.png", None, 2, 2)]
    b = watch.apply_batch(assets, spark.createDataFrame(events, "ts long, event_id long, kind string, path string, to_path string, size long, modified long"), "/p")
    assert {r["path"]: r["size"] for r in b.catalog.collect()} == {"/p/a.png": 9, "/p/a.bak.png": 1, "/p/new/c.png": 2}
    assert b.renamed.count() == 0 and b.reap.count() == 0
    tags = spark.createDataFrame([("/p/a.png", 1), ("/p/one/c.png", 2)], "path string, tag_id long")
    assert {tuple(r) for r in watch.follow_tags(tags, b).collect()} == {("/p/a.png", 1), ("/p/one/c.png", 2)}


def test_feeds_count_what_they_drop(spark, tmp_path):
    schema = "event_id long, ts string, kind string, path string, size long, root string"
    rows = [(1, "2024-01-01 00:00:01", "create", "/p/a.png", 1, "/p"), (2, "2024-01-01 00:00:02", "create", "/p/b.png", 1, "/old")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    counters = watch.Counters()

    def fails(changes, number):
        raise RuntimeError("no")

    q = watch.follow(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/cat", f"{tmp_path}/cp", "/p", trigger={"availableNow": True}, on_delta=fails, drop_failed=True, counters=counters)
    q.awaitTermination()
    assert (counters.merged, counters.dropped, counters.foreign) == (0, 1, 1) and "no" in counters.last_error
    assert [r["path"] for r in spark.read.parquet(f"{tmp_path}/cat/v=0").collect()] == ["/p/a.png"] and watch.progress(q)[0]["rows"] == 2


def test_probe_tells_files_folders_and_the_gone(spark):
    present = spark.createDataFrame([("/p/a.png", 1, 1), ("/p/d/b.png", 2, 2), ("/p/d/e/c.png", 3, 3)], "path string, size long, modified long")
    asked = spark.createDataFrame([("/p/a.png",), ("/p/d",), ("/p/x",)], "path string")
    assert {(r["path"], r["kind"], r["size"]) for r in watch.probed(asked, present).collect()} == {("/p/a.png", "upsert", 1), ("/p/d/b.png", "upsert", 2), ("/p/d/e/c.png", "upsert", 3), ("/p/x", "remove", None)}


def test_templates_are_filled_once(spark):
    rows = spark.createDataFrame([("{{ a }} and {{b}} {{c}}", {"a": "{{b}}", "b": "$1"})], "t string, m map<string,string>")
    assert rows.select(text.render(F.col("t"), F.col("m"))).first()[0] == "{{b}} and $1 {{c}}"


def test_requests_in_chunks_and_image_tokens(spark):
    rows = spark.range(0, 95).selectExpr("concat('/p/', lpad(id, 3, '0')) AS path")
    got = {r["path"]: r["chunk"] for r in history.chunks(rows.repartition(7), "path").collect()}
    assert got == {f"/p/{i:03}": i // 20 for i in range(95)}
    one = spark.createDataFrame([(750 * 10,), (10**7,)], "n long")
    assert [r[0] for r in one.select(history.image_tokens(F.col("n"), "area")).collect()] == [10, 1600]


def test_seeded_ranks_are_siphash(spark):
    """The published vector of SipHash-2-4, this interpreter's own SipHash-1-3 with a key of zeros, and picks in their order."""
    import os
    import subprocess
    import sys

    key = tuple(int.from_bytes(bytes(range(8 * i, 8 * i + 8)), "little") for i in range(2))
    assert int(text.siphash([bytes(range(15))], key, (2, 4))[0]) == 0xA129CA6149BE45E5
    paths = ["", "/p/a.png", "/p/\u00e9.png", "/p/" + "long/" * 40 + "x.wav", *(f"/p/d/{i}.png" for i in range(50))]
    code = "import sys; assert sys.hash_info.algorithm == 'siphash13'; print([hash((7).to_bytes(8, 'little') + p.encode() + b'\\xff') % 2**64 for p in eval(sys.stdin.read())])"
    want = eval(subprocess.run([sys.executable, "-c", code], input=repr(paths), env={**os.environ, "PYTHONHASHSEED": "0"}, capture_output=True, text=True, check=True).stdout)
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["r"] for r in rows.select("path", text.seeded_rank(F.col("path"), 7).alias("r")).collect()}
    assert [(got[p] + 2**63) % 2**64 for p in paths] == want
    files = spark.createDataFrame([("/p/d", "texture", p) for p in paths[4:]], "dir string, asset_type string, path string")
    picks = [r["path"] for r in tagging.stratified_sample(files, 5, text.seeded_rank(F.col("path"), 7)).orderBy("rn").collect()]
    assert picks == sorted(paths[4:], key=lambda p: want[paths.index(p)])[:5]


def test_counting_minimisers_looks_up_no_places():
    """Their places in the segments are needed only where segments are sent."""
    import inspect

    import numpy as np

    from assetloom.llm import suffixdedup

    assert inspect.signature(suffixdedup._Bucket.__init__).parameters["places"].default is True
    assert "places=False" in inspect.getsource(suffixdedup._counted)
    rng = np.random.default_rng(5)
    for sizes in ([], [0, 49, 50, 0, 51, 900, 15], [400], [10, 20]):
        data = rng.integers(97, 99, sum(sizes)).astype(np.uint8)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        grams = suffixdedup.gram_hashes(data)
        found = list(zip(*(x.tolist() for x in suffixdedup.segments(data, offsets, 50, grams)), strict=True))
        want = []
        for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for i in range(a, b - 49):
                least = int(grams[i : i + 35].min())
                if want and want[-1][0] == t and want[-1][3] == least and want[-1][2] < 256 + 49:
                    want[-1] = (t, want[-1][1], want[-1][2] + 1, least)
                else:
                    want.append((t, i, 50, least))
        assert found == want


def test_edges_are_cut_down_before_repeats_are_dropped(spark):
    """Sending all edges once only to drop repeats would shuffle the whole list."""
    edge = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("x", "y"), ("c", "x")], "src string, dst string")
    found = graph.reached_edges(edge, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    assert sorted(map(tuple, found.select("src", "dst").collect())) == [("a", "b"), ("b", "c")]
