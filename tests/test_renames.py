"""Batches of renames against a replay of the events, one after the other."""

import random

import pytest

from pyspark.sql import functions as F

from assetloom.streaming import renames, watch

CATALOG = "path string, name string, extension string, size long, modified long, note string"
EVENTS = "ts long, event_id long, kind string, path string, to_path string, size long, modified long"
ext = lambda p: p.rsplit("/", 1)[1].rpartition(".")[2].lower() if "." in p.rsplit("/", 1)[1] else ""
hidden = lambda p: any(c.startswith(".") for c in p.split("/"))


def replay(catalog, events, tags):
    """What the catalog and the tags are after the events, by a plain file table."""
    files = {p: (s, m, note) for p, _, _, s, m, note in catalog}
    moves = []
    for _, _, kind, path, to, size, modified in sorted(events):
        if kind == "rename":
            if path == to or (hidden(path) and hidden(to)):
                continue
            below = [p for p in files if p.startswith(path + "/")]
            moves.append((path, to, bool(below)))
            if below:
                for p in below:
                    files[to + p[len(path) :]] = files.pop(p)
            else:
                known = files.pop(path, None)
                keep = known if known and ext(path) == ext(to) else (None, None, None)
                files[to] = (keep[0] if size is None else size, keep[1] if modified is None else modified, keep[2])
        elif kind == "remove":
            for p in [p for p in files if p == path or p.startswith(path + "/")]:
                del files[p]
        else:
            files[path] = (size, modified, None)
    seen = {p: v for p, v in files.items() if not hidden(p) and ext(p)}
    bound = set(tags)
    for path, to, folder in moves:
        if folder or path not in seen:
            bound = {(to + p[len(path) :] if p == path or p.startswith(path + "/") else p, t) for p, t in bound}
    return seen, bound


def feed(rng, catalog, n):
    """Random events that a file system could give: no folder moves onto a path that exists."""
    files = {p for p, *_ in catalog}
    events = []
    fresh = iter(range(10_000))
    for i in range(n):
        what = rng.random()
        some = sorted(files) or ["/p/none.png"]
        path = rng.choice(some)
        size = rng.choice([None, rng.randrange(100)])
        if what < 0.45:
            to = rng.choice([rng.choice(some), f"/p/{rng.choice('abc')}/n{next(fresh)}.png", path.replace(".png", ".jpg"), path.replace("/p/", "/p/.h/") if "/.h/" not in path else path.replace("/.h/", "/"), "/p/unknown.png"])
            if rng.random() < 0.1:
                path = f"/p/else{next(fresh)}.png"
            if any(p.startswith(to + "/") for p in files):
                continue
            files.discard(path)
            files.add(to)
            events.append((i // 2, i, "rename", path, to, size, size))
        elif what < 0.65:
            folder = path.rsplit("/", 1)[0]
            folder = folder if rng.random() < 0.7 else "/".join(folder.split("/")[:3])
            if folder == "/p" or "/.h" in folder:
                continue
            to = rng.choice([f"/p/d{next(fresh)}", f"/p/c/d{next(fresh)}", f"/p/.h/d{next(fresh)}"])
            if to.startswith(folder + "/"):
                continue
            files = {to + p[len(folder) :] if p.startswith(folder + "/") else p for p in files}
            events.append((i // 2, i, "rename", folder, to, None, None))
        elif what < 0.8:
            gone = path if rng.random() < 0.8 else path.rsplit("/", 1)[0]
            if gone == "/p" or "/.h" in gone:
                continue
            files = {p for p in files if p != gone and not p.startswith(gone + "/")}
            events.append((i // 2, i, "remove", gone, None, None, None))
        else:
            path = path if rng.random() < 0.5 and "/.h/" not in path else f"/p/{rng.choice('abc')}/w{next(fresh)}.png"
            files.add(path)
            events.append((i // 2, i, rng.choice(["create", "modify"]), path, None, i, i))
    return events


def answer(spark, catalog, events, tags):
    b = watch.apply_batch(spark.createDataFrame(catalog, CATALOG), spark.createDataFrame(events, EVENTS), "/p")
    return {r["path"]: (r["size"], r["modified"], r["note"]) for r in b.catalog.collect()}, {tuple(r) for r in watch.follow_tags(spark.createDataFrame(tags, "path string, tag_id long"), b).collect()}, b


def rows(paths):
    return [(p, p.rsplit("/", 1)[1], ext(p), i, i, f"was {p}") for i, p in enumerate(paths)]


def test_chains_swaps_and_moved_folders(spark):
    catalog = rows(["/p/a.png", "/p/x.png", "/p/y.png", "/p/one/f.png", "/p/one/sub/g.png", "/p/two/h.png", "/p/deep/k.png"])
    events = [
        (1, 1, "rename", "/p/a.png", "/p/b.png", None, None), (1, 2, "rename", "/p/b.png", "/p/c.png", None, None),  # a chain
        (2, 3, "rename", "/p/x.png", "/p/t.png", None, None), (2, 4, "rename", "/p/y.png", "/p/x.png", None, None), (2, 5, "rename", "/p/t.png", "/p/y.png", None, None),  # a swap
        (3, 6, "rename", "/p/one", "/p/uno", None, None), (3, 7, "rename", "/p/uno/f.png", "/p/uno/ff.png", None, None), (3, 8, "rename", "/p/uno/sub", "/p/low", None, None),  # inside a moved folder
        (4, 9, "rename", "/p/two", "/p/w", None, None), (4, 10, "rename", "/p/w", "/p/zwei", None, None),
        (5, 11, "rename", "/p/deep/k.png", "/p/deep/k.jpg", None, None), (5, 12, "rename", "/p/deep/k.jpg", "/p/deep/k.png", 9, None),  # another kind of file in between
    ]
    tags = [(r[0], i) for i, r in enumerate(catalog)]
    found, bound, b = answer(spark, catalog, events, tags)
    assert found == {
        "/p/c.png": (0, 0, "was /p/a.png"), "/p/y.png": (1, 1, "was /p/x.png"), "/p/x.png": (2, 2, "was /p/y.png"), "/p/uno/ff.png": (3, 3, "was /p/one/f.png"), "/p/low/g.png": (4, 4, "was /p/one/sub/g.png"),
        "/p/zwei/h.png": (5, 5, "was /p/two/h.png"), "/p/deep/k.png": (9, None, None),
    }
    assert (found, bound) == replay(catalog, events, tags)
    assert ("/p/c.png", 0) in bound and ("/p/low/g.png", 4) in bound
    renamed = {tuple(r) for r in b.renamed.collect()}
    assert {("/p/a.png", "/p/c.png", False), ("/p/one", "/p/uno", True), ("/p/two", "/p/zwei", True), ("/p/one/f.png", "/p/uno/ff.png", False)} <= renamed
    assert {r[0] for r in b.removed.collect()} >= {"/p/a.png", "/p/one/f.png", "/p/one/sub/g.png", "/p/two/h.png"}
    assert b.reap.count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_random_feeds_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    catalog = rows([f"/p/{d}/{f}{i}.png" for d in ("a", "b", "a/in", "b/in/deep") for i, f in enumerate("xyz")])
    events = feed(rng, catalog, 45)
    # tags only of files that no event removes: what is reaped has its own test
    found, bound, b = answer(spark, catalog, events, [(r[0], i) for i, r in enumerate(catalog)])
    want, tags = replay(catalog, events, [(r[0], i) for i, r in enumerate(catalog)])
    assert found == want
    reaped = {r[0] for r in b.reap.collect()}
    joined = {r["from_path"]: r["to_path"] for r in b.rejoined.collect()}
    assert bound == {(joined.get(p, p), t) for p, t in tags if joined.get(p, p) not in reaped}


def test_long_chain_takes_few_rounds(spark):
    """A file renamed 300 times in one batch, and one folder renamed 5 times."""
    n = 300
    events = [(0, i, "rename", f"/p/f{i}.png", f"/p/f{i + 1}.png", None, None) for i in range(n)] + [(1, n + i, "rename", f"/p/d{i}", f"/p/d{i + 1}", None, None) for i in range(5)]
    catalog = rows(["/p/f0.png", "/p/d0/e.png"])
    found, bound, _ = answer(spark, catalog, events, [("/p/f0.png", 1), ("/p/d0/e.png", 2)])
    assert found == {f"/p/f{n}.png": (0, 0, "was /p/f0.png"), "/p/d5/e.png": (1, 1, "was /p/d0/e.png")}
    assert bound == {(f"/p/f{n}.png", 1), ("/p/d5/e.png", 2)}


def test_events_without_size(spark):
    events = spark.createDataFrame([(1, 1, "rename", "/p/a.png", "/p/b.png"), (1, 1, "rename", "/p/a.png", "/p/b.png")], "ts long, event_id long, kind string, path string, to_path string")
    b = watch.apply_batch(spark.createDataFrame(rows(["/p/a.png"]), CATALOG), events, "/p")
    assert [(r["path"], r["size"]) for r in b.catalog.collect()] == [("/p/b.png", 0)]


def test_no_side_of_a_batch_is_broadcast(spark):
    """Compressed files understate their rows, so small estimates must not choose the joins."""
    catalog = spark.createDataFrame([("/p/a.png", "a.png", "png", 1, 1, "n"), ("/p/d/b.png", "b.png", "png", 2, 2, "n")], CATALOG)
    events = spark.createDataFrame([(1, 1, "rename", "/p/d", "/p/e", None, None), (2, 2, "remove", "/p/a.png", None, None, None), (3, 3, "create", "/p/c.png", None, 5, 5)], EVENTS)
    batch = watch.apply_batch(catalog, events, "/p")
    tags = watch.follow_tags(spark.createDataFrame([("/p/d/b.png", "t"), ("/p/a.png", "u")], "path string, tag_id string"), batch)
    plans = {n: f._jdf.queryExecution().sparkPlan().toString() for n, f in (("tags", tags), *((n, getattr(batch, n)) for n in ("catalog", "removed", "renamed", "reap", "moves", "rejoined")))}
    assert not [n for n, plan in plans.items() if "Broadcast" in plan]
    hits = renames._hits(watch.acts_of(events, "/p"))
    states = catalog.select("path", F.lit(None).cast(hits.schema["hit"].dataType["at"].dataType).alias("at"))
    assert "Broadcast" not in renames._next(states, hits)._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in tags.collect()} == {("/p/e/b.png", "t")}


def test_files_are_not_exploded_over_their_ancestors(spark):
    """Else every file would meet all others of the tree at the topmost directory."""
    hits = renames._hits(watch.acts_of(spark.createDataFrame([(1, 1, "rename", "/p/a.png", "/p/b.png", None, None)], EVENTS), "/p"))
    states = spark.createDataFrame([("/p/a.png",), ("/p/in/c.png",)], "path string").withColumn("at", F.lit(None).cast(hits.schema["hit"].dataType["at"].dataType))
    found = renames._next(states, hits)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["path"], r["h"], r["strict"]) for r in found.collect()} == {("/p/a.png", "/p/a.png", False), ("/p/in/c.png", None, None)}


def test_batch_queries_make_the_catalog_once(spark, monkeypatch):
    """The events of the batch queries come from the catalog that is written down, not from its view again."""
    from assetloom.plans import queries

    seen, made = [], queries._batch_events
    monkeypatch.setattr(queries, "_batch_events", lambda a: seen.append(a) or made(a))
    view = spark.createDataFrame(rows(["/proj/SMALL/a.png"]), CATALOG).withColumn("asset_type", F.lower("extension")).withColumn("dir", F.lit("/proj/SMALL"))
    assert queries._after(view).catalog.select("path").collect() == [("/proj/Tiny/a.png",)]
    assert "Relation" in (plan := seen[0]._jdf.queryExecution().optimizedPlan().toString()) and "lower" not in plan
