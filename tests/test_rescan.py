"""Versioned tables under crashes, and incremental scans that open only what changed."""

import os

import pytest

from assetloom.sources import fsscan, keep, rescan, versioned

from .test_scan import png


def values(df):
    return sorted(r["v"] for r in df.collect())


@pytest.mark.parametrize("broken", ["write", "create", "rename", "clean"])
def test_a_crash_leaves_the_old_version_or_the_new(spark, tmp_path, monkeypatch, broken):
    where = f"{tmp_path}/t"
    df = lambda *v: spark.createDataFrame([(x, x % 4) for x in v], "v long, _bucket int")
    versioned.replace_buckets(df(1, 2, 3), where, [1, 2, 3])

    def fails(*args, **kwargs):
        raise OSError("the machine is gone")

    if broken == "write":
        bad = df(9).selectExpr("CAST(raise_error('no') AS long) AS v", "_bucket")
        with pytest.raises(Exception, match="no"):
            versioned.replace_buckets(bad, where, [1])
    else:
        name = {"create": "_publish", "rename": "_publish", "clean": "_clean"}[broken]
        real = getattr(versioned, name)
        if broken == "rename":  # another writer was first: the rename must not replace its version

            def late(spark, path, number, body):
                real(spark, path, number, {**body, "folders": {}})
                return real(spark, path, number, body)

            monkeypatch.setattr(versioned, name, late)
            with pytest.raises(versioned.NotCommitted):
                versioned.replace_buckets(df(5), where, [1])
        else:
            monkeypatch.setattr(versioned, name, fails)
            with pytest.raises(OSError):
                versioned.replace_buckets(df(5), where, [1])
        monkeypatch.setattr(versioned, name, real)
    assert values(versioned.read(spark, where)) == {"write": [1, 2, 3], "create": [1, 2, 3], "rename": [], "clean": [2, 3, 5]}[broken]
    versioned.replace_buckets(df(7, 11), where, [3])  # and the next writer goes on
    assert values(versioned.read(spark, where)) == {"write": [1, 2, 7, 11], "create": [1, 2, 7, 11], "rename": [7, 11], "clean": [2, 5, 7, 11]}[broken]


def test_only_told_buckets_are_written_and_old_data_go(spark, tmp_path):
    where = f"{tmp_path}/t"
    df = lambda *v: spark.createDataFrame([(x, x % 4) for x in v], "v long, _bucket int")
    versioned.replace_buckets(df(*range(40)), where, [0, 1, 2, 3])
    before = versioned.current(spark, where)["folders"]
    held = versioned.read(spark, where)
    versioned.replace_buckets(df(100), where, [0, 2])
    after = versioned.current(spark, where)["folders"]
    assert {b for b in before if before[b] == after.get(b)} == {"1", "3"} and "2" not in after
    assert values(held) == list(range(40))  # a reader of the version before still can
    for i in range(4):
        versioned.replace(df(i), where)
    assert len([x for x in os.listdir(where) if x.startswith("d-")]) == 2 and len(versioned.versions(spark, where)) == 2


def tree(root):
    for name, body in {"a/one.png": png(1, 1), "a/two.png": png(2, 2), "b/three.png": png(3, 3), "b/gone.png": png(4, 4), "b/noext": b"x"}.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(body)
        os.utime(f"{root}/{name}", ns=(10**18, 10**18))


def test_rescan_opens_changed_files_only(spark, tmp_path):
    root, where = f"{tmp_path}/p", f"{tmp_path}/last"
    tree(root)
    one, counts = rescan.rescan(spark, root, where)
    assert tuple(counts.first()) == (4, 0, 4, 0)
    assert {r["name"]: r["metadata"]["width"] for r in one.collect()} == {"one.png": 1, "two.png": 2, "three.png": 3, "gone.png": 4}
    # another content, same size and time: whoever opens it sees 77, a rescan must not
    with open(f"{root}/a/one.png", "wb") as f:
        f.write(png(77, 1))
    os.utime(f"{root}/a/one.png", ns=(10**18, 10**18))
    with open(f"{root}/a/two.png", "wb") as f:  # the same second, a few nanoseconds on
        f.write(png(22, 2))
    os.utime(f"{root}/a/two.png", ns=(10**18 + 9, 10**18 + 9))
    with open(f"{root}/b/three.png.meta", "w") as f:
        f.write("guid: abc\n")
    os.remove(f"{root}/b/gone.png")
    with open(f"{root}/new.png", "wb") as f:
        f.write(png(5, 5))
    two, counts = rescan.rescan(spark, root, where)
    assert tuple(counts.first()) == (4, 1, 3, 1)
    assert {r["name"]: (r["metadata"]["width"], r["unity_guid"]) for r in two.collect()} == {"one.png": (1, None), "two.png": (22, None), "three.png": (3, "abc"), "new.png": (5, None)}
    number = versioned.versions(spark, where)[-1]
    three, counts = rescan.rescan(spark, root, where)
    assert tuple(counts.first()) == (4, 4, 0, 0) and versioned.versions(spark, where)[-1] == number and three.count() == 4
    # a full scan opens all
    assert {r["name"]: r["metadata"]["width"] for r in fsscan.scan(spark, root).collect()}["one.png"] == 77
    moved, counts = rescan.rescan(spark, f"{root}/a", where)
    assert tuple(counts.first()) == (2, 0, 2, 0) and {r["name"] for r in moved.collect()} == {"one.png", "two.png"}


def test_snapshots_survive_a_failed_save(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("/p/a", 1)], "path string, size long")
    keep.save_snapshot(df, f"{tmp_path}/s", "/p")

    def fails(*args):
        raise OSError("full")

    monkeypatch.setattr(versioned, "_publish", fails)
    with pytest.raises(OSError):
        keep.save_snapshot(df.unionByName(df), f"{tmp_path}/s", "/p")
    assert keep.load_snapshot(spark, f"{tmp_path}/s", "/p").count() == 1
