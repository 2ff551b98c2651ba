"""Running totals over ranges against a sequential sum."""

import random

from pyspark.sql import functions as F

from assetloom.operators import history, prefix, stats


def test_running_totals_of_one_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randrange(40), rng.randrange(100)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    got = prefix.running(df, ["k"], [F.col("t")], {"s": F.col("v"), "n": F.lit(1)}, ranges=16).collect()
    assert len(got) == len(rows)
    for k in (None, "a", "b", "hot"):
        mine = sorted((r["n"], r["t"], r["v"], r["s"]) for r in got if r["k"] == k)
        assert [r[0] for r in mine] == list(range(1, len(mine) + 1))
        assert [r[1] for r in mine] == sorted(r[1] for r in mine)
        so_far = 0
        for _, _, v, s in mine:
            so_far += v
            assert s == so_far
    assert prefix.running(df.limit(0), ["k"], [F.col("t")], {"s": F.col("v")}).collect() == []


def test_files_of_one_time_are_cut_by_path(spark):
    """All files have one time: a range has a share of them, and the oldest by path go."""
    rows = [(f"/p/{i:05}", 10, 77.0) for i in range(2000)] + [("/p/none", 5, None)]
    files = spark.createDataFrame(rows, "path string, size long, modified double")
    gone = sorted(r["path"] for r in stats.evicted(files, 20_005 - 8_000, buckets=8).collect())
    assert gone == [f"/p/{i:05}" for i in range(800)]
    parts = prefix.ranged(files, [F.col("modified")], 8).groupBy("_range").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 600


def test_free_names_in_one_hot_directory(spark):
    """Many files of one directory, many copies of one stem, and names that only look like copies."""
    here = [f"/p/f{i}.png" for i in range(3000)] + ["/p/x.png", "/p/x copy", "/p/y", "/p/x copy copy.png", "/p/none.png"]
    there = [f"/p/f{i} copy.png" for i in range(0, 3000, 3)] + [f"/p/f{i} copy 2.png" for i in range(0, 3000, 6)] + ["/p/x copy.png"] + [f"/p/x copy {k}.png" for k in range(2, 500) if k != 77] + ["/p/x copy 01.png", "/p/x copy 1.png", "/p/x copy x.png", "/p/y copy.png", "/q/none copy.png"]
    names = set(here + there)
    f = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    got = {r["path"]: r["copy"] for r in history.free_copy_name(f(here + here[:5]), f(here + there)).collect()}

    def first(path):
        folder, name = path.rsplit("/", 1)
        stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
        k = 1
        while (made := f"{folder}/{stem} copy{f' {k}' if k > 1 else ''}{dot}{ext}") in names:
            k += 1
        return made

    assert got == {p: first(p) for p in here}
    assert got["/p/x.png"] == "/p/x copy 77.png" and got["/p/none.png"] == "/p/none copy.png"
