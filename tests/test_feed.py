"""The live feed: renames and tags in sequence, bytes by bucket, bursts, and counts over restarts."""

import json
import os
import random

import pytest

from assetloom.sources import versioned
from assetloom.streaming import watch

from .test_renames import CATALOG, EVENTS, feed, replay, rows

N = 16


def started(spark, tmp_path, catalog):
    df = spark.createDataFrame(catalog, CATALOG).withColumn("_bucket", watch.bucket_of(watch.F.col("path"), N))
    versioned.replace_buckets(df, f"{tmp_path}/cat", list(range(N)), n_buckets=N)
    tags = spark.createDataFrame([(r[0], i) for i, r in enumerate(catalog)], "path string, tag_id long").withColumn("_bucket", watch.bucket_of(watch.F.col("path"), N))
    versioned.replace_buckets(tags, f"{tmp_path}/tags", list(range(N)), n_buckets=N)


def test_feed_equals_batches_one_by_one(spark, tmp_path):
    rng = random.Random(77)
    catalog = rows([f"/p/{d}/{f}.png" for d in ("a", "b", "a/in") for f in "xyz"])
    started(spark, tmp_path, catalog)
    files, bound = {p: (s, m, note) for p, _, _, s, m, note in catalog}, {(r[0], i) for i, r in enumerate(catalog)}
    for k in range(2):
        now = [(p, p.rsplit("/", 1)[1], "png", s, m, note) for p, (s, m, note) in files.items()]
        events = [e for e in feed(rng, now, 14) if e[2] != "remove"]  # reaping has a test of its own
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = watch.follow_catalog(spark.readStream.schema(EVENTS).json(f"{tmp_path}/in"), f"{tmp_path}/cat", f"{tmp_path}/cp", "/p", tags_where=f"{tmp_path}/tags", trigger={"availableNow": True})
        q.awaitTermination()
        files, bound = replay(now, events, bound)
        assert {r["path"]: (r["size"], r["modified"], r["note"]) for r in versioned.read(spark, f"{tmp_path}/cat").collect()} == files
        assert {tuple(r) for r in versioned.read(spark, f"{tmp_path}/tags").collect()} == bound
        assert versioned.current(spark, f"{tmp_path}/cat")["batch"] == k


def test_a_batch_writes_its_buckets_and_counts_once(spark, tmp_path):
    catalog = rows([f"/p/f{i:03}.png" for i in range(200)])
    started(spark, tmp_path, catalog)
    before = versioned.current(spark, f"{tmp_path}/cat")["folders"]
    events = spark.createDataFrame([(1, 1, "rename", "/p/f000.png", "/p/g.png", None, None), (1, 2, "remove", "/p/f001.png", None, None, None)], EVENTS)
    one = watch.merge_batch(spark, events, 0, f"{tmp_path}/cat", "/p", f"{tmp_path}/tags")
    assert one is not None and watch.merge_batch(spark, events, 0, f"{tmp_path}/cat", "/p", f"{tmp_path}/tags") is None
    after = versioned.current(spark, f"{tmp_path}/cat")["folders"]
    assert 1 <= sum(before[b] != after.get(b) for b in before) <= 3
    got = {r["path"] for r in versioned.read(spark, f"{tmp_path}/cat").collect()}
    assert len(got) == 199 and "/p/g.png" in got and not got & {"/p/f000.png", "/p/f001.png"}
    assert {r["path"] for r in versioned.read(spark, f"{tmp_path}/tags").collect()} == got
    # the catalog's commit is lost, its tags' is not: the batch run again does the rest
    number = versioned.versions(spark, f"{tmp_path}/cat")[-1]
    more = spark.createDataFrame([(2, 3, "rename", "/p/g.png", "/p/h.png", None, None)], EVENTS)
    watch.merge_batch(spark, more, 1, f"{tmp_path}/cat", "/p", f"{tmp_path}/tags")
    os.remove(f"{tmp_path}/cat/_versions/v{number + 1:012d}.json")
    watch.merge_batch(spark, more, 1, f"{tmp_path}/cat", "/p", f"{tmp_path}/tags")
    assert {r["path"] for r in versioned.read(spark, f"{tmp_path}/cat").collect()} == (got - {"/p/g.png"}) | {"/p/h.png"} == {r["path"] for r in versioned.read(spark, f"{tmp_path}/tags").collect()}
    with pytest.raises(ValueError, match="scan first"):
        watch.merge_batch(spark, more, 2, f"{tmp_path}/none", "/p")


def test_bursts_end_after_a_quiet_time(spark, tmp_path):
    schema = "event_id long, ts string, kind string, path string"
    time = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    one = [(1, time(1), "create", "/p/a.png"), (2, time(1.3), "modify", "/p/a.png"), (3, time(1.9), "remove", "/p/a.png"), (4, time(1.2), "create", "/p/b.png"), (5, time(30), "create", "/p/c.png")]
    found = watch.effects(spark.createDataFrame(one, schema), "/p")
    ends = lambda df: {(r["path"], r["kind"], r["n_events"], round(r["start"].timestamp() % 60, 3), round(r["end"].timestamp() % 60, 3)) for r in df.collect()}
    assert ends(watch.settled(found)) == {("/p/a.png", "upsert", 2, 1.0, 1.8), ("/p/a.png", "remove", 1, 1.9, 2.4), ("/p/b.png", "upsert", 1, 1.2, 1.7), ("/p/c.png", "upsert", 1, 30.0, 30.5)}

    listener = watch.FeedListener(spark, f"{tmp_path}/counts")
    spark.streams.addListener(listener)
    try:
        late = [(6, time(2), "create", "/p/late.png"), (7, time(50), "create", "/p/d.png")]
        for part, wait in ((one, 1), (late, 2)):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
            stream = watch.settled(watch.effects(spark.readStream.schema(schema).json(f"{tmp_path}/in"), "/p"), late="5 seconds")
            q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            if wait == 1:  # the process ends: another listener goes on with the counts kept
                spark.streams.removeListener(listener)
                listener = watch.FeedListener(spark, f"{tmp_path}/counts")
                spark.streams.addListener(listener)
        assert {r["path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"/p/a.png", "/p/b.png", "/p/c.png"}
        kept = json.loads(next((tmp_path / "counts").glob("*.json")).read_text())
        assert (kept["rows"], kept["late"], kept["failures"]) == (7, 1, 0) and kept["batches"] >= 2 and kept["milliseconds"]["triggerExecution"] > 0
    finally:
        spark.streams.removeListener(listener)
