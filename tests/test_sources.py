"""Sources and streams on files of their own."""

import concurrent.futures
import datetime
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources import folders, listing
from vellum.streaming import keyed, progress

SF = "/root/testdata/sf0.001"


def test_walk(spark, tmp_path):
    for name, size in (("a/b.mkv", 3), ("a/c.srt", 1), ("d.txt", 2)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    rows = listing.walk(spark, str(tmp_path)).collect()
    assert sorted((r["path"].split("/")[-1], r["size"]) for r in rows) == [("b.mkv", 3), ("c.srt", 1), ("d.txt", 2)]
    assert listing.reachable(spark, str(tmp_path)) and not listing.reachable(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(
    "path, size, kind, skipped",
    [
        ("/m/Film (2019).mkv", 10**9, "video", None), ("/m/Film.mkv", 1000, None, "too small"), ("/m/Film.fr.srt", 10, "subtitle", None), ("/m/notes.txt", 10, None, "extension"), ("/m/film-sample.mkv", 10**9, None, "side content"),
        ("/m/Bonus/x.mkv", 10**9, None, "folder"), ("/m/Sampler.mkv", 10**9, "video", None), ("/m/@eaDir/x.mkv", 10**9, None, "folder"), ("/m/.hidden.mkv", 10**9, None, "name"),
    ],
)
def test_classify(spark, path, size, kind, skipped):
    r = listing.classify(spark.createDataFrame([(path, size)], "path string, size long")).first()
    assert (r["kind"], r["skipped"]) == (kind, skipped)


def test_documents(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{broken"), (3, None)], "id int, doc string")
    assert [(r["id"], r["a"]) for r in listing.json_documents(df, "doc", "a int").collect()] == [(1, 1)]
    assert sorted(r["id"] for r in listing.broken_documents(df, "doc", "a int").collect()) == [2, 3]
    times = spark.createDataFrame([("0.040,K__\n1.5,___\n-1,K\n4.0,K__\nx,K\n2.0,K",)], "t string").select(listing.point_times(F.col("t")).alias("x")).first()["x"]
    assert times == [0.0, 2.0, 4.0]


def test_evolve(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert listing.evolve(spark.createDataFrame([(1, 2)], "a int, z int"), schema).columns == ["a", "b", "z"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(2):
        assert listing.write_version(spark.range(n + 1), path) == n
    (tmp_path / "t" / "v=7").mkdir()  # one that was not written to the end
    assert listing.read_latest(spark, path).count() == 2
    # it reads what it writes, and takes a number that nobody else has begun with
    assert listing.write_version(listing.read_latest(spark, path).filter("id > 0"), path) == 8 and listing.read_latest(spark, path).count() == 1
    assert not list((tmp_path / "t").glob(".writing*"))
    with pytest.raises(FileNotFoundError):
        listing.read_latest(spark, str(tmp_path / "none"))


def test_two_writers_of_a_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: listing.write_version(spark.range(n), path), range(1, 5)))
    assert sorted(numbers) == [0, 1, 2, 3]
    assert sorted(spark.read.parquet(f"{path}/v={n}").count() for n in numbers) == [1, 2, 3, 4]


def test_upsert_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", (F.col("event_id") % 40).alias("item"), "ts", "value")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    keyed.upsert_stream(progress.read(spark, str(tmp_path / "in"), e.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = progress.merge_states(None, e)
    table = keyed.states_table(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, table.read().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert table.versions() == [0, 1, 2]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path), "k long, v long", ["k"], buckets=8)
    put = lambda old, new: old.join(new, "k", "left_anti").unionByName(new)
    rows = lambda *r: spark.createDataFrame(r, "k long, v long")
    table.update(0, rows(*((k, 0) for k in range(100))), put)
    assert set(table.manifest().values()) == {0} and len(table.manifest()) == 8
    mine = table.update(1, rows((5, 1)), put)
    assert len(mine) == 1 and sorted(table.manifest().values()) == [0] * 7 + [1]
    assert len(list((tmp_path / "data" / "v=1").glob("b=*"))) == 1
    # a batch that is run again starts from the state before it; one that stopped half way is not seen
    table.update(1, rows((5, 2)), put)
    (tmp_path / "manifest" / "v=2").mkdir()
    assert {r["k"]: r["v"] for r in table.read().collect()} == {k: 2 if k == 5 else 0 for k in range(100)}
    # all rows of a bucket may go, and an empty batch touches nothing
    keys = [r["k"] for r in table._rows(table.manifest(), mine).collect()]
    table.update(2, rows(*((k, 9) for k in keys)), lambda old, new: old.join(new, "k", "left_anti"))
    assert table.update(3, rows(), put) == set() and len(table.manifest()) == 7
    assert {r["k"] for r in table.read().collect()} == set(range(100)) - set(keys)
    # earlier states can be read until they are deleted
    assert table.read(0).count() == 100
    assert table.vacuum(keep=1) == [1, 2] and table.read().count() == 100 - len(keys)


def test_resume_feed_is_what_a_whole_run_gives(spark, tmp_path):
    from vellum.operators.progress import continue_feed

    rng = random.Random(9)
    feed = keyed.ResumeFeed(spark, str(tmp_path), buckets=4)
    seen, start = [], datetime.datetime(2024, 1, 1)
    for number in range(6):
        # the last batches reach few users; some reports come late
        batch = [(rng.randrange(12 if number < 3 else 2), rng.choice("ab"), rng.randrange(5), start + datetime.timedelta(days=40 * number + rng.randrange(-50, 30), seconds=rng.randrange(86400)), rng.choice([1.0, 30.0, 60.0, 95.0])) for _ in range(25)]
        rows = spark.createDataFrame(batch, "user_id long, series string, item long, ts timestamp_ntz, value double")
        feed.take(rows, number)
        if number == 2:
            feed.take(rows, number)
        seen += batch
        now = str(start + datetime.timedelta(days=40 * number + 90))
        states = progress.merge_states(None, spark.createDataFrame(seen, rows.schema), ["user_id", "series", "item"]).withColumnRenamed("ts", "updated")
        want = continue_feed(states, ["user_id", "series"], "item", 100.0, now)
        got = feed.entries(now).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_resume_feed_follows_a_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("event_type").alias("series"), (F.col("event_id") % 40).alias("item"), "ts", "value")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    feed = keyed.ResumeFeed(spark, str(tmp_path / "out"), buckets=4)
    feed.follow(progress.read(spark, str(tmp_path / "in"), e.schema), str(tmp_path / "check")).awaitTermination()
    from vellum.operators.progress import continue_feed

    states = progress.merge_states(None, e, ["user_id", "series", "item"]).withColumnRenamed("ts", "updated")
    want = continue_feed(states, ["user_id", "series"], "item", 100.0, "2024-02-01 00:00:00")
    assert sorted(map(tuple, feed.entries("2024-02-01 00:00:00").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_walk_with_errors(spark, tmp_path, monkeypatch):
    for name in ("a/b.mkv", "a/deep/er/c.srt", "d.txt", "sample/x.mkv", ".git/y", "@eaDir/z", "e/f/g.mkv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    (tmp_path / "a" / "link.mkv").symlink_to(tmp_path / "d.txt")
    for levels in (0, 1, 2):
        rows = folders.walk(spark, str(tmp_path), levels).collect()
        assert sorted((r["path"].removeprefix(f"{tmp_path}/"), r["size"], r["error"]) for r in rows) == [("a/b.mkv", 2, None), ("a/deep/er/c.srt", 2, None), ("d.txt", 2, None), ("e/f/g.mkv", 2, None)]
    walked = folders.walk(spark, str(tmp_path / "none"))
    assert {(r["path"], r["operation"]) for r in folders.errors(walked).collect()} == {(str(tmp_path / "none"), "list")} and folders.files(walked).count() == 0
    # a folder without rights: root may list it all the same, so the reader is asked with a refusal of its own
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda f: (_ for _ in ()).throw(PermissionError(13, "Permission denied")) if str(f).endswith("/e") else real(f))
    reader = folders.FolderReader(str(tmp_path), 1)
    found = [row for p in reader.partitions() for row in reader.read(p)]
    assert sorted((r[0].removeprefix(f"{tmp_path}/"), r[3], r[4]) for r in found if r[4]) == [("e", "list", "Permission denied")]
    assert len([r for r in found if not r[4]]) == 3


def test_files_that_nobody_could_look_for_keep_their_flag(spark):
    old = spark.createDataFrame([("/m/a/1", True, 1), ("/m/a/2", True, 2), ("/m/b/3", True, 3), ("/m/b/c/4", False, 4), ("/m/bb/5", True, 5), ("/m/f/6", True, 6), ("/m/a/7", False, 7), ("/x/8", True, 8)], "path string, present boolean, n int")
    walked = spark.createDataFrame([("/m/a/1", 1, None), ("/m/a/7", 1, None), ("/m/b", None, "no"), ("/m/f/6", None, "no"), ("/x", None, "no"), ("/m/new", 1, None)], "path string, size long, error string")
    got = {r["path"]: r["present"] for r in folders.mark_gone(old, walked).collect()}
    assert got == {"/m/a/1": True, "/m/a/2": False, "/m/b/3": True, "/m/b/c/4": False, "/m/bb/5": False, "/m/f/6": True, "/m/a/7": True, "/x/8": True}
    root = spark.createDataFrame([("/", None, "no")], "path string, size long, error string")
    assert {r["n"]: r["present"] for r in folders.mark_gone(old, root).collect()} == {r["n"]: r["present"] for r in old.collect()}


def test_throttled_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.to_timestamp_ltz("ts").alias("ts"), "value")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = progress.throttled(progress.read(spark, str(tmp_path / "in"), e.schema)).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last, want = {}, 0
    for r in sorted(e.collect(), key=lambda r: r["ts"]):
        if r["user_id"] not in last or ((r["ts"] - last[r["user_id"]][0]).total_seconds() >= 10 and abs(r["value"] - last[r["user_id"]][1]) >= 5):
            last[r["user_id"]], want = (r["ts"], r["value"]), want + 1
    assert spark.table("throttled").count() == want


def test_windowed_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_type", F.to_timestamp_ltz("ts").alias("ts"), "value")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = progress.windowed_counts(progress.read(spark, str(tmp_path / "in"), e.schema)).writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("windowed").agg(F.sum("n")).first()[0] <= e.count()
