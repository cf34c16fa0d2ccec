"""Objects as a data source, tables with versions, durations of sounds, bursts with timers, and plans that scan once."""

import datetime
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import documents, engagement, listing, sequences
from tessel.sources import files, objects, sounds
from tessel.sources.versions import Conflict, VersionedTable
from tessel.streaming import counters, quiet

OBJECT = "key string, content binary"


def stored(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_objects_round_trip(spark, tmp_path):
    objects.registered(spark)
    rows = [(f"a/{i % 3}/{i}.bin", bytes([i]) * i) for i in range(40)] + [("empty", b""), ("null", None)]
    df = spark.createDataFrame(rows, OBJECT).repartition(4)
    df.write.format("objects").mode("append").save(str(tmp_path))
    assert stored(tmp_path) == {k: v or b"" for k, v in rows}  # and no temporary folder is left
    back = spark.read.format("objects").option("bytesPerPartition", 200).load(str(tmp_path))
    assert {(r.key, r.length, bytes(r.content)) for r in back.collect()} == {(k, len(v or b""), v or b"") for k, v in rows}
    assert 3 < back.rdd.getNumPartitions() < 15  # by size, not by file
    spark.createDataFrame([("a/0/0.bin", b"new"), ("b", b"2")], OBJECT).write.format("objects").mode("append").save(str(tmp_path))
    assert len(stored(tmp_path)) == 43 and stored(tmp_path)["a/0/0.bin"] == b"new"
    spark.createDataFrame([("only", b"1")], OBJECT).write.format("objects").mode("overwrite").save(str(tmp_path))
    assert stored(tmp_path) == {"only": b"1"}
    assert spark.read.format("objects").load(f"{tmp_path}/nothing").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    objects.registered(spark)
    bad = spark.createDataFrame([(f"k{i}", b"x") for i in range(50)] + [("../up", b"x")], OBJECT).repartition(3)
    with pytest.raises(Exception, match="no key"):
        bad.write.format("objects").mode("append").save(str(tmp_path))
    assert stored(tmp_path) == {}
    with pytest.raises(Exception, match="objects have a key"):
        spark.range(3).write.format("objects").mode("append").save(str(tmp_path))


@pytest.mark.parametrize("key", ["b", "b/c/d"])
def test_tasks_that_still_write_leave_nothing(tmp_path, key):
    """A task in the midst of its rows, and one that starts, when the job is given up."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    w = objects.Objects({"path": str(tmp_path)}).writer(StructType().add("key", "string").add("content", "binary"), False)
    batch = lambda k: pa.RecordBatch.from_pydict({"key": [k], "content": [b"x"]})

    def rows():
        yield batch("a/b")
        w.abort([])
        yield batch(key)

    for batches in (rows(), iter([batch(key)])):
        with pytest.raises(OSError):
            w.write(batches)
        assert stored(tmp_path) == {} and not list(tmp_path.iterdir())


def test_two_tries_of_a_task_leave_one_result(tmp_path):
    """The files of a try that the driver doesn't commit never get a name."""
    import pyarrow as pa

    w = objects.Writer(str(tmp_path), False)
    batch = lambda v: iter([pa.RecordBatch.from_pydict({"key": ["a", "b/c"], "content": [v, v]})])
    lost, kept = w.write(batch(b"lost")), w.write(batch(b"kept"))
    assert lost.folder != kept.folder
    assert not [x for x in objects.objects_in(*objects.opened(str(tmp_path)))]
    w.commit([kept, None])
    assert stored(tmp_path) == {"a": b"kept", "b/c": b"kept"}
    other = objects.Writer(str(tmp_path), False)
    other.write(batch(b"gone"))
    other.abort([])
    assert stored(tmp_path) == {"a": b"kept", "b/c": b"kept"}


def test_many_objects_are_moved_and_listed_by_tasks(spark, tmp_path):
    """Any number of objects: what is written, read and left is the same as by the sink and the source alone."""
    rows = [(f"a/{i % 3}/{i}.bin", bytes([i]) * i) for i in range(40)] + [("empty", b""), ("null", None)]
    objects.save(spark.createDataFrame(rows, OBJECT).repartition(4), str(tmp_path))
    assert stored(tmp_path) == {k: v or b"" for k, v in rows} and not (tmp_path / "_temporary").exists()
    objects.save(spark.createDataFrame([("a/0/0.bin", b"first"), ("b", b"2"), ("a/0/0.bin", b"new")], OBJECT).coalesce(1), str(tmp_path))
    want = {k: v or b"" for k, v in rows} | {"a/0/0.bin": b"new", "b": b"2"}
    assert stored(tmp_path) == want
    back = objects.load(spark, str(tmp_path), 200)
    assert {(r.key, r.length, bytes(r.content)) for r in back.collect()} == {(k, len(v), v) for k, v in want.items()}
    objects.save(spark.createDataFrame([("only", b"1")], OBJECT), str(tmp_path), "overwrite")
    assert stored(tmp_path) == {"only": b"1"}
    with pytest.raises(Exception, match="no key"):
        objects.save(spark.createDataFrame([("k", b"x"), ("../up", b"x")], OBJECT).repartition(2), str(tmp_path))
    assert stored(tmp_path) == {"only": b"1"} and not (tmp_path / "_temporary").exists()
    (tmp_path / "none").mkdir()
    assert objects.load(spark, f"{tmp_path}/none").count() == 0


def test_committed_objects_are_told_by_their_tasks(tmp_path):
    """A job that is published later sends no keys to the driver, and nothing has a name before."""
    import pyarrow as pa

    w = objects.Writer(str(tmp_path), False, "job")
    told = w.write(iter([pa.RecordBatch.from_pydict({"key": ["a", "b/c"], "content": [b"1", b"2"]})]))
    w.commit([told])
    assert (told.keys, told.n) == ([], 2)
    assert not objects.objects_in(*objects.opened(str(tmp_path)))


def test_folders_of_files_are_listed_by_tasks(spark, tmp_path):
    """The same rows as Spark's reader of files gives, which isn't used; each file is read once for its sizes."""
    for name in ("x/1/a.png", "x/1/b.bmp", "x/2/c d.PNG", "e", "x/_hidden/a.png", ".b.png", "x/_c.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    for pattern, recursive in (("*", True), ("*", False), ("*.png", True), ("*.{png,bmp}", True), ("[^a].bmp", True)):
        df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(str(tmp_path))
        got = files.files(spark, str(tmp_path), pattern, recursive)
        assert sorted((r.path, r.length, bytes(r.content)) for r in got.collect()) == sorted((r.path, r.length, bytes(r.content)) for r in df.collect())
        assert "binaryFile" not in got._jdf.queryExecution().toString()
    assert files.files(spark, f"{tmp_path}/x/*", "*.png").count() == 2
    found = files.images(spark, str(tmp_path))
    assert found.columns == ["path", "length", "content", "media", "kind", "width", "height", "id"]
    assert found.count() == 3 and "Join" not in found._jdf.queryExecution().toString()


def test_put_hides_unfinished_files(spark, tmp_path):
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "part").write_text("half")
    files.put(spark.createDataFrame([("x/a.txt", b"1")], OBJECT), str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[1] for r in files.files(spark, str(tmp_path)).collect()} == {"a.txt"}


# Versions

ROW = "id bigint, owner bigint, title string"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), "id")
    with pytest.raises(ValueError):
        t.read()
    first = t.put(spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, 7, None)], ROW))
    start = rows_of(t.read())
    changes = [(1, 7, "older", 1), (1, 7, "newer", 2), (2, 7, "not the owner's", 3), (3, 7, "c", 1), (9, 7, "no such row", 1)]
    second = t.change(spark.createDataFrame(changes, "id bigint, owner bigint, title string, at int"), "owner", ["title"], order="at")
    assert rows_of(t.read()) == {(1, 7, "newer"), (2, 8, "b"), (3, 7, "c")}
    t.delete(spark.createDataFrame([(1, 8), (3, 7)], "id bigint, owner bigint"), "owner")
    t.put(spark.createDataFrame([(3, 9, "again"), (4, 9, "new")], ROW))
    now = {(1, 7, "newer"), (2, 8, "b"), (3, 9, "again"), (4, 9, "new")}
    assert rows_of(t.read()) == now and t.read().columns == ["id", "owner", "title"]
    last = t.compact()
    assert rows_of(t.read()) == now and len(t.manifest(last)["folders"]) == 1
    assert rows_of(t.read(first)) == start and rows_of(t.read(second)) == {(1, 7, "newer"), (2, 8, "b"), (3, 7, "c")}
    assert t.versions() == [1, 2, 3, 4, 5]
    t.delete(t.read().select("id"))
    assert rows_of(t.read()) == set()


def test_two_writers_do_not_both_commit(spark, tmp_path):
    a, b = VersionedTable(spark, str(tmp_path), "id"), VersionedTable(spark, str(tmp_path), "id")
    base = a.put(spark.createDataFrame([(1, 7, "a")], ROW))
    b.put(spark.createDataFrame([(1, 7, "by b")], ROW), base=base)
    with pytest.raises(Conflict):
        a.change(spark.createDataFrame([(1, 7, "by a")], ROW), "owner", ["title"], base=base)
    assert rows_of(a.read()) == {(1, 7, "by b")} and a.versions() == [1, 2]
    a.change(spark.createDataFrame([(1, 7, "by a")], ROW), "owner", ["title"])  # tried again on what is there now
    assert rows_of(b.read()) == {(1, 7, "by a")}
    assert not [p for p in (tmp_path / "log").iterdir() if p.name[0] == "." and not p.name.endswith(".crc")]
    assert json.loads((tmp_path / "log" / f"{1:020d}.json").read_text())["folders"]


def test_two_changes_of_a_key_give_one_row(spark):
    table = spark.createDataFrame([(1, 7, "a"), (2, 8, "b")], ROW)
    changes = spark.createDataFrame([(1, 7, "x", 2), (1, 7, "y", 1), (2, 7, "z", 1)], f"{ROW}, at int")
    assert sorted(map(tuple, engagement.updated(table, changes, "id", "owner", ["title"], ["at"]).collect())) == [(1, 7, "x"), (2, 8, "b")]
    assert sorted(map(tuple, engagement.updated(table, changes, "id", "owner", ["title"]).collect())) == [(1, 7, "y"), (2, 8, "b")]


# Sounds


def frames(head, size, n):
    return (head + bytes(size - len(head))) * n


V1, V2 = bytes([0xFF, 0xFB, 0x90, 0]), bytes([0xFF, 0xF3, 0x84, 0xC0])
SOUNDS = {
    "fixed": (frames(V1, 417, 100), 100 * 1152 / 44100),
    "padded": (frames(V1, 417, 3) + frames(bytes([0xFF, 0xFB, 0x92, 0]), 418, 5), 8 * 1152 / 44100),
    "tagged": (b"ID3\4\0\0" + bytes([0, 0, 1, 5]) + b"\xff\xfb\x90\0" * 33 + bytes(1) + frames(V1, 417, 10) + b"TAG" + bytes(125), 10 * 1152 / 44100),
    "junk": (b"\xff\xfb\x90\0" + bytes(50) + frames(V1, 417, 10), 10 * 1152 / 44100),
    "second version, mono": (frames(V2, 192, 7), 7 * 576 / 24000),
    "variable": (V1 + bytes(32) + b"Xing" + struct.pack(">II", 3, 5000) + bytes(900), 5000 * 1152 / 44100),
    "variable mono": (V2 + bytes(9) + b"Info" + struct.pack(">II", 1, 77) + bytes(200), 77 * 576 / 24000),
    "vbri": (V1 + bytes(32) + b"VBRI" + bytes(10) + struct.pack(">I", 321) + bytes(500), 321 * 1152 / 44100),
    "first layer": (frames(bytes([0xFF, 0xFF, 0x10, 0]), 32 * 12000 // 44100 * 4, 9), 9 * 384 / 44100),
    "cut off": (frames(V1, 417, 10)[:-5], 9 * 1152 / 44100),
    "text": (b"nothing here", 0.0),
    "none": (b"", 0.0),
    "null": (None, 0.0),
    "noise": (b"\xff" * 50, 0.0),
}


def ogg(pages, serial=5):
    return b"".join(b"OggS\0" + bytes([kind]) + struct.pack("<qIII", place, s or serial, i, 0) + bytes([len(body) // 255 + 1]) + bytes([255] * (len(body) // 255) + [len(body) % 255]) + body for i, (kind, place, body, s) in enumerate(pages))


VORBIS, OPUS = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + bytes(14), b"OpusHead\1\2" + struct.pack("<HI", 312, 44100) + bytes(3)
SOUNDS |= {
    "vorbis": (ogg([(2, 0, VORBIS, 0), (0, 30_000, bytes(3000), 0), (0, -1, bytes(10), 0), (4, 88_200, bytes(99), 0)]), 2.0),
    "opus": (ogg([(2, 0, OPUS, 0), (4, 48_312, bytes(300), 0)]), 1.0),
    "two streams": (ogg([(2, 0, VORBIS, 0), (2, 0, OPUS, 6), (4, 44_100, b"x", 0), (4, 999_999, b"x", 6)]), 1.0),
    "half a page": (ogg([(2, 0, VORBIS, 0), (0, 44_100, b"x", 0), (4, 88_200, bytes(500), 0)])[:-7], 1.0),
    "other": (ogg([(2, 0, b"other", 0), (4, 88_200, bytes(5), 0)]), 0.0),
}


def test_durations(spark):
    got = {r.path: r.seconds for r in sounds.durations(spark.createDataFrame([(k, v) for k, (v, _) in SOUNDS.items()], OBJECT.replace("key", "path"))).collect()}
    assert got == pytest.approx({k: s for k, (_, s) in SOUNDS.items()})


# Streams


def test_bursts_join_and_link():
    pause = 10
    r = random.Random(4)
    for _ in range(300):
        rows = [(r.randrange(120), i, 100 + i) for i in range(r.randint(1, 14))]
        bursts = []
        for row in rows:
            bursts = quiet.with_row(bursts, *row, pause)
        rows.sort()
        want = [[rows[0][0], *rows[0]]]
        for row in rows[1:]:
            if row[0] - want[-1][1] <= pause:
                want[-1][1:] = row
            else:
                want.append([row[0], *row])
        assert bursts == [tuple(w) for w in want]


def test_bursts_over_micro_batches(spark, tmp_path):
    """Rows in some disorder, within the lateness, over many batches: the last value of each burst, told once, and no
    state of a key is left once its bursts have ended."""
    start, r = datetime.datetime(2024, 1, 1), random.Random(1)
    rows = sorted((start + datetime.timedelta(minutes=r.randrange(3000)), i % 5, i) for i in range(400))
    for k in range(0, 400, 50):
        some = rows[k : k + 50]
        r.shuffle(some)
        spark.createDataFrame([(u, t, i) for t, u, i in some], "u bigint, ts timestamp, i bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    end = [(9, start + datetime.timedelta(minutes=m), 1000 + m) for m in (9000, 9500)]
    for row in end:
        spark.createDataFrame([row], "u bigint, ts timestamp, i bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    like = spark.read.parquet(f"{tmp_path}/log")
    with quiet.with_timers(spark):
        log = counters.stream(spark, f"{tmp_path}/log", like, 1)
        told = counters.drained(quiet.after_quiet(log, "u", "ts", "i", "i", "30 minutes", "15 hours"), "bursts", "append")
    got = sorted((x.u, x.value) for x in told.collect() if x.u != 9)
    want = sorted((x.u, x.i) for x in sequences.after_quiet(like.filter("u <> 9").withColumn("i", F.struct("ts", "i")), "u", "ts", "i", "30 minutes").select("u", F.col("i.i").alias("i")).collect())
    assert got == want and len(set(got)) == len(got) > 100
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != quiet.ROCKS


def test_daily_counts_free_their_state(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    for day in range(6):
        spark.createDataFrame([(start + datetime.timedelta(days=day, hours=h), "a") for h in range(3)], "ts timestamp, k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    like = spark.read.parquet(f"{tmp_path}/log")
    told = counters.drained(counters.windowed(counters.stream(spark, f"{tmp_path}/log", like, 1), "ts", "k", "1 day", "1 hour"), "daily", "update")
    assert sorted((x.start.day, x.n) for x in told.collect()) == [(d, 3) for d in range(1, 7)]  # no batch tells past days again


# Plans


def test_a_page_scans_its_content_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    items = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("user"))
    content = items.mapInArrow(counted, items.schema)
    users = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "uid bigint, name string")
    got = listing.page_with_authors(content, users, listing.ListQuery(sort=["id"], limit=10), "user", "uid", ["name"]).collect()
    assert [r["id"] for r in got] == list(range(499, 489, -1)) and seen.value == 500
    assert [r["author"] and r["author"]["name"] for r in got] == [f"n{i % 7}" if i % 7 < 5 else None for i in range(499, 489, -1)]


def test_running_counter_of_a_hot_key_in_stretches(spark):
    r = random.Random(9)
    rows = [(1 if i % 10 else 2, i, r.choice([1, -1, -1, 1]), i // 37) for i in range(1500)]
    now, want = {}, {}
    for k, i, s, _ in rows:
        now[k] = max(0, now.get(k, 0) + s)
        want[i] = now[k]
    df = spark.createDataFrame(rows, "k int, i int, step int, part int")
    for part in (None, "part"):
        got = engagement.saturating(df, "k", ["i"], "step", part)
        assert got.columns == [*df.columns, "counter"] and {x["i"]: x["counter"] for x in got.collect()} == want


@pytest.mark.parametrize("least", [0.2, 0.9, 3.0])
def test_kept_frames_by_matrices(spark, least):
    r = np.random.default_rng(int(least * 10))
    rows = [(s, i, [float(x) for x in r.random(6)]) for s in ("a", "b", "c") for i in range(3000 if s == "b" else 40)]
    rows += [("d", 0, [float("nan")] * 6), ("d", 1, [1.0] * 6), ("d", 2, [1.0] * 6)]
    want, last = set(), {}
    for s, i, x in rows:
        if s in last:
            far = 0.0
            for a, b in zip(last[s], x):
                far += abs(a - b)
        if s not in last or far >= least or far != far:
            last[s] = x
            want.add((s, i))
    got = sequences.kept_frames(spark.createDataFrame(rows, "s string, i bigint, x array<double>").repartition(5), "s", "i", "x", least)
    assert {tuple(x) for x in got.collect()} == want


def test_undo_takes_ties_by_action(spark):
    rows = [(1, 5, "push", 10), (1, 5, "undo", 0), (1, 5, "push", 9), (1, 6, "redo", 0)]
    df = spark.createDataFrame(rows, "f bigint, i int, a string, s bigint")
    got = [tuple(x) for x in sequences.undo_redo(df, "f", ["i"], "a", "s", 3).collect()]
    # push 9, push 10, undo: 9 is shown; redo: 10
    assert got == [(1, 10, 1, 0)]


def test_site_maps_are_cut_without_numbering_all(spark, monkeypatch):
    monkeypatch.setattr(documents, "SITEMAP_URLS", 10)
    rows = [("en", f"https://e/{i:03d}", f"<url>{i:03d}</url>") for i in range(95)] + [("de", "https://d/1", "<url>d</url>")]
    got = documents.sitemap_documents(spark.createDataFrame(rows, "lang string, loc string, xml string")).collect()
    assert len({(r.lang, r.part) for r in got}) == len(got) and all(r.xml.count("<url>") <= 10 for r in got)
    assert sorted(u for r in got for u in r.txt.split("\n")) == sorted(x[1] for x in rows)
    for r in got:
        assert r.txt.split("\n") == sorted(r.txt.split("\n"))
