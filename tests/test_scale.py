"""What must not grow with a table: what is broadcast, the share of one task, and what a task holds."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel import catalog
from tessel.operators import codecs, dense, kernels

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
IMAGE = "img string, w int, h int, data binary"


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


#: Queries that joined tables of images, which Spark takes for as small as the parts that they are made from.
SHUFFLED = [
    "adaptive_palettes",
    "encode_files",
    "convert_pending",
    "stamp_colours",
    "ghost_frames",
    "fill_rectangle",
]


@pytest.mark.parametrize("name", SHUFFLED)
def test_images_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan_of(QUERIES[name](spark, SF))


def test_an_image_meets_a_small_lookup(spark):
    """Not the 32,768 bytes of its group's lookup each."""
    data = bytes(np.random.default_rng(1).integers(0, 256, 4 * 64, np.uint8))
    df = spark.createDataFrame([("a", "x", 8, 8, data), ("a", "y", 8, 8, None)], f"seq string, {IMAGE}")
    made = codecs.indexed(df, codecs.palettes(codecs.colour_counts(df, "seq"), "seq", 4), "seq")
    assert plan_of(made).count("MapInArrow") > plan_of(codecs.palettes(codecs.colour_counts(df, "seq"), "seq", 4)).count("MapInArrow") + 1
    assert [len(r["data"]) for r in made.collect()] == [64]


def stack(seed, n=20):
    r = np.random.default_rng(seed)
    return [(f"i{i}", r.integers(0, 256, (int(r.integers(1, 9)), int(r.integers(1, 12)), 4)).astype(np.uint8)) for i in range(n)]


def table(spark, images):
    return spark.createDataFrame([(k, g.shape[1], g.shape[0], g.tobytes()) for k, g in images] + [("none", 3, 3, None)], IMAGE)


@pytest.mark.parametrize("laid", [False, True])
def test_marks_on_dense_rows(spark, monkeypatch, laid):
    """Points beyond the edges are left out; images without marks and without data stay."""
    monkeypatch.setattr(dense, "BYTES_AT_ONCE", 300)
    images = stack(3)
    colour = lambda i: (i, 200, 9, 120 + i)
    marks = spark.createDataFrame([(f"i{i}", *colour(i)) for i in range(0, 20, 2)] + [("none", 1, 1, 1, 1)], "img string, r int, g int, b int, a int")
    points = [(x, y) for x in range(-1, 5) for y in (0, 2, 2, 50)]
    got = {r["img"]: r["data"] for r in dense.marked(table(spark, images), kernels.placed(marks, lambda s: points), laid, 70).collect()}
    assert got.pop("none") is None and len(got) == 20
    for i, (k, g) in enumerate(images):
        want = g.astype(np.int32)
        if i % 2 == 0:
            for x, y in {p for p in points if 0 <= p[0] < g.shape[1] and 0 <= p[1] < g.shape[0]}:
                top = np.array([[colour(i)]], np.int32)
                want[y, x] = dense.over(top, top[..., 3] * 70 / 25500, want[y : y + 1, x : x + 1])[0, 0] if laid else top[0, 0]
        assert (np.frombuffer(bytes(got[k]), np.uint8).reshape(g.shape) == want).all(), k


def test_cropped_and_centred_images(spark):
    """Each image knows its size, so no table of sizes is made from pixels or joined."""
    images = stack(4)
    small = dense.cropped(table(spark, images), F.lit(4), F.col("h") - 1)
    sizes = small.select("w", "h").unionByName(spark.createDataFrame([(9, 13)], "w int, h int"))
    got = {tuple(r) for r in dense.centred(small, sizes).collect()}
    want = set()
    for k, g in images:
        cut = g[: g.shape[0] - 1, :4]
        left, top = (9 - cut.shape[1]) // 2, (13 - cut.shape[0]) // 2
        want |= {(k, left + x, top + y, *map(int, cut[y, x])) for y in range(cut.shape[0]) for x in range(cut.shape[1])}
    assert got == want
    plan = plan_of(QUERIES["centre_images"](spark, SF))
    assert "SortMergeJoin" not in plan and "hashpartitioning(img" not in plan


def test_differences_of_dense_rows(spark, monkeypatch):
    monkeypatch.setattr(dense, "BYTES_AT_ONCE", 300)
    a, b = stack(5), stack(6, 15)
    got = {r["img"]: r["l1"] for r in dense.difference(table(spark, a), table(spark, b), ["img"]).collect()}
    want = {}
    for (k, g), (_, o) in zip(a, b):
        h, w = min(g.shape[0], o.shape[0]), min(g.shape[1], o.shape[1])
        want[k] = int(np.abs(g[:h, :w, :3].astype(int) - o[:h, :w, :3].astype(int)).sum())
    assert got == want
    assert "x#" not in plan_of(QUERIES["image_difference"](spark, SF))  # no pixel is shuffled


def test_bursts_are_kept_without_python(spark, tmp_path):
    """A row of a stream costs no call into Python; timers tell the same."""
    import datetime
    import random

    from tessel.streaming import counters, quiet

    start, r = datetime.datetime(2024, 1, 1), random.Random(7)
    rows = [(i % 3, start + datetime.timedelta(minutes=r.randrange(600)), i) for i in range(100)] + [(9, start + datetime.timedelta(days=3), 100)]
    for some in (rows[:50], rows[50:100], rows[100:]):
        spark.createDataFrame(some, "u bigint, ts timestamp, i bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    like = spark.read.parquet(f"{tmp_path}/log")
    told, plans = [], []
    for way in (quiet.after_quiet, quiet.after_quiet_by_timers):
        with quiet.with_timers(spark):
            bursts = way(counters.stream(spark, f"{tmp_path}/log", like, 1), "u", "ts", "i", "i", "30 minutes", "15 hours")
            plans.append(plan_of(bursts))
            told.append(sorted((x.u, x.value, x.at) for x in counters.drained(bursts, "bursts", "append").collect() if x.u != 9))
    assert told[0] == told[1] and len(told[0]) > 10
    assert "Python" not in plans[0] and "Pandas" not in plans[0]


def test_images_are_dealt_out_by_their_count(spark, tmp_path):
    """A file of few bytes that stands for many pixels is one split; its images aren't one task."""
    from tessel.plans import raster

    parts = spark.read.parquet(f"{SF}/part.parquet").crossJoin(spark.range(30).withColumnRenamed("id", "k"))
    parts.withColumn("p_partkey", F.col("p_partkey") + 200 * F.col("k")).drop("k").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert spark.read.parquet(f"{tmp_path}/part.parquet").rdd.getNumPartitions() == 1
    for made in (raster.image(spark, str(tmp_path)), raster.dense_image(spark, str(tmp_path), "p_partkey")):
        assert made.rdd.getNumPartitions() == 3
    group = raster.dense_image(spark, str(tmp_path), "p_partkey").withColumn("at", F.spark_partition_id()).groupBy(F.floor(F.col("p_partkey") / 192)).agg(F.count_distinct("at").alias("n"))
    assert group.agg(F.max("n")).first()[0] == 1  # sequences and sheets stay together


def test_many_images_are_larger_tasks():
    """In proportion to their count at both ends, and never a handful between."""
    from tessel.plans import raster

    assert [raster.tasks_of(n) for n in (0, 1, 2048, 2049, 120_000)] == [1, 1, 1, 2, 59]
    assert [raster.tasks_of(n) for n in (1_200_000, 7_200_000, 72_000_000)] == [96, 440, 4395]


#: Queries that read images by that step.
DEALT = [
    # queries
    "image_dimensions",
    "blur_colours",
    "palette_colours",
    "outline_rectangle",
    "adjust_colours",
    "merge_down",
    "flood_fill",
    "clear_corners",
    "quantise_colours",
    "chroma_key",
    "convert_dispatch",
    "split_sheet",
    "sharpen",
    "adjust_hue",
    "decode_images",
    "erase",
    "decode_depths",
    "converted_pixels",
]


@pytest.mark.parametrize("name", DEALT)
def test_queries_deal_their_images_out(spark, name):
    assert "REPARTITION_BY_NUM" in plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name, of_the_name", [("decode_depths", "regexp_extract"), ("decode_images", "substring")])
def test_a_name_is_read_once_an_image(spark, name, of_the_name):
    """Not once for each of its pixels, which are made last."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert 0 <= plan.index("MapInArrow") < plan.index(of_the_name)


@pytest.mark.parametrize("name", ["split_sheet", "adjust_colours", "outline_rectangle", "chroma_key", "quantise_colours"])
def test_a_name_is_put_together_once_an_image(spark, name):
    """Beneath the step that makes the pixels (plans begin at the top)."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert 0 <= plan.index("Generate explode") < plan.index("concat(")


@pytest.mark.parametrize("name", ["convert_dispatch", "converted_pixels"])
def test_images_know_their_format(spark, name):
    """It follows from their names, so they don't meet a table of names and aren't shuffled or made a second time for it."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_formats_by_column_and_by_table(spark, monkeypatch):
    """The same files; images without data or a name stay with a column."""
    monkeypatch.setattr(dense, "BYTES_AT_ONCE", 300)
    images = table(spark, stack(12))
    kind = F.element_at(F.array(*map(F.lit, ["bmp", "ico", "gif", "png", "webp"])), F.length("img") + F.ascii(F.right("img", F.lit(1))) % 4 - 1)
    by_table = codecs.dispatched(images, images.select("img", kind.alias("kind")))
    by_column = codecs.dispatched(images, kind)
    assert sorted(map(repr, by_column.collect())) == sorted(map(repr, by_table.collect())) and by_column.select("kind").distinct().count() == 4
    lone = codecs.dispatched(images.withColumn("img", F.lit(None).cast("string")).filter("data is not null").limit(1), F.lit("bmp")).collect()
    assert [(r["img"], r["kind"], bytes(r["content"][:2])) for r in lone] == [(None, "bmp", b"BM")]


def test_files_of_many_images_are_those_of_one():
    """Also every step of a channel in a GIF, and the palette is made once for all."""
    every = np.stack([np.arange(256)] * 3 + [np.arange(256)[::-1]], axis=1).reshape(2, 8, 16, 4).astype(np.int32)
    for kind in ("bmp", "ico", "gif", "webp"):
        assert codecs.in_kind(every, kind)[1] == [codecs.in_kind(every[i : i + 1], kind)[1][0] for i in range(2)]
    for grid, file in zip(every, codecs.in_kind(every, "gif")[1]):
        (_, shown), = codecs.gif_frames(file)
        assert (shown[..., :3] == np.floor(grid[..., :3] / 51 + 0.5) * 51).all()
    assert [next(codecs.frames_of(f))[1][0, 0].tolist() for f in codecs.in_kind(np.full((1, 1, 1, 4), 100, np.int32), "bmp")[1]] == [[194, 194, 194, 255]]


def test_a_repeated_part_is_converted_to_one_row(spark, tmp_path):
    """SQL asks for distinct names."""
    parts = spark.read.parquet(f"{SF}/part.parquet").limit(5)
    parts.unionByName(parts).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["convert_dispatch"](spark, str(tmp_path)).count() == 5


def test_animations_are_made_once(spark):
    """The sizes and the frames read what was written; neither makes the files again."""
    assert "FlatMapGroupsInPandas" not in plan_of(QUERIES["encode_animation"](spark, SF))


def test_a_kernel_holds_a_megabyte_of_images_at_once(spark):
    """However large the Arrow batch: a filter makes tens of bytes of each."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([bytes(1024)] * 10_000, pa.binary())], ["data"])
    parts = [b.num_rows for b in dense.sliced(batch, 0)]
    assert sum(parts) == 10_000 and max(parts) <= 1024


def test_regions_of_many_images(spark):
    """Edges of an image are linked where they are read; those of one too large for that go on to ``components``."""
    from tessel.operators import graph, tiles

    r = np.random.default_rng(8)
    rows = [(f"i{k}", 1000 * k + int(a), 1000 * k + int(b)) for k in range(12) for a, b in r.integers(0, 60, (50, 2))]
    edges = spark.createDataFrame(rows, "img string, a bigint, b bigint").repartition(5)
    want = {tuple(x) for x in graph.components(edges).collect()}
    for bound in (10, 10**6):
        assert {tuple(x) for x in tiles.regions(edges, bound).select("node", "root").collect()} == want
    assert tiles.regions(edges.limit(0)).count() == 0


def test_a_border_is_a_row_not_a_row_a_cell(spark):
    from tessel.operators import tiles

    df = tiles.cut(spark.createDataFrame([("a", 16, 16, bytes(1024))], IMAGE), 8).withColumn("tile", F.monotonically_increasing_id())
    labelled = tiles.with_labels(df, lambda row: tiles.packed(tiles.grid_of(row)))
    sides = tiles.borders(labelled, 8)
    assert sides.filter("tx between 0 and 1 and ty between 0 and 1").count() == 8  # two sides each of four borders


@pytest.mark.parametrize("name, workers", [("sharpen", 2), ("adjust_hue", 2), ("blur_colours", 2), ("flood_fill", 2), ("clear_corners", 2), ("merge_down", 3)])
def test_pixels_are_rows_of_spark(spark, name, workers):
    """Images are changed where they are taken apart, not by a worker more in every task, and Python makes no rows of pixels."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("MapInArrow") == workers and plan.count("Generate posexplode") == 1


@pytest.mark.parametrize("at_once", [7, 1 << 16])
def test_pixels_of_dense_rows(spark, monkeypatch, at_once):
    """Also of images that are larger than an array, and with a change."""
    monkeypatch.setattr(dense, "PIXELS_AT_ONCE", at_once)
    monkeypatch.setattr(dense, "BYTES_AT_ONCE", 300)
    images = stack(9)
    turned = lambda s: 255 - s.swapaxes(1, 2)
    for change, made in ((None, lambda g: g), (turned, lambda g: 255 - g.swapaxes(0, 1))):
        df = dense.to_pixels(table(spark, images).withColumn("more key", F.length("img")), ["img", "more key"], change)
        assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("img", "string"), ("more key", "int"), *((c, "int") for c in "xyrgba")]
        want = [(k, len(k), x, y, *map(int, made(g)[y, x])) for k, g in images for y in range(made(g).shape[0]) for x in range(made(g).shape[1])]
        assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("deviation", [1.5, 20])
def test_running_sums_of_a_blur_may_go_round(monkeypatch, deviation):
    """Sums of narrow boxes have 32 bits; a long white image still is white, and its kernel holds no wider numbers."""
    kinds = set()
    cumsum = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda x, **how: (kinds.add(x.dtype), cumsum(x, **how))[1])
    made = dense.blur(deviation)(np.full((1, 300, 400, 4), 255, np.int32))
    assert (made[..., :3] == 255).all() and (made[:, 120:180, 120:280] == 255).all()
    assert kinds == {np.dtype(np.int32 if deviation == 1.5 else np.int64)}
