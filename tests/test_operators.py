"""Kernels and folds against hand-made results and plain versions."""

import datetime
import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions import scalars as S
from tessel.operators import codecs, engagement, kernels, listing, pixels, sequences
from tessel.sources import files


def test_saturating_counter_equals_the_fold(spark):
    r = random.Random(3)
    rows = [(r.randint(1, 4), i, r.choice([1, -1, -1]), i // 50) for i in range(600)]
    want = {}
    for k, _, s, _ in rows:
        want[k] = max(0, want.get(k, 0) + s)
    df = spark.createDataFrame(rows, "k int, i int, step int, part int")
    for part in (None, "part"):
        got = engagement.final_counter(df, "k", ["i"], "step", part).collect()
        assert {x["k"]: x["counter"] for x in got} == want
    assert engagement.saturating(df, "k", ["i"], "step").filter("counter < 0").count() == 0


def test_kept_frames_compare_with_the_last_kept(spark):
    df = spark.createDataFrame([("s", i, [float(v)]) for i, v in enumerate([0, 1, 2, 3, 4, 9])], "seq string, pos bigint, sig array<float>")
    got = sequences.kept_frames(df, "seq", "pos", "sig", 2.0)
    assert sorted(x["pos"] for x in got.collect()) == [0, 2, 4, 5]  # lag() would keep 0 and 5 only
    assert sequences.kept_frames(df.limit(0), "seq", "pos", "sig", 2.0).count() == 0


def test_kept_frames_hold_no_sequence(spark, capsys):
    """Long sequences over many batches, against a plain fold; no row holds a sequence."""
    r = random.Random(6)
    rows = [(s, i, [r.random(), r.random()]) for s in ("a", "b", None) for i in range(25_000 if s == "a" else 50)]
    rows += [("c", 0, None), ("c", 1, [0.0]), ("c", 2, [5.0, 5.0]), ("c", 3, [None]), ("c", 4, [9.0])]
    want = {("c", 0), ("c", 1), ("c", 4)}
    last = {}
    for s, i, x in rows[:-5]:
        if s not in last or sum(abs(a - b) for a, b in zip(last[s], x)) >= 0.7:
            last[s] = x
            want.add((s, i))
    r.shuffle(rows)
    got = sequences.kept_frames(spark.createDataFrame(rows, "seq string, pos bigint, sig array<double>"), "seq", "pos", "sig", 0.7)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    got.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_ping_pong_has_2n_minus_2(spark):
    df = spark.createDataFrame([("s", i, i) for i in range(5)] + [("one", 0, 0)], "seq string, id bigint, pos bigint")
    out = sequences.ping_pong(df, "seq", "id")
    got = [x["pos"] for x in out.filter("seq = 's'").orderBy("pos").collect()]
    assert got == list(range(8)) and out.filter("seq = 'one'").count() == 1


def test_forward_move_lands_after_the_target(spark):
    df = spark.range(5).select(F.col("id").alias("pos"), sequences.moved(F.col("id"), 1, 3).alias("new"))
    assert [x["pos"] for x in df.orderBy("new").collect()] == [0, 2, 3, 1, 4]


def test_rounding_and_texts(spark):
    df = spark.createDataFrame([(-2.5, "  a\t", "")], "x double, t string, e string")
    row = df.select(S.half_up(F.col("x")).alias("r"), S.blank_to_null(F.col("t")).alias("t"), S.first_filled(F.col("e"), default="d").alias("d")).first()
    assert (row["r"], row["t"], row["d"]) == (-2, "a", "d")
    bad = spark.createDataFrame([("a.b",), ("a.!!.c",), (None,)], "t string").select(S.claims(F.col("t"), "sub bigint").alias("c"))
    assert [x["c"] and x["c"]["sub"] for x in bad.collect()] == [None, None, None]


def image(rows):
    return np.array([[(v, 0, 0, 255) for v in r] for r in rows], np.int32)


def test_flood_fill():
    grid = image([[1, 1, 2], [2, 1, 2], [1, 2, 1]])
    out = kernels.flood_fill(0, 0, (9, 9, 9, 9))(grid)
    assert (out[..., 0] == [[9, 9, 2], [2, 9, 2], [1, 2, 1]]).all()
    assert (kernels.flood_fill(7, 7, (9, 9, 9, 9))(grid) == grid).all()


def test_corner_clearing_stays_within_tolerance():
    grid = image([[0, 0, 200], [0, 200, 200], [200, 200, 0]])
    out = kernels.clear_from_corners(5)(grid)
    assert out[0, 0, 3] == 0 and out[1, 1, 3] == 255
    assert ((out[..., 3] == 0) <= (grid[..., 0] < 250)).all()


@pytest.mark.parametrize("end", [(9, 0), (0, 9), (9, 9), (3, 8), (-4, -7)])
def test_lines_are_connected(end):
    p = kernels.line(0, 0, *end)
    assert p[0] == (0, 0) and p[-1] == end and len(p) == max(map(abs, end)) + 1
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(p, p[1:]))


def midpoint_quarter(rx, ry):
    """By definition: candidates are compared by the ellipse's function half-way between them."""
    f = lambda x, y: ry * ry * x * x + rx * rx * y * y - rx * rx * ry * ry
    x, y, out = 0, ry, []
    while ry * ry * x <= rx * rx * y:
        out.append((x, y))
        x, y = x + 1, y if f(x + 1, y - 0.5) < 0 else y - 1
    while y >= 0:
        out.append((x, y))
        x, y = x + 1 if f(x + 0.5, y - 1) <= 0 else x, y - 1
    return out


def test_ellipse_follows_the_midpoint_rule():
    """Both parts against the definition; the whole is symmetric, and degenerate ones are lines."""
    for rx in range(1, 26):
        for ry in range(1, 26):
            got = kernels.quarter(rx, ry)
            assert got == midpoint_quarter(rx, ry) and got[0] == (0, ry) and got[-1][1] == 0
            for (x, y), (nx, ny) in zip(got, got[1:]):
                assert nx - x in (0, 1) and y - ny in (0, 1)
            p = set(kernels.ellipse(0, 0, rx, ry))
            assert p == {(-x, y) for x, y in p} == {(x, -y) for x, y in p} and p <= set(kernels.ellipse(0, 0, rx, ry, True))
    assert kernels.ellipse(0, 0, 0, 0) == [(0, 0)] and kernels.ellipse(0, 0, 2, 0) == [(x, 0) for x in range(-2, 3)]


def test_brushes():
    assert kernels.brush(1) == kernels.brush(0) == [(0, 0)]
    assert set(kernels.brush(2)) == {(0, 0), (1, 0), (0, 1), (1, 1)}
    assert {x for x, _ in kernels.brush(4)} == {-1, 0, 1, 2} and {x for x, _ in kernels.brush(5)} == {-2, -1, 0, 1, 2}


def test_regions_equal_a_plain_search():
    r = np.random.default_rng(4)
    for _ in range(60):
        grid = r.random((9, 12)) < 0.6
        y, x = int(r.integers(9)), int(r.integers(12))
        want, todo = set(), [(x, y)] if grid[y, x] else []
        while todo:
            a, b = todo.pop()
            if (a, b) not in want:
                want.add((a, b))
                todo += [(c, e) for c, e in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)) if 0 <= c < 12 and 0 <= e < 9 and grid[e, c]]
        got = kernels.region(grid, x, y)
        assert {(int(a), int(b)) for b, a in np.argwhere(got)} == want


def plain_over(top, alpha, under):
    v = under[3] / 255
    o = alpha + v * (1 - alpha)
    if alpha <= 0 or o <= 0:
        return under
    return tuple(int(min(255, max(0, np.floor((top[i] * alpha + under[i] * v * (1 - alpha)) / o + 0.5)))) for i in range(3)) + (int(np.floor(o * 255 + 0.5)),)


def test_layers_by_hand(spark):
    """Values, alphas, opacities and invisible layers against a plain loop; uncovered pixels are clear."""
    r = random.Random(5)
    rows, want = [], {}
    for x in range(300):
        under = (0, 0, 0, 0)
        for z in range(3):
            px = tuple(r.choice([0, 1, 77, 128, 200, 254, 255]) for _ in range(4))
            shown, opacity = r.random() < 0.7, r.choice([0, 1, 33, 50, 99, 100])
            rows.append(("i", z, shown, opacity, x, 0, *px))
            under = plain_over(px, px[3] * opacity / 25500 if shown else 0, under)
        want[x] = under
    df = spark.createDataFrame(rows, "img string, z int, visible boolean, opacity int, x int, y int, r int, g int, b int, a int")
    assert {p.x: (p.r, p.g, p.b, p.a) for p in pixels.composite(df).collect()} == want


def test_undo_and_redo(spark):
    r = random.Random(2)
    rows, want = [], {}
    for frame in range(6):
        shown, back, ahead = None, [], []
        for i in range(80):
            a = r.choice(["push", "push", "undo", "redo"])
            rows.append((frame, i, a, 100 * frame + i))
            if a == "push":
                if shown is not None:
                    back = (back + [shown])[-3:]
                shown, ahead = 100 * frame + i, []
            elif a == "undo" and back:
                ahead.append(shown)
                shown = back.pop()
            elif a == "redo" and ahead:
                back.append(shown)
                shown = ahead.pop()
        want[frame] = (shown, len(back), len(ahead))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "f bigint, i int, a string, s bigint")
    assert {x.f: (x.shown, x.undos, x.redos) for x in sequences.undo_redo(df, "f", ["i"], "a", "s", 3).collect()} == want
    assert sequences.undo_redo(df.limit(0), "f", ["i"], "a", "s", 3).count() == 0


def test_images_decode(spark):
    r = np.random.default_rng(3)
    grid = r.integers(0, 256, (5, 7, 4)).astype(np.int32)
    assert (codecs.png_pixels(kernels.png(grid)) == grid).all()
    assert (kernels.decoded_bmp(kernels.bmp(grid))[..., :3] == grid[..., :3]).all()
    rows = grid.astype(np.uint8).reshape(5, -1)
    filtered = b""
    for y in range(5):  # a filter a row: none, left, above, mean, Paeth
        above = rows[y - 1].astype(int) if y else np.zeros(28, int)
        line = []
        for i in range(28):
            left, corner = (int(rows[y][i - 4]), int(above[i - 4])) if i >= 4 else (0, 0)
            p = left + above[i] - corner
            guess = [0, left, above[i], (left + above[i]) // 2, min((left, int(above[i]), corner), key=lambda v: abs(p - v))][y]
            line.append((int(rows[y][i]) - int(guess)) % 256)
        filtered += bytes([y]) + bytes(line)
    assert (kernels.unfiltered(filtered, 5, 28, 4) == rows).all()
    bad = spark.createDataFrame([("a", b"nothing"), ("b", b"\x89PNG\r\n\x1a\nbroken"), ("c", b"")], "path string, content binary")
    assert {(x.img, x.data) for x in codecs.decoded(bad).collect()} == {("a", None), ("b", None), ("c", None)}
    assert all(x.reason for x in codecs.decoded(bad).collect())


def test_objects_are_put_by_key(spark, tmp_path):
    df = spark.createDataFrame([("gallery/1/a.bin", b"xy"), ("avatars/u/b.bin", b"")], "key string, content binary")
    for _ in range(2):  # putting again replaces
        assert {(x.key, x.length) for x in files.put(df, str(tmp_path)).collect()} == {("gallery/1/a.bin", 2), ("avatars/u/b.bin", 0)}
    assert (tmp_path / "gallery/1/a.bin").read_bytes() == b"xy" and len([p for p in tmp_path.rglob("*") if p.is_file()]) == 2
    with pytest.raises(Exception, match="no key"):
        files.put(spark.createDataFrame([("../x", b"")], df.schema), str(tmp_path)).collect()


def test_head_rewrite_stays_small(spark, capsys):
    from tessel import catalog

    catalog.queries()["head_rewrite"](spark, "/root/testdata/sf0.001").explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("regexp_replace") <= 20


def test_lists_keep_their_order(spark):
    from tessel import catalog

    page = [x["o_totalprice"] for x in catalog.queries()["list_page"](spark, "/root/testdata/sf0.001").collect()]
    best = [x["likes"] for x in catalog.queries()["showcase"](spark, "/root/testdata/sf0.001").collect()]
    assert page == sorted(page, reverse=True) and best == sorted(best, reverse=True)


def test_the_rest_needs_no_subpackage():
    """Nothing outside it imports the subpackage of the operators for training data."""
    root = Path(__file__).resolve().parents[1] / "tessel"
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "tessel.llm" in p.read_text()]


def test_key_is_idempotent_and_pages_do_not_overlap(spark):
    px = spark.createDataFrame([("i", x, 0, x * 30, 0, 0, 255) for x in range(8)], kernels.PIXELS)
    once = pixels.keyed(px, (0, 0, 0), 10)
    assert once.exceptAll(pixels.keyed(once, (0, 0, 0), 10)).count() == 0
    df = spark.range(50).withColumn("score", F.lit(1))
    pages = [{x["id"] for x in listing.page(df, listing.ListQuery(sort=["score"], page=i)).collect()} for i in range(3)]
    assert sum(map(len, pages)) == len(set.union(*pages)) == 50
    after = listing.keyset_page(df, listing.ListQuery(sort=["score"]), (1, 19))
    assert {x["id"] for x in after.collect()} == pages[1]


def test_split_rejects_zero(spark):
    with pytest.raises(ValueError):
        pixels.split_sheet(spark.createDataFrame([], kernels.PIXELS), 4, 4, 0, 1)


def test_containers(spark, tmp_path):
    grid = image([[1, 2, 3], [4, 5, 6]])
    b = kernels.bmp(grid)
    assert b[:2] == b"BM" and len(b) == 54 + 2 * 12 and b[54:57] == bytes([0, 0, 4])
    i = kernels.ico(grid)
    assert i[:6] == bytes([0, 0, 1, 0, 1, 0]) and i[6:8] == bytes([3, 2])
    (tmp_path / "a.png").write_bytes(kernels.png(grid))
    (tmp_path / "b.bmp").write_bytes(b)
    (tmp_path / "c.txt").write_text("x")
    got = {x["kind"]: (x["width"], x["height"]) for x in files.images(spark, str(tmp_path)).collect()}
    assert got == {"png": (3, 2), "bmp": (3, 2)}


def test_valid_rows_and_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, ""), (3, None)], "id int, title string")
    files.append_valid(engagement.checked(df, {"title": F.char_length("title").between(1, 100)}), f"{tmp_path}/t", f"{tmp_path}/q")
    assert {x["id"] for x in spark.read.parquet(f"{tmp_path}/t").collect()} == {1, 3}  # a null passes a CHECK
    assert [x["failed"] for x in spark.read.parquet(f"{tmp_path}/q").collect()] == [["title"]]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["o_orderkey", "o_custkey"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rows_without_an_author_stay(spark):
    items = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, user int")
    users = spark.createDataFrame([(7, "a")], "uid int, name string")
    every = listing.page_with_authors(items, users, listing.ListQuery(sort=["id"]), "user", "uid", ["name"])
    assert [(x["id"], x["author"] and x["author"]["name"]) for x in every.collect()] == [(3, None), (2, None), (1, "a")]


def test_folders_sounds_and_text_sinks(spark, tmp_path):
    for d in ("a", "b/c"):
        (tmp_path / "site" / d).mkdir(parents=True)
        (tmp_path / "site" / d / "index.html").write_text("x")
    assert {x["route"] for x in files.listing(spark, f"{tmp_path}/site").collect()} == {"a", "b/c"}
    form = b"fmt " + (16).to_bytes(4, "little") + bytes(8) + (8000).to_bytes(4, "little") + bytes(4)
    extra = b"LIST" + (6).to_bytes(4, "little") + bytes(6)  # the data needn't begin at byte 44
    wav = b"RIFF" + bytes(4) + b"WAVE" + form + extra + b"data" + (16000).to_bytes(4, "little") + bytes(16000)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.wav").write_bytes(wav)
    (tmp_path / "s" / "y.mp3").write_bytes(b"no")
    got = {x["media"]: x["sec"] for x in files.files(spark, f"{tmp_path}/s").select("media", files.wav_seconds("content").alias("sec")).collect()}
    assert got == {"audio/wav": 2.0, "audio/mpeg": 0.0}
    df = spark.createDataFrame([("en", "x"), ("de", "y")], "lang string, value string")
    files.append(df, f"{tmp_path}/t", ["lang"])
    files.append(df, f"{tmp_path}/t", ["lang"])
    assert spark.read.parquet(f"{tmp_path}/t").filter("lang = 'en'").count() == 2
    files.write_text(df, f"{tmp_path}/txt")
    assert {x["value"] for x in spark.read.text(f"{tmp_path}/txt").collect()} == {"x", "y"}


def test_accepted_colours_round_trip(spark):
    df = spark.createDataFrame([(0, 128, 255)], "r int, g int, b int")
    h = S.hex_colour(F.col("r"), F.col("g"), F.col("b"))
    row = df.select(h.alias("h"), *(S.colour_channel(h, i).alias(f"c{i}") for i in range(3))).first()
    assert tuple(row) == ("#0080ff", 0, 128, 255)


def test_streams_read_folders_in_batches(spark, tmp_path):
    """A table of more part files than a batch takes: all rows are read, and the last batch's
    counter is the one that holds."""
    from tessel import catalog

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 2, start + datetime.timedelta(hours=i), "error" if i >= 100 else "signup") for i in range(140)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string")
    df.repartitionByRange(70, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for i, f in enumerate(sorted((tmp_path / "events.parquet").glob("part-*"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in the order of their times
    got = catalog.queries()["stream_counters"](spark, str(tmp_path))
    assert {x["user_id"]: x["counter"] for x in got.collect()} == {0: 30, 1: 30}
    daily = catalog.queries()["stream_daily_counts"](spark, str(tmp_path)).collect()
    assert sum(x["n"] for x in daily) == 140 and len(daily) == 7
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert catalog.queries()["stream_counters"](spark, str(tmp_path)).count() == 0
