"""Dense image rows against single-image kernels and plain loops; file formats against independent encoders."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import codecs, dense, kernels, pixels

IMAGE = "img string, w int, h int, data binary"


def made(seed, n=30, colours=256):
    """Images of several sizes."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        h, w = int(r.integers(1, 9)), int(r.integers(1, 12))
        out.append((f"i{i}", r.integers(0, colours, (h, w, 4)).astype(np.uint8)))
    return out


def table(spark, images):
    return spark.createDataFrame([(k, g.shape[1], g.shape[0], g.tobytes()) for k, g in images], IMAGE)


def grids(df, key="img"):
    return {r[key]: np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["h"], r["w"], 4).astype(np.int32) for r in df.collect()}


def test_pixel_tables_and_dense_rows_turn_into_each_other(spark, monkeypatch):
    monkeypatch.setattr(dense, "PIXELS_AT_ONCE", 50)
    images = made(1)
    px = dense.to_pixels(table(spark, images))
    want = {(k, x, y, *map(int, g[y, x])) for k, g in images for y in range(g.shape[0]) for x in range(g.shape[1])}
    rows = [tuple(r) for r in px.collect()]
    assert len(rows) == len(want) and set(rows) == want
    back = grids(dense.from_pixels(px.orderBy("x")))
    assert all((back[k] == g).all() for k, g in images) and len(back) == len(images)
    assert dense.to_pixels(table(spark, images).limit(0)).count() == 0 and dense.from_pixels(px.limit(0)).count() == 0
    part = dense.from_pixels(spark.createDataFrame([("a", 2, 1, 9, 9, 9, 9)], kernels.PIXELS)).first()
    assert (part["w"], part["h"]) == (3, 2) and bytes(part["data"]) == bytes(20) + bytes([9] * 4)


@pytest.mark.parametrize("change, plain", [(dense.flood_fill(1, 0, (9, 8, 7, 6)), kernels.flood_fill(1, 0, (9, 8, 7, 6))), (dense.clear_from_corners(1), kernels.clear_from_corners(1)), (dense.on_white, kernels.on_white)])
def test_stacks_equal_single_images(spark, monkeypatch, change, plain):
    monkeypatch.setattr(dense, "BYTES_AT_ONCE", 300)
    images = made(2, 60, colours=2)
    got = grids(dense.changed(table(spark, images), change))
    for k, g in images:
        assert (got[k] == plain(g.astype(np.int32))).all(), k


def corner_search(grid, tolerance):
    """Pixel by pixel, with one set of pixels that were looked at."""
    h, w = grid.shape[:2]
    out, seen = grid.copy(), set()
    for x, y in ((0, 0), (w - 1, 0), (0, h - 1), (w - 1, h - 1)):
        todo = [(x, y)] if (x, y) not in seen else []
        seen |= set(todo)
        colour = grid[y, x, :3]
        while todo:
            a, b = todo.pop()
            if abs(grid[b, a, :3] - colour).sum() > tolerance * 765 / 100:
                continue
            out[b, a, 3] = 0
            for c, e in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < w and 0 <= e < h and (c, e) not in seen:
                    seen.add((c, e))
                    todo.append((c, e))
    return out


def test_corners_share_what_was_looked_at():
    r = np.random.default_rng(5)
    for _ in range(300):
        grid = (r.integers(0, 3, (int(r.integers(1, 7)), int(r.integers(1, 7)), 4)) * 60).astype(np.int32)
        grid[..., 3] = 255
        want = corner_search(grid, 20)
        assert (kernels.clear_from_corners(20)(grid) == want).all() and (dense.clear_from_corners(20)(grid[None])[0] == want).all()


def test_layers_by_the_pixel_operator(spark, monkeypatch):
    monkeypatch.setattr(dense, "BYTES_AT_ONCE", 500)
    r = random.Random(4)
    layers = []
    for k, g in made(7, 40):
        for z in range(r.randint(1, 5)):
            px = np.roll(g, z, axis=1)
            px[..., 3] = np.where(px[..., 3] > 128, 255, px[..., 3] // (z + 1))
            layers.append((k, z, r.random() < 0.8, r.choice([0, 33, 100]), px.shape[1], px.shape[0], px.tobytes()))
    r.shuffle(layers)
    df = spark.createDataFrame(layers, "img string, z int, visible boolean, opacity int, w int, h int, data binary")
    got = {tuple(x) for x in dense.to_pixels(dense.composite(df)).collect()}
    want = {tuple(x) for x in pixels.composite(dense.to_pixels(df, ["img", "z", "visible", "opacity"])).collect()}
    assert got == want
    with pytest.raises(Exception, match="differ in size"):
        dense.composite(spark.createDataFrame([("a", 0, True, 100, 1, 1, bytes(4)), ("a", 1, True, 100, 2, 1, bytes(8))], df.schema)).collect()


def test_dense_operators_shuffle_no_pixels(spark, capsys):
    df = table(spark, made(3))
    dense.to_pixels(dense.changed(df, dense.flood_fill(0, 0, (1, 2, 3, 4)))).explain()
    dense.encoded(df, "png").explain()
    codecs.dimensions(df.select(F.col("img").alias("path"), F.col("data").alias("content"))).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_filters_by_the_pixel_operator(spark):
    df = table(spark, made(11))
    told = {"brightness": 130, "contrast": 70, "saturate": 140, "hue": 50, "invert": 20, "grayscale": 30}
    got = {tuple(x) for x in dense.to_pixels(dense.changed(df, dense.adjust(**told, sharpened=2))).collect()}
    want = {tuple(x) for x in pixels.adjusted(dense.to_pixels(df), **told, sharpen=2).collect()}
    assert got == want


@pytest.mark.parametrize("deviation", [0, 0.2, 0.6, 1, 2.2, 5])
def test_blur_is_three_plain_boxes(deviation):
    grid = np.random.default_rng(9).integers(0, 256, (6, 7, 4)).astype(np.int32)
    got = dense.blur(deviation)(grid[None])[0]
    x = np.zeros((46, 47, 4))
    x[20:26, 20:27] = grid
    x[..., :3] *= x[..., 3:] / 255
    whole = 1
    for before, after in dense.boxes(deviation):
        whole *= before + after + 1
        x = sum(np.roll(x, -k, axis=0) for k in range(-before, after + 1))
        x = sum(np.roll(x, -k, axis=1) for k in range(-before, after + 1))
    x = x[20:26, 20:27] / whole**2
    alpha = x[..., 3]
    assert (np.abs(got[..., 3] - alpha) <= 0.5 + 1e-6).all()
    shown = alpha > 1e-9
    assert (np.abs(got[..., :3] - x[..., :3] * 255 / np.maximum(alpha, 1e-9)[..., None])[shown] <= 0.5 + 1e-6).all()
    if deviation < 0.8:
        assert dense.boxes(deviation) == [] and (got == grid).all()


# PNG


def plain_png(x, depth, colour, laced, palette=b"", clear=b"", filters=(0, 1, 2, 3, 4)):
    """Written sample by sample; rows take the filters in turn."""
    h, w, channels = x.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def rows(part):
        above, out = None, b""
        step = max(1, channels * depth // 8)
        for k, line in enumerate(part):
            bits = "".join(format(int(v), f"0{depth}b") for v in line.ravel())
            row = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
            above, kind, coded = above or [0] * len(row), filters[k % len(filters)], []
            for i, v in enumerate(row):
                left, corner = (row[i - step], above[i - step]) if i >= step else (0, 0)
                p = left + above[i] - corner
                guess = [0, left, above[i], (left + above[i]) // 2, min((left, above[i], corner), key=lambda c: abs(p - c))][kind]
                coded.append((v - guess) % 256)
            out, above = out + bytes([kind, *coded]), row
        return out

    passes = [x[t::d, l::a] for l, t, a, d in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))] if laced else [x]
    body = zlib.compress(b"".join(rows(p) for p in passes if p.size))
    extra = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"")
    return codecs.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + extra + chunk(b"IDAT", body[:7]) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


CASES = [(c, d) for c, depths in ((0, (1, 2, 4, 8, 16)), (2, (8, 16)), (3, (1, 2, 4, 8)), (4, (8, 16)), (6, (8, 16))) for d in depths]


@pytest.mark.parametrize("laced", [0, 1])
@pytest.mark.parametrize("colour, depth", CASES)
def test_every_kind_of_png(colour, depth, laced):
    r = np.random.default_rng(depth * 10 + colour)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    for h, w in ((1, 1), (9, 13), (3, 2), (17, 5)):
        x = r.integers(0, 1 << depth, (h, w, channels))
        palette = r.integers(0, 256, (1 << depth, 3)).astype(np.uint8) if colour == 3 else None
        clear = {0: struct.pack(">H", int(x[0, 0, 0])), 2: b"".join(struct.pack(">H", int(v)) for v in x[0, 0]), 3: b"\x07\x08"}.get(colour, b"") if colour in (0, 2, 3) else b""
        got = codecs.png_pixels(plain_png(x, depth, colour, laced, palette.tobytes() if colour == 3 else b"", clear))
        most = (1 << depth) - 1
        for y in range(h):
            for i in range(w):
                v = [int(a) for a in x[y, i]]
                e = [int(a * 255 / most + 0.5) for a in v]
                want = {0: lambda: [e[0]] * 3 + [255], 2: lambda: [*e, 255], 3: lambda: [*map(int, palette[v[0]]), (7, 8)[v[0]] if v[0] < 2 else 255], 4: lambda: [e[0]] * 3 + [e[1]], 6: lambda: e}[colour]()
                if colour in (0, 2) and v == [int(a) for a in x[0, 0]]:
                    want[3] = 0
                assert got[y, i].tolist() == want
        if colour in (0, 3) and not laced:
            assert (codecs.png_pixels(codecs.png_bytes(x, depth, colour, palette.tobytes() if colour == 3 else b""))[..., :3] == got[..., :3]).all()


def test_damaged_files_have_a_reason(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (5, 6, 4))
    good, gif = plain_png(x, 8, 6, 0), animation(made_patches(r, 3))
    files = [("good", good), ("flipped", good[:60] + bytes([good[60] ^ 1]) + good[61:]), ("short", good[:-30]), ("huge", good[:16] + struct.pack(">II", 1 << 30, 1 << 30) + good[24:]), ("none", None), ("empty", b""), ("odd", b"BM" + bytes(60)), ("gif", gif), ("cut", gif[: len(gif) // 2]), ("gif head", gif[:13])]
    found = codecs.decoded(spark.createDataFrame(files, "path string, content binary")).collect()
    whole = {x.img for x in found if x.reason is None and x.data is not None}
    bad = {x.img: x.reason for x in found if x.reason}
    assert {"good", "gif"} <= whole and set(bad) == {k for k, _ in files} - {"good", "gif"} and not any(x.data for x in found if x.reason)
    for at in range(len(gif)):  # never more than a reason
        for data in (gif[:at], gif[:at] + bytes([gif[at] ^ 0x55]) + gif[at + 1 :], good[:at]):
            try:
                list(codecs.frames_of(data))
            except codecs.DAMAGE:
                pass


# Animations


def plain_lzw(indices, least, reset=None):
    """Variable codes from a plain dictionary of strings, as bits in a text."""
    clear, end = 1 << least, (1 << least) + 1
    bits, width = [], least + 1
    codes = {bytes([i]): i for i in range(clear)}
    put = lambda c: bits.append(format(c, f"0{width}b")[::-1])
    put(clear)
    now, top, count = b"", end, 0
    for i in indices:
        longer = now + bytes([i])
        if longer in codes:
            now = longer
            continue
        put(codes[now])
        count += 1
        if top + 1 < 4096 and not (reset and count % reset == 0):
            top += 1
            codes[longer] = top
            width = max(width, top.bit_length())
        else:  # the reader has made one more entry by now
            if top < 4095:
                width = max(width, (top + 1).bit_length())
            put(clear)
            codes, top, width = {bytes([k]): k for k in range(clear)}, end, least + 1
        now = bytes([i])
    put(codes[now])
    if top < 4095:
        width = max(width, (top + 1).bit_length())
    put(end)
    text = "".join(bits)
    return bytes(int(text[i : i + 8][::-1].rjust(8, "0"), 2) for i in range(0, len(text), 8))


def made_patches(r, n, w=9, h=7):
    """(left, top, indices, palette or None, laced, disposal, clear, delay)"""
    out = []
    for k in range(n):
        pw, ph = int(r.integers(1, w + 1)), int(r.integers(1, h + 1))
        left, top = int(r.integers(0, w - pw + 1)), int(r.integers(0, h - ph + 1))
        own = r.integers(0, 256, (8, 3)).astype(np.uint8) if k % 2 else None
        out.append((left, top, r.integers(0, 8, (ph, pw)), own, int(k % 3 == 1), k % 4, 3 if k % 5 else None, k))
    return out


SHARED = np.random.default_rng(77).integers(0, 256, (8, 3)).astype(np.uint8)


def animation(patches, w=9, h=7):
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | 2, 0, 0) + SHARED.tobytes() + b"\x21\xfe\x03abc\0"
    for left, top, x, own, laced, disposal, clear, delay in patches:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
        ph, pw = x.shape
        out += struct.pack("<BHHHHB", 0x2C, left, top, pw, ph, (0x82 if own is not None else 0) | 0x40 * laced) + (own.tobytes() if own is not None else b"")
        rows = [y for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, ph, b)] if laced else range(ph)
        body = plain_lzw(bytes(int(v) for y in rows for v in x[y]), 3, reset=7)
        out += b"\3" + b"".join(bytes([len(body[i : i + 11])]) + body[i : i + 11] for i in range(0, len(body), 11)) + b"\0"
    return out + b";"


def plain_canvas(patches, w=9, h=7):
    canvas, shown = {(x, y): (0, 0, 0, 0) for x in range(w) for y in range(h)}, []
    for left, top, x, own, _, disposal, clear, delay in patches:
        before = dict(canvas)
        for (j, i), v in np.ndenumerate(x):
            if v != clear:
                canvas[left + i, top + j] = (*map(int, (SHARED if own is None else own)[v]), 255)
        shown.append((delay, dict(canvas)))
        if disposal == 2:
            for j, i in np.ndindex(*x.shape):
                canvas[left + i, top + j] = (0, 0, 0, 0)
        elif disposal == 3:
            canvas = before
    return shown


def test_animations_read_back(spark):
    files, want = [], {}
    for seed in range(25):
        patches = made_patches(np.random.default_rng(seed), 9)
        files.append((str(seed), animation(patches)))
        for pos, (delay, canvas) in enumerate(plain_canvas(patches)):
            want |= {(str(seed), pos, delay, x, y): c for (x, y), c in canvas.items()}
    frames = codecs.decoded(spark.createDataFrame(files, "path string, content binary"))
    assert frames.filter("reason is not null").count() == 0
    got = {tuple(r)[:5]: tuple(r)[5:] for r in dense.to_pixels(frames, ["img", "pos", "delay"]).collect()}
    assert got == want


@pytest.mark.parametrize("least, n", [(2, 1), (2, 5000), (3, 300), (8, 1), (8, 60_000), (8, 255), (8, 511), (8, 4096)])
def test_codes_read_back(least, n):
    r = np.random.default_rng(n)
    for top in (1, 1 << least):
        x = r.integers(0, top, n).astype(np.uint8).tobytes()
        assert codecs.unlzw(codecs.lzw(x, least), least, n) == x == codecs.unlzw(plain_lzw(x, least), least, n)
        for cut in range(1, min(n, 600), 7):
            assert codecs.unlzw(codecs.lzw(x[:cut], least), least, cut) == x[:cut]


def test_written_animations(spark):
    r = np.random.default_rng(3)
    palette = r.integers(0, 256, (200, 3)).astype(np.uint8)
    x = [np.kron(r.integers(0, 200, (3, 4)), np.ones((9, 8), int)) for _ in range(30)]
    rows = [(7, i, 32, 27, f.astype(np.uint8).tobytes(), palette.tobytes()) for i, f in enumerate(x)]
    df = spark.createDataFrame(rows[::-1], "seq bigint, pos int, w int, h int, data binary, palette binary")
    parts = sorted(codecs.animated(df, 12.5, most=8).collect(), key=lambda p: p["part"])
    assert [p["part"] for p in parts] == [0, 1, 2, 3]  # no group holds more than 8 frames
    shown = [f for p in parts for f in codecs.gif_frames(bytes(p["content"]))]
    assert [d for d, _ in shown] == [8] * 30 and all((g[..., :3] == palette[f]).all() for (_, g), f in zip(shown, x))
    assert sum(len(p["content"]) for p in parts) < 30 * 27 * 32 * 9 / 8 / 2  # literal codes would take nine bits a pixel


def plain_median_cut(px, entries):
    """By lists of bins: {bin: entry}."""
    count = {}
    for r, g, b in px:
        count[r // 8, g // 8, b // 8] = count.get((r // 8, g // 8, b // 8), 0) + 1
    boxes = [sorted(count)]
    side = lambda box, a: max(c[a] for c in box) - min(c[a] for c in box)
    weight = lambda box: max(side(box, a) for a in range(3)) * sum(count[c] for c in box)
    while len(boxes) < entries:
        k = max(range(len(boxes)), key=lambda i: (weight(boxes[i]), -i))
        if weight(boxes[k]) == 0:
            break
        box = boxes[k]
        a = max(range(3), key=lambda i: (side(box, i), -i))
        total, so_far = sum(count[c] for c in box), 0
        for v in sorted({c[a] for c in box}):
            so_far += sum(count[c] for c in box if c[a] == v)
            if so_far * 2 >= total:
                break
        low = [c for c in box if c[a] <= v]
        if len(low) == len(box):
            low = [c for c in box if c[a] < v]
        boxes[k] = low
        boxes.append([c for c in box if c not in low])
    return {c: i for i, box in enumerate(boxes) for c in box}


@pytest.mark.parametrize("entries", [1, 2, 7, 64])
def test_palettes_by_plain_median_cut(spark, entries):
    r = np.random.default_rng(entries)
    images = [(f"g{i % 3}", g) for i, (_, g) in enumerate(made(21, 24))]
    images += [("one", np.full((2, 3, 4), 50, np.uint8))]
    df = spark.createDataFrame([(k, f"{k}-{i}", g.shape[1], g.shape[0], g.tobytes()) for i, (k, g) in enumerate(images)], "seq string, img string, w int, h int, data binary")
    tables = codecs.palettes(codecs.colour_counts(df.repartition(3), "seq"), "seq", entries)
    got = {x["seq"]: (np.frombuffer(bytes(x["palette"]), np.uint8).reshape(-1, 3).astype(int), bytes(x["lookup"])) for x in tables.collect()}
    coded = {x["img"]: bytes(x["data"]) for x in codecs.indexed(df, tables, "seq").collect()}
    for seq in {k for k, _ in images}:
        px = [tuple(map(int, p[:3])) for k, g in images if k == seq for p in g.reshape(-1, 4)]
        entry = plain_median_cut(px, entries)
        palette, lookup = got[seq]
        assert {c: lookup[c[0] << 10 | c[1] << 5 | c[2]] for c in entry} == entry and len(palette) == len(set(entry.values()))
        for i, colour in enumerate(palette):
            own = [p for p in px if entry[p[0] // 8, p[1] // 8, p[2] // 8] == i]
            assert colour.tolist() == [int(sum(p[c] for p in own) / len(own) + 0.5) for c in range(3)]
    for i, (k, g) in enumerate(images):
        assert coded[f"{k}-{i}"] == bytes(got[k][1][int(p[0]) // 8 << 10 | int(p[1]) // 8 << 5 | int(p[2]) // 8] for p in g.reshape(-1, 4))
    assert r is not None and codecs.palettes(codecs.colour_counts(df.limit(0), "seq"), "seq").count() == 0


def test_sizes_of_odd_files(spark):
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 60_002) + b"\xff" * 60_000 + b"\xff\xff\xff\xff\xd8"[:2] + b"\xff\xd0" + b"\xff\xff\xff\xc0" + struct.pack(">HBHH", 17, 8, 30, 40)
    webp = b"RIFF0000WEBP" + b"EXIF" + struct.pack("<I", 7) + bytes(8) + b"VP8 " + struct.pack("<I", 20) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 33, 44)
    extended = b"RIFF0000WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (299).to_bytes(3, "little") + (399).to_bytes(3, "little")
    icon = b"\0\0\1\0\2\0" + bytes([0, 0]) + bytes(14) + bytes([16, 16]) + bytes(14)
    files = [("a", jpeg), ("b", webp), ("c", extended), ("d", icon), ("e", jpeg[:50_000]), ("f", webp[:20]), ("g", b"text"), ("h", None), ("i", b"\xff\xd8\xff\xd9"), ("j", b"RIFF0000WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 9 | 19 << 14))]
    got = {r["path"]: tuple(r)[1:] for r in codecs.dimensions(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a": ("jpeg", 40, 30), "b": ("webp", 33, 44), "c": ("webp", 300, 400), "d": ("ico", 256, 256), "e": ("jpeg", None, None), "f": ("webp", None, None), "g": (None, None, None), "h": (None, None, None), "i": ("jpeg", None, None), "j": ("webp", 10, 20)}


def test_jobs_are_converted_once(spark):
    images = made(4, 6)
    jobs = [("i0", True, b"kept"), ("i1", False, None), ("gone", False, None), ("i2", False, b"old")]
    got = {x["img"]: tuple(x)[1:] for x in codecs.converted(spark.createDataFrame(jobs, "img string, done boolean, out binary"), table(spark, images), "png").collect()}
    assert got["i0"] == (True, b"kept") and got["gone"] == (False, None)
    for k in ("i1", "i2"):
        assert got[k][0] and (codecs.png_pixels(bytes(got[k][1])) == dict(images)[k]).all()
    wanted = spark.createDataFrame([(f"i{i}", k) for i, k in enumerate(["bmp", "ico", "gif", "webp"])], "img string, kind string")
    made_ = {x["img"]: (x["kind"], bytes(x["content"])) for x in codecs.dispatched(table(spark, images), wanted).collect()}
    assert [made_[f"i{i}"][0] for i in range(4)] == ["bmp", "ico", "gif", "png"]
    assert (next(codecs.frames_of(made_["i1"][1]))[1] == dict(images)["i1"]).all()


# Tiles


def blobs(seed, n=3):
    """Images of few colours whose regions wind through several tiles."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        h, w = int(r.integers(1, 150)), int(r.integers(1, 150))
        coarse = r.integers(0, 2, (h // 3 + 1, w // 2 + 1)) * 90
        grid = np.zeros((h, w, 4), np.uint8)
        grid[..., 0] = np.kron(coarse, np.ones((3, 2), int))[:h, :w]
        grid[..., 3] = 255
        out.append((f"b{i}", grid))
    spiral = np.zeros((61, 61, 4), np.uint8)
    spiral[..., 3] = 255
    for k in range(0, 30, 2):
        spiral[k, k : 61 - k, 0] = spiral[60 - k, k : 61 - k, 0] = spiral[k : 61 - k, 60 - k, 0] = spiral[k + 2 : 61 - k, k, 0] = 200
        spiral[k + 2, k + 1, 0] = 200
    return [*out, ("spiral", spiral)]


@pytest.mark.parametrize("side", [7, 64])
def test_tiles_equal_the_kernels_of_whole_images(spark, side):
    from tessel.operators import tiles

    images = blobs(side)
    df = tiles.cut(table(spark, images), side)
    whole = {tuple(x) for x in tiles.to_pixels(df, side).collect()}
    assert whole == {(k, x, y, *map(int, g[y, x])) for k, g in images for y in range(g.shape[0]) for x in range(g.shape[1])}
    seeds = spark.createDataFrame([(k, g.shape[1] // 2, g.shape[0] // 3) for k, g in images if k != "b0"] + [("b0", 5000, 0)], "img string, x int, y int")
    filled = {tuple(x) for x in tiles.to_pixels(tiles.flood_fill(df, seeds, (1, 2, 3, 4), side), side).collect()}
    cleared = {tuple(x) for x in tiles.to_pixels(tiles.clear_from_corners(df, 10, side), side).collect()}
    for k, g in images:
        f = kernels.flood_fill(g.shape[1] // 2, g.shape[0] // 3, (1, 2, 3, 4))(g.astype(np.int32)) if k != "b0" else g
        c = kernels.clear_from_corners(10)(g.astype(np.int32))
        for want, got in ((f, filled), (c, cleared)):
            assert {(k, x, y, *map(int, want[y, x])) for y in range(g.shape[0]) for x in range(g.shape[1])} == {p for p in got if p[0] == k}, k


def test_components_in_one_task_and_beyond(spark):
    from tessel.operators import graph

    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(3, None)]
    root = {i: i for e in edges for i in e if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)
    for bound in (0, 10_000):
        assert {x.node: x.root for x in graph.components(df, bound).collect()} == {i: top(i) for i in root if top(i) != i}
    assert graph.components(df.limit(0)).count() == 0


def test_parts_of_a_tile():
    from tessel.operators import tiles

    r = np.random.default_rng(6)
    for _ in range(40):
        kind = r.integers(-1, 2, (int(r.integers(1, 12)), int(r.integers(1, 12))))
        got = tiles.parts(kind)
        for y, x in np.ndindex(*kind.shape):
            if kind[y, x] < 0:
                assert got[y, x] == -1
                continue
            same = kernels.region(kind == kind[y, x], x, y)
            assert got[y, x] == np.flatnonzero(same.ravel())[0]


@pytest.mark.parametrize("side", [1, 3, 8])
def test_signatures_by_plain_means(spark, side):
    images = made(13, 20)
    got = {r["img"]: list(r["signature"]) for r in dense.signatures(table(spark, images), side).collect()}
    for k, g in images:
        h, w = g.shape[:2]
        want = []
        for j in range(side):
            for i in range(side):
                ys, xs = range(j * h // side, max(j * h // side + 1, (j + 1) * h // side)), range(i * w // side, max(i * w // side + 1, (i + 1) * w // side))
                for c in range(3):
                    cells = [int(g[y, x, c]) for y in ys for x in xs]
                    want.append(int(sum(cells) / len(cells) + 0.5))
        assert got[k] == want


def test_images_without_data(spark):
    rows = [("a", 1, 1, bytes([9] * 4)), ("b", 2, 2, None), ("c", None, None, None)]
    df = spark.createDataFrame(rows, IMAGE)
    assert {tuple(r)[:3] + (r["data"] and bytes(r["data"]),) for r in dense.changed(df, dense.on_white).collect()} == {("a", 1, 1, bytes([246, 246, 246, 255])), ("b", 2, 2, None), ("c", None, None, None)}
    assert dense.to_pixels(df).count() == 1 and {r["img"]: r["content"] is None for r in dense.encoded(df, "bmp").collect()} == {"a": False, "b": True, "c": True}
    wanted = spark.createDataFrame([("a", "gif"), ("b", "gif")], "img string, kind string")
    assert {(r["img"], r["content"] is None) for r in codecs.dispatched(df, wanted).collect()} == {("a", False), ("b", True)}
    assert codecs.colour_counts(df, "img").count() == 1
    assert {r["img"]: r["signature"] for r in dense.signatures(df, 1).collect()} == {"a": [9, 9, 9], "b": None, "c": None}
