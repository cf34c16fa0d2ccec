"""Image files in and out, from the public formats: PNG of every depth (ISO/IEC 15948), GIF
animations (GIF89a), and the sizes that PNG, GIF, BMP, JPEG, WebP and ICO files name.

Files are rows (path, content) that Spark splits and tasks read where they lie; helpers here work on
one file. A file that can't be read gives no image but a reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import dense, kernels

Grid = np.ndarray
PNG = b"\x89PNG\r\n\x1a\n"
#: What damaged bytes make the helpers raise.
DAMAGE = (struct.error, ValueError, zlib.error, IndexError, KeyError, OverflowError, MemoryError)
#: Files of more pixels than this aren't read: a few bytes can claim a canvas of any size.
MOST_PIXELS = 1 << 26
#: First column or row and step of the seven passes of interlaced PNG files.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Rows of the four passes of interlaced GIF images: first and step.
LACES = ((0, 8), (4, 8), (2, 4), (1, 2))


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while True:
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, (sum_,) = data[at + 8 : at + 8 + n], struct.unpack(">I", data[at + 8 + n : at + 12 + n])
        if zlib.crc32(kind + part) != sum_:
            raise ValueError("a chunk's checksum differs")
        yield kind, part
        if kind == b"IEND":
            return
        at += 12 + n


def samples(raw: bytes, at: int, w: int, h: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """The samples (h, w, channels) of a pass whose filtered rows begin at ``at``, and its end."""
    stride, step = (w * depth * channels + 7) // 8, max(1, depth * channels // 8)
    rows = kernels.unfiltered(raw[at : at + h * (stride + 1)], h, stride, step)
    if depth == 16:
        x = rows.reshape(h, -1, 2).astype(np.int32) @ np.array([256, 1])
    elif depth == 8:
        x = rows.astype(np.int32)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth).astype(np.int32)
        x = bits @ (1 << np.arange(depth)[::-1])
    return x[:, : w * channels].reshape(h, w, channels), at + h * (stride + 1)


def png_pixels(data: bytes) -> Grid:
    """Pixels (h, w, 4) of a PNG file of any colour type, depth and interlacing. Samples are scaled to
    8 bits, the nearest value each."""
    body, palette, clear, head = [], None, None, None
    for kind, part in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
    w, h, depth, colour, _, _, laced = head or (0,) * 7
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if not 0 < w * h <= MOST_PIXELS or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise ValueError("its header can't be")
    # no more than the rows need, even if a few bytes stand for far more
    raw = zlib.decompressobj().decompress(b"".join(body), 2 * h * (w * depth * channels // 8 + 16) + 1024)
    if laced:
        x, at = np.zeros((h, w, channels), np.int32), 0
        for left, top, across, down in PASSES:
            pw, ph = -(-(w - left) // across), -(-(h - top) // down)
            if pw > 0 and ph > 0:
                x[top::down, left::across], at = samples(raw, at, pw, ph, depth, channels)
    else:
        x, _ = samples(raw, 0, w, h, depth, channels)
    out = np.full((h, w, 4), 255, np.int32)
    if colour == 3:
        alpha = np.full(256, 255, np.int32)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)
        out[..., :3], out[..., 3] = palette[x[..., 0]], alpha[x[..., 0]]
        return out
    most = (1 << depth) - 1
    scaled = (2 * 255 * x + most) // (2 * most)
    out[..., :3] = scaled[..., :3] if colour in (2, 6) else scaled[..., :1]
    if colour in (4, 6):
        out[..., 3] = scaled[..., -1]
    elif clear:
        out[(x == np.frombuffer(clear, ">u2", channels)).all(axis=2), 3] = 0
    return out


def ico_pixels(data: bytes) -> Grid:
    """The largest image of an icon: a PNG file or a bitmap of 32 bits."""
    (n,) = struct.unpack("<H", data[4:6])
    entries = [struct.unpack("<BBBBHHII", data[6 + 16 * i : 22 + 16 * i]) for i in range(n)]
    *_, size, at = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[6]))
    part = data[at : at + size]
    if part[:8] == PNG:
        return png_pixels(part)
    head, w, h, _, bits, packing = struct.unpack("<IiiHHI", part[:20])
    if bits != 32 or packing or not 0 < w * h <= 2 * MOST_PIXELS:
        raise ValueError("a bitmap of this kind can't be read")
    rows = np.frombuffer(part, np.uint8, w * h // 2 * 4, head).reshape(h // 2, w, 4)[::-1]
    return rows[..., [2, 1, 0, 3]].astype(np.int32)


def png_bytes(x: np.ndarray, depth: int, colour: int, palette: bytes = b"") -> bytes:
    """A PNG file of samples (h, w, channels) of that depth and colour type, without interlacing."""
    h, w, channels = x.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    flat = x.reshape(h, w * channels)
    if depth < 8:
        rows = np.packbits((flat[..., None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(h, -1), axis=1)
    else:
        rows = flat.astype(f">u{depth // 8}").view(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# Animations


def unlzw(data: bytes, least: int, n: int) -> bytes:
    """``n`` indices of codes whose width grows from ``least`` + 1 to 12 bits."""
    clear, end = 1 << least, (1 << least) + 1
    table: list[bytes] = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, size, width, bits, held, before = [], 0, least + 1, 0, 0, None
    have, full = end + 1, 1 << width  # entries, and how many codes of this width name
    for at in range(0, len(data), 4):
        some = data[at : at + 4]
        held |= int.from_bytes(some, "little") << bits
        bits += 8 * len(some)
        while bits >= width:
            code = held & (full - 1)
            held >>= width
            bits -= width
            if code == clear:
                del table[end + 1 :]
                have, width, full, before = end + 1, least + 1, 2 << least, None
                continue
            if code == end:
                return b"".join(out)
            if before is None:
                entry = table[code]
            else:
                if code < have:
                    entry = table[code]
                elif code == have:
                    entry = before + before[:1]
                else:
                    raise ValueError("a code isn't in the table")
                if have < 4096:
                    table.append(before + entry[:1])
                    have += 1
                    if have == full and width < 12:
                        width, full = width + 1, 2 * full
            out.append(entry)
            size += len(entry)
            before = entry
            if size > n:
                raise ValueError("there are too many indices")
    return b"".join(out)


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The contents of sub-blocks, and where they end."""
    out = []
    while data[at]:
        if at + 1 + data[at] >= len(data):
            raise ValueError("it is cut off")
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def palette_at(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def gif_frames(data: bytes) -> Iterator[tuple[int, Grid]]:
    """(delay in hundredths of a second, canvas) of each image of an animation: its patch is laid on
    what the image before left, which its disposal says (1 all, 2 a clear patch, 3 what was before)."""
    w, h, flags = struct.unpack("<HHB", data[6:11])
    if data[:6] not in (b"GIF87a", b"GIF89a") or not 0 < w * h <= MOST_PIXELS:
        raise ValueError("its header can't be")
    shared, at = palette_at(data, 13, flags)
    canvas, control = np.zeros((h, w, 4), np.int32), (0, 0, None)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                packed, delay, clear = struct.unpack("<BHB", body[:4])
                control = (packed >> 2 & 7, delay, clear if packed & 1 else None)
            at = end
            continue
        if data[at] != 0x2C:
            raise ValueError("a block's kind is unknown")
        left, top, pw, ph, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        own, at = palette_at(data, at + 10, flags)
        colours = own if own is not None else shared
        body, end = blocks(data, at + 1)
        index = np.frombuffer(unlzw(body, data[at], pw * ph), np.uint8)
        if len(index) < pw * ph or colours is None or left + pw > w or top + ph > h:
            raise ValueError("an image doesn't fit")
        index = index.reshape(ph, pw)
        if flags & 0x40:
            order = [y for first, step in LACES for y in range(first, ph, step)]
            plain = np.empty_like(index)
            plain[order] = index
            index = plain
        disposal, delay, clear = control
        before = canvas.copy() if disposal == 3 else None
        patch = canvas[top : top + ph, left : left + pw]
        if clear is None:
            patch[..., :3], patch[..., 3] = colours[index], 255
        else:
            shown = index != clear
            patch[shown, :3], patch[shown, 3] = colours[index[shown]], 255
        yield delay, canvas.copy()
        if disposal == 2:
            patch[:] = 0
        elif disposal == 3:
            canvas = before
        control, at = (0, 0, None), end


def lzw(indices: bytes, least: int) -> bytes:
    """Codes of a growing table of strings, which is cleared when it is full."""
    clear, end = 1 << least, (1 << least) + 1
    codes: dict[int, int] = {}  # of the code of a string and the index behind it
    out, held, bits, width, now = bytearray(), clear, least + 1, least + 1, -1
    new, full = end + 1, 1 << width  # the next code, and how many this width can name
    for i in indices:
        if now < 0:
            now = i
            continue
        longer = codes.get(now << 8 | i)
        if longer is not None:
            now = longer
            continue
        held |= now << bits
        bits += width
        if new < 4096:
            codes[now << 8 | i] = new
            if new == full:
                width, full = width + 1, 2 * full
            new += 1
        else:
            held |= clear << bits
            bits += width
            codes.clear()
            new, width, full = end + 1, least + 1, 2 << least
        if bits >= 32:
            out += (held & 0xFFFFFFFF).to_bytes(4, "little")
            held >>= 32
            bits -= 32
        now = i
    if now >= 0:
        held |= now << bits
        bits += width
        # the reader has added an entry by now
        if new == full and width < 12:
            width += 1
    held |= end << bits
    bits += width
    out += held.to_bytes(-(-bits // 8), "little")
    return bytes(out)


def gif_bytes(frames: list[np.ndarray], palette: bytes, fps: float) -> bytes:
    """An animation that loops, of index arrays (h, w) over a palette of up to 256 colours."""
    h, w = frames[0].shape
    least = max(2, (max(1, len(palette) // 3) - 1).bit_length())
    delay = int(100 / fps + 0.5)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF0 | least - 1, 0, 0), palette.ljust(3 << least, b"\0"), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for f in frames:
        body = lzw(f.astype(np.uint8).tobytes(), least)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, delay, 0, 0), struct.pack("<BHHHHBB", 0x2C, 0, 0, w, h, 0, least)]
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)] + [b"\0"]
    return b"".join([*out, b";"])


# Sizes


def jpeg_size(data: bytes) -> tuple[int, int]:
    """From marker to marker up to the frame header."""
    at = 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker")
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]


def webp_size(data: bytes) -> tuple[int, int]:
    """From chunk to chunk up to one that names a size: an extended header, or the first image."""
    at = 12
    while True:
        kind, n = struct.unpack("<4sI", data[at : at + 8])
        body = data[at + 8 : at + 18]
        if kind == b"VP8X":
            return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
        if kind == b"VP8 ":
            if body[3:6] != b"\x9d\x01\x2a":
                raise ValueError("no start code")
            w, h = struct.unpack("<HH", body[6:10])
            return w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L":
            if body[0] != 0x2F:
                raise ValueError("no signature")
            bits = int.from_bytes(body[1:5], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        at += 8 + n + n % 2


def ico_size(data: bytes) -> tuple[int, int]:
    """Of the largest image in its directory."""
    (n,) = struct.unpack("<H", data[4:6])
    entries = [struct.unpack("<BB", data[6 + 16 * i : 8 + 16 * i]) for i in range(n)]
    return max(((w or 256, h or 256) for w, h in entries), key=lambda s: (s[0] * s[1], s))


def size_of(data: bytes) -> tuple[str | None, int | None, int | None]:
    """Kind, width and height; nulls for other kinds, and sizes of null where none can be found."""
    kind = None
    try:
        if data[:8] == PNG:
            kind = "png"
            w, h = struct.unpack(">II", data[16:24])
        elif data[:4] == b"GIF8":
            kind = "gif"
            w, h = struct.unpack("<HH", data[6:10])
        elif data[:2] == b"BM":
            kind = "bmp"
            w, h = map(abs, struct.unpack("<ii", data[18:26]))
        elif data[:3] == b"\xff\xd8\xff":
            kind = "jpeg"
            w, h = jpeg_size(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = "webp"
            w, h = webp_size(data)
        elif data[:4] == b"\0\0\1\0":
            kind = "ico"
            w, h = ico_size(data)
        else:
            return None, None, None
    except DAMAGE:
        return kind, None, None
    return kind, w, h


# Over tables of files


def dimensions(files: DataFrame, keep: list[str] = ["path"]) -> DataFrame:  # noqa: B006
    """(keep, kind, width, height) of image files (path, content); without more to keep only four values a file leave a task."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [size_of(c.as_py() or b"") for c in b.column(n)]
            kind, w, h = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(kind, pa.string()), pa.array(w, pa.int32()), pa.array(h, pa.int32())], [*keep, "kind", "width", "height"])

    return files.select(*keep, F.col("content").alias("_content")).mapInArrow(run, f"{dense.schema_of(files, keep)}, kind string, width int, height int")


def frames_of(data: bytes) -> Iterator[tuple[int, Grid]]:
    """(delay, pixels) of each image in a file: one, but for animations."""
    if data[:8] == PNG:
        yield 0, png_pixels(data)
    elif data[:4] == b"GIF8":
        yield from gif_frames(data)
    elif data[:4] == b"\0\0\1\0":
        yield 0, ico_pixels(data)
    elif data[:2] == b"BM":
        grid = kernels.decoded_bmp(data)
        if grid is None:
            raise ValueError("a BMP of this kind can't be read")
        yield 0, grid
    else:
        raise ValueError("its kind can't be read")


def decoded(files: DataFrame) -> DataFrame:
    """(img, pos, delay, w, h, data, reason): the images of PNG, GIF and BMP files (path, content) as dense
    rows; img is the path. A file that can't be read to its end has one row more, without data, with the
    reason; one without images has a reason too. No shuffle: a task reads the files of its split."""
    names = ["img", "pos", "delay", "w", "h", "data", "reason"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        pos = -1
        try:
            for pos, (delay, grid) in enumerate(frames_of(data)):
                yield path, pos, delay, grid.shape[1], grid.shape[0], grid.astype(np.uint8).tobytes(), None
            if pos < 0:
                raise ValueError("it has no images")
        except DAMAGE as e:
            yield path, pos + 1, None, None, None, None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                for row in rows(path, content.as_py() or b""):
                    out.append(row)
                    size += len(row[5] or b"")
                    if size > 1 << 24 or len(out) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return files.select("path", "content").mapInArrow(run, "img string, pos int, delay int, w int, h int, data binary, reason string")


#: The step of ``kernels.cube`` that is nearest to each value of a channel.
STEPS = np.floor(np.arange(256) / 51 + 0.5).astype(np.uint8)


def in_kind(stack: dense.Stack, kind: str | None) -> tuple[str, list[bytes]]:
    """What is written of images of one size for a wanted kind: BMP (laid on white first, as it has no alpha), ICO, GIF (one frame in
    the colours of ``kernels.cube``), and PNG for all others, as no other codec is at hand. Colours are worked out for all at once."""
    if kind == "bmp":
        return kind, [kernels.bmp(grid) for grid in dense.on_white(stack)]
    if kind == "ico":
        return kind, [kernels.ico(grid) for grid in stack]
    if kind == "gif":
        level, palette = STEPS[stack[..., :3]], kernels.cube()
        return kind, [gif_bytes([index], palette, 1) for index in level[..., 0] * 36 + level[..., 1] * 6 + level[..., 2]]
    return "png", [kernels.png(grid) for grid in stack]


def dispatched(images: DataFrame, wanted: DataFrame | Column) -> DataFrame:
    """(img, kind, content): each dense image in the format that ``wanted`` names, as far as it can be written; no content
    without data. ``wanted`` is a column of ``images``, written where they lie, or a table (img, kind), met in a shuffle of dense rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in dense.sliced(batch, 3)):
            w, h, data, kind = (b.column(i).to_pylist() for i in (1, 2, 3, 4))
            content: list[bytes | None] = [None] * b.num_rows
            for (x, k), y, at in dense.by_size(list(zip(w, kind)), h):
                if at := [i for i in at if data[i] is not None]:
                    written, files = in_kind(dense.stack_of([data[i] for i in at], x, y), k)
                    for i, file in zip(at, files):
                        kind[i], content[i] = written, file
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kind, pa.string()), pa.array(content, pa.binary())], ["img", "kind", "content"])

    named = images.withColumn("kind", wanted) if isinstance(wanted, Column) else images.join(wanted.select("img", "kind").hint("merge"), "img")
    return named.select("img", "w", "h", "data", "kind").mapInArrow(run, "img string, kind string, content binary")


def converted(jobs: DataFrame, images: DataFrame, kind: str) -> DataFrame:
    """Jobs (img, done, out) with the pending ones encoded from dense images; those that are done stay, and so do
    jobs without an image. The images meet their jobs in one shuffle; neither side is broadcast."""
    own = images.select("img", "w", "h", "data", F.lit(kind).alias("kind")).hint("merge")
    both = jobs.join(own, "img", "left").withColumn("kind", F.when(F.col("done"), None).otherwise(F.col("kind")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, out = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, (w, h, d, k) in enumerate(zip(*(b.column(c).to_pylist() for c in (3, 4, 5, 6)))):
                if k is not None and d is not None:
                    done[i], out[i] = True, kernels.ENCODERS[kind](np.frombuffer(d, np.uint8).reshape(h, w, 4).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.bool_()), pa.array(out, pa.binary())], ["img", "done", "out"])

    return both.select("img", "done", "out", "w", "h", "data", "kind").mapInArrow(run, "img string, done boolean, out binary")


# Adaptive palettes


BIN = 8


def colour_counts(images: DataFrame, group: str) -> DataFrame:
    """(group, bin, n, r, g, b): how many pixels of each group of dense images fall in a bin of 8 x 8 x 8 colours, and
    the sums of their channels. A task sums a batch first; a group has at most 32,768 bins."""
    rows = images.filter(F.col("data").isNotNull()).select(group, "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, which = np.unique(np.array([repr(k) for k in b.column(0).to_pylist()], object).astype(str), return_inverse=True)
            first = [int(np.flatnonzero(which == i)[0]) for i in range(len(keys))]
            raw = b.column(1).to_pylist()
            px = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 4).astype(np.int64)
            owner = np.repeat(which, [len(d) // 4 for d in raw])
            at = (px[:, 0] // BIN * 32 + px[:, 1] // BIN) * 32 + px[:, 2] // BIN
            used, place, n = np.unique(owner * 32768 + at, return_inverse=True, return_counts=True)
            sums = [np.bincount(place, px[:, c], len(used)).astype(np.int64) for c in range(3)]
            groups = b.column(0).take(pa.array([first[int(k)] for k in used // 32768], pa.int64()))
            yield pa.RecordBatch.from_arrays([groups, pa.array((used % 32768).astype(np.int32)), pa.array(n.astype(np.int64)), *map(pa.array, sums)], [group, "bin", "n", "r", "g", "b"])

    kind = rows.schema[group].dataType.simpleString()
    made = rows.mapInArrow(run, f"`{group}` {kind}, bin int, n bigint, r bigint, g bigint, b bigint")
    return made.groupBy(group, "bin").agg(*(F.sum(c).alias(c) for c in ("n", "r", "g", "b")))


def median_cut(bins: np.ndarray, n: np.ndarray, entries: int) -> np.ndarray:
    """The entry of each bin (r, g, b places). The box whose longest side times its pixels is largest is cut across
    that side, where half its pixels lie before or at the cut, until there are ``entries`` boxes or
    none can be cut (Heckbert 1982). Ties: the box that was made first, and r before g before b."""
    boxes = [np.arange(len(bins))]
    weight = lambda box: (int(np.ptp(bins[box], axis=0).max()) * int(n[box].sum()))
    weights = [weight(boxes[0])] if len(bins) else []
    while 0 < len(boxes) < entries and max(weights) > 0:
        k = int(np.argmax(weights))
        box = boxes[k]
        axis = int(np.argmax(np.ptp(bins[box], axis=0)))
        box = box[np.lexsort((box, bins[box, axis]))]
        along, total = bins[box, axis], np.cumsum(n[box])
        at = along[int(np.searchsorted(total, total[-1] / 2))]
        cut = int(np.searchsorted(along, at, "right"))
        if cut == len(box):  # half the pixels lie in the last plane: it is a box of its own
            cut = int(np.searchsorted(along, at, "left"))
        boxes[k], new = box[:cut], box[cut:]
        weights[k] = weight(boxes[k])
        boxes.append(new)
        weights.append(weight(new))
    out = np.zeros(len(bins), np.int64)
    for i, box in enumerate(boxes):
        out[box] = i
    return out


def palettes(counts: DataFrame, group: str, entries: int = 256) -> DataFrame:
    """(group, palette binary, lookup binary): of each group's ``colour_counts`` up to ``entries`` colours, the mean of a
    box's pixels each, and the entry of each of the 32,768 bins."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        at = pdf["bin"].to_numpy()
        entry = median_cut(np.stack([at >> 10, at >> 5 & 31, at & 31], axis=1), pdf["n"].to_numpy(), entries)
        n = np.bincount(entry, pdf["n"])
        colours = np.stack([np.floor(np.bincount(entry, pdf[c]) / n + 0.5) for c in "rgb"], axis=1).astype(np.uint8)
        lookup = np.zeros(32768, np.uint8)
        lookup[at] = entry
        return pd.DataFrame({group: [pdf[group].iloc[0]], "palette": [colours.tobytes()], "lookup": [lookup.tobytes()]})

    kind = counts.schema[group].dataType.simpleString()
    return counts.groupBy(group).applyInPandas(run, f"`{group}` {kind}, palette binary, lookup binary")


def indexed(images: DataFrame, tables: DataFrame, group: str) -> DataFrame:
    """``images`` with palette, and data as the entry of each pixel's bin in its group's palette (one byte a pixel). The
    tables are shuffled, not broadcast, as there are as many as groups; an image meets its lookup in compressed form."""

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(2, "lookup", pa.array([zlib.compress(x.as_py(), 1) for x in b.column(2)], pa.binary()))

    names = images.columns
    data = names.index("data")
    kind = tables.schema[group].dataType.simpleString()
    small = tables.select(group, "palette", "lookup").mapInArrow(compressed, f"`{group}` {kind}, palette binary, lookup binary")
    rows = images.filter(F.col("data").isNotNull()).join(small.hint("merge"), group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lookup = None, None
        for b in batches:
            made = []
            for raw, now in zip(b.column(data), b.column(len(names) + 1).to_pylist()):
                if now != last:  # images of a group follow each other
                    last, lookup = now, np.frombuffer(zlib.decompress(now), np.uint8)
                px = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, 4).astype(np.int32) // BIN
                made.append(lookup[(px[:, 0] * 32 + px[:, 1]) * 32 + px[:, 2]].tobytes())
            columns = list(b.columns[: len(names) + 1])
            columns[data] = pa.array(made, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, [*names, "palette"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    return rows.select(*names, "palette", "lookup").mapInArrow(run, f"{schema}, palette binary")


def animated(frames: DataFrame, fps: float, most: int = 24) -> DataFrame:
    """(seq, part, content): a GIF of each ``most`` frames of a sequence (seq, pos, w, h, data: entries of ``palette``), so a
    group's size doesn't grow with the table. The frames of a part share the first one's palette and size."""
    import pandas as pd

    rows = frames.select("seq", F.floor(F.col("pos") / most).cast("int").alias("part"), "pos", "w", "h", "data", "palette")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        grids = [np.frombuffer(d, np.uint8).reshape(h, w) for w, h, d in zip(pdf["w"], pdf["h"], pdf["data"])]
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "part": [pdf["part"].iloc[0]], "content": [gif_bytes(grids, pdf["palette"].iloc[0], fps)]})

    kind = rows.schema["seq"].dataType.simpleString()
    return rows.groupBy("seq", "part").applyInPandas(run, f"seq {kind}, part int, content binary")
