"""Videos as a source: what their containers say (AVI, MP4 and QuickTime, WebM and Matroska, by the public formats) and
the frames of uncompressed AVI files at wanted times. A file is walked in the task that reads it, over its
chunk headers; only wanted frames are turned to pixels, a batch at a time, so no task holds all frames of
a video as pixels. Frames of compressed videos need a codec, which this library doesn't have: they have a reason instead."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import dense

Span = tuple[int, int]
#: The part of a frame by which a time may lie before it and still show it: times are rounded.
EARLY = 1e-6
#: Frames a second; below it a header counts as damaged, as it would make times without end.
SLOWEST = 1 / 3600


@dataclass
class Video:
    """Rates are frames a second; 0 where the container names none. The rest is of AVI files only: where each
    frame lies, and how its rows are laid out."""

    kind: str
    width: int
    height: int
    seconds: float
    rate: float = 0.0
    places: list[Span] = field(default_factory=list)
    coding: int = 0
    bits: int = 0
    upward: bool = True
    palette: np.ndarray | None = None


def leaves(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Chunks of a RIFF file that hold data, in order, until one is cut off. Lists are entered: what they hold
    follows their header."""
    at = 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name in (b"RIFF", b"LIST"):
            at += 12
            continue
        start = at + 8
        if start + size > len(data):
            return
        yield name, start, start + size
        at = start + size + size % 2


def avi(data: bytes) -> Video | None:
    """The first video stream. Its frames are counted, as the header of a cut recording doesn't know them."""
    streams, own, head, video, names = -1, -1, (0, 0), None, ()
    for name, a, b in leaves(data):
        if name == b"strh":
            streams += 1
            if own < 0 and data[a : a + 4] == b"vids":
                own, head = streams, struct.unpack_from("<II", data, a + 20)
                names = (b"%02ddb" % own, b"%02ddc" % own)
        elif name == b"strf" and streams == own and video is None and own >= 0:
            size, w, h, _, bits, coding = struct.unpack_from("<IiiHHI", data, a)
            video = Video("avi", w, abs(h), 0.0, head[1] / head[0] if head[0] else 0.0, coding=coding, bits=bits, upward=h > 0)
            if bits == 8:
                entries = np.frombuffer(data[a + size : b], np.uint8)
                video.palette = np.zeros((256, 4), np.uint8)
                video.palette[: len(entries) // 4] = entries[: len(entries) // 4 * 4].reshape(-1, 4)[:256]
        elif video and name in names:
            video.places.append((a, b))
    if video and video.rate:
        video.seconds = len(video.places) / video.rate
    return video


def boxes(data: bytes, span: Span, wanted: bytes) -> Iterator[Span]:
    """The bodies of boxes ``wanted`` among those that lie in ``span``."""
    at, end = span
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:  # a long size follows
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            return
        if name == wanted:
            yield body, stop
        at = stop


def within(data: bytes, span: Span, *path: bytes) -> Span | None:
    """The first box at the end of ``path``."""
    for name in path:
        if (span := next(boxes(data, span, name), None)) is None:
            return None
    return span


def lasting(data: bytes, at: int) -> tuple[int, int]:
    """Ticks a second and ticks of a movie's or a track's header, in 32 or 64 bits."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)


def mp4(data: bytes) -> Video | None:
    """The first track of pictures. A fragmented file names its length apart from the movie's header, if at all."""
    movie = within(data, (0, len(data)), b"moov")
    head = movie and within(data, movie, b"mvhd")
    if not head:
        return None
    second, ticks = lasting(data, head[0])
    if not ticks and (more := within(data, movie, b"mvex", b"mehd")):
        ticks = struct.unpack_from(">Q" if data[more[0]] == 1 else ">I", data, more[0] + 4)[0]
    video = Video("mp4", 0, 0, ticks / second if second else 0.0)
    for track in boxes(data, movie, b"trak"):
        kind, size = within(data, track, b"mdia", b"hdlr"), within(data, track, b"tkhd")
        if kind and size and data[kind[0] + 8 : kind[0] + 12] == b"vide":
            video.width, video.height = (x >> 16 for x in struct.unpack_from(">II", data, size[1] - 8))
            length, frames = within(data, track, b"mdia", b"mdhd"), within(data, track, b"mdia", b"minf", b"stbl", b"stsz")
            if length and frames:
                unit, n = lasting(data, length[0])
                video.rate = struct.unpack_from(">I", data, frames[0] + 8)[0] * unit / n if n else 0.0
            break
    return video


def elements(data: bytes, span: Span) -> Iterator[tuple[int, int, int]]:
    """(id, from, to) of elements; one of unknown length reaches to the end."""
    at, end = span
    while at < end and data[at]:
        n = 9 - data[at].bit_length()
        name, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at >= end or not data[at]:
            return
        n = 9 - data[at].bit_length()
        size = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
        at += n
        stop = end if size == (1 << 7 * n) - 1 else min(end, at + size)
        yield name, at, stop
        at = stop


#: Ids of elements.
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TYPE, EACH, PICTURE, WIDTH, HEIGHT = 0x1654AE6B, 0xAE, 0x83, 0x23E383, 0xE0, 0xB0, 0xBA


def webm(data: bytes) -> Video | None:
    first = lambda span, name: next(((a, b) for i, a, b in elements(data, span) if i == name), None)
    whole = lambda span, name, default=0: int.from_bytes(data[x[0] : x[1]], "big") if (x := first(span, name)) else default
    segment = first((0, len(data)), SEGMENT)
    info = segment and first(segment, INFO)
    if not info:
        return None
    video, length = Video("webm", 0, 0, 0.0), first(info, DURATION)
    if length:
        number = struct.unpack(">f" if length[1] - length[0] == 4 else ">d", data[length[0] : length[1]])[0]
        video.seconds = number * whole(info, SCALE, 1_000_000) / 1e9
    for name, a, b in elements(data, first(segment, TRACKS) or (0, 0)):
        if name == TRACK and whole((a, b), TYPE) == 1 and (picture := first((a, b), PICTURE)):
            video.width, video.height = whole(picture, WIDTH), whole(picture, HEIGHT)
            each = whole((a, b), EACH)
            video.rate = 1e9 / each if each else 0.0
            break
    return video


def video_of(data: bytes | None) -> Video | None:
    """None for other files, for none and for those whose headers are damaged."""
    data = data or b""
    try:
        if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
            found = avi(data)
        elif data[:4] == b"\x1a\x45\xdf\xa3":
            found = webm(data)
        else:
            found = mp4(data) if data[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide") else None
    except (struct.error, IndexError):
        return None
    return found if found and math.isfinite(found.seconds) and found.seconds >= 0 else None


def facts(files: DataFrame) -> DataFrame:
    """(path, kind, width, height, seconds, rate) of files (path, content): nulls where ``video_of`` finds none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [video_of(x.as_py()) for x in b.column(1)]
            told = [pa.array([v and getattr(v, name) for v in found], kind) for name, kind in (("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("seconds", pa.float64()), ("rate", pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *told], ["path", "kind", "width", "height", "seconds", "rate"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, width int, height int, seconds double, rate double")


def pixels_of(data: bytes, v: Video, at: int) -> np.ndarray | None:
    """Frame ``at`` as (h, w, 4); an empty chunk repeats the frame before. None if it has too few bytes."""
    while at > 0 and v.places[at][0] == v.places[at][1]:
        at -= 1
    a, b = v.places[at]
    n, row = v.bits // 8, (v.width * v.bits + 31) // 32 * 4
    if b - a < row * v.height:
        return None
    raw = np.frombuffer(data, np.uint8, row * v.height, a).reshape(v.height, row)[:, : v.width * n]
    bgr = v.palette[raw] if v.palette is not None else raw.reshape(v.height, v.width, n)
    out = np.full((v.height, v.width, 4), 255, np.uint8)
    out[..., :3] = bgr[..., 2::-1]
    return out[::-1] if v.upward else out


def unreadable(v: Video | None) -> str | None:
    if v is None:
        return "no video"
    if v.kind != "avi" or v.coding or v.bits not in (8, 24, 32):
        return "compressed"
    return None if v.places and v.rate >= SLOWEST and v.width > 0 and v.height > 0 else "no frames"


def sampled(files: DataFrame, every: int, rate: float = 30.0, least: float | None = None, side: int = 64) -> DataFrame:
    """(path, idx, ts, w, h, data, reason): the frame that is shown at each of the times of ``sequences.sample_times``,
    ``every`` frames of an assumed ``rate`` apart. A video that can't be read is one row with a reason and no
    frame; a frame with too few bytes has a reason too. With ``least`` a frame stays if its signature (``side`` x ``side``
    cells) differs by at least that much, in the L1 norm, from that of the last one that stayed, as in
    ``sequences.kept_frames``: a file is read in order in one task, so frames are compared there and none is shuffled."""
    names = ["path", "idx", "ts", "w", "h", "data", "reason"]
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    step = every / rate
    if not step > 0:
        raise ValueError("times have to be apart")

    def shown(path: str, data: bytes | None) -> Iterator[tuple]:
        v = video_of(data)
        if why := unreadable(v):
            yield path, None, None, None, None, None, why
            return
        last = None
        for i in range(math.ceil(v.seconds / step)):
            if not i * step < v.seconds:
                break
            grid = pixels_of(data, v, min(len(v.places) - 1, int(i * step * v.rate + EARLY)))
            if grid is not None and least is not None:
                own = dense.cell_means(grid[None], side)[0].astype(np.int64)
                if last is not None and np.abs(own - last).sum() < least:
                    continue
                last = own
            yield (path, i, i * step, v.width, v.height, None, "cut off") if grid is None else (path, i, i * step, v.width, v.height, grid.tobytes(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                for row in shown(path.as_py(), content.as_py()):
                    held.append(row)
                    size += len(row[5] or b"") + 64
                    if size >= dense.BYTES_AT_ONCE:
                        yield made()
                        held, size = [], 0
        if held:
            yield made()

    return files.select("path", "content").mapInArrow(run, "path string, idx int, ts double, w int, h int, data binary, reason string")


def little(x: Column | int, n: int = 4) -> Column:
    """A number that isn't negative as ``n`` bytes, the lowest first."""
    if isinstance(x, int):
        return F.lit(x.to_bytes(n, "little"))
    h = F.lpad(F.hex(x.cast("bigint")), 2 * n, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * (n - i) - 1, 2) for i in range(n))))


def chunk(name: bytes, size: Column | int, *body: Column) -> Column:
    return F.concat(F.lit(name), little(size), *body)


def written(frames: DataFrame, fps: int, most: int = 24) -> DataFrame:
    """(seq, part, content): uncompressed AVI files of frames (seq, pos from 0, w, h, data) of one size each sequence,
    laid on white, in parts of ``most`` positions, so that no group grows with a sequence. Built by Spark's
    own functions from the rows of bitmaps; one shuffle, by part. A frame without data repeats the one before;
    a part without rows has no file."""
    cut = frames.select("seq", F.floor(F.col("pos") / most).cast("int").alias("part"), "pos", F.col("w").alias("width"), F.col("h").alias("height"), "w", "h", "data")
    maps = dense.encoded(dense.changed(cut, dense.on_white), "bmp", ["seq", "part", "pos", "width", "height"])
    rows = F.coalesce(F.substring("content", 55, 1 << 30), F.lit(b""))  # a multiple of four bytes
    ordered = F.sort_array(F.collect_list(F.struct("pos", rows.alias("rows"))))
    films = maps.groupBy("seq", "part").agg(F.max("width").alias("w"), F.max("height").alias("h"), ordered.alias("rows"), F.max(F.octet_length(rows)).alias("size"))
    framed = F.aggregate("rows", F.lit(b""), lambda a, x: F.concat(a, chunk(b"00db", F.octet_length(x["rows"]), x["rows"])))
    films = films.select("seq", "part", "w", "h", "size", F.size("rows").alias("n"), framed.alias("body"))
    n, w, h, size, body = (F.col(c) for c in ("n", "w", "h", "size", "body"))
    zeros = lambda k: F.lit(bytes(k))
    main = chunk(b"avih", 56, little(1_000_000 // fps), zeros(12), little(n), zeros(4), little(1), little(size), little(w), little(h), zeros(16))
    stream = chunk(b"strh", 56, F.lit(b"vids"), zeros(16), little(1), little(fps), zeros(4), little(n), little(size), zeros(12), little(w, 2), little(h, 2))
    form = chunk(b"strf", 40, little(40), little(w), little(h), little(1, 2), little(24, 2), zeros(4), little(size), zeros(16))
    # lists: their kind and the chunks in them, each with a header of eight bytes
    head = chunk(b"LIST", 192, F.lit(b"hdrl"), main, chunk(b"LIST", 116, F.lit(b"strl"), stream, form))
    film = chunk(b"RIFF", F.octet_length(body) + 216, F.lit(b"AVI "), head, chunk(b"LIST", F.octet_length(body) + 4, F.lit(b"movi"), body))
    return films.select("seq", "part", film.alias("content"))
