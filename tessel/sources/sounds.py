"""Durations of MP3 and Ogg files, by the public formats, from rows (path, content). Each file is walked
in the task that reads it, from frame to frame or page to page; payloads aren't decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values (ISO/IEC 11172-3, 13818-3): kbit/s by index, of layers I to III of version 1, then of layer I and of
#: layers II and III of version 2; Hz of version 1; samples of a frame by layer of each version.
RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


def mp3_frame(head: bytes) -> tuple[int, int, int] | None:
    """Length in bytes, samples and Hz of the frame with this header of four bytes; None if it is none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate, hertz, padding = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    kind = (1 if version == 3 else 2, layer)
    hz = HERTZ[hertz] // {3: 1, 2: 2, 0: 4}[version]
    bits, samples = 1000 * RATES[kind][rate - 1], SAMPLES[kind]
    size = (12 * bits // hz + padding) * 4 if layer == 1 else samples // 8 * bits // hz + padding
    return size, samples, hz


def named_frames(data: bytes, at: int) -> int | None:
    """How many frames the header of a variable rate in the frame at ``at`` names; None without one."""
    mono, first_version = data[at + 3] >> 6 == 3, data[at + 1] >> 3 & 3 == 3
    side = (17 if mono else 32) if first_version else (9 if mono else 17)
    tag = data[at + 4 + side : at + 16 + side]
    if tag[:4] in (b"Xing", b"Info") and len(tag) == 12 and tag[7] & 1:
        return struct.unpack(">I", tag[8:])[0]
    tag = data[at + 36 : at + 54]
    return struct.unpack(">I", tag[14:])[0] if tag[:4] == b"VBRI" and len(tag) == 18 else None


def mp3_seconds(data: bytes) -> float:
    """The number of frames that a variable-rate header names, else the frames themselves; of either
    samples over Hz. Tags before and junk between frames are passed over."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        a, b, c, d = data[at + 6 : at + 10]
        at += 10 + (a << 21 | b << 14 | c << 7 | d) + 10 * (data[at + 5] >> 4 & 1)
    total, first = 0.0, True
    while at + 4 <= len(data):
        found = mp3_frame(data[at : at + 4])
        if found and first:
            named = named_frames(data, at)
            if named is not None:
                return named * found[1] / found[2]
            if at + found[0] < len(data) and not mp3_frame(data[at + found[0] : at + found[0] + 4]):
                found = None  # chance bytes that look like a header aren't followed by another
        if not found:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        size, samples, hz = found
        first = False
        if at + size > len(data):
            break  # cut off
        total += samples / hz
        at += size
    return total


def ogg_seconds(data: bytes) -> float:
    """The last place (granule position) of the first stream over its Hz; its beginning, which Opus names, is taken off."""
    at, serial, hz, skipped, last = 0, None, 0, 0, 0
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS":
        place, stream = struct.unpack("<qI", data[at + 6 : at + 18])
        n = data[at + 26]
        body = at + 27 + n
        size = sum(data[at + 27 : body])
        if body + size > len(data):
            break  # cut off: a page counts if it is whole
        if serial is None:
            head = data[body : body + 30]
            if head[:7] == b"\x01vorbis":
                serial, hz = stream, struct.unpack("<I", head[12:16])[0]
            elif head[:8] == b"OpusHead":
                serial, hz, skipped = stream, 48000, struct.unpack("<H", head[10:12])[0]
        if stream == serial and place > last:
            last = place
        at = body + size
    return max(0.0, (last - skipped) / hz) if hz else 0.0


def seconds_of(data: bytes) -> float:
    try:
        return ogg_seconds(data) if data[:4] == b"OggS" else mp3_seconds(data) if data[:3] == b"ID3" or data[:1] == b"\xff" else 0.0
    except (struct.error, IndexError, ValueError):
        return 0.0


def durations(files: DataFrame) -> DataFrame:
    """(path, seconds) of MP3 and Ogg files; 0 for others and for damaged ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([seconds_of(c.as_py() or b"") for c in b.column(1)], pa.float64())], ["path", "seconds"])

    return files.select("path", "content").mapInArrow(run, "path string, seconds double")
