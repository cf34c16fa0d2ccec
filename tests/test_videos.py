"""Containers of videos and frames of uncompressed ones, against files made by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.sources import videos
from tessel.plans.media import films_of


def riff(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def film(frames, bits=24, upward=True, rate=(100, 1000), palette=b"", before=b"", between=b"", coding=0):
    """An AVI file of frames (h, w, 3), or (h, w) of palette entries, or raw bytes."""
    h, w = next(f.shape[:2] for f in frames if isinstance(f, np.ndarray))
    row = (w * bits + 31) // 32 * 4

    def raw(f):
        if isinstance(f, bytes):
            return f
        out = np.zeros((h, row), np.uint8)
        pixels = f if bits == 8 else np.concatenate([f[..., ::-1], np.full((h, w, 1), 9, np.uint8)], axis=2)[..., : bits // 8]
        out[:, : w * bits // 8] = pixels.reshape(h, -1)
        return (out[::-1] if upward else out).tobytes()

    head = b"vids" + bytes(16) + struct.pack("<II", *rate) + bytes(28)
    form = struct.pack("<IiiHHI", 40, w, h if upward else -h, 1, bits, coding) + bytes(20) + palette
    lists = riff(b"LIST", b"hdrl" + riff(b"avih", bytes(56)) + before + riff(b"LIST", b"strl" + riff(b"strh", head) + riff(b"strf", form)))
    own = b"01db" if before else b"00db"
    return riff(b"RIFF", b"AVI " + lists + riff(b"LIST", b"movi" + b"".join(riff(own, raw(f)) + between for f in frames)))


def noise(n, h, w, last=3):
    return list(np.random.default_rng(n).integers(0, 256, (n, h, w, last), np.uint8))


def read(spark, content, every=10, rate=30.0):
    files = spark.createDataFrame([("a", content)], "path string, content binary")
    rows = videos.sampled(files, every, rate).orderBy("idx").collect()
    return [(r.idx, None if r.data is None else np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, 4), r.reason) for r in rows]


@pytest.mark.parametrize("bits", [24, 32])
@pytest.mark.parametrize("upward", [True, False])
def test_frames_of_any_layout(spark, bits, upward):
    frames = noise(10, 3, 5)
    got = read(spark, film(frames, bits, upward), every=6)  # 10 frames a second, a time each 0.2 s
    assert [g[0] for g in got] == [0, 1, 2, 3, 4]
    for (_, x, why), want in zip(got, frames[::2]):
        assert why is None and (x[..., :3] == want).all() and (x[..., 3] == 255).all()


def test_palettes_sounds_and_repeated_frames(spark):
    colours = np.random.default_rng(1).integers(0, 256, (256, 4), np.uint8)
    entries = [f[..., 0] for f in noise(3, 4, 3, 1)]
    sound = riff(b"LIST", b"strl" + riff(b"strh", b"auds" + bytes(52)) + riff(b"strf", bytes(17)))
    content = film([entries[0], b"", entries[1], entries[2]], 8, palette=colours.tobytes(), before=sound, between=riff(b"00wb", bytes(3)))
    got = read(spark, content, every=3)  # each frame
    for (_, x, _), want in zip(got, [entries[0], entries[0], entries[1], entries[2]], strict=True):
        assert (x[..., :3] == colours[want][..., 2::-1]).all()


def test_times_between_frames_show_the_frame_before(spark):
    frames = noise(4, 2, 2)
    got = read(spark, film(frames, rate=(1, 2)), every=7)  # two a second; times 0, 7/30, ... below 2 s
    assert len(got) == 9
    for i, x, _ in got:
        assert (x[..., :3] == frames[int(i * 7 / 30 * 2)]).all()


def test_what_cannot_be_read_has_a_reason(spark):
    frames = noise(4, 3, 5)
    whole = film(frames)
    files = {
        "cut": whole[:-10], "head": whole[:60], "text": b"no video", "none": None, "empty": b"", "coded": film(frames, coding=0x34363248),
        "short": film([frames[0], b"abcd"]), "still": film(frames, rate=(0, 10)), "slow": film(frames, rate=(1 << 31, 1)), "mp4": films_of(4, 4, 3, 25, b"x")["mp4"],
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {}
    for r in videos.sampled(df, 3).collect():
        got.setdefault(r.path, []).append((r.data is None, r.reason))
    assert got["cut"] == [(False, None)] * 3
    assert got["short"] == [(False, None), (True, "cut off")]
    no = {k: v[0][1] for k, v in got.items() if len(v) == 1}
    assert no == {"head": "no video", "text": "no video", "none": "no video", "empty": "no video", "coded": "compressed", "still": "no frames", "slow": "no frames", "mp4": "compressed"}
    with pytest.raises(ValueError):
        videos.sampled(df, 0)


def test_facts_of_containers(spark):
    made = films_of(640, 360, 75, 25, b"padding")
    box = lambda kind, *b: struct.pack(">I", 8 + len(b"".join(b))) + kind + b"".join(b)
    # 64 bits, a fragmented file whose length stands apart, a box with a long size and one that reaches to the end
    head = box(b"mvhd", b"\1" + bytes(19) + struct.pack(">IQ", 1000, 0) + bytes(80))
    long = struct.pack(">I4sQ", 1, b"free", 16 + 5) + bytes(5)
    made["fragments"] = box(b"ftyp", b"isom") + long + box(b"moov", head, box(b"mvex", box(b"mehd", b"\1\0\0\0" + struct.pack(">Q", 2500)))) + struct.pack(">I4s", 0, b"mdat") + bytes(9)
    # lengths that aren't known, as a live recording has; a length of 4 bytes
    info = bytes.fromhex("1549A966") + b"\x87" + bytes.fromhex("448984") + struct.pack(">f", 1500)
    made["live"] = bytes.fromhex("1A45DFA380") + bytes.fromhex("1853806701FFFFFFFFFFFFFF") + info + bytes.fromhex("1F43B67501FFFFFFFFFFFFFF") + b"payload"
    made |= {"cut": made["mp4"][:60], "odd": b"\x1a\x45\xdf\xa3", "none": None, "text": b"ftypftypftyp"}
    got = {r.path: tuple(r)[1:] for r in videos.facts(spark.createDataFrame(list(made.items()), "path string, content binary")).collect()}
    assert got["avi"] == ("avi", 640, 360, 3.0, 25.0)
    assert got["mp4"] == ("mp4", 640, 360, 3.0, 25.0)
    assert got["webm"] == ("webm", 640, 360, 5.0, 25.0)
    assert got["fragments"] == ("mp4", 0, 0, 2.5, 0.0)
    assert got["live"] == ("webm", 0, 0, 1.5, 0.0)
    assert all(got[k] == (None,) * 5 for k in ("cut", "odd", "none"))
    assert got["text"] == (None,) * 5


def test_damage_never_raises():
    rng = np.random.default_rng(3)
    for content in [*films_of(4, 4, 3, 25, b"x").values(), film(noise(2, 2, 2))]:
        for _ in range(300):
            broken = bytearray(content)
            for at in rng.integers(0, len(broken), 3):
                broken[at] = rng.integers(256)
            v = videos.video_of(bytes(broken))
            assert v is None or v.seconds >= 0


def test_written_films_read_back(spark):
    grids = noise(7, 3, 5, 4)
    rows = [(1, i, 5, 3, g.tobytes() if i != 4 else None) for i, g in enumerate(grids)]
    frames = spark.createDataFrame(rows, "seq int, pos int, w int, h int, data binary")
    made = videos.written(frames, 10, most=3).withColumn("path", F.concat_ws(":", "seq", "part"))
    assert {(r.path, r.seconds, r.rate) for r in videos.facts(made).collect()} == {("1:0", 0.3, 10.0), ("1:1", 0.3, 10.0), ("1:2", 0.1, 10.0)}
    got = {(r.path, r.idx): np.frombuffer(r.data, np.uint8).reshape(3, 5, 4) for r in videos.sampled(made, 3).collect()}
    assert len(got) == 7
    for i, g in enumerate(grids):
        a = (g if i != 4 else grids[3]).astype(float)
        laid = np.floor(a[..., :3] * (a[..., 3:] / 255) + 255 * (1 - a[..., 3:] / 255) + 0.5)
        assert (got[f"1:{i // 3}", i % 3][..., :3] == laid).all()
    assert videos.written(frames.limit(0), 10).count() == 0


def test_frames_like_the_last_kept_one_go(spark):
    grey = lambda v: np.full((4, 4, 3), v, np.uint8)
    frames = [grey(v) for v in (0, 1, 2, 3, 1, 0, 9)]  # steps of one add up until they are three away
    files = spark.createDataFrame([("a", film(frames)), ("b", film(frames[:1])), ("c", b"none")], "path string, content binary")
    got = {(r.path, r.idx, r.reason) for r in videos.sampled(files, 3, least=3 * 2 * 2 * 3, side=2).select("path", "idx", "reason").collect()}
    assert got == {("a", 0, None), ("a", 3, None), ("a", 5, None), ("a", 6, None), ("b", 0, None), ("c", None, "no video")}
