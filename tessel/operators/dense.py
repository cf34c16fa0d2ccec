"""Images as dense rows (img, w, h, data): data holds r, g, b, a of each pixel, row by row.

An image is a row, so operators that need a whole image read the rows where they lie: no shuffle of
pixels. Kernels work on stacks, arrays (n, h, w, 4) of all images of one size in an Arrow batch.
``from_pixels`` and ``to_pixels`` turn pixel tables to dense rows and back. Compositing follows Porter and
Duff (1984), filters the W3C Filter Effects; blur is that standard's approximation by three boxes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import kernels
from tessel.operators.pixels import LUMA, RGBA

Stack = np.ndarray
Change = Callable[[Stack], Stack]
SHAPE = ["w", "h", "data"]
#: Pixels of an array of them that a row holds, at most.
PIXELS_AT_ONCE = 1 << 16
#: Image bytes that are worked on at once, about.
BYTES_AT_ONCE = 1 << 20


def schema_of(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def stack_of(data: list[bytes], w: int, h: int) -> Stack:
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), h, w, 4).astype(np.int32)


def bytes_of(stack: Stack) -> list[bytes]:
    return [x.tobytes() for x in stack.astype(np.uint8)]


def sliced(batch: pa.RecordBatch, data: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``BYTES_AT_ONCE`` bytes of column ``data``, about."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(data)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = (size // BYTES_AT_ONCE).tolist()
    start = 0
    for i in range(1, len(part) + 1):
        if i == len(part) or part[i] != part[start]:
            yield batch.slice(start, i - start)
            start = i


def by_size(w: list[int], h: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """Each size with the rows of it."""
    rows: dict[tuple[int, int], list[int]] = {}
    for i, size in enumerate(zip(w, h)):
        rows.setdefault(size, []).append(i)
    for (x, y), at in rows.items():
        yield x, y, at


def with_change(b: pa.RecordBatch, w: int, h: int, data: int, change: Change) -> pa.RecordBatch:
    """The batch with ``change`` made to the images of columns ``w``, ``h`` and ``data``; those without data stay so."""
    raw = b.column(data).to_pylist()
    new, sizes = list(raw), list(zip(b.column(w).to_pylist(), b.column(h).to_pylist()))
    for x, y, at in by_size(*zip(*sizes)):
        if not (at := [i for i in at if raw[i] is not None]):
            continue
        made = change(stack_of([raw[i] for i in at], x, y))
        for i, m in zip(at, bytes_of(made)):
            new[i], sizes[i] = m, made.shape[2:0:-1]
    columns = list(b.columns)
    columns[w], columns[h], columns[data] = pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32()), pa.array(new, pa.binary())
    return pa.RecordBatch.from_arrays(columns, b.schema.names)


def changed(images: DataFrame, change: Change) -> DataFrame:
    """``images`` (w, h, data and further columns) with ``change`` made to each; those without data stay so. No shuffle."""
    names = images.columns
    w, h, data = (names.index(c) for c in SHAPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, data):
                yield with_change(b, w, h, data, change)

    return images.mapInArrow(run, schema_of(images, names))


def in_turn(*changes: Change) -> Change:
    def change(s: Stack) -> Stack:
        for step in changes:
            s = step(s)
        return s

    return change


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows with equal first ``keys`` columns, which lie together, may be in
    several batches. A table holds all groups that end in a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = list(zip(*(b.column(i).to_pylist() for i in range(keys))))
        last = next((i for i in range(len(key) - 1, 0, -1) if key[i] != key[i - 1]), 0)
        if last or held and key[0] != tuple(held[-1].column(i)[-1].as_py() for i in range(keys)):
            if done := [*held, *([b.slice(0, last)] if last else [])]:
                yield pa.Table.from_batches(done)
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def from_pixels(px: DataFrame, keys: list[str] = ["img"]) -> DataFrame:  # noqa: B006
    """Dense rows of a pixel table (keys, x, y, r, g, b, a), as large as their largest coordinates;
    missing pixels are clear. One shuffle, by image; a task holds the images of a batch."""
    rows = px.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("x", "y", *RGBA)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, len(keys)):
            key = list(zip(*(t.column(i).to_pylist() for i in range(len(keys)))))
            start = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            x, y, *rgba = (t.column(len(keys) + i).to_numpy() for i in range(6))
            w, h, data = [], [], []
            for a, b in zip(start, start[1:]):
                w.append(int(x[a:b].max()) + 1)
                h.append(int(y[a:b].max()) + 1)
                grid = np.zeros((h[-1], w[-1], 4), np.uint8)
                grid[y[a:b], x[a:b]] = np.stack([c[a:b] for c in rgba], axis=1)
                data.append(grid.tobytes())
            firsts = t.take(pa.array(start[:-1])).select(keys).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in firsts.columns), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(data, pa.binary())], [*keys, *SHAPE])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{schema_of(rows, keys)}, w int, h int, data binary")


def to_pixels(images: DataFrame, keep: list[str] = ["img"], change: Change | None = None) -> DataFrame:  # noqa: B006
    """A row (keep, x, y, r, g, b, a) for each pixel, after ``change`` if there is one; images without data have none. No shuffle.
    A change is made here rather than by ``changed`` before, as each step of Python is a worker of its own in every task. Python hands
    pixels on as arrays of whole numbers, four channels each; the rows are Spark's."""
    rows = images.filter(F.col("data").isNotNull()).select(*keep, *SHAPE)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, n + 2):
                yield arrays(with_change(b, n, n + 1, n + 2, change) if change else b)

    def arrays(b: pa.RecordBatch) -> pa.RecordBatch:
        """Images in parts of at most ``PIXELS_AT_ONCE`` pixels: (keep, w, first pixel, pixels)."""
        size = pc.binary_length(b.column(n + 2)).to_numpy() // 4
        pixels = np.frombuffer(b"".join(b.column(n + 2).to_pylist()), "<i4")
        parts = np.maximum(-(-size // PIXELS_AT_ONCE), 1)
        image = np.repeat(np.arange(b.num_rows), parts)
        first = (np.arange(len(image)) - np.repeat(np.cumsum(parts) - parts, parts)) * PIXELS_AT_ONCE
        ends = np.cumsum(np.minimum(size[image] - first, PIXELS_AT_ONCE))
        columns = [b.column(c) if len(image) == b.num_rows else b.column(c).take(pa.array(image)) for c in range(n + 1)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(pixels))
        return pa.RecordBatch.from_arrays([*columns, pa.array(first.astype(np.int32)), lists], [*keep, "w", "_first", "_pixels"])

    made = rows.mapInArrow(run, f"{schema_of(rows, keep)}, w int, _first int, _pixels array<int>")
    px = made.select(*keep, "w", "_first", F.posexplode("_pixels").alias("_at", "_rgba")).withColumn("_at", F.col("_first") + F.col("_at"))
    rgba = ["_rgba & 255 AS r", "shiftright(_rgba, 8) & 255 AS g", "shiftright(_rgba, 16) & 255 AS b", "shiftrightunsigned(_rgba, 24) AS a"]
    return px.selectExpr(*(f"`{c}`" for c in keep), "_at % w AS x", "cast(_at div w AS int) AS y", *rgba)


# Kernels of stacks


def channel(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.int32)


def grown(open_: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Of a stack of cells (n, h, w) the four-connected regions of open cells that hold a found one:
    they grow by whole runs of rows and of columns in turn; images that are done drop out."""
    found, left = found & open_, np.arange(len(open_))
    while len(left):
        before, o = found[left], open_[left]
        now = kernels.filled_runs(before, o)
        now = kernels.filled_runs(now.swapaxes(1, 2), o.swapaxes(1, 2)).swapaxes(1, 2)
        found[left] = now
        left = left[(now != before).any(axis=(1, 2))]
    return found


def flood_fill(x: int, y: int, colour: tuple[int, int, int, int]) -> Change:
    """Exact fill: the region of the seed's colour becomes ``colour``."""

    def change(s: Stack) -> Stack:
        if not (0 <= y < s.shape[1] and 0 <= x < s.shape[2]):
            return s
        seed = np.zeros(s.shape[:3], bool)
        seed[:, y, x] = True
        out = s.copy()
        out[grown((s == s[:, y, x][:, None, None]).all(axis=3), seed)] = colour
        return out

    return change


def clear_from_corners(tolerance: float) -> Change:
    """Background removal: from each corner in turn (top first, left first) the region within tolerance
    percent of 765 of the corner's colour becomes clear. A pixel that one corner's search has looked
    at isn't looked at again."""

    def change(s: Stack) -> Stack:
        h, w = s.shape[1:3]
        out, seen = s.copy(), np.zeros(s.shape[:3], bool)
        for y, x in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)):
            near = np.abs(s[..., :3] - s[:, y, x, :3][:, None, None]).sum(axis=3) <= tolerance * 765 / 100
            seed = np.zeros(seen.shape, bool)
            seed[:, y, x] = True
            found = grown(near & ~seen, seed)
            seen |= found
            seen[:, 1:] |= found[:, :-1]
            seen[:, :-1] |= found[:, 1:]
            seen[:, :, 1:] |= found[:, :, :-1]
            seen[:, :, :-1] |= found[:, :, 1:]
            out[found, 3] = 0
        return out

    return change


def on_white(s: Stack) -> Stack:
    a = s[..., 3:] / 255
    out = s.copy()
    out[..., :3] = np.floor(s[..., :3] * a + 255 * (1 - a) + 0.5)
    out[..., 3] = 255
    return out


def sharpen(amount: float) -> Change:
    """The four-neighbour kernel (1 + 4s, -s), s = amount / 5; the border stays."""
    k = amount / 5

    def change(s: Stack) -> Stack:
        out = s.copy()
        c = s[..., :3]
        around = c[:, 1:-1, :-2] + c[:, 1:-1, 2:] + c[:, :-2, 1:-1] + c[:, 2:, 1:-1]
        out[:, 1:-1, 1:-1, :3] = channel(c[:, 1:-1, 1:-1] * (1 + 4 * k) - k * around)
        return out

    return change


def boxes(deviation: float) -> list[tuple[int, int]]:
    """The three boxes of a blur: how many pixels each takes in before and after its centre."""
    d = math.floor(deviation * 3 * math.sqrt(2 * math.pi) / 4 + 0.5)
    if d < 2:  # a box of one pixel changes nothing
        return []
    half = d // 2
    return [(half, half)] * 3 if d % 2 else [(half, half - 1), (half - 1, half), (half, half)]


def blur(deviation: float) -> Change:
    """Three running box sums along rows and columns, of colours weighed by their alpha; outside the
    image all is clear. Sums are integers, so only the end is rounded."""
    spans = boxes(deviation)

    def summed(x: np.ndarray, axis: int) -> np.ndarray:
        n = x.shape[axis]
        for before, after in spans:
            more = [(0, 0)] * x.ndim
            more[axis] = (1, 0)
            total = np.cumsum(np.pad(x, more), axis=axis, dtype=x.dtype)
            high, low = np.minimum(np.arange(n) + after + 1, n), np.maximum(np.arange(n) - before, 0)
            x = total.take(high, axis=axis) - total.take(low, axis=axis)
        return x

    def change(s: Stack) -> Stack:
        if not spans:
            return s
        whole = math.prod(a + b + 1 for a, b in spans) ** 2
        # a box may reach over the edge and come back, so room is left around
        room = sum(max(span) for span in spans)
        # running sums may go round at 32 bits, as their differences are right if they fit
        x = np.pad(s.astype(np.int32 if whole * 255 * 255 < 1 << 31 else np.int64), ((0, 0), (room, room), (room, room), (0, 0)))
        x[..., :3] *= x[..., 3:]
        x = summed(summed(x, 2), 1)[:, room:-room, room:-room]
        alpha = x[..., 3:]
        out = np.where(alpha > 0, np.floor(x / np.maximum(alpha, 1) + 0.5), 0)
        out[..., 3:] = np.floor(alpha / whole + 0.5)
        return out.astype(np.int32)

    return change


def linear(matrix: list[list[float]], offset: float = 0.0) -> Change:
    def change(s: Stack) -> Stack:
        out = s.copy()
        for i, row in enumerate(matrix):
            out[..., i] = channel(offset + s[..., 0] * row[0] + s[..., 1] * row[1] + s[..., 2] * row[2])
        return out

    return change


def adjust(brightness: float = 100, contrast: float = 100, saturate: float = 100, hue: float = 0, blurred: float = 0, invert: float = 0, grayscale: float = 0, sharpened: float = 0) -> Change:
    """The filters in this order, each left out at its neutral value; rounded after each."""
    unit = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
    scale = lambda k: [[k * x for x in row] for row in unit]
    mix = lambda k: [[LUMA[j] + k * (unit[i][j] - LUMA[j]) for j in range(3)] for i in range(3)]
    steps: list[Change] = []
    if brightness != 100:
        steps.append(linear(scale(brightness / 100)))
    if contrast != 100:
        steps.append(linear(scale(contrast / 100), 127.5 * (1 - contrast / 100)))
    if saturate != 100:
        steps.append(linear(mix(saturate / 100)))
    if hue % 360:
        c, s = math.cos(math.radians(hue)), math.sin(math.radians(hue))
        turn = [[-0.213, -0.715, 0.928], [0.143, 0.140, -0.283], [-0.787, 0.715, 0.072]]
        steps.append(linear([[LUMA[j] + c * (unit[i][j] - LUMA[j]) + s * turn[i][j] for j in range(3)] for i in range(3)]))
    if blurred:
        steps.append(blur(blurred))
    if invert:
        steps.append(linear(scale(1 - 2 * invert / 100), 255 * invert / 100))
    if grayscale:
        steps.append(linear(mix(1 - grayscale / 100)))
    if sharpened:
        steps.append(sharpen(sharpened))

    return in_turn(*steps)


def over(top: Stack, alpha: np.ndarray, under: Stack) -> Stack:
    """src-over, rounded to 8 bits. ``alpha``: the top's, a fraction, its opacity included."""
    v = under[..., 3] / 255
    whole = alpha + v * (1 - alpha)
    keep = (alpha <= 0) | (whole <= 0)
    safe = np.where(keep, 1.0, whole)
    out = np.empty_like(under)
    for i in range(3):
        out[..., i] = channel((top[..., i] * alpha + under[..., i] * v * (1 - alpha)) / safe)
    out[..., 3] = channel(whole * 255)
    return np.where(keep[..., None], under, out)


def composite(layers: DataFrame, keys: list[str] = ["img"]) -> DataFrame:  # noqa: B006
    """Dense rows (keys, w, h, data) of stacked layers (keys, z, visible, opacity 0..100, w, h, data), bottom to
    top, rounded after each layer. The layers of an image are of one size and meet in one task; the n-th
    layers of all images of a size are laid on at once."""
    rows = layers.select(*keys, F.when(F.col("visible"), F.col("opacity")).otherwise(0).cast("int").alias("opacity"), *SHAPE, "z")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(small(batches), n):
            key = list(zip(*(t.column(i).to_pylist() for i in range(n))))
            start = np.array([0, *(i for i in range(1, len(key)) if key[i] != key[i - 1])])
            depth = np.arange(len(key)) - np.repeat(start, np.diff([*start, len(key)]))
            image = np.cumsum(depth == 0) - 1
            opacity, w, h = (t.column(n + i).to_numpy() for i in range(3))
            raw, out = t.column(n + 3), [b""] * len(start)
            if (w != w[start][image]).any() or (h != h[start][image]).any():
                raise ValueError("layers of an image differ in size")
            for x, y, of in by_size(w[start].tolist(), h[start].tolist()):
                of = np.array(of)
                slot = np.full(len(start), -1)
                slot[of] = np.arange(len(of))
                now = np.zeros((len(of), y, x, 4), np.int32)
                for d in range(int(depth.max()) + 1):
                    at = np.flatnonzero((depth == d) & (slot[image] >= 0))
                    if len(at):
                        top, i = stack_of([raw[int(k)].as_py() for k in at], x, y), slot[image[at]]
                        now[i] = over(top, top[..., 3] * opacity[at][:, None, None] / 25500, now[i])
                for i, data in zip(of, bytes_of(now)):
                    out[i] = data
            firsts = t.take(pa.array(start)).select(list(range(n)))
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in firsts.columns), pa.array(w[start]), pa.array(h[start]), pa.array(out, pa.binary())], [*keys, *SHAPE])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from sliced(b, n + 3)

    in_order = rows.repartition(*keys).sortWithinPartitions(*keys, "z")
    return in_order.mapInArrow(run, f"{schema_of(rows, keys)}, w int, h int, data binary")


def blended(images: DataFrame, top: str = "top", opacity: int = 100) -> DataFrame:
    """``images`` with the image in column ``top`` (data of the same size, or null) laid over ``data`` at ``opacity``;
    no shuffle."""
    names = [c for c in images.columns if c != top]
    rows = images.select(*names, top)
    w, h, data = (names.index(c) for c in SHAPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, data):
                new, above = b.column(data).to_pylist(), b.column(len(names)).to_pylist()
                for x, y, at in by_size(b.column(w).to_pylist(), b.column(h).to_pylist()):
                    at = [i for i in at if above[i] is not None and new[i] is not None]
                    if at:
                        upper = stack_of([above[i] for i in at], x, y)
                        made = over(upper, upper[..., 3] * opacity / 25500, stack_of([new[i] for i in at], x, y))
                        for i, m in zip(at, bytes_of(made)):
                            new[i] = m
                columns = list(b.columns[: len(names)])
                columns[data] = pa.array(new, pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema_of(images, names))


def marked(images: DataFrame, marks: DataFrame, laid: bool = False, opacity: int = 100) -> DataFrame:
    """``images`` (img, w, h, data) with the points of their ``marks`` (a row an image, of ``kernels.placed``) in the marks' colour in
    place of their own or, if ``laid``, laid over it at ``opacity``; points outside an image are left out. Images meet
    their marks in a shuffle of dense rows: marks are a row for each image, too many to broadcast."""
    names = images.columns
    w, h, data = (names.index(c) for c in SHAPE)
    kept = marks.select("img", F.array(*RGBA).alias("_colour"), "xs", "ys")
    rows = images.join(kept.hint("merge"), "img", "left").select(*names, "_colour", "xs", "ys")
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, data):
                new, colour, xs, ys = (b.column(c).to_pylist() for c in (data, n, n + 1, n + 2))
                for width, height, at in by_size(b.column(w).to_pylist(), b.column(h).to_pylist()):
                    at = [i for i in at if xs[i] and new[i] is not None]
                    if not at:
                        continue
                    s = stack_of([new[i] for i in at], width, height)
                    image = np.repeat(np.arange(len(at)), [len(xs[i]) for i in at])
                    x, y = (np.concatenate([v[i] for i in at]) for v in (xs, ys))
                    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
                    image, x, y = image[inside], x[inside], y[inside]
                    top = np.array([colour[i] for i in at], np.int32)[image]
                    s[image, y, x] = over(top, top[:, 3] * opacity / 25500, s[image, y, x]) if laid else top
                    for i, m in zip(at, bytes_of(s)):
                        new[i] = m
                columns = list(b.columns[:n])
                columns[data] = pa.array(new, pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema_of(images, names))


def ghosted(frames: DataFrame, seq: str, opacity: int) -> DataFrame:
    """Each frame (seq, pos, w, h, data) over the one before it, which shows at ``opacity`` on a clear ground.
    Frames meet their predecessor in a shuffle by sequence and place, so a long sequence is spread out; Spark takes
    made frames for as small as what they are made from, so it is told not to broadcast them."""
    before = frames.select(seq, (F.col("pos") + 1).alias("pos"), F.col("data").alias("under")).hint("merge")
    clear = F.unhex(F.repeat(F.lit("00000000"), F.col("w") * F.col("h")))
    pair = frames.join(before, [seq, "pos"], "left").withColumn("own", F.col("data")).withColumn("data", clear)
    shown = blended(pair.select(seq, "pos", *SHAPE, "own", "under"), "under", opacity)
    return blended(shown, "own").select(seq, "pos", *SHAPE)


def cropped(images: DataFrame, width: Column, height: Column) -> DataFrame:
    """``images`` cut to their top left ``width`` x ``height`` pixels, of their own each; no shuffle."""
    names = images.columns
    w, h, data = (names.index(c) for c in SHAPE)
    least = lambda size, c: F.greatest(F.lit(0), F.least(size, F.col(c))).cast("int")
    rows = images.select(*names, least(width, "w").alias("_w"), least(height, "h").alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, data):
                new = b.column(data).to_pylist()
                size = [b.column(c).to_pylist() for c in (w, h, len(names), len(names) + 1)]
                for i, (x, y, right, low) in enumerate(zip(*size)):
                    if new[i] is not None:
                        new[i] = np.frombuffer(new[i], np.uint8).reshape(y, x, 4)[:low, :right].tobytes()
                columns = list(b.columns[: len(names)])
                columns[w], columns[h], columns[data] = b.column(len(names)), b.column(len(names) + 1), pa.array(new, pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema_of(images, names))


def centred(images: DataFrame, sizes: DataFrame) -> DataFrame:
    """A pixel table of ``images`` padded to the largest of ``sizes`` (w, h) and centred. Each image knows its own size, so
    only the largest one is sought, and nothing is shuffled but that."""
    most = sizes.agg(F.max("w").alias("_W"), F.max("h").alias("_H"))
    off = lambda most, own: F.floor((F.col(most) - F.col(own)) / 2).cast("int")
    own = images.crossJoin(F.broadcast(most))  # one row
    px = to_pixels(own.select("img", *SHAPE, off("_W", "w").alias("dx"), off("_H", "h").alias("dy")), ["img", "dx", "dy"])
    return px.select("img", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), *RGBA)


def encoded(images: DataFrame, kind: str, keep: list[str] = ["img"]) -> DataFrame:  # noqa: B006
    """(keep, content): each image as a file of that kind, null without data; no shuffle."""
    rows = images.select(*keep, *SHAPE)
    n, encode = len(keep), kernels.ENCODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, n + 2):
                made = [None if d is None else encode(stack_of([d], w, h)[0]) for w, h, d in zip(*(b.column(n + i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(made, pa.binary())], [*keep, "content"])

    return rows.mapInArrow(run, f"{schema_of(rows, keep)}, content binary")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l1): the L1 difference of each two images of the same keys, alpha ignored, over the pixels that both have. A shuffle
    of dense rows; pairs without data on a side are left out."""
    other = b.select(*keys, *(F.col(c).alias(f"_{c}") for c in SHAPE)).hint("merge")
    rows = a.join(other, keys).filter("data is not null and _data is not null").select(*keys, *SHAPE, "_w", "_h", "_data")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in sliced(batch, n + 2):
                w, h, own, w2, h2, far = (one.column(n + i).to_pylist() for i in range(6))
                out = np.zeros(one.num_rows, np.int64)
                for (x, x2), (y, y2), at in by_size(list(zip(w, w2)), list(zip(h, h2))):
                    low, right = min(y, y2), min(x, x2)
                    s, t = stack_of([own[i] for i in at], x, y), stack_of([far[i] for i in at], x2, y2)
                    out[at] = np.abs(s[:, :low, :right, :3] - t[:, :low, :right, :3]).sum(axis=(1, 2, 3))
                yield pa.RecordBatch.from_arrays([*one.columns[:n], pa.array(out)], [*keys, "l1"])

    return rows.mapInArrow(run, f"{schema_of(rows, keys)}, l1 bigint")


def cell_means(stack: Stack, side: int) -> np.ndarray:
    """(n, side * side * 3): red, green and blue of each of ``side`` x ``side`` cells, the mean of the pixels that fall in
    a cell (of the one that it falls in, where there are fewer pixels than cells)."""

    def sides(length: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(side) * length // side
        return at, np.maximum(at + 1, np.arange(1, side + 1) * length // side)

    total = np.pad(stack[..., :3].astype(np.int64), ((0, 0), (1, 0), (1, 0), (0, 0))).cumsum(axis=1).cumsum(axis=2)
    (top, bottom), (left, right) = sides(stack.shape[1]), sides(stack.shape[2])
    cell = lambda y, x: total[:, y][:, :, x]
    sums = cell(bottom, right) - cell(top, right) - cell(bottom, left) + cell(top, left)
    return channel(sums / ((bottom - top)[:, None] * (right - left))[..., None]).reshape(len(stack), -1)


def signatures(images: DataFrame, side: int = 64) -> DataFrame:
    """(columns of ``images`` but w, h and data, signature array<int>): ``cell_means`` of each image, null without data. What
    frames are compared by; made where the image is read."""
    keep = [c for c in images.columns if c not in SHAPE]
    rows = images.select(*keep, *SHAPE)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, n + 2):
                raw, out = b.column(n + 2).to_pylist(), [None] * b.num_rows
                for w, h, at in by_size(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                    if not (at := [i for i in at if raw[i] is not None]):
                        continue
                    for i, m in zip(at, cell_means(stack_of([raw[i] for i in at], w, h), side)):
                        out[i] = m.tolist()
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.list_(pa.int32()))], [*keep, "signature"])

    return rows.mapInArrow(run, ", ".join([schema_of(rows, keep), "signature array<int>"]))
