"""Regions of images of any size: images are cut into tiles, and regions into the tiles' parts.

A tile is a row (img, tx, ty, w, h, data), at most ``LARGEST`` pixels a side. Its connected parts are labelled in the task that
reads it. Where two tiles touch, parts that go on become edges (only the pixels at the borders are shuffled), and
components of these edges are the regions of whole images. So no task needs more than a tile of an image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import dense
from tessel.operators.graph import BOUND, components, forest, written

LARGEST = 64
#: Labels of a tile: its number times this, plus the place of the part's first pixel.
CELLS = LARGEST * LARGEST
PLACE = "img string, tx int, ty int, w int, h int"
NAMES = ["img", "tx", "ty", "w", "h"]

Grid = np.ndarray


def cut(images: DataFrame, side: int = LARGEST) -> DataFrame:
    """Tiles of dense images (img, w, h, data); those at the right and the bottom may be smaller."""
    if not 1 <= side <= LARGEST:
        raise ValueError(f"a tile has 1 to {LARGEST} pixels a side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for img, w, h, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                grid = np.frombuffer(data, np.uint8).reshape(h, w, 4)
                for y in range(0, h, side):  # a batch for each row of tiles
                    parts = [grid[y : y + side, x : x + side] for x in range(0, w, side)]
                    columns = [[img] * len(parts), list(range(len(parts))), [y // side] * len(parts), [p.shape[1] for p in parts], [p.shape[0] for p in parts], [p.tobytes() for p in parts]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), *[pa.int32()] * 4, pa.binary()])], [*NAMES, "data"])

    return images.select("img", "w", "h", "data").mapInArrow(run, f"{PLACE}, data binary")


def to_pixels(tiles: DataFrame, side: int = LARGEST) -> DataFrame:
    """A pixel table of the whole images."""
    px = dense.to_pixels(tiles, ["img", "tx", "ty"])
    return px.select("img", (F.col("x") + F.col("tx") * side).alias("x"), (F.col("y") + F.col("ty") * side).alias("y"), "r", "g", "b", "a")


def parts(kind: Grid) -> Grid:
    """Of each cell of a kind of 0 or more the place of the first cell of its connected part; -1 for other cells. Of one tile, or of a
    stack of tiles of one size (n, h, w). The smallest place spreads along runs of rows and of columns in turn."""
    h, w = kind.shape[-2:]
    stack = kind.reshape(-1, h, w)
    n = len(stack)
    label = np.broadcast_to(np.arange(h * w).reshape(h, w), stack.shape)

    def runs(k: Grid) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.ones(k.shape, bool)
        fresh[..., 1:] = k[..., 1:] != k[..., :-1]
        return np.flatnonzero(fresh.ravel()), np.cumsum(fresh.ravel()) - 1

    across, down = runs(stack), runs(stack.swapaxes(1, 2))
    while n:
        before = label
        label = np.minimum.reduceat(label.ravel(), across[0])[across[1]].reshape(n, h, w)
        label = np.minimum.reduceat(label.swapaxes(1, 2).ravel(), down[0])[down[1]].reshape(n, w, h).swapaxes(1, 2)
        if (label == before).all():
            break
    return np.where(stack >= 0, label, -1).reshape(kind.shape)


def told(rows: DataFrame, schema: str, each: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """What ``each`` tells of each row, a dict."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                out += each({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)})
                if len(out) > 5000 or out and i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), fields)], [n for n, _ in fields])
                    out = []

    return rows.mapInArrow(run, schema)


def grid_of(row: dict) -> Grid:
    return np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], 4).astype(np.int64)


def labels_of(row: dict) -> Grid:
    return np.frombuffer(row["labels"], np.int16).reshape(row["h"], row["w"])


def borders(labelled: DataFrame, side: int) -> DataFrame:
    """(img, down, tx, ty, near, tile, kinds, labels): the cells of each tile at a border that another tile may touch, as a row. A border is
    named by the tile behind it; near is 1 of that tile's own cells, and 0 of those of the tile before it."""
    names = ["img", "down", "tx", "ty", "near", "tile", "kinds", "labels"]
    types = [pa.string(), *[pa.int32()] * 4, pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in dense.sliced(batch, 6):
                out = []
                for img, tx, ty, w, h, tile, kinds, labels in zip(*(c.to_pylist() for c in b.columns)):
                    k, l = np.frombuffer(kinds, np.int64).reshape(h, w), np.frombuffer(labels, np.int16).reshape(h, w)
                    if tx:
                        out.append((img, 0, tx, ty, 1, tile, k[:, 0].tobytes(), l[:, 0].tobytes()))
                    if ty:
                        out.append((img, 1, tx, ty, 1, tile, k[0].tobytes(), l[0].tobytes()))
                    if w == side:
                        out.append((img, 0, tx + 1, ty, 0, tile, k[:, -1].tobytes(), l[:, -1].tobytes()))
                    if h == side:
                        out.append((img, 1, tx, ty + 1, 0, tile, k[-1].tobytes(), l[-1].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = labelled.select("img", "tx", "ty", "w", "h", "tile", "kinds", "labels")
    return rows.mapInArrow(run, "img string, down int, tx int, ty int, near int, tile bigint, kinds binary, labels binary")


def met(pairs: DataFrame) -> DataFrame:
    """(img, a, b): parts of two tiles that go on across a border. Borders of one length are compared at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, labels = ([b.column(c).to_pylist() for c in pair] for pair in ((2, 5), (3, 6)))
            tiles = [b.column(c).to_numpy() for c in (1, 4)]
            for n, m, at in dense.by_size([len(x) // 8 for x in kinds[0]], [len(x) // 8 for x in kinds[1]]):
                least = min(n, m)
                stack = lambda x, width, kind: np.frombuffer(b"".join([x[i] for i in at]), kind).reshape(len(at), width)[:, :least]
                k, o = (stack(x, width, np.int64) for x, width in zip(kinds, (n, m)))
                ends = [t[at][:, None] * CELLS + stack(x, width, np.int16) for t, x, width in zip(tiles, labels, (n, m))]
                same = (k == o) & (k >= 0)
                # cells after one another that tell the same are told once
                again = np.zeros(same.shape, bool)
                again[:, 1:] = same[:, :-1] & (ends[0][:, 1:] == ends[0][:, :-1]) & (ends[1][:, 1:] == ends[1][:, :-1])
                row, col = np.nonzero(same & ~again)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(at)[row])), *(pa.array(e[row, col]) for e in ends)], ["img", "a", "b"])

    return pairs.select("img", "tile0", "kinds0", "labels0", "tile1", "kinds1", "labels1").mapInArrow(run, "img string, a bigint, b bigint")


def regions(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, root) of edges (img, a, b) as ``components`` tells them. Edges never leave an image, so those of an image are linked in the task
    that reads them, which holds one image's at a time; what is left of images of more than ``bound`` goes the way of ``components``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, held, n, out, size = None, [], 0, [], 0

        def linked(whole: bool) -> Iterator[pa.RecordBatch]:
            for b in forest(iter([pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(c) for h in held]) for c in (1, 2)], ["a", "b"])])):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, whole))], ["node", "root", "whole"])

        large = False
        for batch in batches:
            keys = batch.column(0).to_pylist()
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if keys[start] != image:
                    if held:
                        out += linked(not large)
                    image, held, n, large = keys[start], [], 0, False
                held.append(batch.slice(start, i - start))
                n += i - start
                if n > bound:
                    large = True
                    out += linked(False)
                    held, n = [], 0
                start = i
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(o.num_rows for o in out) else out[0]
                out = []
        if held:
            yield from linked(not large)

    dealt = edges.repartition("img").sortWithinPartitions("img")
    found = written(dealt.mapInArrow(run, "node bigint, root bigint, whole boolean"), "regions")
    done, rest = found.filter("whole").select("node", "root"), found.filter("not whole").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return done.unionByName(components(rest)) if rest.limit(1).count() else done


def region(labelled: DataFrame, seeds: DataFrame, side: int) -> DataFrame:
    """(tile, found): the labels in each tile that belong to the region of its image's seed. ``labelled``: tiles with their
    number (tile), labels, and kinds of the cells; ``seeds``: img, x, y."""

    sides = written(borders(labelled, side), "sides")
    place = ["img", "down", "tx", "ty"]
    ends = [sides.filter(F.col("near") == near).select(*place, *(F.col(c).alias(f"{c}{near}") for c in ("tile", "kinds", "labels"))) for near in (0, 1)]
    root = regions(met(ends[0].join(ends[1].hint("merge"), place)))

    def start(row: dict) -> Iterator[tuple]:
        x, y = row["x"] - row["tx"] * side, row["y"] - row["ty"] * side
        if 0 <= x < row["w"] and 0 <= y < row["h"] and labels_of(row)[y, x] >= 0:
            yield row["img"], row["tile"] * CELLS + int(labels_of(row)[y, x])

    here = labelled.join(seeds.hint("merge"), [labelled["img"] == seeds["img"], F.col("tx") == F.floor(F.col("x") / side), F.col("ty") == F.floor(F.col("y") / side)]).select(labelled["img"], "tile", "tx", "ty", "w", "h", "labels", "x", "y")
    first = told(here, "img string, node bigint", start).join(root, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
    nodes = root.join(first, "root").select("node").unionByName(first.select(F.col("root").alias("node")))
    tile, place = F.floor(F.col("node") / CELLS).cast("bigint"), (F.col("node") % CELLS).cast("int")
    return nodes.groupBy(tile.alias("tile")).agg(F.collect_set(place).alias("found"))


def with_labels(tiles: DataFrame, kinds: Callable[[dict], Grid]) -> DataFrame:
    """``tiles`` with kinds of their cells and labels of the parts, stored. Tiles of one size are labelled at once."""
    names = tiles.columns
    data = names.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in dense.sliced(batch, data):
                made = [kinds(row).astype(np.int64) for row in b.to_pylist()]
                labels = [b""] * len(made)
                for _, _, at in dense.by_size([k.shape[1] for k in made], [k.shape[0] for k in made]):
                    for i, l in zip(at, parts(np.stack([made[i] for i in at])).astype(np.int16)):
                        labels[i] = l.tobytes()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k.tobytes() for k in made], pa.binary()), pa.array(labels, pa.binary())], [*names, "kinds", "labels"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema)
    return written(tiles.mapInArrow(run, f"{schema}, kinds binary, labels binary"), "tiles")


def packed(grid: Grid) -> Grid:
    return grid @ (256 ** np.arange(4))


def flood_fill(tiles: DataFrame, seeds: DataFrame, colour: tuple[int, int, int, int], side: int = LARGEST) -> DataFrame:
    """Exact fill of tiles: the region of the seed's colour (seeds: img, x, y) becomes ``colour``."""
    own = written(tiles.withColumn("tile", F.monotonically_increasing_id()), "numbered")
    labelled = with_labels(own, lambda row: packed(grid_of(row)))
    hit = labelled.join(region(labelled, seeds, side), "tile", "left").select(*NAMES, "data", "labels", "found")

    def each(row: dict) -> Iterator[tuple]:
        grid = grid_of(row)
        if row["found"]:
            grid[np.isin(labels_of(row), row["found"])] = colour
        yield *(row[n] for n in NAMES), grid.astype(np.uint8).tobytes()

    return told(hit, f"{PLACE}, data binary", each)


def clear_from_corners(tiles: DataFrame, tolerance: float, side: int = LARGEST) -> DataFrame:
    """Background removal of tiles: from each corner in turn (top first, left first) the region within tolerance percent of 765 of
    the corner's colour becomes clear. A pixel that one corner's search has looked at isn't looked at again."""
    size = tiles.groupBy("img").agg(F.max(F.col("tx") * side + F.col("w")).alias("W"), F.max(F.col("ty") * side + F.col("h")).alias("H"))
    state = written(tiles.withColumns({"tile": F.monotonically_increasing_id(), "seen": F.lit(None).cast("binary")}), "numbered")
    corners = [(F.lit(0), F.lit(0)), (F.col("W") - 1, F.lit(0)), (F.lit(0), F.col("H") - 1), (F.col("W") - 1, F.col("H") - 1)]
    for x, y in corners:
        seeds = size.select("img", x.cast("int").alias("x"), y.cast("int").alias("y"))

        def colour(row: dict) -> Iterator[tuple]:
            px = grid_of(row)[row["y"] - row["ty"] * side, row["x"] - row["tx"] * side]
            yield row["img"], *map(int, px[:3])

        at = state.join(seeds, [state["img"] == seeds["img"], F.col("tx") == F.floor(F.col("x") / side), F.col("ty") == F.floor(F.col("y") / side)]).drop(seeds["img"])
        shades = told(at.select(*NAMES, "data", "x", "y"), "img string, r int, g int, b int", colour)

        def open_cells(row: dict) -> Grid:
            apart = np.abs(grid_of(row)[..., :3] - np.array([row["r"], row["g"], row["b"]])).sum(axis=2)
            near = apart <= tolerance * 765 / 100
            if row["seen"]:
                near &= np.frombuffer(row["seen"], np.uint8).reshape(near.shape) == 0
            return near.astype(np.int64) - 1

        labelled = with_labels(state.join(shades, "img"), open_cells)
        hit = written(labelled.join(region(labelled, seeds, side), "tile", "left"), "hit")

        def beside(row: dict) -> Iterator[tuple]:
            """(img, tx, ty, place): cells of other tiles next to a found one."""
            found = np.isin(labels_of(row), row["found"])
            h, w, tx, ty = row["h"], row["w"], row["tx"], row["ty"]
            for k in np.flatnonzero(found[:, 0]).tolist() if tx else ():
                yield row["img"], tx - 1, ty, k, side - 1
            for k in np.flatnonzero(found[:, -1]).tolist():
                yield row["img"], tx + 1, ty, k, 0
            for k in np.flatnonzero(found[0]).tolist() if ty else ():
                yield row["img"], tx, ty - 1, side - 1, k
            for k in np.flatnonzero(found[-1]).tolist():
                yield row["img"], tx, ty + 1, 0, k

        marks = told(hit.filter("found is not null").select("img", "tx", "ty", "w", "h", "labels", "found"), "img string, tx int, ty int, row int, col int", beside)
        marks = marks.groupBy("img", "tx", "ty").agg(F.collect_set(F.col("row") * LARGEST + F.col("col")).alias("marks"))

        def cleared(row: dict) -> Iterator[tuple]:
            grid = grid_of(row)
            seen = np.frombuffer(row["seen"], np.uint8).reshape(row["h"], row["w"]).astype(bool) if row["seen"] else np.zeros((row["h"], row["w"]), bool)
            if row["found"]:
                found = np.isin(labels_of(row), row["found"])
                grid[found, 3] = 0
                seen |= found
                seen[1:] |= found[:-1]
                seen[:-1] |= found[1:]
                seen[:, 1:] |= found[:, :-1]
                seen[:, :-1] |= found[:, 1:]
            for m in row["marks"] or ():
                seen[m // LARGEST, m % LARGEST] = True
            yield *(row[n] for n in NAMES), grid.astype(np.uint8).tobytes(), row["tile"], seen.astype(np.uint8).tobytes()

        both = hit.join(marks, ["img", "tx", "ty"], "left").select(*NAMES, "data", "tile", "seen", "labels", "found", "marks")
        state = written(told(both, f"{PLACE}, data binary, tile bigint, seen binary", cleared), "tiles")
    return state.select(*NAMES, "data")
