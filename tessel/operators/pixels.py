"""Raster operators on pixel tables: rows (img, x, y, r, g, b, a) with channels 0..255.

Pixels are rows, so most operators are projections, filters and coordinate arithmetic, which
scale with the number of pixels and need no image in one task. Compositing follows Porter and
Duff (1984), filters the W3C Filter Effects matrices. Operators that need a whole image, as flood
fill does, are in ``kernels``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RGBA = ["r", "g", "b", "a"]


def channel(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5))).cast("int")


def distance(df_cols: list[str], colour: tuple[int, int, int]) -> Column:
    out = F.lit(0)
    for c, v in zip(df_cols, colour):
        out = out + F.abs(F.col(c) - v)
    return out


def keyed(px: DataFrame, colour: tuple[int, int, int], tolerance: float) -> DataFrame:
    """Alpha 0 where the L1 distance to the colour is below tolerance percent of 765."""
    return px.withColumn("a", F.when(distance(RGBA[:3], colour) < tolerance * 765 / 100, 0).otherwise(F.col("a")))


def sharpened(px: DataFrame, amount: float) -> DataFrame:
    """The four-neighbour kernel (1 + 4s, -s), s = amount / 5; pixels without four neighbours
    stay. Both windows are partitioned by image, so pixels are shuffled once."""
    s = amount / 5
    around: dict[str, list[Column]] = {c: [] for c in RGBA[:3]}
    inner = F.lit(True)
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("img").orderBy(across, along)
        for shift, step in ((F.lag, -1), (F.lead, 1)):
            inner = inner & F.coalesce((shift(along).over(w) == F.col(along) + step) & (shift(across).over(w) == F.col(across)), F.lit(False))
            for c in around:
                around[c].append(shift(c).over(w))
    out = px.select("*", inner.alias("_inner"), *(v.alias(f"_{c}{i}") for c, vs in around.items() for i, v in enumerate(vs)))
    made = {c: F.when(F.col("_inner"), channel(F.col(c) * (1 + 4 * s) - s * sum((F.col(f"_{c}{i}") for i in range(4)), F.lit(0)))).otherwise(F.col(c)).alias(c) for c in around}
    return out.select(*(made.get(c, F.col(c)) for c in px.columns))


def linear(px: DataFrame, matrix: list[list[float]], offset: float = 0.0) -> DataFrame:
    made = [channel(sum((F.col(c) * w for c, w in zip(RGBA[:3], row)), F.lit(offset))).alias(c) for row, c in zip(matrix, RGBA)]
    return px.select(*(made[RGBA.index(c)] if c in RGBA[:3] else F.col(c) for c in px.columns))


#: Luminance weights of the W3C Filter Effects.
LUMA = (0.213, 0.715, 0.072)


def adjusted(px: DataFrame, brightness: float = 100, contrast: float = 100, saturate: float = 100, hue: float = 0, invert: float = 0, grayscale: float = 0, sharpen: float = 0) -> DataFrame:
    """The filters in this order, each left out at its neutral value; rounded after each. Blur,
    which browsers define, isn't among them."""
    unit = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
    scale = lambda k: [[k * x for x in row] for row in unit]
    mix = lambda k: [[LUMA[j] + k * (unit[i][j] - LUMA[j]) for j in range(3)] for i in range(3)]
    if brightness != 100:
        px = linear(px, scale(brightness / 100))
    if contrast != 100:
        px = linear(px, scale(contrast / 100), 127.5 * (1 - contrast / 100))
    if saturate != 100:
        px = linear(px, mix(saturate / 100))
    if hue % 360:
        c, s = math.cos(math.radians(hue)), math.sin(math.radians(hue))
        turn = [[-0.213, -0.715, 0.928], [0.143, 0.140, -0.283], [-0.787, 0.715, 0.072]]
        px = linear(px, [[LUMA[j] + c * (unit[i][j] - LUMA[j]) + s * turn[i][j] for j in range(3)] for i in range(3)])
    if invert:
        px = linear(px, scale(1 - 2 * invert / 100), 255 * invert / 100)
    if grayscale:
        px = linear(px, mix(1 - grayscale / 100))
    return sharpened(px, sharpen) if sharpen else px


def over(top: Column, alpha: Column, under: Column) -> Column:
    """src-over of two structs r, g, b, a (not premultiplied), rounded to 8 bits. ``alpha``: the
    top's, a fraction, its layer's opacity included."""
    ua = under["a"] / 255
    oa = alpha + ua * (1 - alpha)
    mixed = [channel((top[c] * alpha + under[c] * ua * (1 - alpha)) / oa).alias(c) for c in RGBA[:3]]
    return F.when((alpha <= 0) | (oa <= 0), under).otherwise(F.struct(*mixed, channel(oa * 255).alias("a")))


def composite(layers: DataFrame) -> DataFrame:
    """Pixels of stacked layers (img, z, visible, opacity 0..100, x, y, r, g, b, a), bottom to
    top, rounded after each layer: an ordered fold for each pixel, a handful of layers long. A
    pixel that no visible layer covers is clear."""
    alpha = F.when(F.col("visible"), F.col("a") * F.col("opacity") / 25500).otherwise(0.0)
    stack = F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", alpha.alias("alpha"))))
    clear = F.struct(*(F.lit(0).alias(c) for c in RGBA))
    fold = F.aggregate("_s", clear, lambda acc, p: over(p, p["alpha"], acc))
    return layers.groupBy("img", "x", "y").agg(stack.alias("_s")).withColumn("_p", fold).select("img", "x", "y", "_p.*")


def with_over(px: DataFrame, patch: DataFrame) -> DataFrame:
    """``px`` with the pixels of ``patch`` in place of its own. Spark takes a table of pixels for as small as what it is made
    from, so the joins of pixels here say that it isn't to be broadcast."""
    p = patch.select("img", "x", "y", *(F.col(c).alias(f"_{c}") for c in RGBA), F.lit(True).alias("_hit")).hint("merge")
    return px.join(p, ["img", "x", "y"], "left").select("img", "x", "y", *(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in RGBA))


def shifted(px: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    return px.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy).filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def split_sheet(px: DataFrame, width: int, height: int, cols: int, rows: int) -> DataFrame:
    """Cells of a sheet, row by row; what the division leaves over is dropped."""
    if cols < 1 or rows < 1:
        raise ValueError("columns and rows begin at 1")
    w, h = width // cols, height // rows
    inside = px.filter((F.col("x") < w * cols) & (F.col("y") < h * rows))
    cell = F.floor(F.col("y") / h) * cols + F.floor(F.col("x") / w)
    return inside.select("img", cell.cast("int").alias("cell"), (F.col("x") % w).alias("x"), (F.col("y") % h).alias("y"), *RGBA)


def assemble(cells: DataFrame, w: int, h: int, cols: int) -> DataFrame:
    """A sheet from cells of one size."""
    return cells.select("img", (F.col("x") + F.col("cell") % cols * w).cast("int").alias("x"), (F.col("y") + F.floor(F.col("cell") / cols) * h).cast("int").alias("y"), *RGBA)


def centred(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """Images padded to the largest size among ``sizes`` (img, w, h) and centred."""
    most = sizes.agg(F.max("w").alias("_W"), F.max("h").alias("_H"))
    s = sizes.crossJoin(F.broadcast(most)).hint("merge")  # one row is broadcast
    return px.join(s, "img").select("img", (F.col("x") + F.floor((F.col("_W") - F.col("w")) / 2)).cast("int").alias("x"), (F.col("y") + F.floor((F.col("_H") - F.col("h")) / 2)).cast("int").alias("y"), *RGBA)


def scaled(px: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Nearest neighbour: a target pixel takes the source pixel under its centre. Each source
    pixel lists the targets that fall on it, so nothing is joined."""

    def targets(at: Column, old: int, new: int) -> Column:
        # t with floor((t + 0.5) * old / new) = at
        low = F.ceil(at * new / old - 0.5)
        high = F.ceil((at + 1) * new / old - 0.5) - 1
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    out = px.withColumn("_x", F.explode(targets(F.col("x"), width, new_width))).withColumn("_y", F.explode(targets(F.col("y"), height, new_height)))
    return out.select("img", F.col("_x").cast("int").alias("x"), F.col("_y").cast("int").alias("y"), *RGBA)


def square(px: DataFrame, width: int, height: int, side: int) -> DataFrame:
    """The centred square, scaled to ``side``."""
    s = min(width, height)
    return scaled(shifted(px, -((width - s) // 2), -((height - s) // 2), s, s), s, s, side, side)


def fitted_size(w: Column, h: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """Scaled size and offsets that centre an image in a box."""
    k = F.least(F.lit(width) / w, F.lit(height) / h)
    fw, fh = F.greatest(F.lit(1), F.floor(w * k)), F.greatest(F.lit(1), F.floor(h * k))
    return fw, fh, F.floor((F.lit(width) - fw) / 2), F.floor((F.lit(height) - fh) / 2)


def thumbnail_size(w: Column, h: Column, most: int = 300) -> tuple[Column, Column]:
    k = F.least(F.lit(1.0), F.lit(most) / w)
    return F.floor(w * k + 0.5), F.floor(h * k + 0.5)


def other_side(v: Column, ratio: Column, most: int | None = None) -> Column:
    out = F.greatest(F.lit(1), F.floor(v / ratio + 0.5))
    return F.least(F.lit(most), out) if most else out


def frame_at(px: DataFrame, img: str, x: int, y: int) -> DataFrame:
    return px.filter((F.col("img") == img) & (F.col("x") == x) & (F.col("y") == y)).select(*RGBA)


def all_clear(px: DataFrame) -> DataFrame:
    return px.groupBy("img").agg((F.max("a") == 0).alias("is_clear"))


def checkered(px: DataFrame) -> DataFrame:
    return px.withColumn("dark", (F.col("x") + F.col("y")) % 2 == 0)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l1): the L1 difference of each two images of one size, alpha ignored."""
    side = b.select(*keys, "x", "y", *(F.col(c).alias(f"_{c}") for c in RGBA[:3])).hint("merge")
    return a.join(side, [*keys, "x", "y"]).groupBy(*keys).agg(F.sum(sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in RGBA[:3]), F.lit(0))).alias("l1"))


def blended(px: DataFrame, patch: DataFrame, opacity: int = 100) -> DataFrame:
    """``px`` with the pixels of ``patch`` laid over its own, by their alpha times ``opacity``."""
    p = patch.select("img", "x", "y", F.struct(*RGBA).alias("_top")).hint("merge")
    own, alpha = F.struct(*(F.col(c).cast("int").alias(c) for c in RGBA)), F.col("_top.a") * opacity / 25500
    mixed = F.when(F.col("_top").isNotNull(), over(F.col("_top"), alpha, own)).otherwise(own)
    return px.join(p, ["img", "x", "y"], "left").select("img", "x", "y", mixed.alias("_p")).select("img", "x", "y", "_p.*")


def merged_down(upper: DataFrame, lower: DataFrame, opacity: int) -> DataFrame:
    """The upper layer, at its opacity, drawn into the lower one, whose own opacity and the
    upper one's visibility don't matter; the lower one's attributes stay."""
    return blended(lower, upper, opacity)


def ghosted(frames: DataFrame, seq: str, opacity: int) -> DataFrame:
    """Each frame (seq, pos, x, y, r, g, b, a) over the one before it, which shows at ``opacity``."""
    layer = lambda df, z, o: df.select(F.struct(seq, "pos").alias("img"), F.lit(z).alias("z"), F.lit(True).alias("visible"), F.lit(o).alias("opacity"), "x", "y", *RGBA)
    heads = frames.select(seq, "pos").distinct()
    before = frames.withColumn("pos", F.col("pos") + 1).join(heads, [seq, "pos"], "left_semi")
    return composite(layer(before, 0, opacity).unionByName(layer(frames, 1, 100))).select(f"img.{seq}", "img.pos", "x", "y", *RGBA)


def resized(px: DataFrame, width: int, height: int, new_width: int, new_height: int, scale: bool) -> DataFrame:
    """A canvas of another size, 1 to 256 a side: scaled, or cropped at the top left corner."""
    w, h = (max(1, min(256, v)) for v in (new_width, new_height))
    return scaled(px, width, height, w, h) if scale else px.filter((F.col("x") < w) & (F.col("y") < h))


def suggested_cell(w: Column, h: Column, most: int = 256) -> tuple[Column, Column]:
    """A cell's sides for images of that size: scaled down to ``most`` where they are larger."""
    k = F.least(F.lit(1.0), F.lit(most) / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), F.floor(v * k + 0.5)) for v in (w, h))


def outlined(px: DataFrame, x0: int, y0: int, x1: int, y1: int, colour: tuple[int, int, int, int]) -> DataFrame:
    """``px`` with the edge of a rectangle in a colour."""
    inside = F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))
    edge = inside & (F.col("x").isin(x0, x1) | F.col("y").isin(y0, y1))
    return px.select(*(F.when(edge, F.lit(colour[RGBA.index(c)])).otherwise(F.col(c)).alias(c) if c in RGBA else F.col(c) for c in px.columns))


def with_alpha(colour: Column, alpha: Column) -> Column:
    """A colour (r, g, b, a) with another alpha, 0 to 255."""
    return colour.withField("a", F.greatest(F.lit(0), F.least(F.lit(255), alpha)).cast("int"))


def swapped_colours(df: DataFrame, first: str, second: str) -> DataFrame:
    """The two colours in each other's place."""
    return df.withColumns({first: F.col(second), second: F.col(first)})


def in_palette(px: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Extension: each pixel in the nearest colour (L1) of a palette, which callers bring along;
    the first of colours that tie."""
    apart = [F.struct(distance(RGBA[:3], c).alias("apart"), F.lit(i).alias("entry")) for i, c in enumerate(palette)]
    entry = F.array_min(F.array(*apart))["entry"]
    table = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, RGBA))) for p in palette))
    return px.withColumn("entry", entry).withColumns({c: F.get(table, F.col("entry"))[c] for c in RGBA[:3]})


def quantised(px: DataFrame, levels: int = 6) -> DataFrame:
    """Colours rounded to a cube of ``levels`` steps a channel, and their index in it. A fixed
    cube, so results differ from adaptive palettes: an approximation."""
    step = 255 / (levels - 1)
    index = [F.floor(F.col(c) / step + 0.5).cast("int") for c in RGBA[:3]]
    at = index[0] * levels * levels + index[1] * levels + index[2]
    return px.withColumn("index", at).withColumns({c: channel(i * step) for c, i in zip(RGBA, index)})
