"""Ordered sequences of frames: rows with a sequence, an id and a position (from 0).

Positions are columns, so most operators are arithmetic on them; sequences are independent, so
windows and folds are partitioned by sequence.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_times(videos: DataFrame, every: int, rate: float = 30.0) -> DataFrame:
    """(…, idx, ts): a time each ``every`` frames while it is below the duration. Times are
    idx * step; adding steps up instead differs in the last bits."""
    step = every / rate
    last = F.ceil(F.col("duration") / step).cast("int") - 1
    idx = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")))
    return videos.withColumn("idx", idx).withColumn("ts", F.col("idx") * F.lit(step)).filter("ts < duration")


def spread_times(videos: DataFrame, most: int, rate: float = 30.0) -> DataFrame:
    """At most ``most`` times, evenly over the duration; one at least."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("duration") * rate).cast("int")))
    return videos.withColumn("n", n).withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("ts", F.col("idx") * F.col("duration") / F.col("n"))


def kept_frames(frames: DataFrame, seq: str, pos: str, signature: str, least: float) -> DataFrame:
    """Positions that stay when a frame must differ from the last kept one by at least ``least``
    in the L1 norm of its signature. An ordered fold: the reference only moves when a frame is
    kept, so lag() doesn't do. One task reads a sequence in order, holding the last kept
    signature and a batch; Spark's sort spills. A batch is a matrix: the frames after a kept one are compared
    with it in blocks, which double until one is far enough. Frames that can't be compared (nulls, other
    lengths) are dropped."""
    rows = frames.select(F.col(seq), F.col(pos).cast("bigint").alias(pos), F.transform(signature, lambda x: x.cast("double")).alias("_s"))

    def far_enough(ref: list, now: list | None) -> bool:
        if now is None or len(ref) != len(now):
            return False
        far = 0.0
        for a, b in zip(ref, now):
            if a is None or b is None:
                return False
            far += abs(a - b)
        return far >= least or far != far  # as in Spark, NaN is above all numbers

    def next_far(rows: np.ndarray, at: int, end: int, ref: np.ndarray) -> int:
        """The first row from ``at`` on that is far enough from ``ref``, or ``end``."""
        size = 16
        while at < end:
            block = np.abs(rows[at : min(at + size, end)] - ref)
            far = np.cumsum(block, axis=1)[:, -1] if block.shape[1] else np.zeros(len(block))  # added from left to right
            hit = np.flatnonzero((far >= least) | np.isnan(far))
            if len(hit):
                return at + int(hit[0])
            at, size = at + size, 2 * size
        return end

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current, ref = False, None, None
        for b in batches:
            stay = []
            lists, values = b.column(2), b.column(2).flatten()
            width = len(values) // b.num_rows if b.num_rows else 0
            even = b.num_rows and not lists.null_count and not values.null_count and pc.all(pc.equal(pc.list_value_length(lists), width)).as_py()
            if even and (ref is None or None not in ref):
                rows, names = values.to_numpy().reshape(b.num_rows, width), b.column(0).to_pylist()
                at = 0
                while at < b.num_rows:
                    if not started or names[at] != current:
                        started, current, ref = True, names[at], None
                    end = at + 1
                    while end < b.num_rows and names[end] == current:
                        end += 1
                    if ref is None:
                        stay.append(at)
                        ref, at = rows[at].tolist(), at + 1
                    now = np.array(ref)
                    while at < end and len(ref) == width:
                        at = next_far(rows, at, end, now)
                        if at < end:
                            stay.append(at)
                            now, at = rows[at], at + 1
                    ref, at = now.tolist(), end
                yield b.select([0, 1]).take(pa.array(stay, pa.int64()))
                continue
            for i, (s, x) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                if not started or s != current:
                    started, current, ref = True, s, None
                now = x.as_py()
                if ref is None or far_enough(ref, now):
                    stay.append(i)
                    ref = now
            yield b.select([0, 1]).take(pa.array(stay, pa.int64()))

    in_order = rows.repartition(seq).sortWithinPartitions(seq, pos, "_s")
    return in_order.mapInArrow(fold, rows.drop("_s").schema)


def renumbered(df: DataFrame, seq: str, order: list[Column], pos: str = "pos") -> DataFrame:
    return df.withColumn(pos, F.row_number().over(Window.partitionBy(seq).orderBy(*order)).cast("bigint") - 1)


def reconciled(frames: DataFrame, order: DataFrame, seq: str, key: str) -> DataFrame:
    """Known ids in their order, new ones after them by id; ids without a frame are dropped."""
    known = order.select(seq, key, F.col("pos").alias("_p"))
    return renumbered(frames.join(known, [seq, key], "left"), seq, [F.col("_p").asc_nulls_last(), F.col(key).asc()]).drop("_p")


def active(frames: DataFrame, selected: DataFrame, seq: str, key: str) -> DataFrame:
    """The selected frames of a sequence, or all if it has none selected."""
    marks = selected.select(seq, key).distinct().withColumn("_on", F.lit(1))
    w = Window.partitionBy(seq)
    return frames.join(marks, [seq, key], "left").withColumn("_any", F.max("_on").over(w)).filter("_any is null or _on = 1").drop("_on", "_any")


def selection_after(frames: DataFrame, selected: DataFrame, actions: DataFrame, seq: str, key: str) -> DataFrame:
    """The selection (seq, key) of each sequence after its action (``actions``: seq, action): ``all`` selects every frame,
    ``none`` clears, anything else, or no action, leaves the frames that were selected; ids without a frame drop out."""
    marks = selected.select(seq, key).distinct().withColumn("_on", F.lit(True))
    told = frames.select(seq, key).join(actions.select(seq, "action"), seq, "left").join(marks, [seq, key], "left")
    chosen = F.when(F.col("action") == "all", True).when(F.col("action") == "none", False).otherwise(F.coalesce("_on", F.lit(False)))
    return told.filter(chosen).select(seq, key)


def with_size(df: DataFrame, seq: str) -> DataFrame:
    return df.withColumn("n", F.count("*").over(Window.partitionBy(seq)))


def reversed_order(df: DataFrame, seq: str) -> DataFrame:
    return with_size(df, seq).withColumn("pos", F.col("n") - 1 - F.col("pos")).drop("n")


def ping_pong(df: DataFrame, seq: str, key: str) -> DataFrame:
    """The frames, then the inner ones backwards with new ids; sequences of one stay."""
    sized = with_size(df, seq).withColumn("_top", F.max(key).over(Window.partitionBy(seq)))
    back = sized.filter("pos > 0 and pos < n - 1").withColumn(key, F.col("_top") + F.col("n") - 1 - F.col("pos")).withColumn("pos", 2 * F.col("n") - 2 - F.col("pos"))
    return sized.unionByName(back).drop("n", "_top")


def duplicated(df: DataFrame, selected: DataFrame, seq: str, key: str) -> DataFrame:
    """Clones of the selected frames, appended in order under new ids."""
    sized = with_size(df, seq).withColumn("_top", F.max(key).over(Window.partitionBy(seq)))
    chosen = renumbered(sized.join(selected.select(seq, key).distinct(), [seq, key], "left_semi"), seq, [F.col("pos")], "_i")
    clones = chosen.withColumn(key, F.col("_top") + 1 + F.col("_i")).withColumn("pos", F.col("n") + F.col("_i")).drop("_i")
    return sized.unionByName(clones).drop("n", "_top")


def trimmed(df: DataFrame, seq: str, head: int, tail: int) -> DataFrame:
    """Without the first and last frames; a sequence that would be left with none stays whole."""
    sized = with_size(df, seq)
    whole = F.lit(head + tail) >= F.col("n")
    return sized.filter(whole | ((F.col("pos") >= head) & (F.col("pos") < F.col("n") - tail))).withColumn("pos", F.when(whole, F.col("pos")).otherwise(F.col("pos") - head)).drop("n")


def moved(pos: Column, source: int, target: int) -> Column:
    """New position when the frame at ``source`` is taken out and put in at ``target``."""
    if source == target:
        return pos
    low, high, step = (source, target, -1) if source < target else (target, source, 1)
    return F.when(pos == source, F.lit(target)).when(pos.between(low, high), pos + step).otherwise(pos).cast("bigint")


def swapped(pos: Column, at: int) -> Column:
    """New position when a frame and the one after it change places."""
    return F.when(pos == at, pos + 1).when(pos == at + 1, pos - 1).otherwise(pos)


def cyclic(pos: Column, step: int, n: Column) -> Column:
    return F.pmod(pos + step, n)


def clamped_step(pos: Column, step: int, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, pos + step))


def grid(df: DataFrame, seq: str, columns: int | None = None) -> DataFrame:
    """(…, cols, rows, grid_col, grid_row): row-major cells; a square-like grid by default."""
    sized = with_size(df, seq)
    cols = F.lit(columns).cast("bigint") if columns else F.ceil(F.sqrt("n")).cast("bigint")
    return sized.withColumn("cols", cols).withColumn("rows", F.ceil(F.col("n") / F.col("cols")).cast("bigint")).withColumn("grid_col", F.col("pos") % F.col("cols")).withColumn("grid_row", F.floor(F.col("pos") / F.col("cols")).cast("bigint")).drop("n")


def history(snapshots: DataFrame, frame: str, version: str, cap: Column) -> DataFrame:
    """The newest ``cap`` snapshots of each frame."""
    w = Window.partitionBy(frame).orderBy(F.col(version).desc())
    return snapshots.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def history_cap(snapshot_bytes: Column, budget: int = 20 * 1024 * 1024, least: int = 10) -> Column:
    return F.greatest(F.lit(least), F.floor(F.lit(budget) / snapshot_bytes)).cast("bigint")


def after_quiet(events: DataFrame, key: str, ts: str, value: str, gap: str) -> DataFrame:
    """Extension: the last value of each burst, a burst ending with a pause of ``gap``."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias("last_ts")).drop("w")


def looked_up(order: DataFrame, frames: DataFrame, seq: str, key: str) -> DataFrame:
    """Frames in the order given; ids without a frame are dropped."""
    return order.join(frames, [seq, key])


def restored(frames: DataFrame, backup: DataFrame, seq: str, key: str, columns: list[str]) -> DataFrame:
    """Frames with the backup's columns where it has the frame, nulls too."""
    old = backup.select(seq, key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = frames.join(old, [seq, key], "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in frames.columns))


def extracted(frames: DataFrame, seq: str, pos: str, signature: str, similarity: float) -> DataFrame:
    """Frames that stay at a similarity of 0 to 100 percent (0: all). ``frame_id`` counts every
    sampled frame, so ids skip those that were dropped."""
    frames = renumbered(frames, seq, [F.col(pos)], "frame_id")
    if similarity > 0:
        width = F.size(signature)
        scaled = frames.withColumn("_s", F.transform(signature, lambda x: x / width))
        frames = frames.join(kept_frames(scaled, seq, pos, "_s", (100 - similarity) / 2), [seq, pos], "left_semi")
    return frames


def added(df: DataFrame, seq: str, key: str) -> DataFrame:
    """One new frame at the end of each sequence, with an id of its own."""
    new = df.groupBy(seq).agg((F.max(key) + 1).alias(key), (F.max("pos") + 1).alias("pos"))
    return df.select(seq, key, "pos").unionByName(new)


def removed(df: DataFrame, selected: DataFrame, seq: str, key: str) -> DataFrame:
    """Without the selected frames, renumbered. A sequence keeps one frame at least: where all
    are selected the first stays."""
    marks = selected.select(seq, key).distinct().withColumn("_off", F.lit(True))
    w = Window.partitionBy(seq)
    out = df.join(marks, [seq, key], "left").withColumn("_left", F.count_if(F.col("_off").isNull()).over(w))
    stay = out.filter(F.col("_off").isNull() | ((F.col("_left") == 0) & (F.col("pos") == 0))).drop("_off", "_left")
    return renumbered(stay, seq, [F.col("pos")])


def undo_redo(log: DataFrame, frame: str, order: list[str], action: str, snapshot: str, cap: int) -> DataFrame:
    """(frame, shown, undos, redos): what each frame shows after its log of ``push`` (of a snapshot,
    a bigint), ``undo`` and ``redo``. At most ``cap`` snapshots can be undone, the oldest go first; a push clears
    what could be redone; an action that has nothing to act on does nothing. Rows that tie in ``order`` are taken
    by action and snapshot. An ordered fold: one task reads
    a frame's log in order and holds at most the snapshots of one frame that can be undone or redone."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shown, back, ahead, out = None, None, deque(maxlen=cap), [], []
        for b in batches:
            for f, a, x in zip(*(c.to_pylist() for c in b.columns[:3])):
                if now is None or f != now[0]:
                    if now is not None:
                        out.append((now[0], shown, len(back), len(ahead)))
                    now, shown, back, ahead = (f,), None, deque(maxlen=cap), []
                if a == "push":
                    if shown is not None:
                        back.append(shown)  # the oldest goes when the stack is full
                    ahead, shown = [], x
                elif a == "undo" and back:
                    ahead.append(shown)
                    shown = back.pop()
                elif a == "redo" and ahead:
                    back.append(shown)
                    shown = ahead.pop()
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if now is not None:
            out.append((now[0], shown, len(back), len(ahead)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names, kinds = [frame, "shown", "undos", "redos"], [pa.int64()] * 4
    rows = log.select(F.col(frame).cast("bigint").alias(frame), action, F.col(snapshot).cast("bigint").alias("_x"), *order)
    return rows.repartition(frame).sortWithinPartitions(frame, *order, action, "_x").mapInArrow(fold, f"{frame} bigint, shown bigint, undos bigint, redos bigint")


def layer_added(layers: Column, layer: Column) -> Column:
    """The stack with a layer on top."""
    return F.concat(layers, F.array(layer))


def layer_removed(layers: Column, at: int) -> Column:
    """The stack without its layer at ``at`` (from 0); the last one left stays."""
    return F.when(F.size(layers) > 1, F.filter(layers, lambda x, i: i != at)).otherwise(layers)
