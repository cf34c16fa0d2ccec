"""Ordered frames: embeddings are frames (label: sequence, vec_id: id and order, embedding:
signature), conversations are sequences of turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.catalog import query, table
from tessel.operators import sequences as Q

#: The SQL's frames: position within the label.
FRAMES = "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings"


def frames(spark, d, *more):
    return Q.renumbered(table(spark, d, "embeddings").select("label", "vec_id", *more), "label", [F.col("vec_id")])


@query("""SELECT user_id, CAST(i AS INTEGER) AS idx, i * CAST(0.1 AS DOUBLE) AS ts FROM (SELECT user_id, duration, unnest(range(0, CAST(ceil(duration / CAST(0.1 AS DOUBLE)) AS BIGINT))) AS i
FROM (SELECT user_id, (user_id % 20) / 4.0 + 0.05 AS duration FROM (SELECT DISTINCT user_id FROM events))) WHERE i * CAST(0.1 AS DOUBLE) < duration""")
def sample_times(spark, d):
    v = table(spark, d, "events").select("user_id").distinct().withColumn("duration", F.col("user_id") % 20 / 4.0 + 0.05)
    return Q.sample_times(v, 3).select("user_id", "idx", "ts")


@query("""SELECT user_id, CAST(i AS INTEGER) AS idx, i * duration / n AS ts FROM (SELECT user_id, duration, n, unnest(range(0, n)) AS i
FROM (SELECT user_id, duration, least(12, greatest(1, CAST(floor(duration * 30) AS INTEGER))) AS n FROM (SELECT DISTINCT user_id, (user_id % 20) / 40.0 AS duration FROM events)))""")
def spread_times(spark, d):
    v = table(spark, d, "events").select("user_id").distinct().withColumn("duration", F.col("user_id") % 20 / 40.0)
    return Q.spread_times(v, 12).select("user_id", "idx", "ts")


KEPT = """WITH RECURSIVE e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
f AS (SELECT label, vec_id, i, v AS ref, true AS keep FROM e WHERE i = 1
UNION ALL SELECT label, vec_id, i, CASE WHEN far >= CAST({least} AS DOUBLE) THEN v ELSE ref END, far >= CAST({least} AS DOUBLE) FROM
(SELECT e.label, e.vec_id, e.i, e.v, f.ref, list_sum(list_transform(range(1, len(e.v) + 1), lambda k: abs(e.v[k] - f.ref[k]))) AS far FROM f JOIN e ON e.label = f.label AND e.i = f.i + 1))
SELECT label, vec_id FROM f WHERE keep"""


@query(KEPT.format(least=9.0))
def kept_frames(spark, d):
    return Q.kept_frames(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 9.0)


@query(f"WITH k AS ({KEPT.format(least=8.0)}) SELECT e.label, count(*) - count(k.vec_id) AS removed, count(k.vec_id) AS remaining FROM embeddings e LEFT JOIN k USING (label, vec_id) GROUP BY e.label")
def dedup_stats(spark, d):
    e = table(spark, d, "embeddings")
    kept = Q.kept_frames(e, "label", "vec_id", "embedding", 8.0).groupBy("label").agg(F.count("*").alias("remaining"))
    return e.groupBy("label").agg(F.count("*").alias("n")).join(kept, "label").select("label", (F.col("n") - F.col("remaining")).alias("removed"), "remaining")


@query("""SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 3 = 0 THEN -vec_id END NULLS LAST, vec_id) - 1 AS pos FROM embeddings""")
def order_reconcile(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id")
    known = Q.renumbered(e.filter("vec_id % 3 = 0"), "label", [F.col("vec_id").desc()])
    return Q.reconciled(e, known, "label", "vec_id").select("label", "vec_id", "pos")


@query(f"SELECT label, vec_id, n - 1 - pos AS pos FROM ({FRAMES})")
def reverse_order(spark, d):
    return Q.reversed_order(frames(spark, d), "label").select("label", "vec_id", "pos")


@query(f"""WITH f AS ({FRAMES}), t AS (SELECT *, max(vec_id) OVER (PARTITION BY label) AS top FROM f) SELECT label, vec_id, pos FROM t
UNION ALL SELECT label, top + n - 1 - pos, 2 * n - 2 - pos FROM t WHERE pos > 0 AND pos < n - 1""")
def ping_pong(spark, d):
    return Q.ping_pong(frames(spark, d), "label", "vec_id").select("label", "vec_id", "pos")


@query(f"""WITH f AS (SELECT *, max(vec_id) OVER (PARTITION BY label) AS top FROM ({FRAMES})) SELECT label, vec_id, pos FROM f
UNION ALL SELECT label, top + row_number() OVER (PARTITION BY label ORDER BY pos), n + row_number() OVER (PARTITION BY label ORDER BY pos) - 1 FROM f WHERE vec_id % 5 = 0""")
def duplicate_selected(spark, d):
    f = frames(spark, d)
    return Q.duplicated(f, f.filter("vec_id % 5 = 0"), "label", "vec_id").select("label", "vec_id", "pos")


@query(f"SELECT label, vec_id, CASE WHEN 45 >= n THEN pos ELSE pos - 20 END AS pos FROM ({FRAMES}) WHERE 45 >= n OR (pos >= 20 AND pos < n - 25)")
def trim_ends(spark, d):
    return Q.trimmed(frames(spark, d), "label", 20, 25).select("label", "vec_id", "pos")


@query(f"SELECT label, vec_id, CASE WHEN pos = 2 THEN 5 WHEN pos BETWEEN 2 AND 5 THEN pos - 1 ELSE pos END AS forward, CASE WHEN pos = 6 THEN 1 WHEN pos BETWEEN 1 AND 6 THEN pos + 1 ELSE pos END AS back, CASE pos WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE pos END AS swapped FROM ({FRAMES})")
def move_frames(spark, d):
    p = F.col("pos")
    return frames(spark, d).select("label", "vec_id", Q.moved(p, 2, 5).alias("forward"), Q.moved(p, 6, 1).alias("back"), Q.swapped(p, 3).alias("swapped"))


@query(f"SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS pos FROM ({FRAMES}) WHERE pos % 4 <> 1")
def delete_frames(spark, d):
    return Q.renumbered(frames(spark, d).filter("pos % 4 <> 1"), "label", [F.col("pos")]).select("label", "vec_id", "pos")


@query(f"SELECT label, vec_id, (pos + 1) % n AS next, (pos - 1 + n) % n AS previous, greatest(0, pos - 1) AS back, least(n - 1, pos + 1) AS on FROM ({FRAMES})".replace(" AS on ", ' AS "on" '))
def step_frames(spark, d):
    p, n = F.col("pos"), F.col("n")
    f = Q.with_size(frames(spark, d), "label")
    return f.select("label", "vec_id", Q.cyclic(p, 1, n).alias("next"), Q.cyclic(p, -1, n).alias("previous"), Q.clamped_step(p, -1, n).alias("back"), Q.clamped_step(p, 1, n).alias("on"))


@query(f"""SELECT label, vec_id, cols, CAST(ceil(n / cols) AS BIGINT) AS rows, pos % cols AS grid_col, pos // cols AS grid_row FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS cols FROM ({FRAMES}))""")
def grid_layout(spark, d):
    return Q.grid(frames(spark, d), "label").select("label", "vec_id", "cols", "rows", "grid_col", "grid_row")


@query("""SELECT conv_id, turn, (lead(text) OVER w IS NULL) AS newest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= greatest(3, floor(4000 / 1000))""")
def undo_history(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    kept = Q.history(c, "conv_id", "turn", Q.history_cap(F.lit(1000), budget=4000, least=3))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return kept.join(last, "conv_id").select("conv_id", "turn", (F.col("turn") == F.col("last")).alias("newest"))


@query("SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS seq FROM conversations GROUP BY conv_id")
def latest_request(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("seq"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, arg_max(event_id, ts) AS event_id FROM s GROUP BY user_id, burst""")
def last_after_quiet(spark, d):
    return Q.after_quiet(table(spark, d, "events"), "user_id", "ts", "event_id", "30 minutes").select("user_id", "event_id")


@query(f"""WITH f AS ({FRAMES}), g AS (SELECT label, vec_id, pos FROM f UNION ALL SELECT label, max(vec_id) + 1, max(pos) + 1 FROM f GROUP BY label)
SELECT label, vec_id, pos FROM g""")
def add_frames(spark, d):
    return Q.added(frames(spark, d), "label", "vec_id")


@query(f"""WITH f AS (SELECT *, label % 2 = 0 OR vec_id % 3 = 0 AS gone FROM ({FRAMES})), g AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY label) AS left_over FROM f)
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS pos FROM g WHERE NOT gone OR (left_over = 0 AND pos = 0)""")
def remove_frames(spark, d):
    f = frames(spark, d)
    return Q.removed(f, f.filter("label % 2 = 0 or vec_id % 3 = 0"), "label", "vec_id").select("label", "vec_id", "pos")


@query()
def undo_redo(spark, d):
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("push")
    log = table(spark, d, "events").withColumn("action", action)
    return Q.undo_redo(log, "user_id", ["ts", "event_id"], "action", "event_id", 10)


@query("SELECT label, vec_id FROM embeddings WHERE label % 3 = 1 OR (label % 3 = 2 AND vec_id % 4 = 0)")
def select_and_clear(spark, d):
    """Of three sequences one is cleared, one selected whole, and one left with every fourth frame."""
    e = table(spark, d, "embeddings").select("label", "vec_id")
    actions = e.select("label").distinct().withColumn("action", F.when(F.col("label") % 3 == 0, "none").when(F.col("label") % 3 == 1, "all"))
    return Q.selection_after(e, e.filter("vec_id % 4 = 0"), actions, "label", "vec_id")


LAYERS = "SELECT conv_id, list({'name': role || turn, 'visible': turn % 3 <> 0, 'opacity': 100 - turn} ORDER BY turn) AS layers FROM conversations GROUP BY conv_id"


@query(f"""SELECT conv_id, array_to_string(list_append(list_transform(layers, lambda l: l.name), 'new'), ' ') AS added, array_to_string(list_transform(layers[:1] || layers[3:], lambda l: l.name), ' ') AS removed, layers[2].name AS first_after_swap,
array_to_string(list_transform(layers, lambda l: l.name || ':' || (NOT l.visible) || ':' || greatest(0, l.opacity - 50)), ' ') AS edited FROM ({LAYERS}) WHERE len(layers) > 1""")
def layer_edits(spark, d):
    layer = F.struct(F.col("turn"), F.concat("role", F.col("turn").cast("string")).alias("name"), (F.col("turn") % 3 != 0).alias("visible"), (100 - F.col("turn")).alias("opacity"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(layer)).alias("layers")).filter(F.size("layers") > 1)
    swapped = F.concat(F.array(F.get("layers", F.lit(1)), F.get("layers", F.lit(0))), F.slice("layers", 3, 1 << 20))
    new = F.struct(F.lit(999).cast("bigint").alias("turn"), F.lit("new").alias("name"), F.lit(True).alias("visible"), F.lit(100).cast("bigint").alias("opacity"))
    named = lambda layers: F.concat_ws(" ", F.transform(layers, lambda x: x["name"]))
    text = lambda x: F.concat_ws(":", x["name"], (~x["visible"]).cast("string"), F.greatest(F.lit(0), x["opacity"] - 50).cast("string"))
    return rows.select("conv_id", named(Q.layer_added(F.col("layers"), new)).alias("added"), named(Q.layer_removed(F.col("layers"), 1)).alias("removed"), F.get(swapped, F.lit(0))["name"].alias("first_after_swap"), F.concat_ws(" ", F.transform("layers", text)).alias("edited"))


@query(f"SELECT o.label, o.vec_id, o.pos FROM (SELECT label, vec_id + 3 AS vec_id, pos FROM ({FRAMES})) o JOIN embeddings e ON e.label = o.label AND e.vec_id = o.vec_id")
def order_lookup(spark, d):
    order = frames(spark, d).withColumn("vec_id", F.col("vec_id") + 3)
    return Q.looked_up(order, table(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id").select("label", "vec_id", "pos")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'before' ELSE role END AS role FROM conversations")
def backup_overlay(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return Q.restored(c, c.filter("turn % 2 = 0").withColumn("role", F.lit("before")), "conv_id", "turn", ["role"])


EXTRACTED = KEPT.format(least=0.14).replace("abs(e.v[k] - f.ref[k])", "abs(e.v[k] / len(e.v) - f.ref[k] / len(e.v))")


@query(EXTRACTED.replace("WITH RECURSIVE", "WITH RECURSIVE k AS (WITH RECURSIVE", 1) + f") SELECT label, vec_id, pos AS frame_id FROM k JOIN ({FRAMES}) USING (label, vec_id)")
def extract_frames(spark, d):
    return Q.extracted(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 99.72).select("label", "vec_id", "frame_id")
