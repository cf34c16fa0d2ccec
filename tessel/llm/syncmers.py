"""Document fingerprints from closed syncmers (operator 1). DataFrame functions only.

A text is a row of tokens, by one rule at every length: words between ASCII spaces, but each
character of a script written without spaces, and each character of a word beyond its first
``WORD``, is a token of its own. Each token has a hash. A window of ``K`` tokens is a closed
syncmer if the smallest of its inner substrings of ``S`` tokens lies at one of its edges. That
depends on the window alone, not on what surrounds it, so shared passages give shared anchors
wherever they stand. A text with fewer tokens than K has one anchor, all of it.

The fingerprint is the ``SKETCH`` smallest distinct anchor hashes, 8 hex digits each: a bottom
sketch, whose share of common values among the smallest of the union estimates the Jaccard
likeness J of all anchors (1 for equal texts; 0 if one is empty and the other isn't). Its
standard error is sqrt(J (1 - J) / SKETCH), 0.05 at most, and 0 up to SKETCH anchors.

Positions serve two ends: ``in_place`` is the share of a text's anchors that the edited text has
at the same place, and ``passages`` finds the stretches that pairs of texts share, as runs of
equal anchors at one shift.

The next document by descending doc_id needs no single ordered task: ids are cut into ranges by
approximate quantiles (of ``RANGE`` rows, or a ``RANGES``-th of all), each range is ordered in its
task, and the first row of each range is told to the range before it. Rows of one id lie in one
range and are ordered by text.

Null texts count as empty, with an empty fingerprint; very long texts are read whole. Rows with
null ids come last, dealt into ranges by a hash of their texts, and are rows like others. If there
is one row only, it follows itself. Repeated ids or rows are kept, ordered by their texts; rows
that tie are equal, so either order gives one result. Extra columns aren't read, so clashing names
do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K, S = 4, 1
SKETCH = 96
#: Rows of a range that one task orders, on average, while there are fewer than RANGES ranges.
RANGE = 4_000
RANGES = 50_000
#: Characters of a word that are one token.
WORD = 24
#: Scripts written without spaces.
UNSPACED = "".join(f"\\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
SPACE = "\\x20\\x09-\\x0D"
TOKEN = f"[{UNSPACED}]|(?<=[^{SPACE}{UNSPACED}]{{{WORD}}})[^{SPACE}{UNSPACED}]|[^{SPACE}{UNSPACED}]{{1,{WORD}}}"


def folded(a: Column, b: Column) -> Column:
    """A hash of two hashes, whose order matters: stays in codegen and within 64 bits."""
    return F.xxhash64(a, b)


def syncmers(hashes: Column, k: int, s: int) -> Column:
    """Array of (at, hash) of the closed syncmers among token hashes."""
    n = F.size(hashes)
    inner = hashes
    for i in range(1, s):  # hashes of s tokens in a row
        inner = F.zip_with(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))), F.slice(hashes, i + 1, F.greatest(n - i, F.lit(0))), folded)
    width = k - s + 1  # inner substrings of a window
    m = F.greatest(n - k + 1, F.lit(0))
    part = [F.slice(inner, i + 1, m) for i in range(width)]
    # one pass over the windows: their inner hashes side by side
    windows = F.arrays_zip(*(p.alias(f"h{i}") for i, p in enumerate(part)))
    between = lambda w: F.least(*(w[f"h{i}"] for i in range(1, width - 1)))
    edge = lambda w: F.least(w["h0"], w[f"h{width - 1}"])
    # s tokens at every s-th place and at the end cover the window
    covers = sorted({*range(0, width, s), width - 1})
    made = F.transform(windows, lambda w, i: F.struct(i.alias("at"), F.when(edge(w) <= between(w), F.xxhash64(*(w[f"h{c}"] for c in covers))).alias("hash")))
    found = F.filter(made, lambda x: x["hash"].isNotNull())
    return F.when(n >= k, found).when(n > 0, F.array(F.struct(F.lit(0).alias("at"), F.aggregate(hashes, F.lit(k).cast("bigint"), folded).alias("hash")))).otherwise(F.filter(made, lambda x: F.lit(False)))


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens. Only a word that is long, or whose bytes allow for a character of
    three, can be more than one token, so only these are searched for tokens."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[^{SPACE}]+"), F.lit(0))
    several = lambda w: (F.char_length(w) > WORD) | (F.octet_length(w) - F.char_length(w) >= 2)
    hashes = lambda w: F.transform(F.regexp_extract_all(w, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return F.flatten(F.transform(words, lambda w: F.when(several(w), hashes(w)).otherwise(F.array(F.xxhash64(w)))))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the anchors of column ``text``: array of (at, hash)."""
    return df.withColumn(f"_{out}_tokens", token_hashes(F.col(text))).withColumn(out, syncmers(F.col(f"_{out}_tokens"), K, S)).drop(f"_{out}_tokens")


def placed(anchors: Column) -> Column:
    """A hash of each anchor and its place."""
    return F.transform(anchors, lambda x: F.xxhash64(x["at"], x["hash"]))


def in_place(anchors: Column, others: Column) -> Column:
    """Share of distinct anchors that the other text has at the same place; 1 without anchors."""
    own = F.size(anchors)
    return F.when(own > 0, F.size(F.array_intersect(placed(anchors), placed(others))) / own).otherwise(F.lit(1.0))


def passages(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shift, start, end, anchors): the stretches that texts share. ``pairs``: a, b (ids)
    and anchors_a, anchors_b (as ``with_anchors`` makes them). Equal anchors are matched by hash;
    a run holds those whose places differ by one ``shift`` and follow each other within ``K``
    tokens. ``start`` and ``end``: places in a of its first and last anchor; runs with fewer than
    ``least`` anchors are left out. Of an anchor that texts repeat the n-th uses are matched, so
    repeats don't multiply."""
    left = pairs.select("a", "b", F.inline("anchors_a").alias("at_a", "hash"))
    right = pairs.select("a", "b", F.inline("anchors_b").alias("at_b", "hash"))
    sides = left.groupBy("a", "b", "hash").agg(F.sort_array(F.collect_list("at_a")).alias("in_a")).join(right.groupBy("a", "b", "hash").agg(F.sort_array(F.collect_list("at_b")).alias("in_b")), ["a", "b", "hash"])
    # the n-th use in a with the n-th use in b
    matched = sides.select("a", "b", F.inline(F.slice(F.arrays_zip("in_a", "in_b"), F.lit(1), F.least(F.size("in_a"), F.size("in_b")))))
    matched = matched.withColumn("shift", F.col("in_b") - F.col("in_a"))
    along = Window.partitionBy("a", "b", "shift").orderBy("in_a")
    breaks = F.when(F.col("in_a") - F.lag("in_a").over(along) > K, 1).otherwise(0)
    runs = matched.withColumn("new", breaks).withColumn("run", F.sum("new").over(along))
    found = runs.groupBy("a", "b", "shift", "run").agg(F.min("in_a").alias("start"), F.max("in_a").alias("end"), F.count("*").alias("anchors"))
    return found.filter(F.col("anchors") >= least).drop("run")


def sketch(anchors: Column) -> Column:
    """The smallest distinct anchor hashes, their upper 32 bits each, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors, lambda x: F.shiftright(x["hash"], 32).cast("int")))), 1, SKETCH)


def digits(part: Column) -> Column:
    """A sketch as text: 8 hex digits for each hash."""
    return F.concat_ws("", F.transform(part, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) > 0, both / F.size(union)).otherwise(F.lit(1.0))


def range_number(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below the key, by binary search; null for null."""
    if not bounds:
        return F.when(key.isNotNull(), F.lit(0))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    table = F.array(*map(F.lit, bounds))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) < key, F.lit(False)), at + step).otherwise(at))
    return F.when(key.isNotNull(), found)


def with_next(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text) with sketch, and next_text and next_sketch of the row that follows
    by descending doc_id (after the last: the first)."""
    rows, none = df.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = max(1, min(RANGES, (rows - none) // RANGE))
    bounds = df.select(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 100_000).alias("b")).first()["b"] if cuts > 1 else []
    without = -1 - F.pmod(F.xxhash64("text"), F.lit(max(1, min(RANGES, none // RANGE)))).cast("int")
    df = df.withColumn("_range", F.coalesce(range_number(F.col("doc_id"), sorted(set(bounds or []))), without))
    # anchors are as large as the text, so they aren't shuffled with it
    sketched = lambda x: with_anchors(x, "text", "_a").withColumn("sketch", sketch(F.col("_a"))).drop("_a")
    # the first row of each range: its largest id, a table of at most 2 RANGES numbers
    tops = stored(df.groupBy("_range").agg(F.max("doc_id").alias("_top")), "tops")
    heads = df.join(F.broadcast(tops.withColumnRenamed("_range", "_of")), (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    firsts = heads.groupBy("_range").agg(F.max("text").alias("text"))
    ranges = [r["_range"] for r in tops.select("_range").orderBy(F.desc("_range")).collect()]
    link = df.sparkSession.createDataFrame([(ranges[(i + 1) % len(ranges)], r) for i, r in enumerate(ranges)], "_range int, _before int")
    seam = sketched(firsts.join(F.broadcast(link), "_range")).select(F.col("_before").alias("_range"), F.struct("text", "sketch").alias("_seam"))
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    ahead = F.lead(F.struct("text", "sketch")).over(order)
    whole = sketched(df).withColumn("_next", ahead).join(stored(seam, "seam"), "_range", "left").withColumn("_next", F.coalesce("_next", "_seam"))
    return whole.withColumn("next_text", F.col("_next.text")).withColumn("next_sketch", F.col("_next.sketch")).drop("_next", "_seam", "_range")


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    in_place."""
    base = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    linked = with_next(base).withColumn("n_chars", F.char_length("text").cast("bigint"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substring("next_text", F.lit(1), tail))
    done = with_anchors(with_anchors(linked.withColumn("edited", edited), "edited", "_e"), "text", "anchors").withColumn("edited_sketch", sketch(F.col("_e"))).withColumn("in_place", in_place(F.col("anchors"), F.col("_e")))
    return done.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), digits(F.col("sketch")).alias("fingerprint"), digits(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "in_place")
