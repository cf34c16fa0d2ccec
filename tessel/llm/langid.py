"""Language identification by nearest centroid (operator 10).

A text is the vector of its letter trigrams (hashed into ``BUCKETS``), weighted by log counts
and inverse document frequency and normalised. Each language has up to ``CENTROIDS`` centroids,
found by spherical k-means, as its texts differ in kind; starts are drawn as in k-means++, the
best of ``TRIES`` counts, and a cluster with less than ``SMALL`` of the sample is given up, so an
odd text doesn't become a centroid. The nearest centroid by cosine gives the language; a text
whose nearest centroid is farther than ``REACH`` times what all but ``OUTSIDE`` of the language's
own training texts need is rejected.

Document frequencies are counted over all training texts, summed in each task. k-means is fitted
on at most ``SAMPLE`` texts of a language, a documented bound, those whose id and text have the
smallest hashes, each language in a task of its own. Every value of lang is learned. The model (0.1 MB
for each) is broadcast in parts of about ``LANGUAGES`` values; texts are compared with one part after
the other, carrying the best so far.

A text that is null or has no letter is ``und`` with score 0; in ``identified`` it isn't rejected
as too far, and ``accepted`` leaves it out. Texts are read whole, however long. Null languages and
null ids aren't learned from. Without any training text all others are ``und`` too. Ties go to the
language that sorts first. Repeated rows are counted and returned as often as they occur. Extra
columns may have any name; ``accepted`` returns them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, place, remainder, shipped, stored, with_looked_up

BUCKETS = 8192
CENTROIDS = 3
ROUNDS = 10
TRIES = 4
#: Least share of the sample that a cluster needs.
SMALL = 0.02
#: Texts of a language that k-means sees at most.
SAMPLE = 1000
#: Languages of one part of the model, about.
LANGUAGES = 1000
#: Share of a language's training texts beyond the reach that calibrates rejection.
OUTSIDE = 0.01
REACH = 1.25
AT_ONCE = 1 << 20
UND = "und"
#: What is found for a text; second: the score of the next language.
FOUND = "lang_pred string, score double, rejected boolean, second double"


def letters() -> np.ndarray:
    """Each code point's lower case letter, or 0 for all that isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


LETTERS: list[np.ndarray] = []


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts by bucket of trigrams of letters and word limits; None without a letter."""
    if not LETTERS:
        LETTERS.append(letters())
    code = LETTERS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not code.any():
        return None
    code = np.concatenate([[0], code, [0]]).astype(np.uint32)
    keep = np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])  # one limit between words
    code = code[keep].astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(code) - 2), AT_ONCE):
        c = code[at : at + AT_ONCE + 2]
        if len(c) < 3:
            continue
        h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return (v / max(np.sqrt(v @ v), 1e-12)).astype(np.float32)


def packed(counts: np.ndarray) -> bytes:
    """Numbers of the buckets in use, and their counts."""
    at = np.flatnonzero(counts)
    return np.concatenate([at, counts[at]]).astype(np.int32).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    at, n = np.frombuffer(raw, np.int32).reshape(2, -1)
    out = np.zeros(BUCKETS, np.int64)
    out[at] = n
    return out


def frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency of each bucket over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if (c := trigram_counts(t.as_py())) is not None:
                    df += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, BUCKETS), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], ["bucket", "n"])

    rows = train.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    got = {r["bucket"]: r["n"] for r in rows}
    n = got.get(-1, 0)
    return np.log((1 + n) / (1 + np.array([got.get(i, 0) for i in range(BUCKETS)]))) + 1, n


def clustered(x: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Centres by spherical k-means: of ``TRIES`` runs the one whose vectors lie nearest. Starts
    are drawn in proportion to the distance from those before. Clusters with less than ``SMALL``
    of the vectors are given up and their vectors dealt to the others."""
    best, best_sum = None, -np.inf
    for seed in range(TRIES):
        draw = np.random.default_rng(seed)
        starts = [int(draw.integers(len(x)))]
        while len(starts) < min(k, len(x)):
            apart = np.maximum(1 - (x @ x[starts].T).max(axis=1), 0).astype(np.float64)
            if apart.sum() < 1e-6:
                break
            starts.append(int(draw.choice(len(x), p=apart / apart.sum())))
        c = x[starts]
        for _ in range(ROUNDS):
            size = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
            if len(c) > 1 and size.min() < SMALL * len(x):
                c = np.delete(c, size.argmin(), axis=0)
            near = (x @ c.T).argmax(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        if (got := float((x @ c.T).max(axis=1).sum())) > best_sum:
            best, best_sum = c, got
    return best


def centroids(train: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, centroids binary, least): centroids and the least cosine that is accepted."""
    size = stored(train.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    total = size.agg(F.sum("docs")).first()[0] or 0
    lots = train.withColumn("lot", F.xxhash64("doc_id", "text"))
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order)) <= SAMPLE
    # where in the order of hashes the first SAMPLE rows of a language end: from the numbers of
    # rows in 512 stretches, so that no text and no row but these numbers is shuffled
    stretch = F.shiftright("lot", 55)  # -256 to 255
    counted = lots.groupBy("lang", stretch.alias("stretch")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    needed = counted.withColumn("before", before).filter(F.col("before") < SAMPLE)
    least = needed.groupBy("lang").agg(F.max("stretch").alias("last")).join(size, "lang")
    drawn = with_looked_up(lots, least, "lang", "docs", total).filter(stretch <= F.col("last"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [packed(c) if (c := trigram_counts(t.as_py())) is not None else None for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], ["doc_id", "lang", "lot", "counts"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lot", "doc_id"])
        x = np.stack([vector(unpacked(c), idf) for c in pdf["counts"]])
        c = clustered(x)
        least = 1 - REACH * (1 - float(np.quantile((x @ c.T).max(axis=1), OUTSIDE)))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centroids": [c.astype(np.float32).tobytes()], "least": [least]})

    # texts become counts where they are read, so a group holds at most SAMPLE rows of 64 kB
    rows = drawn.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "lot", "text").mapInArrow(counts, "doc_id bigint, lang string, lot bigint, counts binary")
    # repeats of one row share a hash: what exceeds SAMPLE is dropped, again before the shuffle
    kept = rows.filter("counts is not null").withColumn("in", first("lot", "doc_id")).filter("in").drop("in")
    return kept.groupBy("lang").applyInPandas(run, "lang string, centroids binary, least double")


def nearer(spark: SparkSession, part: list, idf: np.ndarray) -> Callable:
    """A function of texts and what was found for them so far (lang_pred, score, rejected, second):
    the same, with the languages of ``part`` (lang, centroids, least) considered too."""
    shared = spark.sparkContext.broadcast((part, idf))

    @F.pandas_udf(FOUND)
    def compared(texts: pd.Series, so_far: pd.DataFrame) -> pd.DataFrame:
        rows, idf = shared.value
        names = [r["lang"] for r in rows]
        each = [np.frombuffer(bytes(r["centroids"]), np.float32).reshape(-1, BUCKETS) for r in rows]
        start, matrix = np.cumsum([0, *(len(c) for c in each)])[:-1], np.concatenate(each)
        out = []
        for text, old in zip(texts, so_far.itertuples(index=False, name=None)):
            counts = trigram_counts(text) if text else None
            if counts is None:
                out.append((UND, 0.0, False, None))
                continue
            near = np.maximum.reduceat(matrix @ vector(counts, idf), start)
            k = int(near.argmax())
            score = float(near[k])
            others = float(np.delete(near, k).max()) if len(near) > 1 else None
            new = (names[k], score, bool(score < rows[k]["least"]), others)
            if old[0] != UND:
                best, other = (old, new) if (-old[1], old[0]) < (-score, names[k]) else (new, old)
                new = (*best[:3], max(x for x in (best[3], other[1]) if x is not None and x == x))
            out.append(new)
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected", "second"])

    return compared


def identified(df: DataFrame, keep: list[str] | None = None, rest: int = 2, divisor: int = 4, languages: int | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (doc_id if none are named) with held_out, lang_pred, score
    (cosine, 0 to 1), rejected and margin (to the next language). Only the text goes through Python, so
    columns of any type may be kept."""
    spark = shipped(df.sparkSession)
    part = remainder(df["doc_id"], divisor)
    train = df.filter((part != rest) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    idf, _ = frequencies(train)
    model = stored(centroids(train, idf), "centroids")
    parts = -(-model.count() // (languages or LANGUAGES))
    held = F.coalesce(part == rest, F.lit(False)).alias("held_out")
    rows = df.select(*(keep or ["doc_id"]), held, df["text"].alias("_text"), F.struct(F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"), F.lit(None).cast("double").alias("second")).alias("_found"))
    for i in range(parts):
        some = model.filter(F.pmod(F.xxhash64("lang"), F.lit(parts)) == i).collect()
        if some:
            rows = rows.withColumn("_found", nearer(spark, sorted(some, key=lambda r: r["lang"]), idf)("_text", "_found"))
    found = F.col("_found")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), found["score"])).alias("score")
    margin = found["score"] - F.coalesce(found["second"], F.lit(0.0))
    return rows.select(*(c for c in rows.columns if c not in ("_text", "_found")), found["lang_pred"].alias("lang_pred"), score, found["rejected"].alias("rejected"), margin.alias("margin"))


def accepted(df: DataFrame) -> DataFrame:
    """The rows of ``df`` whose language is told and near enough, with the same columns."""
    own = numbered(df)
    names = {f"_{n}": F.col(place(df, n)) for n in ("doc_id", "text", "lang")}
    rows = own.withColumns(names).select(*own.columns, *(F.col(n).alias(n[1:]) for n in names))
    return identified(rows, own.columns).filter((F.col("lang_pred") != UND) & ~F.col("rejected")).select(own.columns).toDF(*df.columns)
