"""Quality classifier: Naive Bayes support vectors (operator 2).

Features are indicators of n-grams (``ORDER`` words at most) of two readings of a text: its words
in lower case, and its words' shapes (letters by case, digits and marks, runs shortened, and
whether a word repeats the one before), hashed into ``BUCKETS``. Each indicator is scaled by the
log ratio of its smoothed counts in the two classes; a linear model with hinge loss is fitted to
the scaled vectors by dual coordinate descent; a sigmoid over held-out margins gives the score.

The model is fitted in one task on at most ``SAMPLE`` labelled documents (whole texts), a
documented bound; a row of the sample is at most ``BUCKETS`` buckets of 4 bytes however long its
text. The model is ``BUCKETS`` numbers (1 MB), which is what is broadcast. Scoring is one pass
over the texts without a shuffle.

Null and empty texts have no features and the score of the intercept; very long texts are read
whole. Null ids aren't held out and not learned from. Labels, lang, source and doc_id are no
input of a score, and no other column is read, so clashing names do no harm. If the labels hold
fewer than two classes the score is their smoothed mean; without labels it is 0.5. Rows of equal
texts score alike, and repeated rows come back as often. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, shipped, stored, text_of
from .labelled import training_rows

BUCKETS = 1 << 18
SAMPLE = 8000
COST = 1.0
EPOCHS = 12
#: Share of the sample that the sigmoid is fitted on.
CALIBRATION = 0.25
CACHE = 300_000
CUT = 0.3

RUNS = re.compile(r"(.)\1+")
KEPT: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    marked = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c for c in word)
    return RUNS.sub(r"\1\1", marked)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its shape."""
    found = list(map(KEPT.get, words))
    if None in found:
        for i, f in enumerate(found):
            if f is None:
                w = words[i]
                f = found[i] = KEPT.get(w) or (xxhash.xxh64_intdigest(w.lower().encode(), 1), xxhash.xxh64_intdigest(shape(w).encode(), 2))
                if len(w) <= 64:
                    if len(KEPT) >= CACHE:
                        KEPT.clear()
                    KEPT[w] = f
    pairs = np.array(found, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


MIX = np.uint64(0x9E3779B97F4A7C15)
SAME = np.uint64(0xD6E8FEB86659FD93)


def features(text: str) -> np.ndarray:
    """The buckets of the text's n-grams, sorted, each once."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32)
    word, form = codes(words)
    form = form.copy()
    form[1:][word[1:] == word[:-1]] ^= SAME
    out = [word, (word[:-1] * MIX) ^ word[1:], form]
    gram = form
    for k in (1, 2):
        gram = gram[:-1] * MIX ^ form[k:]
        out.append(gram + np.uint64(k))
    return np.unique(((np.concatenate(out) * MIX) >> np.uint64(46)).astype(np.int32))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's smoothed share in class 1 to that in class 0; zero for a bucket
    that no document has, as it tells nothing."""
    n = [np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y == k)] or [np.empty(0, np.int32)]), minlength=BUCKETS) for k in (0, 1)]
    p = [(1.0 + x) / (2.0 + (y == k).sum()) for k, x in enumerate(n)]
    return np.where(n[0] + n[1] > 0, np.log(p[1] / p[0]), 0.0)


def unit(buckets: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the scaled vector, of length 1."""
    v = r[buckets]
    use = v != 0
    v = v[use]
    return buckets[use], v / max(float(np.sqrt(v @ v)), 1e-9)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-loss linear SVM by dual coordinate descent (Hsieh et al.
    2008): alpha_i moves to the optimum of its own coordinate within 0..cost_i. The two classes
    weigh alike."""
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    sign = np.where(y == 1, 1.0, -1.0)
    upper = cost * np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    square = np.array([v @ v + 1.0 for _, v in rows])  # one more for the intercept
    turn = np.random.default_rng(7)
    for _ in range(epochs):
        for i in turn.permutation(len(y)):
            at, v = rows[i]
            slope = sign[i] * (w[at] @ v + b) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                w[at] += step * v
                b += step
                alpha[i] = new
    return w, b


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton's method on smoothed targets (Platt)."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model as one row: weights of the buckets (ratio included), of the ratios alone for the
    vector's length, the intercept and the sigmoid."""
    pdf = pdf.sort_values(["doc_id"])
    rows, y, fold = [np.frombuffer(f, np.int32) for f in pdf["features"]], pdf["y"].to_numpy(), pdf["fold"].to_numpy()
    fit = fold >= CALIBRATION
    if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
        fit = np.ones(len(y), bool)
    if len(set(y)) < 2:
        mean = (y.sum() + 1) / (len(y) + 2)
        return pd.DataFrame([{"r": np.zeros(BUCKETS, np.float32).tobytes(), "w": np.zeros(BUCKETS, np.float32).tobytes(), "b": 0.0, "slope": 1.0, "shift": float(np.log(mean / (1 - mean)))}])
    r = ratios([x for x, f in zip(rows, fit) if f], y[fit])
    scaled = [unit(x, r) for x in rows]
    w, b = descend([s for s, f in zip(scaled, fit) if f], y[fit])
    margin = np.array([w[at] @ v + b for at, v in scaled])
    held = ~fit if (~fit).any() else fit
    slope, shift = sigmoid_fit(margin[held], y[held])
    return pd.DataFrame([{"r": r.astype(np.float32).tobytes(), "w": w.astype(np.float32).tobytes(), "b": float(b), "slope": slope, "shift": shift}])


def model(documents: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """Fits on the sample, in one task; None without labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([features(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "y", "fold", "features"])

    rows = training_rows(documents, labels, label, SAMPLE).select(F.col("doc_id").cast("bigint"), "text", "y", "fold")
    sample = stored(rows.mapInArrow(run, "doc_id bigint, y int, fold double, features binary"), "features")
    got = sample.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "r binary, w binary, b double, slope double, shift double").collect()
    return got[0].asDict() if got else None


def scored(documents: DataFrame, labels: DataFrame, label: str = "quality", rest: int = 0, divisor: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``documents``."""
    spark = shipped(documents.sparkSession)
    shared = spark.sparkContext.broadcast(model(documents, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        r, w = (np.frombuffer(m[k], np.float32).astype(np.float64) for k in ("r", "w")) if m else (None, None)
        for b in batches:
            out = []
            for t in b.column(2):
                if m is None:
                    out.append(0.5)
                    continue
                at, v = unit(features(t.as_py()), r)
                x = m["slope"] * (float(w[at] @ v) + m["b"]) + m["shift"]
                out.append(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    held = F.coalesce(remainder(documents["doc_id"], divisor) == rest, F.lit(False))
    got = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), text_of(documents).alias("text")).mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
