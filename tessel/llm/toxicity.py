"""Toxicity: boosted trees over dense features, with isotonic calibration (operator 3).

Features of a text: densities of a fixed lexicon of insults and of a lexicon learned from the
labels, the closest and densest of their uses, uses near second-person words, rates of capitals,
marks and obfuscation (digits or signs within words, letters spelt apart, runs of one letter).

The learned lexicon holds words and word beginnings of 4 to 8 letters that labelled toxic texts
use far more often than others, once or (entries of their own) at least twice, by a likelihood
ratio beyond what chance gives among as many candidates. Its counts are summed in Spark over the
labelled sample, whose bound bounds it.

Trees and calibration are Spark's own (``pyspark.ml``), fitted on at most ``SAMPLE`` labelled
documents, a documented bound; words and trees are learned from one share of it, the calibration
from the other. Where one of the two shares lacks a class (a few labels), both are fitted on all of it, so
the calibration then sees what the trees were taught and is too sure. Scoring is one pass over the texts without a shuffle.

Null and empty texts have features of zero; very long texts and words are read whole, in time
that grows with their length. Null ids aren't held out and not learned from. Labels, lang, source
and doc_id are no input of a score. If the labels hold fewer than two classes the score is their
smoothed mean. Rows of equal texts score alike, and repeated rows come back as often. Extra
columns may have any name; ``accepted`` returns them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, place, remainder, shipped, stored, text_of
from .labelled import training_rows

SAMPLE = 20_000
#: Share of the sample that the calibration is fitted on.
CALIBRATION = 0.3
CUT = 0.5
TREES, DEPTH, STEP = 15, 3, 0.3
#: Counts of uses are told apart in as many bins.
BINS = 128
WINDOW = 50
NEAR = 5
CACHE = 300_000

#: Common English insults, and second-person words of four languages.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers trash scum clown clowns pathetic worthless disgusting dumb imbecile jerk bastard bitch asshole fool garbage filth filthy vermin ugly retard crap shit fuck fucking damn freak".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tus vosotros".split())
SIGNS = str.maketrans("013457@$!", "oieastasi")
RUN = re.compile(r"(.)\1\1+")
HIDDEN = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]|[^\W\d_]\*{2,}(?:\s|$)")
SINGLES = re.compile(r"(?<!\S)\w[ .\-_*]\w[ .\-_*]\w[ .\-_*]")
APART = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){3,}(?!\S)")
NAMES = ["fixed_hits", "learned_hits", "fixed_density", "learned_density", "repeated_density", "repeated", "hits", "densest", "second_density", "near_second", "capitals", "shouted", "marks", "exclaims", "hidden", "runs", "apart", "log_words"]


def plain(word: str) -> str:
    """Lower case, without marks at the ends, signs read as letters, long runs cut to one."""
    w = word.lower()
    start, end = 0, len(w)
    while end and not w[end - 1].isalnum():
        end -= 1
    while start < end and not (w[start].isalnum() or w[start] == "_"):
        start += 1
    w = w[start:end]
    if not w.isalpha():
        w = w.translate(SIGNS)
    return RUN.sub(r"\1", w)


def beginnings(word: str) -> list[str]:
    """What the learned lexicon is looked up by: the word, and its first 4 to 8 letters."""
    return [f"={word}", *(f"{word[:k]}*" for k in range(4, 9) if len(word) >= k)] if word else []


class Features:
    """Dense features, with what each word counts for kept by word."""

    def __init__(self, learned: frozenset[str]):
        # bit 1: one use counts; from bit 5 on the number of an entry that must be used twice
        self.entries: dict[str, int] = {}
        for i, e in enumerate(sorted(learned), 1):
            self.entries[e[1:]] = self.entries.get(e[1:], 0) | (2 if e[0] == "1" else i << 5)
        self.stems = len(learned) + 1
        self.kept: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """1: fixed lexicon, 2: learned lexicon, 4: second person, 8: shouted, 16: hidden; from
        bit 5 on the number of the first entry that must be used twice."""
        got = 0
        if word.isalpha():
            w = RUN.sub(r"\1", word.lower())
        else:
            w, got = plain(word), 16 * bool(HIDDEN.search(word))
        if w in INSULTS:
            got |= 1
        if w in SECOND:
            got |= 4
        if len(word) > 2 and word.isupper():
            got |= 8
        for b in beginnings(w):
            if e := self.entries.get(b):
                got |= e if got < 32 else e & 2
        if len(word) <= 64:
            if len(self.kept) >= CACHE:
                self.kept.clear()
            self.kept[word] = got
        return got

    def of(self, text: str) -> list[float]:
        words = text.split()
        if not words:
            return [0.0] * len(NAMES)
        kinds = list(map(self.kept.get, words))
        if None in kinds:
            kinds = [self.kind(w) if k is None else k for w, k in zip(words, kinds)]
        k, n = np.array(kinds), len(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = len(points)
        apart = 0
        if SINGLES.search(text):
            apart = sum(1 for m in APART.finditer(text) if self.kind(re.sub(r"[ .\-_*]", "", m[0])) & 3)
        stem = k >> 5
        uses = np.bincount(stem, minlength=self.stems)
        uses[0] = 0
        again = uses[stem] > 1
        hit, second = np.flatnonzero(((k & 3) > 0) | again), np.flatnonzero(k & 4)
        densest = near = 0
        if len(hit):
            densest = int((np.searchsorted(hit, hit + WINDOW) - np.arange(len(hit))).max())
        if len(hit) and len(second):
            near = int((np.searchsorted(second, hit + NEAR, "right") > np.searchsorted(second, hit - NEAR)).sum())
        capitals = int(((points >= 65) & (points <= 90)).sum())
        marks = int(((points > 32) & (points < 127)).sum()) - capitals - int(((points >= 97) & (points <= 122)).sum()) - int(((points >= 48) & (points <= 57)).sum())
        runs = int(((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & (points[2:] > 64)).sum())
        fixed, learned = int((k & 1).sum()), int((k & 2).astype(bool).sum())
        return [float(fixed), float(learned), fixed / n, learned / n, float(again.sum()) / n, float(uses.max()), float(len(hit) + apart), float(densest), len(second) / n, float(near), capitals / c, float((k & 8).astype(bool).sum()) / n, marks / c, text.count("!") / c, float((k & 16).astype(bool).sum()) / n, runs / c, float(apart), math.log1p(n)]


LOADED: dict[frozenset[str], Features] = {}


def loaded(learned: frozenset[str]) -> Features:
    """One instance for each Python worker, so that its words are kept from task to task."""
    if learned not in LOADED:
        LOADED.clear()
        LOADED[learned] = Features(learned)
    return LOADED[learned]


def learned_lexicon(sample: DataFrame) -> frozenset[str]:
    """Entries from (text, y): a shuffle on the entry after each task has summed its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            n = list(held.values())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64())], ["entry", "no", "yes"])

        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                uses = Counter()
                for w, c in Counter(text.as_py().split()).items():
                    for e in beginnings(plain(w)):
                        uses[e] += c
                for e, c in uses.items():
                    held.setdefault(f"1{e}", [0, 0])[y > 0] += 1
                    if c > 1:
                        held.setdefault(f"2{e}", [0, 0])[y > 0] += 1
            if len(held) > CACHE:
                yield out()
                held.clear()
        yield out()

    n0, n1 = sample.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") > 0)).first()
    if not n0 or not n1:
        return frozenset()
    got = stored(sample.select("text", "y").mapInArrow(run, "entry string, no bigint, yes bigint").groupBy("entry").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")), "lexicon")
    tried = got.count()
    part = lambda x, n: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    yes, no, all_ = F.col("yes"), F.col("no"), F.col("yes") + F.col("no")
    both = lambda x, n: part(x, F.lit(float(n))) + part(F.lit(n) - x, F.lit(float(n)))
    ratio = 2 * (both(yes, n1) + both(no, n0) - both(all_, n0 + n1))
    often = (yes / n1) / ((no + 0.5) / n0)
    best = got.filter("yes >= 3").withColumn("g", ratio).filter((often >= 10) & (F.col("g") >= 2 * math.log(max(tried, 2)) + 6))
    return frozenset(r["entry"] for r in best.collect())


def featured(df: DataFrame, keep: list[str], learned: frozenset[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and NAMES."""
    shared = df.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        f = loaded(shared.value)
        return pd.Series([f.of(t) for t in texts])

    # only the text goes through Python, so columns of any type may be kept
    return df.select(*keep, array_to_vector(dense(text_of(df))).alias("_x"))


class Model:
    def __init__(self, documents: DataFrame, labels: DataFrame, label: str = "toxic"):
        sample = stored(training_rows(documents, labels, label, SAMPLE).withColumn("y", (F.col("y") > 0).cast("int")), "sample")
        n0, n1 = sample.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") > 0)).first()
        self.trees = self.steps = None
        self.mean = (n1 + 1) / (n0 + n1 + 2)
        # the calibration's rows stay unseen: neither words nor trees are learned from them
        shares = [F.col("fold") < CALIBRATION, F.col("fold") >= CALIBRATION]
        if sample.groupBy(shares[0], "y").count().count() < 4:
            shares = [F.lit(True), F.lit(True)]
        self.learned = learned_lexicon(sample.filter(shares[1]))
        if not n0 or not n1:
            return
        rows = stored(featured(sample, ["y", "fold"], self.learned).withColumn("y", F.col("y").cast("double")), "dense")
        held, fit = rows.filter(shares[0]), rows.filter(shares[1])
        trees = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=BINS, seed=7, predictionCol="_class")
        self.trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_p").fit(fit)
        # rows of one probability are one point with their number as weight: the fit is the same
        points = stored(self.raw(held).groupBy("_q").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w")), "points")
        self.steps = IsotonicRegression(featuresCol="_q", labelCol="y", weightCol="w", predictionCol="_score").fit(points)

    def raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("_q", vector_to_array("_p")[1]).drop("_class", "_raw", "_p", "_x")

    def scored(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep`` of ``df``, _score (calibrated) and _q (the trees' own), 0 to 1."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.mean).alias("_score"), F.lit(self.mean).alias("_q"))
        out = self.steps.transform(self.raw(featured(df, keep, self.learned)))
        return out.withColumn("_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_score")))


def scored(documents: DataFrame, labels: DataFrame, label: str = "toxic", rest: int = 0, divisor: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted and raw (the trees' probability before calibration) of
    each row of ``documents``."""
    shipped(documents.sparkSession)
    held = F.coalesce(remainder(documents["doc_id"], divisor) == rest, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    got = Model(documents, labels, label).scored(rows, ["doc_id", "held_out"])
    score = F.col("_score").alias("score")
    return got.select("doc_id", "held_out", score, (score >= CUT).cast("int").alias("predicted"), F.col("_q").alias("raw"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that score below CUT, with the same columns; all rows if the
    labels hold fewer than two classes, as nothing tells toxic rows apart then."""
    shipped(documents.sparkSession)
    model = Model(documents, labels)
    if model.trees is None:
        return documents
    own = numbered(documents)
    rows = own.withColumn("text", F.col(place(documents, "text")))
    return model.scored(rows, own.columns).filter(F.col("_score") < CUT).select(own.columns).toDF(*documents.columns)
