"""Subword lattice likelihood (operator 9).

The model gives each text the sum over all its segmentations. A word's lattice has an arc for
each piece of an existing public vocabulary that matches at a place, weighted by the vocabulary's
own score, and an arc for each single character outside it. A piece begins a word or goes on with
it, as its mark tells, so every segmentation of a text passes through the ends of its words: the
forward recursion of a text is the sum of its words' logarithms plus the end's, and the recursion
itself runs over each distinct word once, in log space, whole, however long. ``lattice_score`` is
that, and the end at its share of the training tokens.

``score`` adds what the corpus knows: where training holds a word, one arc over the whole word
with its relative count. The vocabulary's lattice has the weight t and the whole-word arcs 1 - t,
where t is the share of training tokens that occur once (Good-Turing).

The scores of a unigram vocabulary are taken as they are. A merge vocabulary has ranks instead
(0, -1, -2, ...); rank r then stands for a share of about 1 / (r + 2), as in Zipf's law, a rule
that looks at no corpus.

Scale. (1) Words are counted in each task and summed by a shuffle on the word. (2) Lattices run
over the distinct words, spread over the cluster. (3) Words whose share of the tokens is at
least ``SHARE`` are at most 1 / SHARE and are broadcast, those over ``LONG`` bytes by their
128-bit hash, so the broadcast is bounded by 1 / SHARE * (LONG + 32) bytes at any input size.
Their part of each text is added up in the task that reads it. (4) All other words go out as one
row for each text and distinct word and are joined by a shuffle; none of them holds more than
SHARE of the tokens, so no key is hot. What is collected to the driver besides: 4 totals.

Null texts count as empty: the end alone. Very long texts are counted whole; a word of n
characters takes time and memory in proportion to n. Null ids are never held out and never
learned from. Rows are told apart by a number of their own, so repeated ids and rows are scored
one by one, each with the same result. Only id and text are read, so clashing names do no harm. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, remainder, shipped, stored, text_of

SHARE = 1e-6
LONG = 64
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
MARK = "▁"
#: What a character outside the vocabulary scores below its least piece.
UNKNOWN = 10.0
#: Characters that are worked on at once, all words together.
CELLS = 1 << 18
#: Multiplier of the hash of a stretch of code points.
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


class Pieces:
    """A public vocabulary with its own scores, read from a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and MARK not in names[i][1:] for i in range(len(names))]
        self.names = [n for n, ok in zip(names, usable) if ok]
        score = np.array([sp.get_score(i) for i in range(len(names)) if usable[i]])
        # A merge vocabulary scores by rank: 0, -1, -2, ... A rank r stands for a share of about
        # 1 / (r + 2), as in Zipf's law; proper log probabilities are taken as they are.
        if score.min() < -200:
            score = -np.log(2.0 - score)
        self.start = score - np.log(np.exp(score - score.max()).sum()) - score.max()
        self.longest = max(map(len, self.names))
        hashes = np.zeros(len(self.names), np.uint64)
        for i, name in enumerate(self.names):
            h = 0
            for c in name:
                h = (h * int(BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")


LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in LOADED:
        LOADED[path] = Pieces(path)
    return LOADED[path]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which words have one length, and their code points, a row each; ``CELLS`` at a time."""
    rows: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        rows.setdefault(len(w) + 1, []).append(i)
    for n, which in rows.items():
        step = max(1, CELLS // n)
        for at in range(0, len(which), step):
            part = which[at : at + step]
            yield np.array(part), np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)


def lattice(p: Pieces, codes: np.ndarray) -> list[np.ndarray]:
    """For lengths 1, 2, ...: the piece that begins at each place of each row; the number of
    pieces for a single character outside the vocabulary, one more for no arc."""
    out, h, n = [], np.zeros_like(codes), codes.shape[1]
    for k in range(1, min(n, p.longest) + 1):
        h = h[:, : n - k + 1] * BASE + codes[:, k - 1 :]
        at = np.minimum(np.searchsorted(p.hashes, h), len(p.hashes) - 1)
        out.append(np.where(p.hashes[at] == h, p.by_hash[at], len(p.names) + (k > 1)))
    return out


def forward(p: Pieces, codes: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Log of the summed weights of all paths through each row: every place passes its sum on
    along the arcs that begin there. Arcs are looked up for a block of places at a time."""
    rows, n = codes.shape
    a = np.full((rows, n + p.longest + 1), -np.inf)
    a[:, 0] = 0
    block = max(p.longest, CELLS // (rows * p.longest))
    for start in range(0, n, block):
        end = min(start + block, n)
        arcs = np.full((rows, end - start, p.longest), -np.inf)
        for k, x in enumerate(lattice(p, codes[:, start : end + p.longest - 1])):
            x = x[:, : end - start]
            arcs[:, : x.shape[1], k] = score[x]
        for i in range(start, end):
            a[:, i + 1 : i + 1 + p.longest] = np.logaddexp(a[:, i + 1 : i + 1 + p.longest], a[:, i, None] + arcs[:, i - start])
    return a[:, n]


def spelt(p: Pieces, words: list[str], score: np.ndarray) -> np.ndarray:
    """Log probability of each word's letters over all segmentations. ``score``: of the pieces,
    of a single character outside them, and of no arc (minus infinity)."""
    out = np.zeros(len(words))
    for which, codes in by_length(words):
        out[which] = forward(p, codes, score)
    return out


def scores(p: Pieces) -> np.ndarray:
    return np.append(p.start, [p.start.min() - UNKNOWN, -np.inf])


def counted(texts: DataFrame) -> DataFrame:
    """(word, c, seen): training and all occurrences of each word of ``texts`` (train, text)."""

    def out(held: dict[bytes, list[int]]) -> pa.RecordBatch:
        words, n = list(held), list(held.values())
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64())], ["word", "c", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for train, text in zip(b.column(0).to_pylist(), b.column(1)):
                for w, n in Counter(words_of(text.as_py())).items():
                    x = held.get(w)
                    if x is None:
                        held[w] = [n * train, n]
                    else:
                        x[0] += n * train
                        x[1] += n
                if len(held) > HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    return texts.select(F.col("train").cast("int"), "text").mapInArrow(run, "word string, c bigint, seen bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def together(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    """Batches put together, so that words of one length come in numbers."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def weighed(words: DataFrame, path: str, docs_in: int) -> tuple[DataFrame, dict[str, float]]:
    """(word, c, base, model, lattice): each word's log10 under the base, the model with and the
    model without whole words, and the totals N, V and the end's logarithms."""
    total, distinct, once = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    n, v, once = (total or 0) + docs_in, (distinct or 0) + (docs_in > 0), once or 0
    new = (once + 0.5) / (n + 1)  # the lattice's weight at each token
    low = -math.log10(n + 0.5 * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(path)
        score = scores(p)
        for t in together(batches):
            c = t["c"].to_numpy()
            x = spelt(p, t["word"].to_pylist(), score)
            with np.errstate(divide="ignore"):
                both = np.logaddexp(math.log(new) + x, np.log(c * (1 - new) / max(n, 1)))
            for name, y in (("base", np.log10(c + 0.5) + low), ("model", both / math.log(10)), ("lattice", x / math.log(10))):
                t = t.append_column(name, pa.array(y))
            yield from t.to_batches(max_chunksize=20_000)

    share = math.log10(max(docs_in, 0.5) / max(n, 1))
    end = {"n": n, "v": v, "base": math.log10(docs_in + 0.5) + low, "model": share + math.log10(1 - new), "lattice": share, "known": int(docs_in > 0)}
    return words.select("word", "c").mapInArrow(run, "word string, c bigint, base double, model double, lattice double"), end


SCORES = ["base", "model", "lattice"]


def short(word: bytes) -> bytes:
    """What a word is looked up by: itself, or a hash if it is long."""
    return word if len(word) <= LONG else b"\0" + hashlib.sha256(word).digest()


#: Numbers of the broadcast words, in this Python worker, by the query they are for.
NUMBERS: dict[str, dict[bytes, int]] = {}


def likelihoods(df: DataFrame, path: str, train_rest: int = 1, divisor: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of each
    row."""
    spark = shipped(df.sparkSession)
    rest = remainder(df["doc_id"], divisor)
    texts = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(rest == train_rest, F.lit(False)).alias("held_out"), F.coalesce(rest != train_rest, F.lit(False)).alias("train"), text_of(df).alias("text"))
    words = stored(counted(texts), "words")
    docs_in = texts.filter("train").count()
    weights, end = weighed(words, path, docs_in)
    weights = stored(weights, "weights")
    # c + 0.5 and the like: the share is taken of all tokens, so held-out texts count too
    seen = words.agg(F.sum("seen")).first()[0] or 0
    least = max(2, math.ceil(SHARE * seen))
    often = words.filter(F.col("seen") >= least).select("word")
    raw = F.encode("word", "UTF-8")  # shortened here, so that no long word reaches the driver
    name = F.when(F.length(raw) <= LONG, raw).otherwise(F.concat(F.unhex(F.lit("00")), F.unhex(F.sha2(raw, 256))))
    frequent = weights.join(often, "word", "left_semi").select(name.alias("word"), "c", *SCORES).toArrow()  # at most 1 / SHARE rows
    names = frequent["word"].to_pylist()
    shared = spark.sparkContext.broadcast((names, frequent["c"].to_numpy() > 0, np.stack([frequent[k].to_numpy() for k in SCORES], axis=1).reshape(-1, len(SCORES))))
    folder = new_folder(spark, "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, logs = shared.value
        if folder not in NUMBERS:
            NUMBERS.clear()
            NUMBERS[folder] = {w: i for i, w in enumerate(names)}
        at = NUMBERS[folder]
        ends = [end[k] for k in SCORES]
        for b in batches:
            rows: list[tuple] = []
            for r, d, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                tally = Counter(words_of(text.as_py()))
                places = [at.get(w if len(w) <= LONG else short(w)) for w in tally]
                counts = list(tally.values())
                i = np.array([x for x in places if x is not None], np.int64)
                c = np.array([n for x, n in zip(places, counts) if x is not None], np.int64)
                rows.append((r, d, h, None, sum(counts) + 1, int(c @ known[i]) + end["known"], *(c @ logs[i] + ends).tolist()))
                rows += [(r, None, None, w.decode(), n, None, None, None, None) for (w, n), x in zip(tally.items(), places) if x is None]
                if len(rows) > 100_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "word": pa.string(), "tf": pa.int64(), "known": pa.int64(), **dict.fromkeys(SCORES, pa.float64())}

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    # written before it is used twice: row numbers are the same then
    schema = "row bigint, doc_id bigint, held_out boolean, word string, tf bigint, known bigint, base double, model double, lattice double"
    texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(run, schema).write.parquet(folder)
    parts = spark.read.schema(schema).parquet(folder)
    rare = parts.filter("word is not null").select("row", "word", "tf").join(weights, "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known_r"), *(F.sum(F.col("tf") * F.col(k)).alias(f"{k}_r") for k in SCORES))
    heads = parts.filter("word is null").select("row", "doc_id", "held_out", F.col("tf").alias("n_tokens"), "known", *SCORES)
    sums = {k: F.col(k) + F.coalesce(f"{k}_r", F.lit(0.0)) for k in SCORES}
    return heads.join(rare, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_r", F.lit(0))).alias("n_known"), F.lit(end["n"]).cast("bigint").alias("train_tokens"), sums["base"].alias("base_score"), sums["model"].alias("score"), sums["lattice"].alias("lattice_score"))
