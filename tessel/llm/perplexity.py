"""Quality rules with an n-gram perplexity model (operator 5).

Base rules count words, symbols, repeated lines and repeated five-word windows of each text.
The model is a modified Kneser-Ney model of character 5-grams, for each language:

* Texts fall into ``FOLDS`` halves by their hash, so copies of a text are in one half. A text is
  scored by the counts of the other half: its own n-grams don't vouch for it.
* Spark counts the n-grams of all texts (each task sums before it shuffles). Orders 4 to 1 use
  continuation counts. Every n-gram of the corpus gets its probability by joins with its context
  and its suffix, so no order of any language has to fit a task.
* The n-grams are kept by 64-bit hash. The ``FREQUENT`` most frequent at most (12 bytes each) are
  broadcast, as arrays sorted by hash; a second pass looks them up by binary search. The others
  of a text are joined by hash in a shuffle; each of them occurs in at most 1 / ``FREQUENT`` of all
  places, so no key is hot.
* Bands: per language, around the median of log perplexity, as wide as ``SPREADS`` robust
  spreads plus what chance allows in a text of that length. Texts below or above are rejected.

The order of words farther apart than five characters isn't seen. What a task holds of n-grams
while it counts is bounded by ``KEPT``, and of a long text's code points by ``AT_ONCE``.

Null texts and texts without words fail the base rules; very long texts are read whole. Null
languages form a group of their own. Every language has a band, by one rule. Repeated rows count
as often as they occur and get equal results; a value on a band's limit is kept. Only id, text
and lang are read, so clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACES, discard, stored, text_of

SYMBOLS = "#*$%&|<>"
#: Documents that the spread of all languages counts for beside a language's own.
PRIOR = 30
SPREADS = 3.0
CHANCE = 1.5
#: Rows of a table of languages that are broadcast, at most; more are joined in a shuffle.
FEW = 10_000
#: Code points that are handled at once.
AT_ONCE = 1 << 20
ORDER = 5
FOLDS = 2
#: n-grams that are broadcast, at most.
FREQUENT = 1_000_000
#: Distinct n-grams that a task keeps while it counts.
KEPT = 4_000_000
#: Distinct code points that a task tells apart at a time, and the bits for one.
BITS = 12
NUMBERED = 1 << BITS
#: Code points of a text that get their numbers together.
PART = NUMBERED - ORDER
MIX = np.uint64(0x9E3779B97F4A7C15)
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def key_of(lang: str | None) -> int:
    """A language as a key that isn't null: a signed 64-bit hash."""
    h = xxhash.xxh64_intdigest("" if lang is None else f"={lang}")
    return h - (1 << 64) if h >> 63 else h


def fold_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 7) % FOLDS


def padded(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(ORDER - 1, np.uint32), points(text)]).astype(np.uint64)


def seed_of(key: int, fold: int) -> int:
    return xxhash.xxh64_intdigest(f"{fold}{key}".encode())


def mixed(grams: list[np.ndarray], seed) -> np.ndarray:
    """A hash for each n-gram: ``grams`` holds its first code points, its second ones, and so on;
    ``seed`` is one number or one for each n-gram."""
    h = np.full(len(grams[0]), seed, np.uint64) if np.isscalar(seed) else seed.copy()
    for x in grams:
        h += x
        h *= MIX
    h ^= h >> np.uint64(29)  # a product's lower bits depend on few of its factor's
    h *= MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(c: np.ndarray, key: int, fold: int) -> np.ndarray:
    """A hash for each run of ``ORDER`` code points."""
    n = len(c) - ORDER + 1
    return mixed([c[i : i + n] for i in range(ORDER)], np.uint64(seed_of(key, fold)))


class Tally:
    """n-gram counts of one task by (key, fold), of texts as they come. Code points get numbers in
    order of appearance, ``NUMBERED`` at most at a time, so an n-gram is one exact integer."""

    def __init__(self):
        self.number = np.full(0x110000, -1, np.int64)
        self.alphabet = np.empty(0, np.int64)
        self.parts: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.kept = 0

    def takes(self, c: np.ndarray) -> bool:
        """Numbers the new code points of ``c``; False if there are too many."""
        new = np.unique(c[self.number[c] < 0])
        if len(self.alphabet) + len(new) > NUMBERED:
            return False
        self.number[new] = np.arange(len(self.alphabet), len(self.alphabet) + len(new))
        self.alphabet = np.concatenate([self.alphabet, new.astype(np.int64)])
        return True

    def add(self, where: tuple, texts: list[np.ndarray]) -> None:
        """Counts n-grams of padded ``texts``, whose code points have numbers."""
        c = self.number[np.concatenate(texts)]
        n = len(c) - ORDER + 1
        code = np.zeros(n, np.int64)
        for i in range(ORDER):
            code = code << BITS | c[i : i + n]
        if len(texts) > 1:  # those that reach into the next text aren't n-grams
            own = np.ones(n, bool)
            for end in np.cumsum([len(t) for t in texts])[:-1].tolist():
                own[end - ORDER + 1 : end] = False
            code = code[own]
        found = np.unique(code, return_counts=True)
        self.parts.setdefault(where, []).append(found)
        self.kept += len(found[0])
        if self.kept > KEPT:
            for k in self.parts:
                self.parts[k] = [self.merged(k)]
            self.kept = sum(len(p[0][0]) for p in self.parts.values())

    def merged(self, where: tuple) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*self.parts[where]))
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[first], np.add.reduceat(n, first)

    def out(self) -> Iterator[pa.RecordBatch]:
        for key, fold in self.parts:
            codes, counts = self.merged((key, fold))
            for at in range(0, len(codes), 1 << 16):
                code, n = codes[at : at + (1 << 16)], counts[at : at + (1 << 16)]
                hi = lo = np.zeros(len(code), np.int64)
                for i in range(ORDER):
                    c = self.alphabet[(code >> BITS * (ORDER - 1 - i)) & (NUMBERED - 1)]
                    hi, lo = (hi << 21 | c, lo) if i < ORDER - 3 else (hi, lo << 21 | c)
                cols = [np.full(len(code), key), np.full(len(code), fold, np.int32), hi, lo, n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "fold", "hi", "lo", "n"])


def counted(df: DataFrame) -> DataFrame:
    """(key, fold, hi, lo, n, freq) over all texts of ``df`` (lang, text): how often the texts of
    the other folds have the n-gram, and those of the fold. ``key``: hash of the language; hi, lo:
    the n-gram's code points, 21 bits each, the last three in lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, waiting, n = Tally(), {}, 0
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                if not text:
                    continue
                where, c = (np.int64(key_of(lang)), fold_of(text)), padded(text)
                for at in range(0, len(text), PART):
                    piece = c[at : at + PART + ORDER - 1]
                    if not tally.takes(piece) or tally.kept > KEPT // 2:
                        for k, texts in waiting.items():
                            tally.add(k, texts)
                        waiting, n = {}, 0
                        if not tally.takes(piece) or tally.kept > KEPT // 2:
                            yield from tally.out()
                            tally = Tally()
                            tally.takes(piece)
                    waiting.setdefault(where, []).append(piece)
                    n += len(piece)
                if n >= AT_ONCE:
                    for k, texts in waiting.items():
                        tally.add(k, texts)
                    waiting, n = {}, 0
        for k, texts in waiting.items():
            tally.add(k, texts)
        yield from tally.out()

    found = df.select("lang", text_of(df).alias("text")).mapInArrow(run, "key bigint, fold int, hi bigint, lo bigint, n bigint")
    each = [F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).cast("bigint") for f in range(FOLDS)]
    sums = found.groupBy("key", "hi", "lo").agg(F.sum("n").alias("all"), *(e.alias(f"n{f}") for f, e in enumerate(each)))
    folds = F.array(*(F.struct(F.lit(f).alias("fold"), (F.col("all") - F.col(f"n{f}")).alias("n"), F.col(f"n{f}").alias("freq")) for f in range(FOLDS)))
    return sums.select("key", "hi", "lo", F.inline(folds))


def prefix() -> tuple[Column, Column]:
    """hi, lo of an n-gram without its last code point."""
    hi, lo = F.col("hi"), F.col("lo")
    return F.shiftright(hi, 21), F.shiftright(lo, 21).bitwiseOR(F.shiftleft(hi.bitwiseAND(F.lit((1 << 21) - 1)), 42))


def last(k: int) -> tuple[Column, Column]:
    """hi, lo of an n-gram's last ``k`` code points."""
    bits = lambda n: F.lit((1 << 21 * n) - 1).cast("bigint")
    return F.col("hi").bitwiseAND(bits(max(k - 3, 0))), F.col("lo").bitwiseAND(bits(min(k, 3)))


def discounts(n: np.ndarray) -> np.ndarray:
    """D0 = 0, D1, D2, D3+ of modified Kneser-Ney (Chen and Goodman 1998)."""
    have = [np.count_nonzero(n == k) for k in range(1, 5)]
    y = have[0] / (have[0] + 2 * have[1]) if have[0] else 0.5
    d = [k - (k + 1) * y * have[k] / have[k - 1] if have[k - 1] and have[k] else k * y for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05 * k), k) for k, x in enumerate(d, 1))])


def fold_discounts(levels: list[DataFrame]) -> DataFrame:
    """(key, fold, order, d1, d2, d3) as ``discounts``, a row for each order of each language."""
    few = [t.select("key", "fold", F.lit(k).alias("order"), "n").filter("n between 1 and 4") for k, t in enumerate(levels, 1)]
    all_few = few[0]
    for t in few[1:]:
        all_few = all_few.unionByName(t)
    have = all_few.groupBy("key", "fold", "order").agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def d(k: int) -> Column:
        n, more = F.col(f"n{k}"), F.col(f"n{k + 1}")
        raw = F.when((n > 0) & (more > 0), k - (k + 1) * y * more / n).otherwise(k * y)
        return F.least(F.greatest(raw, F.lit(0.05 * k)), F.lit(float(k)))

    return have.select("key", "fold", "order", *(d(k).alias(f"d{k}") for k in (1, 2, 3)))


def models(counts: DataFrame) -> DataFrame:
    """(h, logp, freq): each n-gram of a fold with its log probability by the other folds."""
    levels = [stored(counts, f"grams{ORDER}")]
    for k in range(ORDER - 1, 0, -1):
        hi, lo = last(k)
        suffix = levels[0].select("key", "fold", hi.alias("hi"), lo.alias("lo"), "n")
        levels.insert(0, stored(suffix.groupBy("key", "fold", "hi", "lo").agg(F.count_if(F.col("n") > 0).alias("n")), f"grams{k}"))
    d = stored(fold_discounts(levels), "discounts")
    broadcast = d.count() <= FEW * FOLDS * ORDER
    below = None
    for k, t in enumerate(levels, 1):
        own = d.filter(F.col("order") == k).drop("order")  # a row for each language and fold
        x = t.join(F.broadcast(own) if broadcast else own, ["key", "fold"], "left")
        cut = F.when(F.col("n") == 0, 0.0)
        for i in (1, 2, 3):
            of = F.coalesce(F.col(f"d{i}"), F.lit(0.5 * i))
            cut = cut.when(F.col("n") == i, of) if i < 3 else cut.otherwise(of)
        w = Window.partitionBy("key", "fold", *prefix())
        x = x.withColumn("cut", cut).withColumn("total", F.sum("n").over(w)).withColumn("weight", F.sum("cut").over(w))
        if below is None:  # the rest is even over the language's characters and one more
            x = x.withColumn("low", 1 / (F.count("*").over(w) + 1))
        else:
            hi, lo = last(k - 1)
            x = x.withColumn("hi_", hi).withColumn("lo_", lo).join(below, ["key", "fold", "hi_", "lo_"]).drop("hi_", "lo_")
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") / F.col("total") * F.col("low")).otherwise(F.col("low"))
        x = x.withColumn("p", p)
        below = x.select("key", "fold", F.col("hi").alias("hi_"), F.col("lo").alias("lo_"), F.col("p").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds: dict[tuple, int] = {}
            each = [seeds.get(k) or seeds.setdefault(k, seed_of(*k)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            hi, lo = (b.column(i).to_numpy().view(np.uint64) for i in (2, 3))
            c = [(hi if i > 2 else lo) >> np.uint64(21 * (i % 3)) & np.uint64((1 << 21) - 1) for i in reversed(range(ORDER))]
            h = mixed(c, np.array(each, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(4), b.column(5)], ["h", "logp", "freq"])

    out = stored(x.filter("freq > 0").select("key", "fold", "hi", "lo", F.ln("p").cast("float").alias("logp"), "freq").mapInArrow(run, "h bigint, logp float, freq bigint"), "model")
    for t in [*levels, d]:
        discard(t)
    return out


def least_frequent(model: DataFrame, most: int) -> int:
    """The smallest count such that at most ``most`` n-grams occur as often."""
    sizes = model.groupBy(F.least("freq", F.lit(1 << 16)).alias("freq")).count().orderBy(F.col("freq").desc()).collect()  # 65,536 rows at most
    n, least = 0, 1 << 62
    for x in sizes:
        n += x["count"]
        if n > most:
            break
        least = x["freq"]
    return least


class SortedHashes:
    """An array of values in order of their 64-bit hashes, and where the hashes with the same
    upper bits begin, so that a search looks at a handful of neighbours."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, want: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(want), -1, np.int64)
        top = (want >> self.shift).astype(np.int32)
        at = self.start[top]
        out = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == want, at, -1)
        left = np.flatnonzero(out < 0)
        end, at = self.start[top[left] + 1], at[left] + 1
        while len(left):
            go = at < end
            left, at, end = left[go], at[go], end[go]
            hit = self.keys[at] == want[left]
            out[left[hit]] = at[hit]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out


def repeats(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    code = x[:n].astype(np.uint64)
    for i in range(1, width):
        code = code * MIX + x[i : i + n].astype(np.uint64)
    code.sort()
    if not (code[1:] == code[:-1]).any():  # equal windows have equal hashes
        return 0
    code = x[:n]
    for i in range(1, width):  # exact: pairs (code so far, next word) are numbered anew
        code = np.unique(code * len(ids) + x[i : i + n], return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.flatnonzero(again), 1)
    np.add.at(step, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(step) > 0).sum())


def metrics(text: str) -> tuple[int, int, int, int, int]:
    """As METRICS. bytes.split() cuts at just the six ASCII spaces that separate words."""
    words = text.encode().split()
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(WORD_SPACES):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, WORD_SPACES)), sum(map(text.count, SYMBOLS)), dup, repeats(words)


def scored(df: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, METRICS, n_chars and log perplexity (null without characters), and the mean
    of squared log probabilities, for each row."""
    least = least_frequent(model, FREQUENT)
    top = model.filter(F.col("freq") >= least).select("h", "logp").toArrow()  # 12 bytes each
    shared = df.sparkSession.sparkContext.broadcast(SortedHashes(top.column("h").to_numpy().view(np.uint64), top.column("logp").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            got, sums, squares, chars, rest, times = [], [], [], [], [], []
            for lang, text in zip(b.column(1).to_pylist(), b.column(2)):
                t = text.as_py()
                got.append(metrics(t))
                chars.append(len(t))
                c, s, q, others = padded(t), 0.0, 0.0, []
                for at in range(0, len(t), AT_ONCE):
                    h = gram_hashes(c[at : at + AT_ONCE + ORDER - 1], key_of(lang), fold_of(t))
                    found = known.find(h)
                    hit = found >= 0
                    p = np.where(hit, known.values[found], 0.0).astype(np.float64) if len(known.values) else np.zeros(len(h))
                    s, q = s + p.sum(), q + p @ p
                    others.append(h[~hit])
                sums.append(s)
                squares.append(q)
                h, n = np.unique(np.concatenate(others), return_counts=True) if others else (np.empty(0, np.uint64), np.empty(0))
                rest.append(h.view(np.int64))
                times.append(n.astype(np.int32))
            cols = [pa.array(c, pa.int64()) for c in zip(*got)] if got else [pa.array([], pa.int64())] * 5
            rows = pa.array(range(row, row + len(got)), pa.int64())
            row += len(got)
            lists = [pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([rows, b.column(0), b.column(1), *cols, pa.array(chars, pa.int64()), pa.array(sums, pa.float64()), pa.array(squares, pa.float64()), *lists], ["row", "doc_id", "lang", *METRICS, "n_chars", "s", "q", "rest", "times"])

    schema = "row bigint, doc_id bigint, lang string, " + ", ".join(f"{m} bigint" for m in METRICS) + ", n_chars bigint, s double, q double, rest array<bigint>, times array<int>"
    part = stored(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of(df).alias("text")).mapInArrow(run, schema), "parts")
    rare = part.select("row", F.inline(F.arrays_zip(F.col("rest").alias("h"), F.col("times").alias("n"))))
    p = F.col("logp").cast("double")
    more = rare.join(model.filter(F.col("freq") < least).select("h", "logp"), "h").groupBy("row").agg(F.sum(F.col("n") * p).alias("s2"), F.sum(F.col("n") * p * p).alias("q2"))
    whole = part.drop("rest", "times").join(more, "row", "left")
    mean = F.when(F.col("n_chars") > 0, -(F.col("s") + F.coalesce("s2", F.lit(0.0))) / F.col("n_chars"))
    square = F.when(F.col("n_chars") > 0, (F.col("q") + F.coalesce("q2", F.lit(0.0))) / F.col("n_chars"))
    return whole.select("doc_id", "lang", *METRICS, "n_chars", mean.alias("log_ppl"), square.alias("square"))


def bands(scores: DataFrame) -> DataFrame:
    """Per language: the middle and spread of log perplexity of documents that pass the base
    rules, and the deviation of a single character's log probability. A language's spread and
    deviation are averaged with those of all documents, which weigh as ``PRIOR`` of its own, so a
    language with few documents has a band too."""
    good = scores.filter("log_ppl is not null and not base_failed")
    var = F.sum(F.col("n_chars") * F.col("square")) / F.sum("n_chars") - F.pow(F.sum(F.col("n_chars") * F.col("log_ppl")) / F.sum("n_chars"), 2)
    found = [F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000).alias("q"), F.count("*").alias("docs"), F.greatest(var, F.lit(0.0)).alias("var")]
    own = good.groupBy("lang").agg(*found).select("lang", "docs", F.col("q")[1].alias("middle"), (F.col("q")[2] - F.col("q")[0]).alias("range"), "var")
    own = stored(own, "bands")
    every = own.agg(F.sum(F.col("docs") * F.col("range")) / F.sum("docs"), F.sum(F.col("docs") * F.col("var")) / F.sum("docs")).first()  # one row
    share = F.col("docs") / (F.col("docs") + PRIOR)
    mean = lambda x, of: share * F.col(x) + (1 - share) * F.lit(of or 0.0)
    return own.select("lang", "middle", (mean("range", every[0]) / 1.349).alias("spread"), F.sqrt(mean("var", every[1])).alias("dev"))


def if_few(df: DataFrame) -> DataFrame:
    """``df``, a row for each language or a few, to be broadcast if it has at most ``FEW`` rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def quality(df: DataFrame) -> DataFrame:
    """Metrics, base_failed, kept, log_ppl, and the band's lower and upper limit."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scores = stored(scored(df, models(counted(df))).withColumn("base_failed", base), "scores")
    band = if_few(bands(scores))
    half = SPREADS * F.col("spread") + CHANCE * F.col("dev") / F.sqrt(F.greatest("n_chars", F.lit(1)))
    out = scores.alias("s").join(band.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("lower", F.col("middle") - half).withColumn("upper", F.col("middle") + half)
    # a language without any document that passes the base rules has no band, and none that needs it
    fits = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & fits).select("doc_id", *METRICS, "base_failed", "kept", "log_ppl", "lower", "upper", "lang")
