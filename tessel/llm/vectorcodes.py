"""Product codes of vectors, their nearest entries found by segment-mean lower bounds (operator 12).

Components become integers, floor(``SCALE`` * x); a vector is cut into ``PARTS`` consecutive parts
and each part is named by the nearest of ``ENTRIES`` codebook entries. Codebooks start as the parts
of the vectors with the smallest ids and are refined in ``ROUNDS`` rounds.

The nearest entry of a part is found coarse to fine. Both are cut into 1, then 2, 4 and 8 segments. By
a segment's mean m and the norm r of what is left, |x - c|^2 >= n (m_x - m_c)^2 + (r_x - r_c)^2, summed
over segments of n components. At each level the entry with the least bound gets its exact distance; entries whose bound
exceeds the least distance so far are out, rows with more than one entry left go to the next level, and what
survives all of them gets exact integer distances. Bounds are lowered by more than the arithmetic's error, so no
nearest entry is lost, and ties go to the lower index.

A round is one Spark job: tasks assign their rows and send one sum for each part and entry that they
met; these are summed by key. Codebooks (``PARTS`` x ``ENTRIES`` entries, whatever the table's size)
are all that reaches the driver and goes back to tasks. A label's error is summed before the shuffle
and looked up, frequent labels by broadcast, so a label of any size is spread out.

Rows with a null vector, or with null or non-finite components, are dropped. The number of
components is that of the first kept row by id; a row with another number keeps its place in the
result with a null code and error, and neither codebooks nor label errors count it. If parts can't be
equal the first ones are shorter. Null ids come after all others; of rows with one id all count, ordered by
vector; nulls of ``label`` are one label. Fewer kept rows than ``ENTRIES`` make smaller codebooks. Extra columns, also
with clashing names, aren't read. An empty table gives an empty result. Components must be below
``MOST`` / ``SCALE`` in size, so that sums stay exact; larger ones are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, place, stored, with_looked_up

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers below this: 512 squared differences of a part fit 63 bits.
MOST = 1 << 26
#: Segments of a part at each level, coarse to fine.
LEVELS = (1, 2, 4, 8)
#: Rows whose bounds are worked out at once.
AT_ONCE = 512


def borders(width: int, parts: int) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


def signature(x: np.ndarray, segments: int) -> np.ndarray:
    """Of rows x: each segment's mean, times the root of its length, and the norm of what the mean leaves.
    The squared distance of two signatures is the lower bound."""
    edge = borders(x.shape[1], segments)
    out = []
    for a, b in zip(edge, edge[1:]):
        if b > a:
            mean = x[:, a:b].mean(axis=1, keepdims=True)
            out += [mean * np.sqrt(b - a), np.sqrt(((x[:, a:b] - mean) ** 2).sum(axis=1, keepdims=True))]
    return np.concatenate(out, axis=1) if out else np.zeros((len(x), 1))


class Codebook:
    """Entries of one part, with what the bounds need."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [(s, signature(entries.astype(float), s)) for s in LEVELS]
        self.verified = 0

    def exact(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = x - self.entries[entry]
        self.verified += len(entry)
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of integers."""
        out = [self.some(x[at : at + AT_ONCE]) for at in range(0, len(x), AT_ONCE)] or [(np.empty(0, np.int64),) * 2]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def some(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.ones((len(x), len(self.entries)), bool)
        most = np.full(len(x), np.iinfo(np.int64).max)
        open_rows = np.arange(len(x))
        for segments, theirs in self.levels:
            own = signature(x[open_rows].astype(float), segments)
            size = (own**2).sum(axis=1)[:, None] + (theirs**2).sum(axis=1)
            bound = size - 2 * (own @ theirs.T)
            bound -= 1e-9 * size + 1e-3  # far more than the arithmetic's error
            bound[~left[open_rows]] = np.inf
            best = bound.argmin(axis=1)
            most[open_rows] = np.minimum(most[open_rows], self.exact(x[open_rows], best))
            left[open_rows] = bound <= most[open_rows][:, None]
            open_rows = open_rows[left[open_rows].sum(axis=1) > 1]
        row, entry = np.nonzero(left)
        distance = self.exact(x[row], entry)
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # every row has at least one entry left
        least = np.minimum.reduceat(distance, start)
        hit = np.flatnonzero(distance == least[row])  # rows and entries ascend, so the first is the lower index
        return entry[hit[np.unique(row[hit], return_index=True)[1]]], least


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v array<bigint>) of the rows that are kept."""
    rows = numbered(df)
    x = F.col(place(df, vector)).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = rows.filter(x.isNotNull() & finite)
    return rows.select(F.col(place(df, "vec_id")).alias("vec_id"), F.col(place(df, "label")).alias("label"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the right length as one matrix, and which rows these are."""
    fits = column.value_lengths().to_numpy(zero_copy_only=False) == width
    x = column.filter(pa.array(fits)).flatten().to_numpy().reshape(int(fits.sum()), width)
    if (x >= MOST).any() or (x <= -MOST).any():
        raise ValueError(f"components must be below {MOST // SCALE} in size")
    return x, fits


def parts_of(x: np.ndarray) -> list[np.ndarray]:
    edge = borders(x.shape[1], PARTS)
    return [x[:, a:b] for a, b in zip(edge, edge[1:])]


def sums(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): count and sum of the parts that are nearest to an entry."""
    wide = max(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        n = np.zeros((PARTS, len(books[0])), np.int64)
        total = np.zeros((PARTS, len(books[0]), wide), np.int64)
        for b in batches:
            for p, part in enumerate(parts_of(matrix(b.column(0), width)[0])):
                entry, _ = found[p].nearest(part)
                n[p] += np.bincount(entry, minlength=n.shape[1])
                np.add.at(total[p, :, : part.shape[1]], entry, part)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *(pa.array(total[p, e, j]) for j in range(wide))], names)

    names = ["part", "entry", "n", *(f"s{j}" for j in range(wide))]
    made = rows.select("v").mapInArrow(run, ", ".join(f"{x} {'int' if x in ('part', 'entry') else 'bigint'}" for x in names))
    return made.groupBy("part", "entry").agg(*(F.sum(x).alias(x) for x in names[2:]))


def trained(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks of the parts, as integers, from the stored ``rows`` of ``integers``."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("d")).first()
    width = first[0] if first else 0
    start = rows.filter(F.size("v") == width).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = [b.copy() for b in parts_of(np.array([r[0] for r in start], np.int64).reshape(len(start), width))]
    if not start:
        return books
    for _ in range(rounds):
        for part, entry, n, *total in sums(rows, books, width).collect():
            books[part][entry] = [s // n for s in total[: books[part].shape[1]]]
    return books


def coded(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of ``rows``."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for b in batches:
            x, fits = matrix(b.column(2), width)
            near = [found[p].nearest(part) for p, part in enumerate(parts_of(x))]
            code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
            code[fits] = ["".join(f"{i:02x}" for i in c) for c in zip(*(c.tolist() for c, _ in near))]
            error[fits] = sum(e for _, e in near).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``df`` (vec_id, vector, label)."""
    rows = stored(integers(df, vector), "integers")
    books = trained(rows)
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    out = stored(coded(rows, books).select("vec_id", named.alias("key"), "code", "error"), "codes")
    each = out.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return with_looked_up(out, each, "key", "n", out.count()).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
