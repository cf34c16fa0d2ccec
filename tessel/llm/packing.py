"""Best-fit packing by sums of squares (operator 4).

Documents are tokenized, cut where they exceed a sequence, and packed so that few sequences are
needed. Each item goes where the sum over gaps of the squared number of open sequences with
that gap becomes smallest: either into an open sequence or into a new one.

Scale: tokens are made and digested in the task that reads the text; what is shuffled is some
40 bytes for each piece. Pieces that fill a sequence need no packing. The others are dealt in
turn into groups of at most about ``GROUP`` items, each packed on its own in one task (longest
first), so memory and time of a task are bounded and the loss is a few sequences for each group.

Null texts count as empty: one piece with the end token only. Very long texts become many pieces;
their ids are held by the task that reads them. Repeated rows are packed as often as they occur,
also where a whole table consists of one row. Null ids are kept. Only id and text are read, so
extra columns do no harm. Equal lengths are ordered by id, piece and digest. An empty table gives
an empty result.
"""

from __future__ import annotations

import array
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, ByteBpe, Chunked, little_endian
from .common import stored, text_of

CAPACITY = 2048
END = 0
#: Items that one task packs.
GROUP = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class LibraryIds(Chunked):
    """Ids of a tokenizers file, kept by chunk. Where the file's ids follow the order of its
    merges, as in byte-level BPE files they do, tiktoken's faster merge of ranks gives the same
    ids and is used for chunks without special tokens; otherwise the tokenizers library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole, self.ranks, self.special = {}, None, None
        bpe = ByteBpe(path)
        self.special = bpe.cut
        made = [new for _, new in sorted(bpe.merge.values())]
        if made == sorted(made) and max(bpe.byte_id) < min(made, default=1 << 31):
            import tiktoken

            ranks = {b: i for i, b in enumerate(bpe.bytes_of) if b and b.decode("utf-8", "replace") not in bpe.special}
            self.ranks = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def chunk(self, text: str) -> bytes:
        if self.ranks and not (self.special and self.special.search(text)):
            return array.array("I", self.ranks.encode_ordinary(text)).tobytes()
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


LOADED: dict[str, LibraryIds] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each row of ``df`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in LOADED:
            LOADED[path] = LibraryIds(path)
        ids_of = LOADED[path]
        end = array.array("I", [END]).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                out = []
                for d, t in zip(part.column(0).to_pylist(), texts):
                    ids = little_endian(ids_of.spaced(t) + end)
                    out += [(d, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(df).alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given. ``open_`` counts open bins by gap; a
    move from gap g to g - s changes the sum of squares by 2 (open[g - s] - open[g]) + 2, a new
    bin by 2 open[capacity - s] + 1, and a bin that becomes full no longer counts."""
    open_ = np.zeros(capacity + 1, np.int64)
    bins_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        now = open_[s:capacity]
        change = np.where(now > 0, 2 * (open_[: capacity - s] - now) + 2, np.iinfo(np.int64).max)
        if s < capacity and now[0] > 0:
            change[0] = 1 - 2 * now[0]
        k = int(change.argmin()) if s < capacity else -1
        if k < 0 or change[k] > 2 * open_[capacity - s] + 1:
            gap, b = capacity, made
            made += 1
        else:
            gap = s + k
            b = bins_at[gap].pop()
            open_[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        if left := gap - s:
            bins_at[left].append(b)
            open_[left] += 1
    return where, offset


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``items`` (PIECES; stored, as they are counted first) with sequence_id and offset."""
    full, rest = items.filter(F.col("length") >= capacity), items.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        whole = whole.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = sum_of_squares(whole["length"].to_numpy(), capacity)
        base = whole["task"][0].as_py() << 32
        out = whole.drop_columns(["task"]).append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=20_000)

    schema = f"{PIECES}, sequence_id bigint, offset bigint"
    # dealt in turn (after a sort of each task's rows, so a repeated task deals alike): equal rows
    # don't meet in one group
    packed = rest.repartition(groups).withColumn("task", F.spark_partition_id().cast("bigint")).mapInArrow(run, schema)
    # numbers of full sequences: negative, so that they meet none of the packed ones
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(alone)


def packed_documents(df: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document of ``df`` packed: the columns of PIECES, sequence_id and offset."""
    return pack(stored(pieces(df, path, capacity), "pieces"), capacity)
