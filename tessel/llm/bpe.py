"""Byte-level BPE encoding and decoding (operator 6).

A text is cut into pre-tokens by the published pattern of byte-level BPE; each pre-token is
merged with a priority queue of merge ranks over a doubly linked list of symbols. Entries of
the queue that no longer describe two neighbouring symbols are stale and skipped. Decoding
concatenates vocabulary strings and maps them back to bytes.

Work in tasks is a mapInArrow over batches of documents; the vocabulary (50k entries, a fixed
size) is read once in each Python worker from the path given. Results for chunks of text are
kept in a dictionary that is emptied when it holds ``CACHE`` entries, which bounds memory.

Null texts count as empty: no ids, hash of the empty string. Very long texts take memory in
proportion to their longest pre-token (some 190 bytes a character while its queue is worked off;
0.2 GB for a word of 1 MB), besides their ids. Equal ranks are merged from left to right, as the
library does. Columns other than the id and the text aren't read, so clashing names do no harm;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_of

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's dictionary of chunks; some 200 bytes each.
CACHE = 600_000
#: Longer chunks aren't kept.
LONGEST_KEPT = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: bytes that print as themselves stay,
    the others take the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Chunked:
    """Splits texts at spaces where a pre-token always begins, and keeps the ids of chunks."""

    whole: dict[str, bytes]

    def chunk(self, text: str) -> bytes:
        raise NotImplementedError

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= LONGEST_KEPT:
            if len(self.whole) >= CACHE:
                self.whole.clear()
            self.whole[piece] = ids

    def spaced(self, text: str) -> bytes:
        """Ids (unsigned 32-bit, native order) of a text.

        A pre-token always begins at a space whose predecessor isn't white space. So whole
        pieces between spaces are looked up; one that is empty or ends in white space is joined
        to its successors first.
        """
        pieces = text.split(" ")
        out = list(map(self.whole.get, pieces))
        n, i, out[0] = len(pieces), 0, None
        while True:
            try:
                i = out.index(None, i)
            except ValueError:
                return b"".join(out)
            piece, j = " " * (i > 0) + pieces[i], i + 1
            while j < n and (not piece or piece[-1].isspace()):
                piece += " " + pieces[j]
                out[j] = b""
                j += 1
            out[i] = self.chunk(piece)
            if i and j == i + 1 and pieces[i] and not piece[-1].isspace():
                self.keep(pieces[i], out[i])
            i = j


class ByteBpe(Chunked):
    """Vocabulary and merges of a tokenizers file whose model is byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, shown = spec["model"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(shown)}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = [vocab[c] for c in shown]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kept: dict[str, bytes] = {}
        self.whole = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbol = [self.byte_id[b] for b in word]
        n = len(symbol)
        if n == 1:
            return symbol
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, queue = self.merge, []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found:
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # stale: one of the two symbols has been merged since
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((new, symbol[k])):
                    heapq.heappush(queue, (found[0], i, new, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((symbol[h], new))):
                heapq.heappush(queue, (found[0], h, symbol[h], new, found[1]))
        return [s for s in symbol if s >= 0]

    def pretoken(self, word: str) -> bytes:
        found = self.kept.get(word)
        if found is None:
            found = array.array("I", self.merged(word.encode())).tobytes()
            if len(word) <= LONGEST_KEPT:
                if len(self.kept) >= CACHE:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.pretoken, self.words.findall(text)))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers in native order."""
        if not self.cut or not self.cut.search(text):
            return self.spaced(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.spaced(text[at : m.start()]), array.array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.spaced(text[at:])])

    def encode(self, text: str) -> list[int]:
        return array.array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One instance for each Python worker."""
    if path not in LOADED:
        LOADED[path] = ByteBpe(path)
    return LOADED[path]


def little_endian(ids: bytes) -> bytes:
    a = array.array("I", ids)
    if array.array("I", [1]).tobytes()[0] != 1:
        a.byteswap()
    return a.tobytes()


def encode(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded string) for each row of ``df`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], [key, "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_of(df).alias("text")).mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")


def digests(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the digests of what ``encode`` gives, made
    in the task so that neither ids nor texts leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                raw = bpe.encode_bytes(t)
                ids = array.array("I", raw)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(little_endian(raw)).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_of(df).alias("text")).mapInArrow(run, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
