"""Token counts by a whole-token shortcut (operator 11).

The vocabulary is a BPE with word ends: texts are normalised (NFC, lower case), cut into
pre-tokens, and each pre-token's bytes, the last of them marked as a word's end, are merged by
rank. Before any text is read, every vocabulary string that ends a word is merged from its bytes;
those that come out as one token form the table of whole tokens. A pre-token of that table counts
as one without any merging, and only the others are merged (priority queue of ranks over a linked
list), each once as long as it stays in a bounded dictionary.

Texts are counted in the tasks that read them (mapInArrow, no shuffle). The vocabulary (a fixed
size) is read once in each Python worker. Texts are worked off in stretches of some ``STRETCH``
characters cut before a space, where no pre-token, special string or composed character can lie
across; so memory is bounded by the longest word.

Null texts count as empty: no bytes, no tokens. Texts are counted whole, however long. Equal ranks
are merged from left to right. Special tokens' strings inside a text are one token each, as is the
library's default. Columns other than the id and the text aren't read, so clashing names do no
harm; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import numbered, place

#: Fixed value: the published pre-token pattern of this vocabulary; white space is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Characters that are worked off at once, about.
STRETCH = 1 << 20
#: Entries of a worker's dictionary of merged pre-tokens, and the longest that is kept.
CACHE, LONGEST_KEPT = 400_000, 64
LIMIT = 2048


def lowered(text: str) -> str:
    """NFC, then each character's own lower case, whatever stands beside it (Python would give a
    sigma that ends a word its final form)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class WordBpe:
    """Counts by a tokenizers file whose model is a byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, shown = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.inner, self.last = [vocab[c] for c in shown], [vocab[c + WORD_END] for c in shown]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.words = regex.compile(PATTERN)
        self.whole = self.proven(vocab, {c: b for b, c in enumerate(shown)})
        self.merged: dict[str, int] = {}

    def proven(self, vocab: dict[str, int], byte_of: dict[str, int]) -> dict[str, int]:
        """The texts of those vocabulary strings that end a word and merge to just one token."""
        out = {}
        for token in vocab:
            if token.endswith(WORD_END):
                raw = bytes(byte_of[c] for c in token.removesuffix(WORD_END))
                try:
                    text = raw.decode()
                except UnicodeDecodeError:  # part of a character: never a pre-token
                    continue
                if raw and len(self.tokens(raw)) == 1:
                    out[text] = 1
        return out

    def tokens(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < end and (found := self.ranks.get((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, j, ids[i], ids[j], found[1]))

        for i in range(end - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, left, right, new = heapq.heappop(queue)
            if ids[i] != left or ids[j] != right or after[i] != j:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [i for i in ids if i >= 0]

    def rest(self, word: str) -> int:
        """Tokens of a pre-token that isn't a whole token."""
        n = self.merged.get(word)
        if n is None:
            n = len(self.tokens(word.encode()))
            if len(word) <= LONGEST_KEPT:
                if len(self.merged) >= CACHE:
                    self.merged.clear()
                self.merged[word] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        words = self.words.findall(lowered(text))
        counts = list(map(self.whole.get, words))
        single = counts.count(1)
        if single == len(words):
            return single
        return single + sum(self.rest(w) for w, c in zip(words, counts) if c is None)

    def count(self, text: str) -> int:
        n, at = 0, 0
        while at < len(text):
            end = len(text) if len(text) - at <= STRETCH else text.find(" ", at + STRETCH)
            part = text[at : end if end > 0 else len(text)]
            if self.special and (found := self.special.split(part))[1:]:
                n += len(found) - 1 + sum(map(self.plain, found))
            else:
                n += self.plain(part)
            at += len(part)
        return n


LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One instance for each Python worker."""
    if path not in LOADED:
        LOADED[path] = WordBpe(path)
    return LOADED[path]


def counts(df: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of ``df`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            n = [bpe.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = numbered(df)
    text = F.coalesce(F.col(place(df, "text")), F.lit(""))
    rows = rows.select(F.col(place(df, key)).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
