"""SimHash near-duplicates with pivot distance tables (operator 7).

``near_duplicates`` links texts whose 64-bit fingerprints differ in at most ``BITS`` bits:

1. A fingerprint of each whole text, from its word shingles (in the task that reads it).
2. Equal fingerprints are one node, so thousands of copies cost one row from here on.
3. The pivot table: distances of each node to ``2 x PIVOTS`` reference fingerprints for each of
   ``BLOCKS`` blocks. References come in pairs that differ in just one block, so half the
   difference of the two distances is a coordinate of that block alone. Two nodes with at most
   ``BITS`` differing bits have equal coordinates in at least ``BLOCKS - BITS`` blocks: candidates
   are the nodes that share a key of that many blocks' coordinates. Of these, pairs are discarded
   if a coordinate differs by more than ``BITS``, or the coordinates of one rank by more than that
   in sum (the triangle inequality rules them out), and survivors are verified on the fingerprints.
4. A bucket of more than ``PAIRS`` nodes isn't paired up. Its members list their neighbours at
   distance 0 and 1; two are linked iff they share a neighbour, and at most 65 fingerprints share
   one. Members of a key are linked to the smallest, which keeps what is reachable. This exact way
   covers all that step 3 leaves, so dense buckets are linked without the pivots.
5. Components of the links, and the smallest document of each.

So rows stay in proportion to the number of distinct fingerprints, however large a group.

``representatives`` keeps one row of each group of texts whose shingle sets are alike by
``LIKENESS`` or more. That is far more than two of 64 bits (a Jaccard likeness of 0.8 is 10 bits),
so fingerprints have ``LONG`` words here, and there are ``BANDS`` blocks of ``WIDTH`` bits, the bands. Each band has
``LONG_PIVOTS`` pairs of references that differ in just that band, so again half the difference of the two distances is a
coordinate of the band alone; candidates share all coordinates of a band (nodes with the same bits of a band always do). Within a bucket
the first node leads. Nodes are discarded if the triangle inequality rules them out: if the coordinates of one rank, over the
bands of a turn, which have no bit in common, differ by more in sum than the bits may. It is a candidate partner of those left
whose differing bits allow for the likeness; of those that don't seem alike the first leads next, and so
on. Large buckets are split by a hash into groups of ``GROUP`` nodes, whose leaders meet again in
the next round, so no task holds a hot bucket. Candidates are verified on their shingle sets. A
first dozen bands goes ahead: nodes that it links are no candidates of each other any more, so
large groups don't list a partner for each band.
Leaders only make groups small; they decide nothing. What they leave is done by ``rest``: of each bucket all pairs of
nodes that aren't linked by then, but those whose shingle sets can't be alike for sure. That is told by ``ODD`` bits of a set, each the
parity of its hashes in one class: sets differ in as many shingles as these bits, at least, and as their sizes. Its pairs are verified
too, so no two alike texts that share a band stay apart. Buckets beyond ``GROUP`` nodes are compared part by part; the nodes of
a bucket's largest group are linked already, so they meet only the others.
Bands may miss a pair: a pair of likeness 0.8 shares one with a chance of 0.81, of 0.85 0.96.

Null texts have no words and the fingerprint zero, and are like other texts without words. Texts
are read whole, however long. Null ids are kept by ``near_duplicates``; they never become a
component's id unless a component has no other, and ``representatives`` takes a row with an id
before one without. Of repeated rows ``near_duplicates`` returns all and ``representatives`` one;
ties between rows of one id and text are broken by the other columns. Extra columns may have any
name; ``representatives`` returns them. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, numbered, place, stored, text_of, with_looked_up
from .components import components

SEED = 42
BITS = 2
BLOCKS = 4
#: Pairs of reference fingerprints for each block.
PIVOTS = 6
#: Of ``representatives``: words of a shingle, likeness, words of a fingerprint, bits of a band,
#: bands, and nodes of a bucket that one task compares.
SHINGLE, LIKENESS = 5, 0.8
LONG = 8
WIDTH = 24
BANDS = 84
#: Bands that are worked on together: what the first ones link needs no more candidates.
PHASES = ((0, 12), (12, BANDS))
GROUP = 20_000
#: Pairs of reference fingerprints for each band (all their coordinates are a number below 25 ** 12, so that with the band it has
#: 63 bits), and of how many ranks of them the triangle inequality is tried.
LONG_PIVOTS, RANKS = 12, 2
#: Classes of hashes whose parities tell that two sets can't be alike.
ODD = 2048
#: Rows of 33 bytes that are broadcast, at most.
BROADCAST_ROWS = 500_000
#: The largest bucket whose pairs are compared.
PAIRS = 64
#: Shingles whose bits are counted at once.
AT_ONCE = 100_000


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    # bytes.lower() and bytes.split() know ASCII only, as asked for
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(words)))), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned: a bit is 1 if it is set in over half the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        ones += np.unpackbits(hashes[at : at + AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp bigint) for each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(df).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> list[list[tuple[int, int]]]:
    """For each block pairs of reference fingerprints, which differ in all bits of the block:
    hashes of their numbers, and these with the block inverted."""
    edge = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    out = []
    for i in range(BLOCKS):
        block = ((1 << (edge[i + 1] - edge[i])) - 1) << edge[i]
        first = [xxhash.xxh64_intdigest(f"pivot {i} {k}".encode(), SEED) for k in range(PIVOTS)]
        out.append([(signed(r), signed(r ^ block)) for r in first])
    return out


def pivot_table(nodes: DataFrame) -> DataFrame:
    """(fp, d): for each block its coordinates. A coordinate is the distance to a reference less
    that to its partner, halved, plus 32: never negative, and equal up to a constant to the
    block's own distance."""
    apart = lambda r: F.bit_count(F.col("fp").bitwiseXOR(F.lit(r)))
    coordinate = lambda pair: ((apart(pair[0]) - apart(pair[1])) / 2 + 32).cast("tinyint")
    return nodes.select("fp", F.array(*(F.array(*map(coordinate, pairs)) for pairs in references())).alias("d"))


def links(nodes: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` of ``nodes``. Where a bucket is
    large, those to the smallest fingerprint of each shared neighbour only."""
    chosen = list(combinations(range(BLOCKS), BLOCKS - BITS))
    keys = F.array(*(F.xxhash64(F.lit(t), *(F.col("d")[i][k] for i in blocks for k in range(PIVOTS))) for t, blocks in enumerate(chosen)))
    keyed = pivot_table(nodes).select("fp", "d", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n"))
    member = stored(with_looked_up(keyed, sizes, "key", "rows", nodes.count() * len(chosen)), "buckets")
    few = member.filter(F.col("n") <= pairs)
    x, y = few.select("key", F.col("fp").alias("a"), F.col("d").alias("da")), few.select("key", F.col("fp").alias("b"), F.col("d").alias("db"))
    differ = [[F.abs(F.col("da")[i][k] - F.col("db")[i][k]) for i in range(BLOCKS)] for k in range(PIVOTS)]
    near = [sum(d[1:], d[0]) <= BITS for d in differ]
    close = F.col("a") < F.col("b")
    for test in [*near, F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS]:
        close = close & test
    paired = x.join(y, "key").filter(close).select("a", "b")
    many = member.filter(F.col("n") > pairs).select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))
    shared = many.select("fp", F.explode(around).alias("near")).groupBy("near").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    starred = shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return paired.unionByName(starred).distinct()


def near_duplicates(df: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp bigint, component_id) for each row of ``df`` (doc_id, text)."""
    prints = stored(fingerprints(df, words, seed), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = components(links(nodes))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    named = stored(with_looked_up(rooted, least, "root", "nodes", total).select("fp", "n", "component_id"), "named")
    return with_looked_up(prints, named, "fp", "n", total).select("doc_id", "fp", "component_id")


def long_fingerprint(hashes: np.ndarray) -> list[int]:
    """``LONG`` fingerprints of a set of shingle hashes: of the hashes and of mixtures of them."""
    h, out = np.unique(hashes), []
    for i in range(LONG):
        x = h + np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF)
        if i:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out.append(fingerprint(x))
    return out


def radius(likeness: float, bits: int = 64 * LONG) -> int:
    """Bits that differ, on average, between sets of a Jaccard likeness: their vectors' angle."""
    return round(bits * math.acos(2 * likeness / (1 + likeness)) / math.pi)


def band_bits() -> list[np.ndarray]:
    """The bits of each band: every bit once, then every bit once in another order, and so on."""
    per, out = 64 * LONG // WIDTH, []
    for turn in range(-(-BANDS // per)):
        order = np.random.default_rng(turn).permutation(64 * LONG)
        out += [order[WIDTH * i : WIDTH * (i + 1)] for i in range(per)]
    return out[:BANDS]


def band_references() -> np.ndarray:
    """(band, WIDTH, LONG_PIVOTS): a band's bits in the first reference of each pair. In the second these are inverted, and
    outside the band the two are equal, so what they are there doesn't matter."""
    made = [[xxhash.xxh64_intdigest(f"band {t} {k}".encode(), SEED) for k in range(LONG_PIVOTS)] for t in range(BANDS)]
    return (np.array(made, np.uint64)[:, None] >> np.arange(WIDTH, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.float32)


def band_coordinates(fps: list[bytes], first: int, last: int) -> np.ndarray:
    """(n, bands, LONG_PIVOTS): the distance to a reference less that to its partner, halved, plus half of ``WIDTH``, for some of
    the bands: what is outside the band cancels out, so it is the distance within the band. From 0 to ``WIDTH``."""
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 8 * LONG), axis=1)
    own = bits[:, np.stack(band_bits()[first:last])].transpose(1, 0, 2).astype(np.float32)
    pivots = band_references()[first:last]
    apart = own.sum(axis=2)[..., None] + pivots.sum(axis=1)[:, None] - 2 * own @ pivots
    return apart.transpose(1, 0, 2).astype(np.int64)


def with_pivots(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fps and others) with pivots (binary): ``RANKS`` times the coordinates of the bands of the first turn."""
    names = nodes.columns
    at = names.index("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                made = band_coordinates(part.column(at).to_pylist(), 0, 64 * LONG // WIDTH)[..., :RANKS]
                made = np.ascontiguousarray(made.transpose(0, 2, 1)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in made], pa.binary())], [*names, "pivots"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("pivots", T.BinaryType())]))


def parities(hashes: np.ndarray) -> bytes:
    """``ODD`` bits of a set of hashes: a bit is 1 if an odd number of them is in its class."""
    return np.packbits((np.bincount((hashes % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)).tobytes()


def long_prints(rows: DataFrame, words: int) -> DataFrame:
    """The columns of ``rows`` but the last, its text, with fps (binary, 8 LONG bytes), many (its distinct shingles), odd
    (their parities) and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, many, odd = [], [], []
            for t in b.column(b.num_columns - 1):
                own = np.unique(shingle_hashes(t.as_py(), words, SEED))
                fps.append(np.array(long_fingerprint(own), np.uint64).tobytes())
                many.append(len(own))
                odd.append(parities(own))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.binary()), pa.array(many, pa.int32()), pa.array(odd, pa.binary())], [*names, "fps", "many", "odd"])

    names = rows.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, fps binary, many int, odd binary").withColumn("node", F.xxhash64("fps"))


def bands(nodes: DataFrame, first: int = 0, last: int = BANDS, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, node): of some of the bands of each node (node, fps) the coordinates, as one number; and columns ``also`` (bigint) of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (WIDTH + 1) ** np.arange(LONG_PIVOTS + 1, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = band_coordinates(part.column(1).to_pylist(), first, last) @ power[:-1] + np.arange(first, last) * power[-1]
                same = [pa.array(np.repeat(part.column(i).to_numpy(), last - first)) for i in (0, *range(2, 2 + len(also)))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *same], ["key", "node", *also])

    return nodes.select("node", "fps", *also).mapInArrow(run, ", ".join(f"{c} bigint" for c in ("key", "node", *also)))


def led(members: DataFrame, likeness: float) -> DataFrame:
    """(key, a, b) of ``members`` (key, part, parts, node, fps, root, pivots): of each part of a bucket,
    leaders a with the nodes b that may be alike (two standard errors are allowed for) and have
    another root, as those of one root are linked already; b is a where a leader has to meet those
    of other parts."""
    surely = radius(likeness)
    most = surely + round(2 * math.sqrt(surely * (1 - surely / (64 * LONG))))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows of one bucket's part, which may lie in several batches."""

        def whole() -> tuple:
            nodes, raw, roots, pivots = zip(*rows)
            near = np.frombuffer(b"".join(pivots), np.uint8).reshape(len(rows), RANKS, -1).astype(np.int16)
            return now[0], now[2], np.array(nodes), np.frombuffer(b"".join(raw), np.uint64).reshape(-1, LONG), np.array(roots), near

        now, rows = None, []
        for b in batches:
            for key, part, parts, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now != (key, part, parts):
                    if rows:
                        yield whole()
                    now, rows = (key, part, parts), []
                rows.append(row)
        if rows:
            yield whole()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for key, parts, nodes, prints, roots, pivots in groups(batches):
            left = np.ones(len(nodes), bool)
            while left.any():
                lead = int(left.argmax())
                # the triangle inequality first; only what it leaves is compared
                may = np.flatnonzero((np.abs(pivots - pivots[lead]).sum(axis=2) <= most).all(axis=1))
                apart = np.full(len(nodes), 64 * LONG + 1)
                apart[may] = np.bitwise_count(prints[may] ^ prints[lead]).sum(axis=1)
                near = (apart <= most) & (roots != roots[lead])
                near[lead] = parts > 1
                left &= apart > surely
                out += [(key, int(nodes[lead]), int(n)) for n in nodes[near]]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "a", "b"])

    return members.mapInArrow(run, "key bigint, a bigint, b bigint")


def candidates(nodes: DataFrame, total: int, likeness: float, group: int = GROUP, phase: tuple[int, int] = (0, BANDS)) -> DataFrame:
    """(a, b): pairs of nodes (node, fps, root, pivots) that share the coordinates of a band and may be alike; a led b."""
    keyed, edges, last = stored(bands(nodes, *phase), "bands"), [], None
    total *= phase[1] - phase[0]
    while True:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        member = with_looked_up(keyed, sizes.withColumn("parts", F.ceil(F.col("n") / group)).withColumn("rows", F.col("n")), "key", "rows", total)
        member = member.withColumn("part", F.pmod(F.xxhash64("node", F.lit(len(edges))), F.col("parts"))).join(nodes.select("node", "fps", "root", "pivots"), "node")
        dealt = member.select("key", "part", "parts", "node", "fps", "root", "pivots").repartition("key", "part").sortWithinPartitions("key", "part", "node")
        edges.append(stored(led(dealt, likeness), "alike"))
        discard(keyed)
        keyed = edges[-1].filter("a = b").select("key", F.col("a").alias("node"))
        n = keyed.count()
        if n == 0 or n == last:  # all buckets have met in one part, or leaders are all unlike
            break
        keyed, last = stored(keyed, "leaders"), n
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    # each pair once, its leader (of some bucket) first
    ends = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    once = every.filter("a <> b").groupBy(*ends).agg(F.min("a").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def parts_of(keyed: DataFrame, group: int) -> DataFrame:
    """(key, n, top, apart, whole) of each bucket of ``keyed`` (key, node, root) with several roots: its nodes, the root
    that most of them have, and of how many parts the others and those of that root are, ``group`` nodes each, about. Small buckets are one part."""
    per = keyed.repartition("key").groupBy("key", "root").agg(F.count("*").alias("m"))
    sizes = per.groupBy("key").agg(F.count("*").alias("roots"), F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("most")).filter("roots > 1")
    small = F.col("n") <= group
    apart = F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("most.m")) / group)).alias("apart")
    return sizes.select("key", "n", F.when(~small, F.col("most.root")).alias("top"), apart, F.when(small, 0).otherwise(F.ceil(F.col("most.m") / group)).alias("whole"))


def unlinked(members: DataFrame, likeness: float) -> DataFrame:
    """(a, b) of ``members`` (key, one, two, part, node, root, many, odd): the pairs of a block whose roots differ and whose sets may be
    alike, a's the smaller. A block is a part ``one`` of a bucket with itself, or the pairs that two parts have between them."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
        now, rows = None, []
        for b in batches:
            for key, one, two, *row in zip(*(c.to_pylist() for c in b.columns)):
                if now != (key, one, two):
                    if rows:
                        yield now[1] != now[2], rows
                    now, rows = (key, one, two), []
                rows.append(row)
        if rows:
            yield now[1] != now[2], rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], ["a", "b"])
            made.clear()
            return out

        for between, rows in groups(batches):
            part, node, root, many = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
            order = np.lexsort((node, many))
            part, node, root, many = part[order], node[order], root[order], many[order]
            odd = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)[order]
            # a set of fewer shingles than this share of another's isn't like it; one more, as shares are rounded
            ends, held = np.searchsorted(many, many / likeness + 1, "right"), 0
            for i, end in enumerate(ends.tolist()):
                may = root[i + 1 : end] != root[i]
                if between:
                    may &= part[i + 1 : end] != part[i]
                at = np.flatnonzero(may) + i + 1
                if not len(at):
                    continue
                apart = np.maximum(np.bitwise_count(odd[at] ^ odd[i]).sum(axis=1, dtype=np.int64), many[at] - many[i])
                both = many[at] + many[i]
                at = at[both - apart >= likeness * (both + apart) - 1e-6 * both]
                if len(at):
                    made.append((np.full(len(at), node[i]), node[at]))
                    held += len(at)
                if held > 100_000:
                    yield told()
                    held = 0
            if len(made) > 1000:
                yield told()
        if made:
            yield told()

    return members.mapInArrow(run, "a bigint, b bigint")


def rest(nodes: DataFrame, total: int, likeness: float, group: int = GROUP) -> DataFrame:
    """(a, b): all pairs of nodes (node, fps, root, many, odd) that share the coordinates of a band, have different roots and may be
    alike. Each is there once. Nothing but what is sure is left out."""
    keyed = stored(bands(nodes, also=("root",)), "bands")
    parts = stored(parts_of(keyed, group), "parts")
    member = with_looked_up(keyed, parts, "key", "n", total * BANDS)
    h = lambda n: F.pmod(F.xxhash64("node", F.lit("part")), n)
    whole = F.coalesce(F.col("root") == F.col("top"), F.lit(False))
    part = F.when(whole, F.col("apart") + h(F.greatest("whole", F.lit(1)))).otherwise(h(F.col("apart")))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(whole, F.col("apart")).otherwise(F.col("apart") + F.col("whole")) - 1)
    dealt = member.select("key", "node", part.alias("part"), F.explode(others).alias("other"))
    blocks = dealt.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "node").join(nodes.select("node", "root", "many", "odd"), "node")
    sorted_ = blocks.select("key", "one", "two", "part", "node", "root", "many", "odd").repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    pairs = stored(unlinked(sorted_, likeness).distinct(), "rest")
    for t in (keyed, parts):
        discard(t)
    return pairs


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles binary): sorted distinct hashes of the shingles of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t.as_py(), words, SEED)).tobytes() for t in b.column(1)], pa.binary())], ["node", "shingles"])

    # equal texts may stand for a node more than once
    return texts.mapInArrow(run, "node bigint, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have a Jaccard likeness of at least ``likeness``.
    Hubs are leaders, so b's set is joined first: a leader's pairs then are as large as their sets, and
    Spark's skew join splits them over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= likeness * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for end in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set")).hint("merge"), end)
    return pairs.select("a", "b", "a_set", "b_set").mapInArrow(run, "a bigint, b bigint")


def representatives(df: DataFrame, words: int = SHINGLE, likeness: float = LIKENESS, group: int = GROUP) -> DataFrame:
    """The rows of ``df`` that stay: of each group of alike texts the one with the smallest
    doc_id, of rows with one id the one whose text has the smallest hash."""
    own = numbered(df)
    text, key = F.coalesce(F.col(place(df, "text")), F.lit("")), F.col(place(df, "doc_id")).cast("bigint")
    # a row is told by its id and two hashes of its text; none of these is null
    told = {"_none": key.isNull(), "_id": F.coalesce(key, F.lit(0)), "_x": F.xxhash64(text), "_y": F.xxhash64(F.lit(1), text)}
    rows = own.withColumns(told)
    prints = stored(long_prints(rows.select(*told, text.alias("text")), words), "prints")
    top = F.struct(*told)
    nodes = prints.groupBy("node").agg(F.min("fps").alias("fps"), F.min(F.struct(top.alias("top"), "many", "odd")).alias("first"))
    nodes = stored(with_pivots(nodes.select("node", "fps", "first.*")), "nodes")
    discard(prints)
    total = nodes.count()
    rooted, edges = nodes.withColumn("root", F.col("node")), None
    for phase in (*PHASES, None):
        pairs = stored(candidates(rooted, total, likeness, group, phase), "candidates") if phase else rest(rooted, total, likeness, group)
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        tops = stored(nodes.join(ends, "node", "left_semi").select("node", "top.*"), "ends")
        few = F.broadcast(tops) if tops.count() <= BROADCAST_ROWS else tops
        sets = stored(shingle_sets(rows.withColumn("text", text).join(few, list(told)).select("node", "text"), words), "shingles")
        good = stored(verified(pairs, sets, likeness), "links")
        for t in (pairs, tops, sets):
            discard(t)
        edges = edges.unionByName(good) if edges is not None else good
        rooted = stored(nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    kept = rooted.groupBy("root").agg(F.min("top").alias("top")).select("top.*")
    orderable = [f.name for f in own.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    # repeats of a row are reduced to one in each task, before the shuffle
    one = F.min_by(F.struct(*own.columns), F.struct(*orderable, F.lit(0)))
    return rows.join(kept, list(told), "left_semi").groupBy(*told).agg(one.alias("_row")).select("_row.*").toDF(*df.columns)
