"""Whole-token counts against the library, codes and repair against plain versions, odd inputs of each."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import conversations, oracles, registry, tokencounts, vectorcodes

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


# 11


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return tokencounts.WordBpe(PATH)


def library_count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proven(library, bpe):
    """Of all vocabulary strings just those that the library encodes alone as one token."""
    for text in random.Random(0).sample(sorted(bpe.whole), 3000):
        assert library.encode(text, add_special_tokens=False).tokens == ["".join(tokencounts.byte_alphabet()[b] for b in text.encode()) + "</w>"] or len(bpe.words.findall(tokencounts.lowered(text))) != 1 or tokencounts.lowered(text) != text
    others = [t.removesuffix("</w>") for t in library.get_vocab() if t.endswith("</w>") and t.isascii() and t.removesuffix("</w>") not in bpe.whole]
    assert all(library_count(library, t) != 1 for t in others if t and bpe.words.findall(t) == [t])


@pytest.mark.parametrize("stretch", [5, 1 << 20])
def test_counts_equal_the_library(library, bpe, monkeypatch, stretch):
    monkeypatch.setattr(tokencounts, "STRETCH", stretch)
    some = ["a", "B", "é", "é", "Σ", "σ", "ς", " ", " ", " ", "\x1c", "\x85", "　", "'s", "'S", "1", "٣", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "İ", "ß", "ǅ", "\n", "Å", "!!", "ﬁ", "the", "ing"]
    rng = random.Random(stretch)
    for _ in range(3000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 30)))
        assert bpe.count(text) == library_count(library, text), repr(text)


def test_every_character(library, bpe):
    """All of the basic plane and beyond that both sides' Unicode versions know."""
    import unicodedata

    known = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    got = [bpe.count(f"a{c}b {c}") for c in known]
    want = [len(e.ids) for e in library.encode_batch([f"a{c}b {c}" for c in known], add_special_tokens=False)]
    assert [c for c, g, w in zip(known, got, want) if g != w] == []


def test_counts_of_odd_rows(spark, library):
    long = "the unbelievablest cat " * 50_000 + "x" * 200_000
    rows = [(1, "The cat's hat."), (2, None), (3, ""), (None, "no id"), (5, " \n\t"), (5, " \n\t"), (6, long), (7, "ba<|endoftext|>na")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_tokens": F.lit("x"), "id": F.lit(1), "TEXT ": F.lit(2), "n bytes": F.struct(F.lit(1).alias("a b"))})
    got = tokencounts.counts(df, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((i, len((t or "").encode()), library_count(library, t or ""), library_count(library, t or "") > 2048) for i, t in rows)
    assert Counter(map(tuple, got.collect())) == want
    assert tokencounts.counts(df.limit(0), PATH).count() == 0


# 12


def plain_codes(rows, entries=256):
    """rows: (vec_id, vector, label); as the contract says, with Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    edge = [d * i // 4 for i in range(5)]
    cut = lambda v: [v[a:b] for a, b in zip(edge, edge[1:])]
    fit = [r for r in kept if len(r[1]) == d]
    books = [[cut(v)[p] for _, v, _ in fit[:entries]] for p in range(4)]
    apart = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, book: min((apart(x, c), e) for e, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            of = {}
            for _, v, _ in fit:
                of.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for e, members in of.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, g in kept:
        best = [near(x, books[p]) for p, x in enumerate(cut(v))] if len(v) == d else None
        out.append((i, "".join(f"{e:02x}" for _, e in best) if best else None, sum(a for a, _ in best) if best else None, g))
    total = Counter()
    for _, _, error, g in out:
        total[g] += error or 0
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((repr((i, c, e, total[g], sha)) for i, c, e, g in out))


def test_codes_by_plain_version(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    rows = [(int(i), [float(np.float32(x)) for x in centre[i % 40] + rng.normal(size=16) * 0.1], int(i % 3) if i % 5 else None) for i in range(500)]
    rows += [(7, rows[7][1], 9), (None, rows[8][1], 9), (600, None, 1), (601, [1.0, None] * 8, 1), (602, [float("nan")] * 16, 1), (603, [float("inf")] * 16, 1), (604, [-0.0, 0.5] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"code": F.lit(1), "v": F.lit("x"), "Label ": F.lit(3), "a b": F.create_map(F.lit(1), F.lit(2))})
    got = vectorcodes.compressed(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.5] * 8, 1)], [(1, [0.25] * 8, 1)] * 5 + [(2, [1.0] * 8, 2)], [(1, [0.5] * 6, None), (2, [0.1] * 6, 1)], [(1, [], 1), (2, [], 1)]])
def test_codes_of_odd_rows(spark, rows):
    got = vectorcodes.compressed(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted(repr(tuple(r)) for r in got) == (plain_codes(rows) if rows else [])


def test_other_lengths_stay(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 4, 1), (3, [0.25] * 8, 1)]
    got = {r["vec_id"]: r for r in vectorcodes.compressed(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert got[2]["code"] is None and got[2]["error"] is None and got[1]["code"] == "00000000" and len(got) == 3
    with pytest.raises(Exception, match="below"):
        vectorcodes.compressed(spark.createDataFrame([(1, [1e9] * 8, 1)], "vec_id bigint, embedding array<float>, label int")).collect()


@pytest.mark.parametrize("scale", [3, 1000, 1 << 25])
def test_bounds_lose_no_nearest_entry(scale):
    rng = np.random.default_rng(scale)
    for width in (1, 5, 16):
        entries = rng.integers(-scale, scale, (64, width))
        entries[32:40] = entries[:8]
        x = np.concatenate([rng.integers(-scale, scale, (900, width)), entries, entries + 1])
        book = vectorcodes.Codebook(entries)
        index, distance = book.nearest(x)
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_bounds_discard_entries():
    rng = np.random.default_rng(1)
    centre = rng.integers(-2000, 2000, (256, 16))
    x = centre[rng.integers(0, 256, 4000)] + rng.integers(-100, 100, (4000, 16))
    book = vectorcodes.Codebook(centre)
    book.nearest(x)
    assert book.verified < 0.05 * len(x) * 256


# 13

PATTERN = re.compile(r"(s?(ua)+)?$")
PREFIX = re.compile(r"(s?(ua)*u?)?$")


def plain_repair(rows):
    """rows: (initial, has to go, truncated). Least (cost, audit) by trying edits in that order."""
    queue = [(0, "", 0, "")]
    while True:
        cost, audit, i, made = heapq.heappop(queue)
        if i == len(rows) and PATTERN.match(made):
            return cost, audit
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, made))
            for c in "" if gone else "ua":
                if PREFIX.match(made + c):
                    heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", i + 1, made + c))
            if not gone and initial in ("s", "u", "a") and PREFIX.match(made + initial):
                heapq.heappush(queue, (cost + 3 * cut, audit + "K", i + 1, made + initial))
        for c in "ua":
            if PREFIX.match(made + c):
                heapq.heappush(queue, (cost + 3, audit + "I", i, made + c))


def test_cheapest_edits_by_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        rows = [(rng.choice("suaxuaua"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        codes = bytes((conversations.INITIALS.find(c) if c in "sua" else 3) | (4 if gone else 8 if cut else 0) for c, gone, cut in rows)
        want = plain_repair([(c, gone, cut and not gone) for c, gone, cut in rows])
        for stretch in (1, 2, 3, 4096):
            assert conversations.cheapest(codes, stretch) == want, rows


def plain_report(rows):
    """rows: (conv_id, turn, role, text) of the undamaged table."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if act == 0:
            continue
        text = "" if act == 1 else re.sub(r"[.!?]", "", text) if act == 2 else text
        role = "user" if act == 4 else role
        mark = hashlib.sha256(f"{len(role)}\x00{role}\x00{text}".encode()).hexdigest()
        convs[conv] += [(turn is not None, turn or 0, role, mark, text, turn)] * (2 if act == 3 else 1)
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: r[:4])
        seen, faults, coded = set(), Counter(), []
        for *_, role, _, text, _ in found:
            fault = "blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[-1] for r in found if r[-1] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit = plain_repair(coded)
        i, made, lines = 0, "", []
        for e in audit:
            role, text = (found[i][2], found[i][4]) if e != "I" else ("", "")
            i += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "user" if PREFIX.match(made + "u") else "assistant"
            made += role[0]
            lines.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return Counter(out)


def repaired(df):
    return conversations.report(conversations.repair(conversations.damaged(df)))


KIND = "conv_id bigint, turn bigint, role string, text string"


def odd_rows():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["Hi.", "Yes!", "what", "", " \t", "ok?  ", None, "Hi.", "Ärger.", " ", "a.\x85"])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (200, None, "user", "a."), (200, None, "user", "a."), (200, None, "assistant", "b."), (201, None, "user", "x")]
    return rows + rows[:9] + [(300, 1, "user", "long " * 200_000), (300, 2, "assistant", "Yes.")]


def test_repair_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 1000)
    rows = odd_rows()
    df = spark.createDataFrame(rows, KIND).withColumns({"alive": F.lit("x"), "fault": F.lit(1), "Turn ": F.lit(1), "step": F.struct(F.lit(1).alias("a b"))})
    got = repaired(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_report(rows)
    assert repaired(df.limit(0)).count() == 0


def test_one_conversation_holds_all_rows(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {rng.randint(0, 4000)}{rng.choice(['.', ''])}") for t in range(9000)]
    edits = conversations.repair(spark.createDataFrame(rows, KIND)).collect()
    facts, edits = edits[0], edits[1:]
    assert [e["step"] for e in edits] == list(range(1, len(edits) + 1))
    kept = [e["role"] for e in edits if e["role"]]
    assert kept == ["user", "assistant"] * (len(kept) // 2)
    cut = {t for _, _, _, t in rows if t[-1] != "."}
    price = {"K": 0, "R": 3, "D": 4, "I": 3}
    assert facts["cost"] == sum(price[e["edit"]] + 3 * (e["text"] in cut) for e in edits)


def test_lost_conversations_stay(spark):
    gone = [(c, t, "user", "a.") for c in range(400) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = repaired(spark.createDataFrame(gone, KIND)).collect()
    assert len(got) == len({c for c, *_ in gone})
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("name", ["op12_segment_bounds", "op13_bucket_queue_repair"])
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    assert got.columns == [x[0] for x in want.description]
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    assert oracles.codes_sql() and oracles.repair_sql()


def test_counts_of_the_whole_table(spark, library):
    got = registry.op11_whole_tokens(spark, SF)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library_count(library, texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], len(texts[r["doc_id"]].encode()), n, n > 2048)
