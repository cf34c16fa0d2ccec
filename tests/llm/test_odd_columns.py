"""Columns of any type beside the text, models in parts, and parts of the classifiers by plain versions."""

import gzip
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import bpe, labelled, langid, lattice, nbsvm, simhash, toxicity, warc
from tessel.llm.components import components

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns of types that Python and Arrow can't all take."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    return docs.withColumns({"s": F.struct(F.lit(1).alias("a b"), F.lit("x").alias("c.d")), "i": F.expr("make_interval(1, 2, 0, 3)"), "v": F.expr("parse_json('{\"a\": 1}')"), "m": F.create_map(F.lit("k k"), F.array(F.lit(1))), "n": F.lit(None), "text copy": F.lit("t"), "day": F.expr("interval '3' day")})


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_columns_of_any_type(odd, spark, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, odd, SF)
    assert out.dtypes == odd.dtypes and 30 < out.count() <= odd.count()
    assert out.selectExpr("s.`a b` AS one", "map_keys(m)[0] AS k", "cast(v AS string) AS v", "cast(i AS string) AS i").distinct().count() == 1


def test_rows_that_differ_in_odd_columns_only(spark):
    df = spark.range(5).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("one two three four five six").alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.lit(None).alias("n"))
    assert simhash.representatives(df).count() == 1


def test_packing_takes_odd_columns(odd, spark):
    assert corpus_pipeline.STAGES[3][1](spark, odd, SF).select("doc_id").distinct().count() == odd.count()


def test_languages_in_parts(spark):
    r = random.Random(3)
    kinds = {f"l{i}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for i in range(9)}
    rows = [(i, " ".join(r.choice(kinds[k]) + r.choice(kinds[k]) for _ in range(40)), k) for i, k in enumerate(list(kinds) * 12)] + [(900, "", None), (901, None, None), (902, "12", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = {x.doc_id: x for x in langid.identified(df).collect()}
    for n in (1, 4):
        for x in langid.identified(df, languages=n).collect():
            y = whole[x.doc_id]
            assert (x.held_out, x.lang_pred, x.rejected) == (y.held_out, y.lang_pred, y.rejected)
            assert math.isclose(x.score, y.score, abs_tol=1e-5) and math.isclose(x.margin, y.margin, abs_tol=1e-5)
    assert len({x.lang_pred for x in whole.values()}) == 10


def test_document_frequencies_and_vectors_by_plain_counts(spark):
    texts = ["The cat. The dog", "où ça", "Über 12 dog", "cat"]
    train = spark.createDataFrame([(t,) for t in [*texts, "1 2 3"]], "text string")
    idf, n = langid.frequencies(train)
    bucket = lambda tri: int(np.flatnonzero(langid.trigram_counts(tri))[0])

    def plain(text):
        words = re.findall(r"[^\W\d_]+", text)
        joined = "\0" + "\0".join(w.lower() for w in words) + "\0"
        return Counter(joined[i : i + 3] for i in range(len(joined) - 2))

    assert n == 4
    used = Counter()
    for t in texts:
        used.update(set(plain(t)))
        assert langid.trigram_counts(t).sum() == sum(plain(t).values())
    inner = [x for x in used if "\0" not in x]
    for x in inner:
        mates = [y for y in used if "\0" not in y and bucket(f"{y}") == bucket(x)]
        assert len(mates) >= 1
    got = Counter(np.round(idf, 9).tolist())
    assert max(used.values()) == 2 and got[round(math.log(5 / 3) + 1, 9)] == sum(c == 2 for c in used.values()) and got[round(math.log(5 / 2) + 1, 9)] == sum(c == 1 for c in used.values())


def test_gzip_members_take_linear_time():
    def seconds(n):
        data = b"".join(gzip.compress(warc.record_text(i, "u", f"<p>{i}</p>", None).encode() + warc.END) for i in range(n))
        began = time.time()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == n
        return time.time() - began

    seconds(200)
    assert seconds(20_000) < 30 * seconds(2000)


def test_large_gzip_members(monkeypatch):
    data = [gzip.compress(warc.record_text(i, "u", "x" * n, None).encode() + warc.END) for i, n in enumerate((100_000, 10, 300_000, 20))]
    assert [x[0] for x in warc.salvage(b"".join(data))] == ["record"] * 4
    assert [x[0] for x in warc.salvage(b"".join(data)[:-5])] == ["record"] * 3 + ["gap"]
    monkeypatch.setattr(warc, "MEMBER_BYTES", 200_000)
    found = list(warc.salvage(b"".join(data)))
    assert [x[0] for x in found] == ["record", "record", "gap", "record"] and found[2][3] == "gzip member is too large"


@pytest.mark.parametrize("bound", [0, 10, 500_000])
def test_components_in_one_task_and_spread_out(spark, bound):
    r = random.Random(bound)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(7, None), (5, 5)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {x.node: x.root for x in components(df, bound).collect()}
    assert got == {i: find(i) for i in range(400) if find(i) != i}
    assert components(df.limit(0), bound).count() == 0


def test_long_frequent_words_are_told_by_a_hash(spark, monkeypatch):
    monkeypatch.setattr(lattice, "SHARE", 0.01)
    word = "x" * 30_000
    df = spark.createDataFrame([(i, f"{word} the cat {word} y{i}") for i in range(20)], "doc_id bigint, text string")
    got = lattice.likelihoods(df, public.path("piece_bpe_32k.model")).collect()
    train = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1]
    n, v = 6 * len(train), 4 + len(train)
    for r in got:
        c = [2 * len(train), len(train), len(train), 2 * len(train), int(r.doc_id in train), len(train)]
        assert r.n_known == sum(x > 0 for x in c) and math.isclose(r.base_score, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), rel_tol=1e-9)


# The toxicity model by plain versions

TEXTS = ["You are an IDIOT!!! and stupid, you id1ot", "a clean text", "", "   ", "s t u p i d person", "SHOUTING WORDS here", "so coooool and heyyyy", "f***ing trash you scum " * 40, "tu es un clown, toi", "zorbly zorbly frag you", "é日本 you ⁂", "x" * 5000, "i.d.i.o.t and l-o-s-e-r"]
LEARNED = frozenset({"1=zorbly", "2=frag", "1zorb*", "2clea*"})


def plain_features(text):
    words = text.split()
    if not words:
        return [0.0] * 18
    entries = lambda w: [e for e in LEARNED if w and (e[1:] == f"={w}" or e[-1] == "*" and e[1:-1] == w[: len(e) - 2] and len(w) >= len(e) - 2)]
    shown = [toxicity.plain(w) for w in words]
    fixed = [w in toxicity.INSULTS for w in shown]
    once = [any(e[0] == "1" for e in entries(w)) for w in shown]
    twice = [sorted(e for e in entries(w) if e[0] == "2") for w in shown]
    use = Counter(x[0] for x in twice if x)
    again = [bool(x) and use[x[0]] > 1 for x in twice]
    second = [i for i, w in enumerate(shown) if w in toxicity.SECOND]
    hit = [i for i in range(len(words)) if fixed[i] or once[i] or again[i]]
    apart = sum(toxicity.plain(re.sub(r"[ .\-_*]", "", m[0])) in toxicity.INSULTS or any(e[0] == "1" for e in entries(toxicity.plain(re.sub(r"[ .\-_*]", "", m[0])))) for m in toxicity.APART.finditer(text)) if toxicity.SINGLES.search(text) else 0
    n, c = len(words), len(text)
    densest = max((sum(h <= x < h + 50 for x in hit) for h in hit), default=0)
    near = sum(any(abs(h - s) <= 5 for s in second) for h in hit)
    marks = sum(33 <= ord(x) < 127 and not x.isalnum() for x in text)
    runs = sum(text[i] == text[i + 1] == text[i + 2] and ord(text[i]) > 64 for i in range(c - 2))
    shouted = sum(len(w) > 2 and w.isupper() for w in words)
    hidden = sum(not w.isalpha() and bool(toxicity.HIDDEN.search(w)) for w in words)
    return [sum(fixed), sum(once), sum(fixed) / n, sum(once) / n, sum(again) / n, max(use.values(), default=0), len(hit) + apart, densest, len(second) / n, near, sum("A" <= x <= "Z" for x in text) / c, shouted / n, marks / c, text.count("!") / c, hidden / n, runs / c, apart, math.log1p(n)]


@pytest.mark.parametrize("text", TEXTS)
def test_features_by_plain_version(text):
    assert np.allclose(toxicity.Features(LEARNED).of(text), plain_features(text))


def labelled_texts(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("the a cat dog ran over under house tree blue green day".split()) for _ in range(40)) + (" zorbly grumpfish zorbly you" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict(rows)


def test_learned_lexicon_by_plain_ratios(spark):
    docs, labels, _ = labelled_texts(spark)
    sample = labelled.training_rows(docs, labels, "toxic", 1000)
    rows = [(r.text, r.y) for r in sample.collect()]
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    count = {}
    for text, y in rows:
        uses = Counter(e for w in text.split() for e in toxicity.beginnings(toxicity.plain(w)))
        for e, c in uses.items():
            for k in ("1", "2")[: 1 + (c > 1)]:
                count.setdefault(k + e, [0, 0])[y] += 1
    part = lambda x, m: x * math.log(x / m) if x else 0.0
    both = lambda x, m: part(x, m) + part(m - x, m)
    want = set()
    for e, (no, yes) in count.items():
        g = 2 * (both(yes, n[1]) + both(no, n[0]) - both(yes + no, sum(n)))
        if yes >= 3 and (yes / n[1]) / ((no + 0.5) / n[0]) >= 10 and g >= 2 * math.log(len(count)) + 6:
            want.add(e)
    assert toxicity.learned_lexicon(sample) == want and "1=zorbly" in want


def test_calibration_by_pool_adjacent_violators(spark):
    docs, labels, _ = labelled_texts(spark)
    marks = labels.withColumn("toxic", F.when(F.col("doc_id") % 29 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.Model(docs, marks)
    points = {}
    sample = labelled.training_rows(docs, marks, "toxic", toxicity.SAMPLE).filter(F.col("fold") < toxicity.CALIBRATION)
    for r in model.raw(toxicity.featured(sample, ["y"], model.learned)).collect():
        points.setdefault(r._q, []).append(r.y)
    blocks = []
    for q in sorted(points):
        blocks.append([sum(points[q]), len(points[q]), [q]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    want = {q: total / n for total, n, qs in blocks for q in qs}
    got = {r._q: r._score for r in model.scored(docs, []).collect()}
    assert len(want) >= 2 and all(math.isclose(got[q], s, abs_tol=1e-9) for q, s in want.items() if q in got)


def test_log_count_ratios_by_plain_counts(spark):
    docs, labels, texts = labelled_texts(spark)
    m = nbsvm.model(docs, labels.withColumn("quality", F.col("toxic")))
    assert m["r"] is not None and len(np.frombuffer(m["r"], np.float32)) > 0
    ratio = np.frombuffer(m["r"], np.float32)
    strange = set(nbsvm.features("zorbly grumpfish").tolist()) - set(nbsvm.features("the cat ran over the house").tolist())
    plain = set(nbsvm.features("the cat").tolist())
    assert max(ratio[list(strange)]) > 2 > max(abs(ratio[list(plain)]))
    assert bpe is not None and texts
