"""Ranked search, language identification and whitening: brute force, accuracy, exact arithmetic."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from conftest import prose
from test_scoring import SF
from veriloom.llm import language, lexical, whitening
from veriloom.llm.tables import table

LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def slow_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in LETTERS or c >= "\x80":
            word += c
        else:
            out += [word] * (word != "")
            word = ""
    return out


def slow_rank(docs, items, k):
    """Every item against every document, term by term."""
    counted = [(i, Counter(slow_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in slow_terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_ranks_equal_brute_force(spark, awkward, seed):
    rng = random.Random(seed)
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    docs += [(100 + i, prose(seed * 1000 + i, rng.choice([3, 30, 300]), 60)) for i in range(150)] + [(500 - i, "tie tie w1") for i in range(40)]
    items = [(1, prose(seed, 25, 60)), (2, "TIE, w1; tie"), (3, None), (4, ""), (5, "nowhere-else"), (2, "w1"), (None, "Ünïcode éé ÉÉ w3"), (7, prose(1, 20_000)), (8, "w1 " * 500)]
    source = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, score int")
    got = lexical.rank(source, asked, k=7, shard_postings=400)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow_rank(docs, items, 7)
    if seed == 0:
        assert sorted(map(tuple, lexical.rank(source, asked, k=7, most_terms=3000).collect()), key=repr) == slow_rank(docs, items, 7)


def test_ranks_of_nothing(spark, awkward):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.rank(awkward.where("false"), items).count() == 0
    assert lexical.rank(awkward, items.where("false")).count() == 0
    assert lexical.rank(awkward.where("text is null or doc_id = 1"), items).count() == 0


def test_a_search_stops_where_all_is_resolved():
    rng = np.random.default_rng(5)
    n = rng.integers(5, 400, 4000)
    shard = lexical.Shard(n, np.arange(0, 8001, 2), np.tile([0, 1], 4000), rng.integers(1, 9, 8000), 4000, int(n.sum()))
    best = lambda doc, score: [(int(score[i]), int(doc[i])) for i in np.lexsort((doc, -score))[:5]]
    whole = best(*shard.search(np.array([0, 1]), np.array([5000, 3]), 5, 1, depth=4000))
    assert best(*shard.search(np.array([0, 1]), np.array([5000, 3]), 5, 1, depth=16)) == whole
    one = shard.search(np.array([0]), np.array([5000]), 5, 1, depth=16)  # one list: the first read is enough
    assert best(*one) == best(*shard.search(np.array([0]), np.array([5000]), 5, 1, depth=4000)) and shard.deepest == 4000
    assert shard.search(np.array([0]), np.array([5000]), 5, 1, depth=16)[0].size <= 64 and shard.deepest < 4000


def slow_model(rows, bits):
    """Counts of n-grams of single words, one by one, hashed as the model does."""
    counts, docs = {}, Counter()
    for text, lang in rows:
        docs[lang] += 1
        mine = counts.setdefault(lang, Counter())
        letters = "".join(c.lower() if c.isalpha() else " " for c in text)
        for word in letters.split():
            padded = f" {word} "
            for n in language.ORDERS:
                for i in range(len(padded) - n + 1):
                    gram = padded[i : i + n]
                    if n == 1 and gram == " ":
                        continue
                    h = n
                    for c in gram:
                        h = ((h ^ ord(c)) * 0x100000001B3) % 2**64
                    mine[(h * 0x9E3779B97F4A7C15) % 2**64 >> (64 - bits)] += 1
    return counts, docs


def test_language_model_equals_brute_force(spark):
    rng = random.Random(3)
    words = {"a": ["uno", "dos", "tres", "año"], "b": ["one", "two", "three", "ßtraße"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randrange(1, 9))) + ".", x) for i in range(60) for x in "ab"]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    model = language.train(docs)
    learned = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    counts, n_docs = slow_model(learned, model.bits)
    assert model.languages == ("a", "b")
    for i, x in enumerate(model.languages):
        total = sum(counts[x].values()) + 0.5 * 2**model.bits
        want = np.full(2**model.bits, math.log(0.5 / total))
        for bucket, n in counts[x].items():
            want[bucket] = math.log((n + 0.5) / total)
        assert np.allclose(model.weights[i], want, atol=1e-5)
        assert abs(model.prior[i] - math.log(n_docs[x] / len(learned))) < 1e-12
    texts = ["Uno, TWO año!", "x" * 3000, None, "12 .", "", "tres " * 1000]
    got, lettered = model.log_likelihoods(texts)
    for j, text in enumerate(texts):
        mine = slow_model([(text or "", "t")], model.bits)[0]["t"]
        assert lettered[j] == any(c.isalpha() for c in text or "")
        for i in range(2):
            assert abs(got[j, i] - sum(n * float(model.weights[i][b]) for b, n in mine.items())) < 1e-3 * max(1, len(text or ""))


def test_languages_of_awkward_rows(spark, awkward):
    docs = awkward.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "xx").when(F.col("doc_id") % 3 == 1, "yy"))
    out = language.identify(docs)
    rows = out.collect()
    assert len(rows) == awkward.count() and out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.lang_pred in ("xx", "yy", "und") and 0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and language.identify(docs.where("false")).count() == 0


def test_texts_in_pieces_are_scored_whole(spark, monkeypatch):
    model = language.Model(("a", "b"), 10, np.random.default_rng(1).normal(size=(2, 1024)).astype(np.float32), np.zeros(2))
    texts = [prose(i, 40) + " Ünï" for i in range(20)] + [None, "", "a" * 777]
    whole, _ = model.log_likelihoods(texts)
    monkeypatch.setattr(language, "_PIECE", 50)
    assert np.allclose(model.log_likelihoods(texts)[0], whole)


def test_languages_on_held_out_documents(spark):
    got = registry.queries()["op12_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.97


def test_inertia_counts():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in rng.uniform(-12, 12, 50):
        assert whitening.inertia(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[9, 5, 4, 1, 0.5], [7, 7, 7, 2, 2], [1, 1 - 1e-13, 1 - 1e-9, 0.5, 0.1], [1e8, 3, 2, 1, 1e-3], [4, 3, 0, 0, 0], [0, 0, 0, 0, 0], [2, 2, 2, 2, 2]])
def test_leading_eigenpairs(values):
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(5, 5)))[0]
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.leading(a, 4)
    want = np.sort(np.array(values, dtype=float))[::-1]
    want = want[want > 1e-14 * want[0]][:4] if want[0] else want[:0]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-10, atol=1e-13 * max(values[0], 1e-9))
    assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * got).max(initial=0) <= 1e-11 * max(values)


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(6)
    mixed = rng.normal(size=(300, 12)) @ (rng.normal(size=(12, 12)) * np.linspace(3, 0.1, 12)[:, None])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(mixed)] + [(300, None), (301, [None] * 12), (302, [float("nan")] * 12), (303, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (5, [float(x) for x in mixed[5]]), (304, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n string").repartition(4)
    got = whitening.whiten(df).collect()
    usable = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(usable), [sum(col) for col in zip(*(x for _, x in usable))]
    off = np.array([[n * c - s for c, s in zip(x, sums)] for _, x in usable], dtype=object)
    exact = Counter((i, int((row * row).sum())) for (i, _), row in zip(usable, off))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == exact and {r.n for r in got} == {n}
    centred = off.astype(float) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    for c in range(1, 9):
        value, v = values[-c], vectors[:, -c]
        mine = sorted(abs(r.whitened) for r in got if r.component == c)
        assert np.allclose(mine, np.sort(np.abs(centred @ v / math.sqrt(value))), atol=1e-9)
        assert {round(r.explained, 9) for r in got if r.component == c} == {round(value / np.trace(covariance), 9)}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_of_few_rows(spark):
    few = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert few([]).count() == 0 and few([(1, None)]).count() == 0 and few([(1, [1.0, 2.0])]).count() == 0
    assert few([(i, [0.5, 0.25]) for i in range(9)]).count() == 0
    line = few([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    two = few([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0]), (3, [4.0])]).collect()
    assert Counter(r.vec_id for r in two) == {0: 1, 1: 1, 2: 1, 3: 1} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in two)
    huge = few([(i, [1e12 * (i % 3), 1.0 * i]) for i in range(50)]).collect()
    assert {r.deviation for r in huge} == {None} or all(r.deviation is None or r.deviation >= 0 for r in huge)
