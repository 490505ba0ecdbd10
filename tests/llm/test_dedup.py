"""Near-duplicates, duplicated passages and decontamination against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
import xxhash

from veriloom.llm import decontaminate as D, simhash as S, substring as L
from veriloom.llm.components import connected_components


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=2):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius and root(a) != root(b):
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_fingerprints_and_components_equal_brute_force(spark, awkward):
    docs = [(r.doc_id, slow_fingerprint(r.text)) for r in awkward.collect()]
    roots = slow_components({f for _, f in docs})
    first = {}
    for d, f in docs:
        if d is not None:
            first[roots[f]] = min(first.get(roots[f], d), d)
    want = sorted(((d, f"{f:016x}", first.get(roots[f])) for d, f in docs), key=repr)
    got = sorted((tuple(r) for r in S.near_duplicates(awkward.select("doc_id", "text")).collect()), key=repr)
    assert got == want


def test_no_documents_have_no_near_duplicates(spark, awkward):
    none = awkward.where("false")
    assert S.near_duplicates(none.select("doc_id", "text")).count() == 0
    assert S.keep_one(none).columns == none.columns and S.keep_one(none).count() == 0


@pytest.mark.parametrize("max_shard", [4096, 2])
def test_links_of_random_fingerprints(spark, max_shard):
    rng, fps = random.Random(4), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(25):
            near = base
            for _ in range(rng.randint(1, 4)):
                near ^= 1 << rng.randrange(64)
            fps.add(near)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    pairs = connected_components(S.links(table, max_shard=max_shard)).collect()
    want = slow_components(fps)
    groups = {}
    for r in pairs:
        groups.setdefault(r.root, {r.root}).add(r.node)
    got = sorted(sorted(g) for g in groups.values())
    expected = {}
    for f, root in want.items():
        expected.setdefault(root, set()).add(signed(f))
    assert got == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_a_shard_of_near_copies_stays_cheap():
    rng, base, fps = random.Random(1), 12345, set()
    while len(fps) < 3000:
        near = base
        for _ in range(rng.randint(1, 3)):
            near ^= 1 << rng.randrange(64)
        fps.add(near)
    began = time.time()
    forest = S.spanning_forest(sorted(fps), 2)
    assert len(forest) == len(fps) - 1 and time.time() - began < 30


def test_components_of_a_path_and_a_star(spark):
    path, star = [(i, i + 1) for i in range(60)], [(1000, 1001 + i) for i in range(300)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 60 + 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark, awkward):
    kept = S.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == sorted({c for r in S.near_duplicates(awkward.select("doc_id", "text")).collect() if (c := r.component_id) is not None})
    assert sum(r.doc_id is None for r in rows) == 2


def test_rows_that_share_an_id_go_only_with_their_own_group(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(5, a), (5, b), (3, b), (7, a), (9, b), (5, a), (4, prose(3, 60)), (4, prose(4, 60))]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(5, a), (3, b), (4, prose(3, 60)), (4, prose(4, 60))})


def slow_removed(rows, width=50):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - width + 1 if doc is not None else 0):
            key = tuple(words[i : i + width])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        keep = [True] * len(words)
        for i in range(len(words) - width + 1 if doc is not None else 0):
            if first[tuple(words[i : i + width])] < doc:
                keep[i : i + width] = [False] * width
        kept = b" ".join(w for w, k in zip(words, keep) if k)
        out.append((doc, len(words), len(words) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def spliced(seed=9, n=120):
    """Documents that share passages of 40 to 120 words at any place, copies and repeated words."""
    rng = random.Random(seed)
    passages = [prose(100 + i, rng.randint(40, 120)) for i in range(8)]
    docs = []
    for i in range(n):
        parts = [prose(1000 + i, rng.randint(0, 80)), rng.choice(passages), prose(2000 + i, rng.randint(0, 60))]
        if rng.random() < 0.3:
            words = rng.choice(passages).split()
            parts.append(" ".join(words[rng.randint(0, 20) :]))
        if rng.random() < 0.1:
            parts.append("und " * rng.randint(40, 120))
        docs.append((i, " ".join(parts)))
    return docs + [(n, docs[3][1]), (n + 1, docs[3][1]), (3, docs[5][1])]


def test_removed_words_equal_brute_force(spark, awkward):
    rows = spliced() + [(None if r.doc_id is None else 500 + r.doc_id, r.text) for r in awkward.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in L.removed_words(docs).collect()), key=repr)
    assert got == slow_removed(rows)


def test_parse_is_greedy_and_crosses_factor_ends():
    # windows 0 to 3 are in document 1, 4 and 5 in document 2; 9 is alone; repeated rows do no harm
    looked_up = [(4, 1, 2), (0, 3, 1), (3, 1, 1), (5, 1, 2), (9, 1, 1), (3, 1, 1)]
    assert L.parse(looked_up) == [(0, 4, 1), (4, 2, 2), (9, 1, 1)]
    assert L.parse([]) == []


def test_hot_passages_make_a_row_a_block_at_most(spark):
    """A passage and a line of all documents, and copies: blocks and looked-up windows are linear."""
    line, passage = prose(1, 30), prose(2, 60)
    rows = [(i, f"{prose(10 + i, 40)} {line} {prose(20_000 + i, 40)} {passage} {prose(40_000 + i, 40)}") for i in range(300)] + [(1000 + i, prose(3, 200)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in L.removed_words(docs).collect()), key=repr)
    assert got == slow_removed(rows)
    found = L.referenced_windows(docs, L.dealt_by_id(docs)).collect()
    assert len(found) == 299 + 299 and all(sum(f.n for f in r.found) in (range(11, 17) if r.doc_id < 1000 else (151,)) for r in found)
    assert all(len(r.found) <= 30 for r in found)


def test_without_duplicates(spark, awkward):
    out = L.without_duplicates(awkward.withColumn("n_chars", awkward["doc_id"]))
    assert out.columns == [*awkward.columns, "n_chars"]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 14 not in ids and {0, 1, 2, 3, 5, 6, 12, 13} <= set(ids)
    assert L.removed_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_leaks(spark):
    items = [(i, f"Question {prose(300 + i, 40)}. {prose(700 + i, 6)}") for i in range(30)] + [(100, None), (101, "too short"), (1, f"Question {prose(301, 40)}. {prose(701, 6)}")]
    docs = [(i, f"{prose(5000 + i, 150)} {items[i][1] if i < 30 else ''} {prose(6000 + i, 150)}") for i in range(60)]
    words = items[2][1].split()
    for k in (3, 9, 15, 21, 27):
        words[k] = "other"
    docs += [(200, f"{prose(1, 90)} {' '.join(words)} {prose(2, 90)}"), (201, None), (202, ""), (203, items[5][1]), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.leaks(table, bench).collect()}
    assert found == {(i, i) for i in range(30)} | {(200, 2), (203, 5), (None, 5)}
    clean = D.without_leaks(table.withColumn("leaky", table["doc_id"]), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [*range(30, 60), 201, 202]
    assert D.leaks(table, bench.where("false")).count() == 0 and D.leaks(table.where("false"), bench).count() == 0


def test_leaks_of_long_items_equal_brute_force(spark):
    rng, items, docs = random.Random(12), [], []
    for n in (100, 160, 300, 1000):
        for _ in range(4):
            key, question, answer = len(items), prose(3000 + len(items), n - 8), prose(4000 + len(items), 8)
            items.append((key, f"{question}. {answer}"))
            for share in (1.0, 0.85, 0.7, 0.4):
                copy = " ".join(w if rng.random() < share else "other" for w in question.split())
                docs.append((len(docs), f"{prose(5000 + len(docs), rng.randint(50, 200))} {copy}. {answer} {prose(6000 + len(docs), 150)}"))
    want = set()
    for d, text in docs:
        words = D.words_of(text)
        for key, item in items:
            asked = D.words_of(item)
            if len(set(asked) & set(words)) > 0.3 * len(set(asked)):
                share = D.common_subsequence(asked, words) / len(asked)
                if share >= 0.8 or share >= 0.6 and D.common_subsequence(asked[-8:], words) >= 6.4:
                    want.add((d, key))
    assert want == {(d, d // 4) for d in range(len(docs)) if d % 4 < 3}
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(table, bench).collect()} == want
    few = D.Settings(block=100, cells=500)
    assert {(r.doc_id, r.item_id) for r in D.leaks(table, bench, few).collect()} == want
    assert {r.doc_id for r in D.without_leaks(table, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_paraphrases_against_every_window(spark):
    """Items in whose copies words are replaced, left out or added: recall against the longest common
    subsequence with the whole text, over 600 documents with nothing else of the items."""
    rng, items, docs = random.Random(5), [(i, f"{prose(300 + i, 34)}. {prose(700 + i, 6)}") for i in range(60)], []
    for d in range(600):
        words = items[d % 60][1].split()
        rate = rng.choice((0.0, 0.1, 0.2, 0.3, 0.6))
        copy = [x for w in words if rng.random() >= rate / 3 for x in ((w, "extra") if rng.random() < rate / 3 else (w if rng.random() >= rate / 3 else "other",))]
        docs.append((d, f"{prose(5000 + d, 120)} {' '.join(copy)} {prose(9000 + d, 120)}"))
    want = set()
    for d, text in docs:
        words, (key, item) = D.words_of(text), items[d % 60]
        asked = D.words_of(item)
        share = D.common_subsequence(asked, words) / len(asked)
        if share >= 0.8 or share >= 0.6 and D.common_subsequence(asked[-6:], words) >= 4.8:
            want.add((d, key))
    found = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 350 and len(found & want) / len(want) >= 0.9
    assert len({d for d, k in found if (d, k) not in want}) <= 0.01 * len(docs)


def test_leaks_of_very_long_texts_and_short_items(spark):
    items = [(1, f"{prose(1, 40)}. {prose(2, 6)}"), (2, "Who won? Nobody."), (3, "no"), (4, "東京は日本の首都ですか。はい。"), (5, ""), (6, "Who won? Nobody.")]
    docs = [(0, f"{prose(9, 300_000)} {items[0][1]} {prose(10, 100_000)}"), (1, "They ask who won: nobody, no."), (2, "who won nothing nobody"), (3, "それは 東京は日本の首都ですか はい です"), (4, "東京は首都"), (5, None), (5, ""), (None, items[1][1])]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(0, 1), (1, 2), (1, 6), (3, 4), (None, 2), (None, 6)}
    assert {(r.doc_id, r.item_id) for r in D.leaks(table, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in D.leaks(table, bench, D.Settings(block=2)).collect()} == want
    assert sorted(r.doc_id for r in D.without_leaks(table, bench, D.Settings(block=2)).collect()) == [2, 4, 5, 5]


def test_common_subsequence():
    rng = random.Random(2)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(20))] for _ in range(2))
        assert D.common_subsequence(a, b) == slow(a, b)


def test_the_latent_space_is_that_of_all_passages(spark):
    """Against a plain decomposition of every passage and item: words of one document count as well."""
    rng, words = random.Random(4), [f"w{i}" for i in range(60)]
    texts = [[rng.choice(words[:40]) for _ in range(rng.randint(1, 60))] + ["else"] * 30 for _ in range(5000)]
    texts[17] = [rng.choice(words[40:44]) for _ in range(30_000)]  # words that stand nowhere else
    items = [(i, " ".join(rng.choice(words) for _ in range(60 if i == 3 else 12))) for i in range(20)]
    s, vocabulary = D.Settings(dims=3, common=0.9), {w: i for i, w in enumerate(words)}
    ids = [np.array([vocabulary.get(w, -1) for w in t], dtype=np.int32) for t in texts]
    tokens = spark.createDataFrame([(x.tobytes(),) for x in ids], "ids binary").repartition(5)
    space = D._space(tokens, vocabulary, items, s)

    def unit(run):
        x = np.zeros(len(words))
        np.add.at(x, run[run >= 0], space.idf[run[run >= 0]])
        return x / (np.sqrt(x @ x) or 1.0)

    passages = np.array([x for t in ids for k in range(0, max(1, len(t) - s.window // 2), s.window // 2) if (x := unit(t[k : k + s.window])).any()])
    own = np.array([unit(np.array(i.words)[a:b]) for i in space.items for a, b in D._pieces(len(i.words), s.window)])
    whole = np.concatenate([passages, own * np.sqrt(len(passages) / len(own))])
    held = lambda basis: ((whole @ basis) ** 2).sum()
    basis = np.where(space.idf[:, None] > 0, space.basis / np.maximum(space.idf, 1e-9)[:, None], 0)
    assert held(basis) >= 0.99 * held(np.linalg.svd(whole, full_matrices=False)[2][:3].T)
    empty = D._space(tokens.where("false"), vocabulary, items, s)
    assert empty.basis.shape == (60, 3) and np.isfinite(empty.latent).all()
