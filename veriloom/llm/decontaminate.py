"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping windows of a document's words) and benchmark items are TF-IDF vectors over
the items' vocabulary, with document frequencies counted over the whole corpus. A distributed
randomised SVD of all passages and items gives a latent space; a passage whose cosine with an item
is high enough is a candidate. An item longer than a passage has a vector for itself and one for each of its
own overlapping windows, and is a candidate where any of them is near: a passage inside a copy of a
long item holds only a small part of it. The longest common subsequence of words decides: most of
the item in order is a leak, and a smaller part is one if the item's answer, its last sentence, is
there as well. Items that are too short for that leak where they stand word for word.

The items are the query set, held in blocks of a bounded number of vectors; every passage of every
document is compared with each block. Texts are taken apart once a block, into numbers of the
items' words, which the counts, the fit and the search then read. No row of the corpus is shuffled.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tables import cut, free_name

#: Letters of scripts that are written without spaces (Thai, Lao, Burmese, Khmer, kana, Han): each
#: counts as a word.
DENSE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORDS = re.compile(r"\w+").findall
_DENSE = re.compile(f"[{DENSE}]").search
_DENSE_WORDS = re.compile(rf"[{DENSE}]|[^\W{DENSE}]+").findall
_SENTENCE = re.compile(r"[.!?]+\s+")


@dataclass(frozen=True)
class Settings:
    """``copied`` and ``paraphrased``: share of an item's words that a leak has in order, without
    and with its answer. Words of more than ``common`` of all documents have no part in the
    retrieval (in the comparison of word sequences they do). A candidate's cosine is at least
    ``cosine`` and it covers at least ``covered`` of the item's latent weight. Items with fewer than
    ``fewest_words`` words leak where they stand word for word, those with fewer than
    ``fewest_run`` say nothing by themselves and match nothing. The latent space is fitted on all
    passages and on all items, of equal weight; about ``block`` vectors of items are searched at a time, in steps of at most ``cells`` pairs of a passage and a
    vector."""

    window: int = 48
    dims: int = 64
    common: float = 0.1
    cosine: float = 0.5
    covered: float = 0.35
    copied: float = 0.8
    paraphrased: float = 0.6
    answered: float = 0.8
    fewest_words: int = 8
    fewest_run: int = 3
    power_steps: int = 2
    block: int = 20_000
    cells: int = 1_000_000
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return _WORDS(low) if low.isascii() or not _DENSE(low) else _DENSE_WORDS(low)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of integers."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := places.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Item:
    key: object
    words: list[int]
    answer: list[int]
    different: frozenset[int]


@dataclass(frozen=True)
class Space:
    """Items with the latent vectors of themselves and of their pieces, and each word's contribution
    to a passage's."""

    items: list[Item]
    phrases: dict[tuple[int, ...], list[object]]  # short items' words, and the items' keys
    basis: np.ndarray  # words x dims, scaled by IDF
    latent: np.ndarray  # vectors x dims
    owner: np.ndarray  # vectors: place of the item
    sizes: np.ndarray  # vectors: number of words
    idf: np.ndarray  # 0 for common words
    settings: Settings


def _ids(vocabulary: dict[str, int], text: str | None) -> np.ndarray:
    """Numbers of a text's words; -1 for those of no item."""
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))


def _windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of texts of ``sizes`` words that stand one after the other: (text, begin, end)."""
    half = max(1, width // 2)
    counts = -(-np.maximum(1, sizes - half) // half)
    of = np.repeat(np.arange(len(sizes)), counts)
    base = np.cumsum(sizes) - sizes
    begin = base[of] + half * (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts))
    return of, begin, np.minimum(begin + width, (base + sizes)[of])


def _pieces(n: int, width: int) -> list[tuple[int, int]]:
    """What an item of n words has vectors for: itself and, if it is longer, windows of ``width``."""
    return [(0, n)] + (list(zip(*(x.tolist() for x in _windows(np.array([n]), width)[1:]))) if n > width else [])


def _unit(ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vector of unit length of a run of word ids; empty where no word has a weight."""
    at, tf = np.unique(ids[ids >= 0], return_counts=True)
    x = tf * weight[at]
    at, x = at[x > 0], x[x > 0]
    return at, x / np.sqrt((x * x).sum()) if len(x) else x


def _tokenised(docs: DataFrame, vocabulary: dict[str, int], name: str) -> DataFrame:
    """``docs`` (text, ...) with a binary column of the numbers of each text's words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_ids(shared.value, t).tobytes() for t in texts], dtype=object)

    return docs.withColumn(name, run(F.col("text").cast("string")))


def _numbers(rows: Iterable[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.int32) for x in rows]


def _document_frequencies(tokens: DataFrame, n_words: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each word, over all rows of ``tokens`` (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros(n_words + 1, dtype=np.int64)  # the last is for words of no item, -1
        for batch in batches:
            for ids in _numbers(batch.column("ids").to_pylist()):
                counts[np.unique(ids)] += 1
                n += 1
        at = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, counts[at]])], ["at", "n"])

    total = np.zeros(n_words, dtype=np.int64)
    n = 0
    for at, count in tokens.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # a row per word of the items
        if at < 0:
            n = count
        else:
            total[at] = count
    return n, total


#: Passages at a time, partial products of the corpus, and words whose rows of them are summed together.
_STEP, _PARTS, _SLAB = 1024, 64, 64


def _passages(texts: list[np.ndarray], idf: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """TF-IDF vectors (words, values, where each begins) of unit length of all passages of ``texts``, so many
    at a time that memory is bounded. Passages without a word of weight have none."""
    flat, sizes = np.concatenate(texts or [np.zeros(0, dtype=np.int32)]), np.array([len(t) for t in texts], dtype=np.int64)
    _, begin, end = _windows(sizes, width)
    known = np.flatnonzero(np.r_[idf > 0, False][flat])  # -1 is no item's word
    words, first, last = flat[known].astype(np.int64), np.searchsorted(known, begin), np.searchsorted(known, end)
    first, last = first[last > first], last[last > first]
    for k in range(0, len(first), _STEP):
        n = (last - first)[k : k + _STEP]
        of = np.repeat(np.arange(len(n)), n)
        at = words[np.arange(len(of)) + np.repeat(first[k : k + _STEP] - np.cumsum(n) + n, n)]
        pairs, tf = np.unique(of * len(idf) + at, return_counts=True)
        of, at = np.divmod(pairs, len(idf))
        x, starts = tf * idf[at], np.flatnonzero(np.r_[True, of[1:] > of[:-1]])
        yield at, (x / np.sqrt(np.add.reduceat(x * x, starts))[of]).astype(np.float32), starts


def _multiplied(at: np.ndarray, x: np.ndarray, starts: np.ndarray, m: np.ndarray, total: np.ndarray, small: bool) -> None:
    """Adds to ``total`` the product of sparse rows, transposed, with their product y with ``m``; if ``small``
    that of y, transposed, with y."""
    y = np.add.reduceat(m[at] * x[:, None], starts)
    if small:
        total += y.T @ y
        return
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))
    total[at[order][first]] += np.add.reduceat(y[of[order]] * x[order, None], first)


def randomised_svd(tokens: DataFrame, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, s: Settings) -> np.ndarray:
    """The leading right singular vectors (words x dims) of the passages of all rows of ``tokens`` (ids) and
    of the items' ``vectors``, which together weigh as much as the passages, else the space holds little of them.

    A random test matrix is multiplied by the rows and their transpose, power_steps + 1 times; each task
    sums its part of the product, parts are summed by slabs of words, and the sum is all that the driver gets.
    """
    rank = min(len(idf), s.dims + 8)
    basis = np.linalg.qr(np.random.default_rng(s.seed).standard_normal((len(idf), rank)))[0]
    spark, parts = tokens.sparkSession, tokens.coalesce(_PARTS)  # however many rows: so many partial products
    weights, width = spark.sparkContext.broadcast(idf), s.window
    own = np.concatenate([at for at, _ in vectors]), np.concatenate([x for _, x in vectors]), np.cumsum([0, *(len(at) for at, _ in vectors[:-1])])

    def product(matrix: np.ndarray, small: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(matrix.astype(np.float32))
        shape = (matrix.shape[1] if small else len(matrix), matrix.shape[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(shape), 0
            for batch in batches:
                for at, x, starts in _passages(_numbers(batch.column("ids").to_pylist()), weights.value, width):
                    _multiplied(at, x, starts, shared.value, total, small)
                    n += len(starts)
            slabs = [total[k : k + _SLAB].astype(np.float32).tobytes() for k in range(0, len(total), _SLAB)]
            told = [range(len(slabs)), [TaskContext.get().partitionId()] * len(slabs), [n] * len(slabs), slabs]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(told, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["slab", "task", "n", "part"])

        def summed(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("task")  # in order: reruns agree
            return pd.DataFrame({"slab": rows["slab"][:1], "n": rows["n"].sum(), "part": [sum(np.frombuffer(p, dtype=np.float32).astype(float) for p in rows["part"]).tobytes()]})

        got = sorted(parts.mapInArrow(run, "slab int, task int, n long, part binary").groupBy("slab").applyInPandas(summed, "slab int, n long, part binary").collect())
        total, n = (np.frombuffer(b"".join(r.part for r in got)).reshape(shape).copy(), got[0].n) if got else (np.zeros(shape), 0)
        items = np.zeros(shape)
        _multiplied(*own, matrix, items, small)
        return total + items * max(1.0, n / len(vectors))

    for _ in range(s.power_steps):
        basis = np.linalg.qr(product(basis, False))[0]
    turned = np.linalg.eigh(product(basis, True))[1][:, ::-1]
    return basis @ turned[:, : s.dims]


def _space(tokens: DataFrame, vocabulary: dict[str, int], items: list[tuple], s: Settings) -> Space:
    n_docs, df = _document_frequencies(tokens, len(vocabulary))
    idf = np.where(df <= s.common * n_docs, np.log((1 + n_docs) / (1 + df)), 0.0)
    known, phrases = [], {}
    for key, text in items:
        ids = _ids(vocabulary, text)
        if len(ids) >= s.fewest_words:
            last = [p for p in _SENTENCE.split((text or "").strip()) if words_of(p)][-1]
            known.append(Item(key, ids.tolist(), _ids(vocabulary, last).tolist(), frozenset(ids.tolist())))
            if not idf[ids].any():  # an item of common words only is retrieved by those
                idf[ids] = np.log((2 + n_docs) / (1 + df[ids]))
        elif len(ids) >= s.fewest_run:
            phrases.setdefault(tuple(ids.tolist()), []).append(key)
    if not known:
        return Space([], phrases, np.zeros((len(vocabulary), 0)), np.zeros((0, 0)), np.zeros(0, dtype=int), np.zeros(0), idf, s)
    pieces = [(k, np.array(i.words[begin:end])) for k, i in enumerate(known) for begin, end in _pieces(len(i.words), s.window)]
    pieces = [(k, ids) for k, ids in pieces if idf[ids].any()]
    vectors = [_unit(ids, idf) for _, ids in pieces]
    right = randomised_svd(tokens, vectors, idf, s)
    length = [np.sqrt(((np.unique(ids, return_counts=True)[1] * idf[np.unique(ids)]) ** 2).sum()) for _, ids in pieces]
    latent = np.stack([x @ right[at] * n for (at, x), n in zip(vectors, length)])
    return Space(known, phrases, (right * idf[:, None]).astype(np.float32), latent.astype(np.float32), np.array([k for k, _ in pieces]), np.array([len(ids) for _, ids in pieces]), idf, s)


def _candidates(space: Space, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, begin, end, item) of the passages near an item, of texts that stand one after the
    other in ``flat``; passages are scored so many at a time that memory is bounded."""
    s = space.settings
    of, begin, end = _windows(sizes, s.window)
    rare = np.r_[space.idf > 0, False]  # -1 is no item's word
    theirs = np.sqrt((space.latent**2).sum(1))
    # an item shorter than the window shares it with other words
    slope = s.cosine * np.sqrt(np.minimum(1.0, space.sizes / s.window)) * theirs
    least = np.maximum(s.covered * theirs**2, 1e-30).astype(np.float32)
    step = min(4096, max(1, s.cells // len(theirs)))
    for k in range(0, len(of), step):
        lo, hi = begin[k], end[min(k + step, len(of)) - 1]
        words = flat[lo:hi]
        known = np.flatnonzero(rare[words])
        if not len(known):
            continue
        total = np.zeros((len(known) + 1, space.basis.shape[1]), dtype=np.float32)
        np.cumsum(space.basis[words[known]], axis=0, out=total[1:])
        some = total[np.searchsorted(known, end[k : k + step] - lo)] - total[np.searchsorted(known, begin[k : k + step] - lo)]
        dots = some @ space.latent.T
        w, v = np.nonzero(dots >= least)
        near = dots[w, v] >= slope[v] * np.sqrt((some[w] ** 2).sum(1))
        w, v = w[near] + k, v[near]
        yield from sorted(set(zip(of[w].tolist(), begin[w].tolist(), end[w].tolist(), space.owner[v].tolist())))


def _phrases(space: Space, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(text, words) of the short items that stand in a text word for word."""
    first = np.zeros(len(space.idf) + 1, dtype=bool)
    first[[p[0] for p in space.phrases]] = True
    lengths, ends = sorted({len(p) for p in space.phrases}), np.cumsum(sizes)
    for at in np.flatnonzero(first[flat]).tolist():
        text = int(np.searchsorted(ends, at, side="right"))
        for n in lengths:
            if at + n <= ends[text] and (run := tuple(flat[at : at + n].tolist())) in space.phrases:
                yield text, run


def matches(space: Space, rows: Iterable[bytes]) -> list[list[tuple[object, float, str]]]:
    """(item, share of its words in order, copy or paraphrase) of all items that each text leaks,
    given the numbers of its words."""
    s, texts = space.settings, _numbers(rows)
    best: list[dict] = [{} for _ in texts]
    flat, sizes = np.concatenate(texts or [np.zeros(0, dtype=np.int32)]), np.array([len(t) for t in texts], dtype=np.int64)
    if space.items:
        base = np.cumsum(sizes) - sizes
        for text, begin, end, i in _candidates(space, flat, sizes):
            item, n = space.items[i], len(space.items[i].words)
            if best[text].get(i) == 1.0:
                continue
            # the passage and as much around it as the item may reach over its edges
            around = flat[max(base[text], begin - n) : min(base[text] + sizes[text], end + n)].tolist()
            if n - len(item.different.difference(around)) < s.paraphrased * n:
                continue  # each different word that is missing is missing from every subsequence
            share = common_subsequence(item.words, around) / n
            if share >= s.copied or share >= s.paraphrased and common_subsequence(item.answer, around) >= s.answered * len(item.answer):
                best[text][i] = max(best[text].get(i, 0.0), share)
    out = [[(space.items[i].key, share, "copy" if share >= s.copied else "paraphrase") for i, share in sorted(found.items())] for found in best]
    if space.phrases:
        for text, phrase in sorted(set(_phrases(space, flat, sizes))):
            out[text] += [(key, 1.0, "copy") for key in space.phrases[phrase]]
    return out


def _item_blocks(items: DataFrame, s: Settings) -> Iterator[list[tuple]]:
    """(item_id, text) of all different ``items``, in blocks of a bounded number of vectors."""
    items = items.dropDuplicates()
    n_words = F.coalesce(F.regexp_count("text", F.lit(rf"(?U)[{DENSE}]|[\w&&[^{DENSE}]]+")), F.lit(0))
    half = max(1, s.window // 2)
    vectors = items.agg(F.sum(F.when(n_words > s.window, 1 + F.ceil((n_words - half) / half)).otherwise(1))).first()[0]
    blocks = -(-(vectors or 0) // s.block)
    for b in range(blocks):
        yield sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), key=repr)


def _searched(docs: DataFrame, items: list[tuple], s: Settings, name: str) -> tuple[DataFrame, Space]:
    """``docs`` (text, ...), written with the numbers of their words in the binary column ``name``,
    and the space of a block of items."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, text in items for w in words_of(text)}))}
    tokens = cut(_tokenised(docs, vocabulary, name))
    return tokens, _space(tokens.select(F.col(name).alias("ids")), vocabulary, items, s)


def leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, share, kind) of every row of ``docs`` (doc_id, text) that leaks an item of
    ``items`` (item_id, text).

    A null or empty text leaks nothing, a null or empty item matches nothing. Repeated rows of
    documents are reported each; repeated items once. Item ids are longs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, share double, kind string")
    for block in _item_blocks(items, settings):
        tokens, space = _searched(docs, block, settings, "ids")
        shared = spark.sparkContext.broadcast(space)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = matches(shared.value, batch.column("ids").to_pylist())
                rows = [(d, *m) for d, ms in zip(batch.column("doc_id").to_pylist(), found) for m in ms]
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.string()))], ["doc_id", "item_id", "share", "kind"])

        out = out.unionByName(tokens.select("doc_id", "ids").mapInArrow(run, out.schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that leak an item; nothing is shuffled."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    columns, ids = docs.columns, free_name(docs, "ids")
    for block in _item_blocks(items, settings):
        tokens, space = _searched(docs, block, settings, ids)
        docs = tokens.where(~_leaky(docs.sparkSession.sparkContext.broadcast(space))(F.col(ids))).select(*columns)
    return docs


def _leaky(shared):
    """Does a text leak an item of the broadcast space, given the numbers of its words?"""

    @F.pandas_udf("boolean")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([bool(found) for found in matches(shared.value, rows)], dtype=bool)

    return run
