"""Ranked lexical search with NRA: only sequential, impact-sorted reads.

A document's impact for a term is a whole number that falls with its length; a score is the weighted
sum of impacts. Documents lie in shards as Spark has dealt them out. In each shard the postings of
every term are sorted by impact. A query reads its lists from the top, side by side, in deepening
steps. What has been read is a document's lower bound; what its unread lists could still add, at
most the next unread impact of each, makes the upper bound. Reading goes on until every document
whose upper bound reaches the k-th lower bound has no unread part left: then membership, ties and
final scores are resolved. The k-th score of the shards that a task has read is the floor of its
next one. Nothing is shuffled but the k best of each task.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import cut

#: Digits and letters of ASCII, lower-cased, and all bytes of other characters; the rest parts terms.
_BYTES = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else ord(chr(c).lower()) if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 0x20 for c in range(256))
_COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, with repeats; none for null."""
    return text.translate(_BYTES).split() if text else []


@dataclass(frozen=True)
class Queries:
    """Queries as numbers of their different terms, with how often each stands in the query."""

    vocabulary: dict[bytes, int]
    ids: list[object]
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[object, bytes | None]]) -> "Queries":
        vocabulary: dict[bytes, int] = {}
        counted = [(i, Counter(terms_of(text))) for i, text in rows]
        terms = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in c], dtype=np.int64) for _, c in counted]
        return cls(vocabulary, [i for i, _ in counted], terms, [np.array(list(c.values()), dtype=np.int64) for _, c in counted])


class Shard:
    """The postings of some documents, by term and falling impact."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, length: int) -> None:
        doc = np.repeat(np.arange(len(n)), np.diff(offsets))
        m = 100 - 25 + (25 * n * n_docs) // length
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc])
        order = np.lexsort((-impact, terms))
        self.size, self.doc, self.impact, terms = len(n), doc[order], impact[order], terms[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]][: len(terms)])
        self.deepest = 0  # of the last search
        self.at = dict(zip(terms[first].tolist(), zip(first.tolist(), np.r_[first[1:], len(terms)].tolist())))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, depth: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that can be among the k best with a score of at least ``floor``, 1
        or more; scores are exact."""
        lists = [(int(w), *self.at[t]) for t, w in zip(terms.tolist(), weights.tolist()) if w and t in self.at]
        lower, alive, read = np.zeros(self.size, dtype=np.int64), None, 0
        while True:
            unread, slack, seen = 0, None, []
            for weight, begin, end in lists:
                at, to = begin + read, min(begin + depth, end)
                if at < to:
                    doc, gain = self.doc[at:to], weight * self.impact[at:to]
                    if alive is not None:
                        doc, gain = doc[alive[doc]], gain[alive[doc]]
                    lower[doc] += gain  # a document stands once in a list
                if to < end:
                    bound = weight * int(self.impact[to])
                    unread += bound
                    seen.append((self.doc[begin:to], bound))
            best = np.partition(lower, -k)[-k] if len(lower) > k else 0
            floor, self.deepest = max(floor, int(best), 1), depth
            if unread:
                slack = np.full(self.size, unread, dtype=np.int64)
                for doc, bound in seen:
                    slack[doc] -= bound
                reach = lower + slack >= floor
                alive = reach if alive is None else alive & reach
                if (slack[alive] > 0).any():
                    read, depth = depth, depth * 4
                    continue
            reach = lower >= floor
            found = np.flatnonzero(reach if alive is None else alive & reach)
            return found, lower[found]


class Best:
    """The k best documents of each query so far: higher scores first, then smaller ids, null last."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, none = k, np.zeros(0, dtype=np.int64)
        self.floor, self.found = [1] * n_queries, [(none, none, none)] * n_queries  # score, id is null, id

    def add(self, query: int, score: np.ndarray, null: np.ndarray, doc_id: np.ndarray) -> None:
        score, null, doc_id = (np.concatenate(x) for x in zip(self.found[query], (score, null, doc_id)))
        order = np.lexsort((doc_id, null, -score))[: self.k]
        self.found[query] = score[order], null[order], doc_id[order]
        if len(order) == self.k:
            self.floor[query] = int(score[order[-1]])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of ``docs`` (doc_id, text): a document's number of terms with repeats, and
    the terms of the vocabulary that it has, by number, with their occurrences."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            n, offsets, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                c = Counter(map(number, found))
                del c[None]
                n.append(len(found))
                terms.extend(c)
                tfs.extend(c.values())
                offsets.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, _COUNTED)


def _cuts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` postings together, or of one document."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def rank(docs: DataFrame, items: DataFrame, k: int = 20, most_terms: int = 500_000, shard_postings: int = 2_000_000) -> DataFrame:
    """The k highest-scoring documents above 0 of each row of ``items`` (item_id, text): item_id, rank
    (from 1, without gaps), doc_id, score; equal scores by smaller doc_id.

    Documents and items without terms (null, empty) find nothing and count for nothing. Rows that
    repeat a doc_id are documents each, and rows that repeat an item_id are queries each; a null
    doc_id comes after all others of its score. Extra columns are not read.

    A set of queries with ``most_terms`` terms at most is sent to every task; more queries are
    searched in several such sets, one pass over the documents each.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    n_bytes = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n_sets = max(1, math.ceil(n_bytes / 2 / most_terms))  # a term takes two bytes at least
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in range(n_sets):
        some = asked.where(F.pmod(F.xxhash64("text"), F.lit(n_sets)) == part) if n_sets > 1 else asked
        rows = [tuple(r) for r in some.collect()]
        out = out.unionByName(_search(docs, Queries.of(rows), kind, k, shard_postings))
    return out


def _search(docs: DataFrame, queries: Queries, kind: str, k: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    index = cut(counted(docs, queries.vocabulary))
    n_docs, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_terms = len(queries.vocabulary)
    weight = np.zeros(n_terms, dtype=np.int64)
    for term, df in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per known term
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast((queries.terms, [weight[t] * c for t, c in zip(queries.terms, queries.times)]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = shared.value
        best = Best(len(terms), k)
        for batch in batches:
            ids, n = batch.column("doc_id"), batch.column("n").to_numpy()
            null, ids = np.asarray(ids.is_null()).astype(np.int64), ids.fill_null(0).to_numpy()
            column = batch.column("terms")
            offsets = column.offsets.to_numpy().astype(np.int64)
            of, tfs = column.values.to_numpy().astype(np.int64), batch.column("tfs").values.to_numpy().astype(np.int64)
            for at, to in _cuts(offsets, shard_postings):
                inside = slice(offsets[at], offsets[to])
                if inside.start == inside.stop:
                    continue
                shard = Shard(n[at:to], offsets[at : to + 1], of[inside], tfs[inside], n_docs, length)
                for q in range(len(terms)):
                    doc, score = shard.search(terms[q], weights[q], k, best.floor[q])
                    if len(doc):
                        best.add(q, score, null[at:to][doc], ids[at:to][doc])
        for q, (score, null, doc_id) in enumerate(best.found):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q, dtype=np.int64)), pa.array(doc_id, mask=null.astype(bool)), pa.array(score)], ["query", "doc_id", "score"])

    # a task's result is of one size however much it reads: some tasks a core are enough
    found = index.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(search, "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), f"query long, item_id {kind}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
