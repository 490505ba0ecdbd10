"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The duplicated unit is a window of ``width`` words that also starts in a document with a smaller
doc_id. The steps:

1. Winnowing gives each document anchors: word k-grams that are the smallest of a run of k-grams.
   Run and k-gram together are one window long, so a window chooses one anchor from its own words
   alone, and equal windows choose equal anchors.
2. Anchors of a single document are left out. A run of windows that choose the same anchor is a
   block, of ``width - gram + 1`` windows at most. The reference block of a content is the one of
   its smallest document; blocks of later documents with that content are copies as they stand.
3. Where an anchor has several contents, reference blocks are indexed by their windows: each window
   of more than one document with the smallest of them. Every other window is looked up there.
4. Each document is parsed greedily: a factor starts at the first window with a reference and goes
   on while the next window has its reference in the same document. At a factor's end the next
   window is looked up anew, so that a window over a boundary is not missed. A factor of w windows
   is w + width - 1 words: a duplicate span.

Contents and windows are counted with partial sums before anything is shuffled, and met by joins
whose one side has a row per key, which Spark splits where a key is hot: a passage of a third of all
documents costs no task more than its share. Two windows are equal if 64-bit hashes of their words
and of their anchor's words are: 128 bits unless they share the anchor. Words are not compared.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut, free_name

WIDTH = 50
GRAM = 25
_ODD = 0x9E3779B97F4A7C15


class Hashes:
    """Polynomial hashes modulo 2^64 of all word runs of one length in a text."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up))
            inverse = pow(_ODD, -1, 1 << 64)
            self._up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _ODD, dtype=np.uint64)], dtype=np.uint64)
            self._down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, dtype=np.uint64)], dtype=np.uint64)
        return self._up[:n], self._down[:n]

    def runs(self, words: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
        n = len(words)
        up, down = (p[:n] for p in self._powers(max(1, n)))
        total = np.r_[np.uint64(0), np.cumsum(words * up, dtype=np.uint64)]
        out = []
        for k in lengths:
            h = (total[k:] - total[:-k]) * down[: max(0, n - k + 1)] if n >= k else np.zeros(0, dtype=np.uint64)
            h ^= h >> np.uint64(29)  # the low bits of a product depend on few bits
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out.append(h ^ (h >> np.uint64(32)))
        return out


    def of_groups(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A hash of each group of values, from one offset to the next; groups are not empty."""
        sizes = np.diff(offsets)
        place = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
        up, _ = self._powers(int(sizes.max()) + 1)
        return np.add.reduceat(values * up[place + 1], offsets[:-1]) + sizes.astype(np.uint64)


def chosen_anchors(grams: np.ndarray, run: int) -> np.ndarray:
    """For each run of ``run`` consecutive k-grams the place of its smallest, the last of equals."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, best, width = np.arange(len(grams)), grams, 1
    while width < run:  # the smaller of two overlapping halves
        step = min(width, run - width)
        left, right = best[:-step], best[step:]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        width += step
    return at


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(anchor, doc_id, at) of every document with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found, counts = [], []
            ids = batch.column("doc_id").to_numpy()
            places = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = _words(text)
                if len(words) < width:
                    counts.append(0)
                    continue
                (grams,) = hashes.runs(_word_hashes(words), (gram,))
                at = np.unique(chosen_anchors(grams, width - gram + 1))
                found.append(grams[at])
                places.append(at)
                counts.append(len(at))
            if found:
                anchor, at = np.concatenate(found).view(np.int64), np.concatenate(places).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.repeat(ids, counts)), pa.array(at)], ["anchor", "doc_id", "at"])

    return docs.mapInArrow(run, "anchor long, doc_id long, at int")


def _blocks(docs: DataFrame, doc_id: str, tid: str, at: str, width: int, gram: int) -> DataFrame:
    """Of documents with the places ``at`` of shared anchors: their blocks (anchor, doc_id, tid,
    start, content, n, windows), a run of n windows that choose the same anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            ids, tids = batch.column(doc_id).to_numpy(), batch.column(tid).to_numpy()
            texts, shared = batch.column("text").cast(pa.string()).cast(pa.binary()).to_pylist(), batch.column(at)
            parts: list[tuple] = []
            for i, text in enumerate(texts):
                words = _words(text)
                if len(words) < width:
                    continue
                grams, windows = hashes.runs(_word_hashes(words), (gram, width))
                of = chosen_anchors(grams, width - gram + 1)
                wanted = np.zeros(len(grams), dtype=bool)
                places = np.asarray(shared[i].values.to_numpy(zero_copy_only=False))
                wanted[places[places < len(grams)]] = True
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                lengths = np.diff(np.r_[starts, len(of)])
                keep = wanted[of[starts]]
                mask = np.repeat(keep, lengths)
                starts, lengths = starts[keep], lengths[keep]
                if len(starts):
                    parts.append((grams[of[starts]], np.full(len(starts), ids[i]), np.full(len(starts), tids[i]), starts, lengths, windows[mask]))
            if parts:
                anchor, doc, text_hash, start, length, windows = (np.concatenate(x) for x in zip(*parts))
                offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
                content = hashes.of_groups(windows, offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(windows.view(np.int64)))
                columns = [anchor.view(np.int64), doc, text_hash, start.astype(np.int32), content.view(np.int64), length.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["anchor", "doc_id", "tid", "start", "content", "n", "windows"])

    return docs.mapInArrow(run, "anchor long, doc_id long, tid long, start int, content long, n int, windows array<long>")


def parse(looked_up: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy factors (first window, windows, reference) of a document, given its runs of windows
    with a reference, in the same form. A factor goes on while the next window has the same
    reference; else the next window begins another."""
    factors: list[list[int]] = []
    for at, n, ref in sorted(looked_up):
        end = factors[-1][0] + factors[-1][1] if factors else -1
        if at < end:
            continue  # a repeated row of the document
        if at == end and factors[-1][2] == ref:
            factors[-1][1] += n
        else:
            factors.append([at, n, ref])
    return [tuple(f) for f in factors]


def text_id(text: Column) -> Column:
    return F.xxhash64(text)


def dealt_by_id(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a doc_id, dealt out by it once: the blocks and the kept words both
    read this exchange."""
    return docs.where(F.col("doc_id").isNotNull()).repartition("doc_id")


def referenced_windows(docs: DataFrame, dealt: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Windows of ``docs`` (doc_id, text), ``dealt`` out by id, that have a reference: doc_id and
    ``found``, an array of (tid, at, n, ref): n windows from ``at`` are in the document ref as well;
    tid tells the texts of a doc_id apart. Documents without such windows have no row. Rows with a
    null doc_id have no order among the others and take no part; rows that share a doc_id are not
    duplicates of each other."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    anchors = cut(_anchors(ids, width, gram))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = cut(shared)  # a plain table, so that Spark can split the join where an anchor is hot
    places = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    of, at, tid = (free_name(docs, name) for name in ("of", "at", "tid"))
    met = dealt.join(places.select(F.col("doc_id").alias(of), F.col("at").alias(at)), F.col("doc_id").cast("long") == F.col(of))
    blocks = cut(_blocks(met.withColumn(tid, text_id(F.col("text"))), of, tid, at, width, gram))
    contents = cut(blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("first")))
    several = cut(contents.groupBy("anchor").count().select("anchor", (F.col("count") > 1).alias("mixed")))  # else all its blocks are copies
    firsts = cut(contents.join(several, "anchor"))
    # a copy is a run of windows with a reference; a reference block's windows are looked up one by one
    copy = F.array(F.struct(F.col("start").alias("at"), F.col("n").alias("n"), F.col("first").alias("ref"), F.lit(None).cast("long").alias("window")))
    alone = F.transform("windows", lambda w, i: F.struct((F.col("start") + i).alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("ref"), w.alias("window")))
    parts = F.when(F.col("doc_id") > F.col("first"), copy).when(F.col("mixed"), alone)
    looked = cut(blocks.join(firsts, ["anchor", "content"]).select("anchor", "doc_id", "tid", F.explode(parts).alias("p")).select("anchor", "doc_id", "tid", "p.*"))
    copies, asked = looked.where("ref is not null").select("doc_id", "tid", "at", "n", "ref"), looked.where("ref is null").drop("n", "ref")
    index = cut(asked.groupBy("anchor", "window").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("high")).where("ref < high").drop("high"))
    found = asked.join(index, ["anchor", "window"]).where("doc_id > ref").select("doc_id", "tid", "at", F.lit(1).alias("n"), "ref")
    return copies.unionByName(found).groupBy("doc_id").agg(F.collect_list(F.struct("tid", "at", "n", "ref")).alias("found"))


_KEPT = "struct<n_words: bigint, n_removed: bigint, kept: string>"


def kept_words(text: Column, found: Column, width: int) -> Column:
    """n_words, n_removed and the words outside the factors' spans, joined by one space."""

    @F.pandas_udf(_KEPT)
    def run(texts: pd.Series, tids: pd.Series, all_found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, tid, found in zip(texts, tids, all_found):
            words = (t or "").encode().split()
            keep = np.ones(len(words), dtype=bool)
            for at, n, _ in parse((f["at"], f["n"], f["ref"]) for f in (found if found is not None else ()) if f["tid"] == tid):
                keep[at : at + n - 1 + width] = False
            kept = words if keep.all() else [w for w, k in zip(words, keep) if k]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return run(text, text_id(text), found)


def with_kept(docs: DataFrame, name: str, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_removed, kept. A null text has no words."""
    dealt = dealt_by_id(docs)
    of = free_name(docs, "of")
    found = referenced_windows(docs.select("doc_id", "text"), dealt, width, gram).select(F.col("doc_id").alias(of), F.col("found").alias(name))
    met = dealt.join(found, F.col("doc_id").cast("long") == F.col(of), "left").drop(of)
    unnamed = docs.where(F.col("doc_id").isNull()).withColumn(name, F.lit(None).cast(found.schema[name].dataType))
    return met.unionByName(unnamed).withColumn(name, kept_words(F.col("text"), F.col(name), width))


def removed_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256. Repeated rows each
    have one; they are no duplicates of each other, and a null doc_id loses nothing."""
    out = with_kept(docs.select("doc_id", "text"), "__kept", **options)
    return out.select("doc_id", F.col("__kept.n_words").alias("n_words"), F.col("__kept.n_removed").alias("n_removed"), F.sha2(F.col("__kept.kept").cast("binary"), 256).alias("kept_sha256"))


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with duplicated words taken out of the text (kept words joined by one space, n_chars
    set to the new length where there is such a column). Texts that lose nothing stay as they are;
    documents that lose every word go."""
    kept = free_name(docs, "kept")
    out = with_kept(docs, kept, **options)
    lost = F.col(f"{kept}.n_removed")
    changed = {"text": F.when(lost > 0, F.col(f"{kept}.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost > 0, F.length(f"{kept}.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where((lost == 0) | (lost < F.col(f"{kept}.n_words"))).withColumns(changed).select(*docs.columns)
