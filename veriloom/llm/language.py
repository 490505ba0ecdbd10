"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed over all learned texts; their logarithms are one matrix,
which is sent to every task and bounded in size however many languages there are. Texts are scored
in numpy, many at once: each n-gram picks its row of the matrix.
"""

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: The matrix of languages and hash buckets holds so many numbers at most.
MOST_NUMBERS = 1 << 24
_PIECE = 1 << 20
_BLANK = 32
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id as text 1 modulo 3? A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def _plain() -> np.ndarray:
    """For each code point the one that stands for it: letters in lower case, marks, else a blank."""
    out = np.full(0x110000, _BLANK, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a blank before each and one at the end, runs of blanks as one; and
    where each text begins."""
    codes = [np.frombuffer(f" {t or ''}".encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    starts = np.cumsum([0, *map(len, codes)])
    plain = _plain()[np.concatenate([*codes, np.array([_BLANK], dtype=np.uint32)])]
    keep = np.ones(len(plain), dtype=bool)
    keep[1:] = (plain[1:] != _BLANK) | (plain[:-1] != _BLANK)
    keep[starts] = True  # a text's own blank, and the last
    at = np.cumsum(keep) - 1
    return plain[keep], at[starts]


def hashed(codes: np.ndarray, begin: int, end: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (positions, buckets) of the n-grams that begin in ``codes[begin:end]``: parts of
    single words with a blank at most at either end."""
    for n in ORDERS:
        stop = min(end, len(codes) - n + 1)
        if stop <= begin:
            continue
        part = codes[begin : stop + n - 1].astype(np.uint64)
        size = stop - begin
        h = np.full(size, np.uint64(n), dtype=np.uint64)
        for i in range(n):
            h = (h ^ part[i : i + size]) * _STEP
        blank = part == _BLANK
        ok = ~(blank[:size] & blank[n - 1 : n - 1 + size])
        for i in range(1, n - 1):
            ok &= ~blank[i : i + size]
        at = np.flatnonzero(ok)
        yield at + begin, ((h[at] * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``weights``: log-probabilities by language and bucket; ``prior``: by language."""

    languages: tuple[str, ...]
    bits: int
    weights: np.ndarray
    prior: np.ndarray

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, has a letter) of some texts."""
        total, lettered = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=bool)
        if not texts:
            return total, lettered
        codes, starts = _letters(texts)
        for begin in range(0, len(codes), _PIECE):
            for positions, buckets in hashed(codes, begin, begin + _PIECE, self.bits):
                if not len(positions):
                    continue
                text = np.searchsorted(starts, positions, side="right") - 1
                first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                lettered[text[first]] = True
                for language, weights in enumerate(self.weights):
                    total[text[first], language] += np.add.reduceat(weights[buckets], first, dtype=np.float64)
        return total, lettered


def _slices(lengths: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together, or of one text."""
    at, ends = 0, np.cumsum(lengths)
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def train(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Model of ``docs`` (doc_id, text, lang): all rows with a text, a language and an id that is there
    and not held out. Rows that repeat are learned as often; a model of no rows knows no language."""
    spark = docs.sparkSession
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    sizes = sorted(map(tuple, usable.groupBy("lang").count().collect()))
    names, n_docs = tuple(name for name, _ in sizes), np.array([n for _, n in sizes], dtype=float)
    bits = min(18, int(math.log2(MOST_NUMBERS / max(1, len(names)))))
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()])
            texts = batch.column("text")
            for lang in np.unique(langs):
                mine = texts.take(pa.array(np.flatnonzero(langs == lang)))
                into = counts.setdefault(int(lang), np.zeros(1 << bits, dtype=np.int64))
                for at, to in _slices(np.array([len(t) for t in mine.to_pylist()])):
                    codes, _ = _letters(mine.slice(at, to - at).to_pylist())
                    for begin in range(0, len(codes), _PIECE):
                        for _, buckets in hashed(codes, begin, begin + _PIECE, bits):
                            into += np.bincount(buckets, minlength=1 << bits)
        for lang, into in counts.items():
            there = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), lang, dtype=np.int32)), pa.array(there), pa.array(into[there])], ["lang", "bucket", "n"])

    # a task's counts are of one size however much it reads: some tasks a core are enough
    told = usable.coalesce(4 * spark.sparkContext.defaultParallelism).mapInArrow(count, "lang int, bucket long, n long")
    total = np.full((len(names), 1 << bits), smoothing)
    if names:
        summed = told.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        total[summed.column("lang").to_numpy(), summed.column("bucket").to_numpy()] += summed.column("n").to_numpy()
    weights = np.log(total / total.sum(1, keepdims=True)).astype(np.float32)
    return Model(names, bits, weights, np.log(n_docs / max(1.0, n_docs.sum())))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text): the language of the
    highest posterior probability, and that probability. A text that is null or has no letter, and
    any text where no language is known, is ``und`` with score 0. Equal probabilities go to the first
    language by name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, lengths = batch.column("text"), batch.column("chars").fill_null(0).to_numpy()
            names, scores = [], []
            for at, to in _slices(lengths):
                total, lettered = model.log_likelihoods(texts.slice(at, to - at).to_pylist())
                if not model.languages:
                    names += [UNKNOWN] * (to - at)
                    scores += [0.0] * (to - at)
                    continue
                total += model.prior
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores += np.where(lettered, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.length("text").alias("chars"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """predict with a model that is learned from the same rows, where they are not held out."""
    return predict(docs, train(docs))
