"""Toxicity: severity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector for all thresholds, which are ordered
by construction. Weights and thresholds maximise the likelihood of the grades under an L1 penalty on
the weights alone, which leaves few features with weight; folds of the training rows choose the
penalty. The expected severity is the sum of the P(grade > k). A feature is whether a text has a word,
or one, two or three different words with a given beginning: insults are often inflected or composed,
and one such word may be chance.
"""

import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut

_WORDS = re.compile(r"[^\W\d_]+").findall
STEMS = (4, 5, 6, 7)
MOST = 3


def features(text: str | None, stems: Collection[int] = STEMS, wanted: set[str] | None = None) -> set[str]:
    """Words of a text in lower case, and beginnings of longer words (those ``wanted``, if given)
    with a hyphen and the numbers from 1 to ``MOST`` of different words that begin so."""
    words = set(_WORDS((text or "").lower()))
    starts = (w[:k] for w in words for k in stems if len(w) > k)
    begun = Counter(starts if wanted is None else filter(wanted.__contains__, starts))
    return words | {f"{stem}-{n}" for stem, found in begun.items() for n in range(1, min(found, MOST) + 1)}


@dataclass(frozen=True)
class OrdinalModel:
    """``weights`` by feature; ``thresholds`` ascend, one fewer than the grades."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def exceed(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of latent scores w . x."""
        return 1 / (1 + np.exp(-(latent[:, None] - np.asarray(self.thresholds)[None, :])))

    def latent(self, texts: Iterable[str | None]) -> np.ndarray:
        wanted = {f[: f.index("-")] for f in self.weights if "-" in f}
        stems = {len(stem) for stem in wanted}
        return np.array([math.fsum(self.weights[f] for f in features(text, stems, wanted) & self.weights.keys()) for text in texts], dtype=float)


def _has(column: Column):
    return F.pandas_udf(lambda texts: pd.Series([sorted(features(t)) for t in texts]), "array<string>")(column)


def grades(rows: DataFrame, telling: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """``rows`` (id, fold, toxic, has) with a grade: 0 where the label is not toxic, else 1 and one more
    for each of ``bounds`` that the number of its ``telling`` features (fold, feature) reaches."""
    hits = rows.where("toxic = 1").select("id", "fold", F.explode("has").alias("feature")).join(telling, ["fold", "feature"]).groupBy("id").agg(F.count("*").alias("hits"))
    grade = F.lit(1)
    for bound in bounds:
        grade = grade + (F.coalesce(F.col("hits"), F.lit(0)) >= bound).cast("int")
    return rows.join(hits, "id", "left").withColumn("grade", F.when(F.col("toxic") == 1, grade).otherwise(0))


class Rows:
    """Sparse 0/1 rows: ``at`` holds the places of the ones, row after row from ``starts``."""

    def __init__(self, at: np.ndarray, starts: np.ndarray, grade: np.ndarray, n_features: int) -> None:
        self.at, self.grade, self.n_features = at.astype(np.int32), grade, n_features
        self.sizes = np.diff(np.r_[starts, len(at)]).astype(np.int64)
        self.filled = np.flatnonzero(self.sizes)
        self.starts = starts[self.filled].astype(np.int64)
        self.owner = np.repeat(np.arange(len(grade), dtype=np.int32), self.sizes)

    def take(self, mask: np.ndarray) -> "Rows":
        kept = self.sizes[mask]
        return Rows(self.at[np.repeat(mask, self.sizes)], np.cumsum(kept) - kept, self.grade[mask], self.n_features)

    def latent(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.grade))
        if len(self.filled):
            out[self.filled] = np.add.reduceat(w[self.at], self.starts)
        return out

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, residual[self.owner], self.n_features)


def loss(rows: Rows, w: np.ndarray, theta: np.ndarray, gradients: bool = True) -> tuple:
    """Mean negative log likelihood of the grades, and its gradients by weights and by ``theta``: the
    first threshold and the logarithms of the steps to the next ones."""
    cuts = thresholds_of(theta)
    z = rows.latent(w)[:, None] - cuts[None, :]
    above = np.c_[np.ones(len(z)), 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.zeros(len(z))]  # P(grade > -1, 0, 1, ...)
    i, n = np.arange(len(z)), len(z)
    hi, lo = above[i, rows.grade], above[i, rows.grade + 1]
    p = np.maximum(hi - lo, 1e-12)
    value = float(-np.log(p).mean())
    if not gradients:
        return (value,)
    by_cut = np.zeros((n, len(cuts) + 2))
    by_cut[i, rows.grade] += hi * (1 - hi) / p
    by_cut[i, rows.grade + 1] -= lo * (1 - lo) / p
    by_cuts = by_cut[:, 1:-1].sum(0) / n
    later = np.cumsum(by_cuts[::-1])[::-1]  # a step moves all later thresholds
    return value, rows.back((hi + lo - 1) / n), np.r_[later[0], later[1:] * np.exp(theta[1:])]


def thresholds_of(theta: np.ndarray) -> np.ndarray:
    return theta[0] + np.r_[0.0, np.cumsum(np.exp(theta[1:]))]


def fit_rows(rows: Rows, levels: int, penalty: float, start: tuple[np.ndarray, np.ndarray] | None = None, most_steps: int = 300, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and theta of least loss + penalty * sum |w|, by accelerated proximal gradient steps
    with a step length that is halved where a step is too long, and restarts."""
    if start is None:
        share = np.clip([(rows.grade > k).mean() for k in range(levels)], 1e-4, 1 - 1e-4)
        first = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(levels))
        start = np.zeros(rows.n_features), np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-3))]
    x = np.concatenate(start)
    n = rows.n_features
    y, momentum, length, last = x.copy(), 1.0, 4.0, np.inf
    for _ in range(most_steps):
        value, by_w, by_theta = loss(rows, y[:n], y[n:])
        gradient = np.r_[by_w, by_theta]
        while True:
            new = y - length * gradient
            new[:n] = np.sign(new[:n]) * np.maximum(np.abs(new[:n]) - length * penalty, 0)
            step = new - y
            after = loss(rows, new[:n], new[n:], gradients=False)[0]
            if after <= value + gradient @ step + step @ step / (2 * length) + 1e-12 or length < 1e-6:
                break
            length /= 2
        total = after + penalty * np.abs(new[:n]).sum()
        if total > last:
            y, momentum = x.copy(), 1.0  # restart from the best point
            if np.abs(step).max() < tolerance:
                break
            last = np.inf
            continue
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        y, x = new + (momentum - 1) / following * (new - x), new
        done = last - total < tolerance * max(1.0, abs(total))
        momentum, last, length = following, total, length * 1.1
        if done:
            break
    return x[:n], x[n:]


def chosen_fit(rows: Rows, fold: np.ndarray, levels: int, penalties: Sequence[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """The fit of all rows with the penalty of least loss over the ``fold``s, each judged by the fit of
    the others."""
    lost = dict.fromkeys(sorted(penalties, reverse=True), 0.0)
    for k in np.unique(fold):
        train, test, start = rows.take(fold != k), rows.take(fold == k), None
        if len(np.unique(train.grade)) < 2:
            continue
        for penalty in lost:  # from few weights to many, each from the last
            start = fit_rows(train, levels, penalty, start, most_steps=40)
            lost[penalty] += loss(test, *start, gradients=False)[0] * len(test.grade)
    best = min(lost, key=lost.get)
    return *fit_rows(rows, levels, best), best


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_z: float = 2.5, fewest: int = 4, bounds: tuple[int, ...] = (3, 6), penalties: Sequence[float] = (0.0002, 0.0001, 0.00005), folds: int = 3) -> OrdinalModel:
    """Model of ``labels`` (doc_id, toxic) over the texts of ``docs`` (doc_id, text), without the
    held-out ids.

    About ``most_rows`` labelled documents are used, those with the smallest hashes of their ids.
    Features in at least ``fewest`` of them whose log odds differ from chance by ``least_z`` standard
    errors are the columns, however many they are. The tables label only whether a text is toxic; how
    many telling features it has grades the toxic ones, and which features tell is learned from the
    documents of other folds than its own. The rows, sparse and of a bounded number, are fitted in
    one task.
    """
    from .quality import held_out

    labels = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    labels = labels.groupBy("id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("id")))
    n = labels.count()
    part = min(1.0, most_rows / n) if n else 1.0
    sample = labels.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    fold = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(folds)).cast("int")
    rows = cut(chosen.select("id", fold.alias("fold"), "toxic", _has(F.col("text")).alias("has")))
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == total:
        share = (bad + 0.5) / (total + 1)
        return OrdinalModel({}, tuple(math.log((1 - share) / share) + k for k in range(len(bounds) + 1)))
    by_fold = cut(rows.select("fold", "toxic", F.explode("has").alias("feature")).groupBy("feature", "fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")))
    whole = by_fold.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    names = sorted(r[0] for r in _scored(whole, fewest, bad / (total - bad)).where(F.abs("z") >= least_z).select("feature").collect())
    # of each fold: what the other folds tell
    others = whole.where("bad > 0").join(by_fold.withColumnsRenamed({"n": "own_n", "bad": "own_bad"}), "feature").select("feature", "fold", (F.col("n") - F.col("own_n")).alias("n"), (F.col("bad") - F.col("own_bad")).alias("bad"))
    telling = _scored(others, fewest, bad / (total - bad)).where("z > 4 and share > 0.6").select("fold", "feature")
    place, levels = {w: i for i, w in enumerate(names)}, len(bounds) + 1
    shared = docs.sparkSession.sparkContext.broadcast(place)

    @F.pandas_udf("array<int>")
    def places(has: pd.Series) -> pd.Series:
        return pd.Series([sorted(shared.value[w] for w in words if w in shared.value) for words in has])

    sparse = cut(grades(rows, telling, bounds).select("id", "fold", "grade", places(F.col("has")).alias("at")))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(batches)).sort_values("id")
        sizes = table["at"].str.len().to_numpy()
        data = Rows(np.concatenate(table["at"].to_numpy()).astype(np.int64), np.cumsum(sizes) - sizes, table["grade"].to_numpy().astype(np.int64), len(place))
        w, theta, penalty = chosen_fit(data, table["fold"].to_numpy(), levels, penalties)
        yield pd.DataFrame({"w": [w.tolist()], "theta": [theta.tolist()], "penalty": [penalty]})

    w, theta, _ = sparse.coalesce(1).mapInPandas(train, "w array<double>, theta array<double>, penalty double").first()
    return OrdinalModel({f: x for f, x in zip(names, w) if abs(x) > 1e-6}, tuple(thresholds_of(np.array(theta)).tolist()))


def _scored(counts: DataFrame, fewest: int, odds: float) -> DataFrame:
    """``counts`` (feature, n, bad) of the features in ``fewest`` documents at least, with ``z``, their log
    odds of a toxic label against ``odds`` in standard errors, and the share of toxic ones."""
    a, b = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    z = (F.log(a / b) - math.log(odds)) / F.sqrt(1 / a + 1 / b)
    return counts.where(F.col("n") >= fewest).withColumns({"z": z, "share": a / (a + b)})


def severity(docs: DataFrame, model: OrdinalModel, toxic_at: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, toxic (1 where P(grade > 0) reaches
    ``toxic_at``), grade (number of thresholds that are exceeded more likely than not) and the
    expected severity. A null or empty text has no features and the base rate's severity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<toxic: int, grade: int, severity: double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        exceed = shared.value.exceed(shared.value.latent(texts))
        return pd.DataFrame({"toxic": (exceed[:, 0] >= toxic_at).astype("int32"), "grade": (exceed >= 0.5).sum(1).astype("int32"), "severity": exceed.sum(1)})

    return docs.select("doc_id", run(F.col("text").cast("string")).alias("s")).select("doc_id", "s.toxic", "s.grade", "s.severity")
