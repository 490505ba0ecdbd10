"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark columns. Paths of shallow trees over these statistics are rules,
conjunctions of comparisons; an L1-penalised logistic regression gives most rules weight zero, and
what is left is compiled into one Spark column. Scoring is a projection: nothing is shuffled and no
Python runs.
"""

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .tables import SPACE, cut, free_name


def _share(count: Column, of: Column) -> Column:
    return F.when(of > 0, count / of).otherwise(F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


#: Statistics of a text, by name.
NAMES = ("log_words", "word_length", "variety", "repeated_words", "upper_case", "digits", "symbols", "doubled_signs", "stops", "lone_signs")


def statistics(text: Column) -> Column:
    """A struct of the statistics of a whole text; null counts as empty, and an empty text has
    zeros and full variety."""
    words_of = lambda t: F.filter(F.split(t, SPACE), lambda w: w != "")
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(words_of(t), lambda words: _statistics(t, words)))


def _statistics(text: Column, words: Column) -> Column:
    chars, n = F.length(text), F.size(words)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    follower = F.slice(words, 2, F.greatest(n, F.lit(1)))
    same = F.filter(F.arrays_zip(words.alias("a"), follower.alias("b")), lambda p: p["a"] == p["b"])
    values = {
        "log_words": F.log1p(n),
        "word_length": _share(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), n),
        # against the logarithm of the length, for long texts repeat more of their words
        "variety": F.when(n > 1, F.log(F.size(F.array_distinct(words))) / F.log(n)).otherwise(F.lit(1.0)),
        "repeated_words": _share(F.size(same), n),
        "upper_case": _share(count(r"\p{Lu}"), chars),
        "digits": _share(count(r"[0-9]"), chars),
        "symbols": _share(count(r"[#$%&*+<=>@\\^_`{|}~]"), chars),
        "doubled_signs": _share(count(r"([#$%&*!?])\1"), n),
        "stops": _share(count(r"[.,;:]"), chars),
        "lone_signs": _share(F.size(F.filter(words, lambda w: (F.length(w) == 1) & ~w.rlike(r"[\p{L}\p{N}]"))), n),
    }
    return F.struct(*(values[name].cast("double").alias(name) for name in NAMES))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): above the threshold, or at most it."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, stats: dict[str, Column]) -> Column:
        return reduce(Column.__and__, (stats[name] > bound if above else stats[name] <= bound for name, above, bound in self.parts))

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>' if above else '<='} {bound:.6g}" for name, above, bound in self.parts)


def tree_rules(tree: str, names: Sequence[str]) -> list[Rule]:
    """The rules of a tree's description: each path from the root, to inner nodes and leaves."""
    rules, path = [], []
    for line in tree.splitlines():
        if found := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(found[1])
            path = [(d, part) for d, part in path if d < depth] + [(depth, (names[int(found[2])], found[3] == ">", float(found[4])))]
            rules.append(_shortened([part for _, part in path]))
    return rules


def _shortened(parts: list[tuple[str, bool, float]]) -> Rule:
    """Of several bounds on one side of a statistic the tightest stays."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, bound in parts:
        old = tight.get((name, above), bound)
        tight[name, above] = max(old, bound) if above else min(old, bound)
    return Rule(tuple((name, above, bound) for (name, above), bound in sorted(tight.items())))


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        """Probability of label 1, given columns of the statistics."""
        total = reduce(Column.__add__, (F.when(rule.holds(stats), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weights), F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, names: Sequence[str], trees: int = 12, depth: int = 3, penalty: float = 0.0005, seed: int = 17) -> RuleModel:
    """Model of ``rows`` (the statistics, label 0.0 or 1.0). With one label only, or without rows,
    the model is that label's share, kept inside 0..1."""
    ones, n = rows.agg(F.sum("label"), F.count("*")).first()
    if not n or ones in (0, n):
        share = ((ones or 0) + 0.5) / (n + 1)
        return RuleModel(math.log(share / (1 - share)), ())
    vectors = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows).select("features", "label", *names)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed).fit(vectors)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)))
    if not rules:
        return RuleModel(math.log(ones / (n - ones)), ())
    stats = {name: F.col(name) for name in names}
    marks = rows.select(F.array(*(r.holds(stats).cast("double") for r in rules)).alias("marks"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    model = lasso.fit(cut(marks.select(array_to_vector("marks").alias("features"), "label")))
    weights = tuple((r, float(w)) for r, w in zip(rules, model.coefficients) if w)
    return RuleModel(float(model.intercept), weights)


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id as text divisible by 5? A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Model of all ``labels`` (doc_id, quality) over the texts of ``docs`` (doc_id, text), without the
    held-out ids.

    Ids with null or conflicting labels are left out; only texts, never ids, languages or sources, make the
    statistics. These are made before labels meet them, so that no text is shuffled.
    """
    labels = labels.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("label")).where("labelled is not null and label is not null")
    labels = labels.groupBy("labelled").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other and label in (0, 1)").where(~held_out(F.col("labelled")))
    made = docs.where(~held_out(F.col("doc_id"))).select("doc_id", statistics(F.col("text")).alias("s"))
    met = made.join(labels, F.col("doc_id") == F.col("labelled"))
    # in order, since the samples that trees draw depend on it: reruns agree
    return fit(cut(met.sortWithinPartitions("doc_id").select("label", "s.*")), NAMES)


def with_score(docs: DataFrame, model: RuleModel, name: str) -> DataFrame:
    """``docs`` with the score of each text, also of null and empty ones."""
    score = _let(statistics(F.col("text")), lambda s: model.score({stat: s[stat] for stat in NAMES}))
    return docs.withColumn(name, score)


THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1: at or above threshold)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = with_score(docs, train(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score is under the threshold."""
    score = free_name(docs, "score")
    scored = with_score(docs, train(docs, labels), score)
    return scored.where(F.col(score) >= threshold).drop(score)
