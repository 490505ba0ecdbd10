"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral is the source's cumulative
demand of words; the demand's inverse turns the place of a document within its source into the
time at which training meets it. Documents are range-sorted by that time.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import cut, running_total, word_count

WEIGHTS = (5, 2, 1)
#: Slope of each source's schedule: above 0 the weight falls over time, below 0 it rises.
TILTS = (-0.5, 0.0, 0.5)
MOST_PASSES = 3


def _cycle(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES, total_share: float = 1.0) -> DataFrame:
    """One row per source of ``sizes`` (source, size): index by code point (null last), size, weight
    and target, which are words.

    Targets share ``total_share`` of all words by weight and stop at ``most`` times the source's
    size; what is above is shared again. With sources in order of cap / weight, the level at which
    the rest share by weight is found with running sums, which are dealt out over ranges of the
    sources: the first source that stays under its cap has the final level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    by_source = running_total(by_source.withColumn("one", F.lit(1)), [], ["unnamed", "source"], "one", "source_no").drop("one", "unnamed")
    ranked = by_source.withColumn("weight", _cycle(weights, F.col("source_no")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap").cast("double") / F.col("weight"))
    ranked = running_total(running_total(ranked, [], ["full_at", "source_no"], "cap", "caps"), [], ["full_at", "source_no"], "weight", "weights")
    ranked = cut(ranked)
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) * F.lit(float(total_share)) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    levels = ranked.withColumn("level", level)
    final = levels.where("level <= full_at").agg(F.min_by("level", F.struct("full_at", "source_no"))).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if final is None else F.least(F.col("weight") * F.lit(final), cap)
    return levels.select("source_no", "source", "source_size", target.alias("target"))


def demand_time(share: Column, tilt: Column) -> Column:
    """The time t with t + tilt * (t - t^2) = share: the inverse of a source's cumulative demand
    when its weight falls linearly from 1 + tilt to 1 - tilt."""
    up = 1 + tilt
    root = F.sqrt(F.greatest(up * up - 4 * tilt * share, F.lit(0.0)))
    return F.when(tilt == 0, share).otherwise((up - root) / (2 * tilt) + 0.0)


def curriculum(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES, tilts: Sequence[float] = TILTS, rows_a_bucket: int = 50_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size,
    target, taken and ``positions``, the times at which training meets it (none where it is left
    out), range-sorted by the first of them.

    Within a source documents come in the order of md5(doc_id), or of the text where there is no id,
    then size and text: reruns agree.
    A source's target is met by whole passes and then a part of one: the last pass takes the
    documents whose middle lies before its end, so a source is off by half a document at most.
    A null or empty text has size 0 and is never in the way; a null source is a source of its own.
    Rows that repeat are mixed like any others.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit("")))).cast("binary")).alias("place"), F.xxhash64("text").alias("tie")))
    targets = cut(source_targets(sized, weights, most))
    largest = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = 2
    while largest > rows_a_bucket * 16**digits and digits < 8:
        digits += 1
    if targets.count() <= 10_000:
        targets = F.broadcast(targets)
    # a hot source is spread over buckets of its order, whose sums give each bucket's start
    told = sized.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    told = told.withColumn("bucket", F.substring("place", 1, digits))
    starts = told.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = starts.withColumn("start", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bucket_size")
    within = Window.partitionBy("source_no", "bucket").orderBy("place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.join(starts, ["source_no", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    placed = placed.withColumn("passes", passes).withColumn("more", (F.col("before") + F.col("size") / 2 < rest).cast("long"))
    placed = placed.withColumn("times", F.col("passes") + F.col("more")).withColumn("tilt", _cycle(tilts, F.col("source_no")).cast("double"))
    share = lambda i: F.least((i * F.col("source_size") + F.col("before")) / F.col("target"), F.lit(1.0))
    positions = F.when((F.col("times") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.col("times") - 1), lambda i: demand_time(share(i), F.col("tilt")))).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumn("positions", positions)
    # documents that are left out come after the end, in their own order
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1)).otherwise(1 + F.col("before") / F.greatest(F.col("source_size"), F.lit(1)))
    out = placed.withColumn("first", first).withColumn("taken", F.col("size") * F.col("times"))
    out = out.repartitionByRange("first", "place").sortWithinPartitions("first", "place", "doc_id", "size", "tie")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "positions")
