"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from .tables import cut


def _meet(edges: DataFrame, mins: DataFrame) -> DataFrame:
    return edges.join(mins, "u")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots; a root is the smallest
    node of its component. Loops and repeated edges do no harm.

    A step gives each node's neighbours the smallest node it has seen, so every component ends as
    a star. Minima are pre-aggregated before each shuffle and written to the shared folder, so a
    node with very many edges is a plain join that Spark can split.
    """
    star = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        after = tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if after == before or not after[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
        # large star: neighbours above a node go to the smallest of its neighbours and itself
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(_meet(both, mins).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its neighbours below go to the smallest of them
        mins = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = _meet(large, mins).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = cut(moved.unionByName(mins.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"no star after {most_rounds} rounds")
