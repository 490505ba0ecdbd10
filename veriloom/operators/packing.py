"""Greedy packing of ordered rows into chunks of a capacity, by pointer jumping.

A chunk takes rows while they fit, so where it ends depends on where it began, and that on all chunks
before. But where a chunk that begins at a row would end depends on that row only: every row has a
next chunk's start. Starts are marked from the first row on by doubling: what is marked leads to as
many more, and each pointer is then replaced by the pointer of where it leads. After as many rounds as
the logarithm of the most chunks of a document all starts are known. Each step is an equality join or
a window over rows that share less than twice a capacity, so one document of any number of rows is
many tasks' work.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import kept
from .running import RANGE, dealt, running


def pack(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, room: int, name: str, alone: Column | None = None, blank: Column | None = None, counted: Column | None = None, most: int = 0) -> DataFrame:
    """``rows`` with ``name``, the number of their chunk from 0 on.

    In ``order``, a row joins the chunk that is open while the weights of its rows, whole and not
    negative, stay within ``room``; else it begins the next one. Rows that are ``alone``, or above the
    room themselves, are a chunk each. ``blank`` rows begin no chunk: where one would, it is left out with
    null. Of ``counted`` rows a chunk has ``most`` at most. Order is total within the keys; no key is
    null.
    """
    no = F.lit(False)
    marked = rows.withColumns({"__weight": weight.cast("long"), "__blank": no if blank is None else blank, "__counted": no if counted is None else counted})
    marked = marked.withColumn("__alone", F.col("__weight") > room if alone is None else alone | (F.col("__weight") > room))
    lean = dealt(marked.select(*keys, *order, "__weight", "__blank", "__counted", "__alone"), keys, order)
    sums = {"n": F.lit(1), "before": F.col("__weight"), "alones": F.col("__alone").cast("int"), "full": (~F.col("__blank")).cast("int"), "seen": F.col("__counted").cast("int")}
    # rows between two that are alone are a segment, and so is each of these
    placed = running(lean, keys, order, sums).withColumn("segment", 2 * F.col("alones") + F.col("__alone").cast("int"))
    placed = kept(placed.drop("alones", "__alone"))
    of = [*keys, "segment"]

    whole = placed.groupBy(*of).agg(F.min(F.when(~F.col("__blank"), F.struct("n", "before"))).alias("first"), F.sum("__weight").alias("total"), F.count_if("__counted").alias("shown"))
    heads = whole.where("first is not null").select(*of, F.col("first.n").alias("n"), F.col("first.before").alias("begun"), (F.col("total") > room).alias("heavy"), (F.col("shown") > most).alias("crowded"))
    long = F.col("heavy") if counted is None else F.col("heavy") | F.col("crowded")
    heads = kept(heads.withColumn("long", long & (F.col("segment") % 2 == 0)))  # a row alone leads nowhere
    starts = heads.select(*keys, "n", "begun")
    if not heads.where("long").isEmpty():
        chained = placed.join(heads.where("long").select(*of), of, "left_semi")
        starts = _chains(kept(_next(chained, of, room, most if counted is not None else None)), keys, starts, heads.where("long").select(*keys, "n"))
    return _numbered(rows, placed, starts, keys, order, room, name)


def _next(rows: DataFrame, of: list[str], room: int, most: int | None) -> DataFrame:
    """(keys, n, begun, to): for each row that is not blank, the row of its segment that begins the next
    chunk after one that begins there.

    Rows lie in buckets of the room by their running weight. The first row above a bound is in the
    bound's bucket or, since no row is heavier than the room, leads the next one.
    """
    end = F.col("before") + F.col("__weight")
    bucket = lambda c: F.floor(c / (room + 1)).cast("long")
    there = rows.select(*of, end.alias("value"), "n")
    asked = rows.where("not __blank").select(*of, (F.col("before") + room).alias("value")).distinct()
    both = there.withColumn("asks", F.lit(False)).unionByName(asked.select("*", F.lit(None).cast(dict(rows.dtypes)["n"]).alias("n"), F.lit(True).alias("asks"))).withColumn("bucket", bucket(F.col("value")))
    above = Window.partitionBy(*of, "bucket").orderBy(F.col("value").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("to", F.min("n").over(above)).where("asks").select(*of, "value", "bucket", "to")
    leads = there.groupBy(*of, bucket(F.col("value")).alias("lead")).agg(F.min("n").alias("leads"))
    found = found.join(leads.withColumn("bucket", F.col("lead") - 1).drop("lead"), [*of, "bucket"], "left")
    ends = found.select(*of, (F.col("value") - room).alias("before"), F.coalesce("to", "leads").alias("to"))
    out = rows.where("not __blank").join(ends, [*of, "before"], "left")
    if most is not None:  # the counted row that is one too many
        beyond = rows.where("__counted").select(*of, (F.col("seen") - most).alias("seen"), F.col("n").alias("crowd"))
        out = out.join(beyond, [*of, "seen"], "left").withColumn("to", F.least("to", "crowd"))
    # where a blank row would begin a chunk the next other one does
    at = rows.select(*of, F.col("n").alias("to"), F.col("full").alias("nth"))
    full = rows.where("not __blank").select(*of, F.col("full").alias("nth"), F.col("n").alias("lands"), F.col("before").alias("begins"))
    out = out.where("to is not null").join(at, [*of, "to"]).join(full, [*of, "nth"])
    return out.select(*of[:-1], "n", F.col("lands").alias("to"), "begins")


def _chains(jumps: DataFrame, keys: Sequence[str], starts: DataFrame, heads: DataFrame) -> DataFrame:
    """``starts`` with all rows that ``jumps`` (keys, n, to, begins) lead to from the heads. The marked rows
    double with each round, as do the lengths of jumps; each round's rows are dealt anew, so that files
    follow rows and not rounds."""
    marked = heads
    while True:
        led = kept(marked.join(jumps, [*keys, "n"]).select(*keys, F.col("to").alias("n"), F.col("begins").alias("begun")).repartition(*keys, "n"))
        if led.isEmpty():
            return starts
        starts, marked = starts.unionByName(led), marked.unionByName(led.drop("begun"))
        further = jumps.select(*keys, F.col("n").alias("to"), F.col("to").alias("to2"), F.col("begins").alias("begins2"))
        jumps = kept(jumps.join(further, [*keys, "to"]).select(*keys, "n", F.col("to2").alias("to"), F.col("begins2").alias("begins")))


def _numbered(rows: DataFrame, placed: DataFrame, starts: DataFrame, keys: Sequence[str], order: Sequence[str], room: int, name: str) -> DataFrame:
    flagged = placed.select(RANGE, *keys, *order, "n", "segment", "__blank", (F.col("before") + F.col("__weight")).alias("end")).join(starts, [*keys, "n"], "left")
    counts = running(flagged, keys, ["n"], {"nth": F.col("begun").isNotNull().cast("int")}, inclusive=True)
    last = running(counts, keys, ["n"], {"since": F.col("begun"), "in": F.when(F.col("begun").isNotNull(), F.col("segment"))}, inclusive=True, combine=F.max)
    out = F.col("__blank") & ((F.col("in") != F.col("segment")) | (F.col("end") > F.col("since") + room) | F.col("in").isNull())
    numbers = last.select(*keys, *order, F.when(~out, F.col("nth") - 1).alias(name))
    return rows.join(numbers, [*keys, *order])
