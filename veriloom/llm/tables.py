"""Reading the input tables, and cutting lineage with tables in the shared folder."""

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: White space between words, and the words themselves.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: executors may be lost without its
    lineage being run again, and later joins see a plain scan whose skew Spark can split."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, n_dealt: int | None = None) -> DataFrame:
    """``df`` with a column ``name``: the sum of ``value`` over the rows of the same ``keys`` (null is
    a key) that come before in ``order``, nulls first.

    Rows are dealt out by ranges of keys and order (its first ``n_dealt`` columns: bounds of ranges
    are held by the driver, so they are not to be long), so a hot key is many tasks' work; a range's
    own sums, one row per key and range, give its start.
    """
    at, start = free_name(df, "range"), free_name(df, "start")
    dealt = cut(df.repartitionByRange(*keys, *order[:n_dealt]).withColumn(at, F.spark_partition_id()))
    sums = dealt.groupBy(at, *keys).agg(F.sum(value).alias(start))
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn(start, F.coalesce(F.sum(start).over(earlier), F.lit(0)))
    of = {c: free_name(dealt, f"of_{c}") for c in (at, *keys)}
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(o)) for c, o in of.items()))
    met = dealt.join(starts.withColumnsRenamed(of), same).drop(*of.values())
    before = Window.partitionBy(at, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn(name, F.col(start) + F.coalesce(F.sum(value).over(before), F.lit(0))).drop(at, start)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken, name = {c.lower() for c in df.columns}, f"__{re.sub(r'[^a-z0-9_]', '_', stem.lower())}"
    while name in taken:
        name += "_"
    return name
