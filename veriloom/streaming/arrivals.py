"""Arriving files, verified as a stream: each batch adds its entries to a ledger of batches.

The ledger is a folder with one folder of entries per batch number. A batch that runs again after a
failure reads the batches before it and writes its own folder anew, so it leaves what it would have
left the first time. What an entry replaces stays until it is read: the latest entry of a hash counts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.verify import verified_entries
from ..sources.shared import kept

Check = Callable[[DataFrame], DataFrame]


def start_ledger(entries: DataFrame, path: str) -> None:
    """A ledger that holds ``entries`` (those of an earlier run, or none)."""
    entries.write.parquet(f"{path}/batch=-1")


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The entries that count: of each hash the latest, and all without a hash; only those of batches
    ``before`` a number, if it is given."""
    entries = spark.read.parquet(path)
    if before is not None:
        entries = entries.where(F.col("batch") < before)
    latest = F.row_number().over(Window.partitionBy("file_hash").orderBy(F.col("batch").desc(), F.col("saved_at").desc(), F.col("id").desc()))
    hashed = entries.where("file_hash is not null").withColumn("__n", latest).where("__n = 1").drop("__n")
    return hashed.unionByName(entries.where("file_hash is null")).drop("batch")


def batch_handler(spark: SparkSession, ledger: str, version: int, check: Check) -> Callable[[DataFrame, int], None]:
    """What a batch of files does: those that no earlier entry of this version answers are verified, and
    their entries become the batch's folder. All of it runs in the session ``spark``, whose plans adapt;
    those of a stream's own session do not."""

    def handle(batch: DataFrame, number: int) -> None:
        files = kept(batch, spark)
        if files.isEmpty():  # the stream's clock has moved, nothing else
            return
        entries, _ = verified_entries(files, read_ledger(spark, ledger, number), version, check)
        entries.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return handle


def incremental(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, repeats_within: str = "1 day") -> StreamingQuery:
    """Starts a stream that hands each batch of new file contents of ``files`` (id, file_hash, ...) to
    ``handle(batch, number)``.

    Repeats of a hash that arrive ``repeats_within`` of the first are dropped before anything is done
    for them, and state is held for so long only; later ones find the first one's entry in the ledger.
    The clock is that of arrival, so no file is ever late. Files without a hash are all new.
    """
    key = F.coalesce(F.concat(F.lit("hash "), "file_hash"), F.concat(F.lit("id "), F.col("id").cast("string")))
    known = files.withColumns({"__arrived": F.current_timestamp(), "__key": key}).withWatermark("__arrived", repeats_within)
    once = known.dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__arrived")
    return once.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
