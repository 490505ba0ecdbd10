"""Tables in the shared folder that the session's spark.checkpoint.dir names."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder; a temporary one where none is set and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def kept(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """``df`` written once and read again, by another session if one is given: what is read many times is
    computed once, plans stay small, and a lost executor costs nothing that was done before."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)
