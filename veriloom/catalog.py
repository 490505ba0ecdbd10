"""Registered queries of the verification engine and their SQL oracles."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans import corpus, records, verification
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claimed order totals have which verdict."""
    verdicts = QUERIES["j1_check_amounts"](spark, sf_dir)
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")).orderBy("verdict")
