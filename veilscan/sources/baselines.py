"""Baseline files: the findings a team has accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.schemas import BASELINE_FILE_SCHEMA


def read_baseline_json(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``fingerprint`` of a baseline JSON file; missing or malformed gives none."""
    empty = spark.createDataFrame([], "fingerprint string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    parsed = F.from_json("value", BASELINE_FILE_SCHEMA)
    return (
        raw.select(F.explode(parsed["entries"]).alias("entry"))
        .select("entry.fingerprint").where("fingerprint IS NOT NULL").distinct()
    )


def read_baseline_table(spark: SparkSession, path: str) -> DataFrame:
    """Baseline written as a table (any size)."""
    return spark.read.parquet(path).select("fingerprint").distinct()
