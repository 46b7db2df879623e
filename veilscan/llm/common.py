"""Helpers that the operators share: tables, the shared folder, digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that ``materialize`` writes are named so.
PREFIX = "veilscan-"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on a single machine (as in tests) where ``spark.checkpoint.dir`` is unset a folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix=PREFIX))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled for the table is of no more use once it is written, and is let go of then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{PREFIX}{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Empty tables that ``materialize`` wrote, once all that is made of them is written."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith(PREFIX):
                raise ValueError(f"not a table of materialize(): {folder}")
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(folder)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that what is made of one stays small.

    Later pieces are copies: some kernels (``ascii_lower``) misread arrays that begin within a buffer.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            yield piece.take(pa.array(range(piece.num_rows), pa.int32())) if at else piece
