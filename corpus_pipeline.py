"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet; all but the last give the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm.common import materialize, table
from veilscan.llm.stages import drop_near_duplicates, hide_personal_data, keep_quality, pack_sequences

STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("pseudonyms", hide_personal_data),
    ("best-fit packing", pack_sequences),
]

#: No stage can be stated in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
