"""Stages of the corpus pipeline: documents in, the columns of documents out, but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import nbsvm
from veilscan.llm.common import materialize, table
from veilscan.llm.jaccard_join import row_classes, text_key
from veilscan.llm.packing import pack
from veilscan.llm.pseudonyms import pseudonymize
from veilscan.llm.queries import PSEUDONYM_KEY, pieces_of


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside fold 0.

    Null and empty texts are scored like others; repeated rows are kept or go together.  Other columns,
    whatever their names, stay as they are.  An empty table gives no rows.
    """
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    columns = [F.col(f"doc.{c}").alias(c) for c in docs.columns]
    # The score's columns must not meet a document's own.
    scored = nbsvm.score(docs.select(F.struct("*").alias("doc"), "text"), model)
    return scored.where("predicted = 1").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest number of each class of near copies.

    Only the keys of rows that go are joined with the documents.  Rows that share a number, and rows
    without one, are told apart by their text: one of equal ones stays.  Texts without words are kept
    each.  An empty table gives no rows.
    """
    classes = materialize(row_classes(docs), "classes")
    keys = ["doc_id", "text_key"]
    leaves = classes.where(~F.col("first")).select(*keys).distinct()
    again = materialize(classes.where("first").groupBy(*keys).count().where("count > 1").select(*keys), "again")
    same = lambda rows, keys: rows["doc_id"].eqNullSafe(keys["doc_id"]) & (
        text_key(rows["text"]) == keys["text_key"])
    kept = docs.join(leaves, same(docs, leaves), "left_anti")
    return kept.join(again, same(kept, again), "left_anti").unionByName(
        kept.join(again, same(kept, again), "left_semi").dropDuplicates(["doc_id", "text"]))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms; ``n_chars`` follows the text.

    Null texts stay null, with a null ``n_chars``; every row is kept, with its other columns.  An empty
    table gives no rows.
    """
    changed = pseudonymize(docs, PSEUDONYM_KEY, found="_pii").drop("_pii")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4,096 tokens.

    A null text is an empty one, of one token; repeated rows and rows without a number are packed each.
    An empty table gives no rows.
    """
    return pack(pieces_of(docs))
