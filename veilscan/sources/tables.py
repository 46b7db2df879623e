"""Text tables as corpora of ``(path, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_corpus(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Any table as a corpus: one row per text."""
    return df.select(path.cast("string").alias("path"), content.alias("content"))


def documents_corpus(documents: DataFrame) -> DataFrame:
    return as_corpus(
        documents, F.format_string("documents/%d.txt", F.col("doc_id")), F.col("text"))


def pages_corpus(pages: DataFrame) -> DataFrame:
    return as_corpus(pages, F.col("url"), F.col("html"))


def conversations_corpus(conversations: DataFrame) -> DataFrame:
    return as_corpus(
        conversations, F.format_string("conversations/%d#%d", F.col("conv_id"), F.col("turn")),
        F.col("text"))


def events_corpus(events: DataFrame) -> DataFrame:
    return as_corpus(events, F.format_string("events/%d.json", F.col("event_id")), F.col("props"))


def seeded_lines(orders: DataFrame) -> DataFrame:
    """A leak corpus derived from order keys: ``path, line, kind, text``.

    The supplied texts hold hardly any vendor-shaped secrets; ten kinds of line, each from the MD5
    of its key, exercise the rules, the filters and the decoders on as many rows as there are orders.
    """
    k = F.col("o_orderkey")
    h = F.md5(k.cast("string").cast("binary"))
    ak = F.concat(F.lit("AK"), F.lit("IA"), F.upper(F.substring(h, 1, 16)))
    kind = k % 10
    folder = F.when(k % 3 == 0, "/tests/").otherwise("/")
    path = F.concat(F.lit("src/m"), k % 7, folder, F.lit("f"), k % 50, F.lit(".ts"))

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    texts = [
        text("aws_access_key_id = ", ak),
        text("registry auth npm_", h, F.substring(h, 1, 4)),
        text('password: "', F.substring(h, 1, 12), '"'),
        text("Authorization: Bearer ", h),
        text('k = "', ak, '" // scan:ignore'),
        text("url postgres://svc:", F.substring(h, 1, 14), "@db.internal:5432/app"),
        text("blob ", F.base64(ak.cast("binary"))),
        text("blob ", F.lower(F.hex(ak))),
        text('api_key = "change_me_', h, '"'),
        text("order note ", h),
    ]
    line = F.lit(None).cast("string")
    for i, value in enumerate(texts):
        line = F.when(kind == i, value).otherwise(line)
    return orders.select(path.alias("path"), k.alias("line"), kind.alias("kind"),
                         line.alias("text"))
