"""Files to lines: numbering, previous line, merging of spliced lines, cutting of long ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.paths import any_of
from veilscan.functions.text import js_trim, js_trim_end

LINE_BREAK = r"\r?\n"
QUOTES = ["`", '"', "'"]
# Lines kept in one piece of the merge state; bounds what a step of the fold copies.
MERGE_BLOCK = 256


def split_lines(content: Column) -> Column:
    return F.split(content, LINE_BREAK, -1)


def line_rows(
    files: DataFrame, content: str = "content", merge: bool = False, needed: Column | None = None
) -> DataFrame:
    """Add ``rows``: ``array<struct<line, text, prev_text>>``, null where ``needed`` is false."""
    text = F.col(content) if needed is None else F.when(needed, F.col(content))
    df = files.withColumn("_lines", split_lines(text))
    if merge:
        return _merged_rows(df)
    none = F.array(F.lit(None).cast("string"))
    previous = F.concat(none, F.slice("_lines", F.lit(1), F.size("_lines") - 1))
    number = F.sequence(F.lit(1), F.size("_lines"))
    rows = F.arrays_zip(
        number.alias("line"), F.col("_lines").alias("text"), previous.alias("prev_text"))
    return df.withColumn("rows", F.when(F.col("_lines").isNotNull(), rows)).drop("_lines")


def to_lines(files: DataFrame, content: str = "content", merge: bool = False) -> DataFrame:
    """One row per line: ``line`` (from 1), ``text`` and ``prev_text``; other columns are kept.

    The previous line is taken from the array of lines, so no shuffle is needed.
    """
    keep = [c for c in files.columns if c != content]
    df = line_rows(files, content, merge)
    # Outer, though no file is without lines: for a plain explode of a column the optimizer adds a
    # filter on its size, which would split every text a second time.
    return df.select(*keep, F.explode_outer("rows").alias("_row")).select(
        *keep, "_row.line", "_row.text", "_row.prev_text")


def _odd_quotes(line: Column) -> Column:
    return any_of(
        (F.length(line) - F.length(F.replace(line, F.lit(q), F.lit("")))) % 2 == 1 for q in QUOTES)


def _has_quote(line: Column) -> Column:
    return any_of(line.contains(q) for q in QUOTES)


def _merged_rows(df: DataFrame) -> DataFrame:
    """Lines with an open quote or a trailing ``+`` or ``\\`` take in the next one or two lines.

    Which lines open a merge depends on their neighbours only; which of them are reached depends on
    the merges before, and a fold over the file's lines settles that.
    """
    lines, n = F.col("_lines"), F.size("_lines")

    def taken(line, i):
        is_open = _odd_quotes(line) | js_trim(line).rlike(r"[+\\]\z")
        closes = _has_quote(F.get(lines, i + 1)) | (i + 1 == n - 1)
        return F.when(is_open & (i < n - 1), F.when(closes, 1).otherwise(2)).otherwise(0)

    df = df.withColumn("_taken", F.transform(lines, taken))

    start = F.struct(
        F.lit(0).alias("skip"), F.array().cast("array<int>").alias("block"),
        F.array().cast("array<array<int>>").alias("blocks"))

    def step(state, item):
        full = F.size(state["block"]) >= MERGE_BLOCK
        here = F.array(item["at"])
        reached = F.struct(
            item["taken"].alias("skip"),
            F.when(full, here).otherwise(F.concat(state["block"], here)).alias("block"),
            F.when(full, F.concat(state["blocks"], F.array(state["block"])))
            .otherwise(state["blocks"]).alias("blocks"))
        consumed = F.struct(
            (state["skip"] - 1).alias("skip"), state["block"].alias("block"),
            state["blocks"].alias("blocks"))
        return F.when(state["skip"] > 0, consumed).otherwise(reached)

    items = F.transform("_taken", lambda t, i: F.struct(i.alias("at"), t.alias("taken")))
    folded = F.aggregate(
        items, start, step,
        lambda s: F.flatten(F.concat(s["blocks"], F.array(s["block"]))))
    untouched = F.sequence(F.lit(0), n - 1)
    reached = F.when(F.exists("_taken", lambda t: t > 0), folded).otherwise(untouched)

    def row(at):
        took = F.get(F.col("_taken"), at)

        def joined(count):
            tail = [js_trim(F.get(lines, at + k)) for k in range(1, count + 1)]
            return F.concat(js_trim_end(F.get(lines, at)), *tail)

        text = F.when(took == 2, joined(2)).when(took == 1, joined(1)).otherwise(
            F.get(lines, at))
        return F.struct(
            (at + took + 1).alias("line"), text.alias("text"),
            F.get(lines, at - 1).alias("prev_text"))

    rows = F.when(F.col("_lines").isNotNull(), F.transform(reached, row))
    return df.withColumn("rows", rows).drop("_lines", "_taken")


def cut_long_lines(lines: DataFrame, width: int, overlap: int) -> DataFrame:
    """Cut texts over ``width`` into overlapping windows and add ``col_shift``, their start.

    For callers that cannot hold a long line.  The scan does not use it: a window may cut a secret.
    """
    n, stride = F.length("text"), width - overlap
    last = (F.ceil((n - width) / stride) * stride).cast("int")
    starts = F.when(n > width, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(
        F.array(F.lit(0)))
    others = [c for c in lines.columns if c != "text"]
    return lines.select(*others, "text", F.explode(starts).alias("col_shift")).withColumn(
        "text", F.when(F.length("text") > width, F.substring(
            "text", F.col("col_shift") + 1, F.lit(width))).otherwise(F.col("text")))
