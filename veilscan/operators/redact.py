"""Texts with their secrets masked: literal ones, and those that only a disguise or an encoding shows.

A finding in a normalised or decoded text is led back to the characters of the file that it came
from.  Normalisation keeps, step by step, how many characters each change had and has; a decoded
finding belongs to the tokens of the normalised line out of which it can be decoded again.  What is
masked are characters of the source, so that a second scan finds nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from veilscan.functions.normalize import join_wrapped_base64, normalized_with_lineage
from veilscan.functions.text import (
    MASK_ALL_UP_TO,
    MASK_REVEAL_MAX,
    MASK_REVEAL_SHARE,
    WHITESPACE,
    js_trim,
    mask,
)
from veilscan.operators.lines import LINE_BREAK, to_lines
from veilscan.operators.segments import DEFAULT_DECODE_DEPTH, decode_texts, encoded_tokens


def mask_all(text: Column, secrets: Column) -> Column:
    """Mask every occurrence of the given secrets, longer ones first."""
    ordered = F.reverse(F.array_sort(F.transform(
        F.array_distinct(secrets),
        lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    return F.aggregate(
        ordered, text, lambda acc, item: F.replace(acc, item["s"], mask(item["s"])))


def redact(corpus: DataFrame, findings: DataFrame, content: str = "content") -> DataFrame:
    """Replace the secrets found in each file by their masked values.

    ``findings`` must still hold ``secret``.  Distinct secrets are gathered per file before the
    join, so a file's row meets one small row.  Files without findings pass through unchanged.
    """
    found = (
        findings.where("secret <> ''").select("path", "secret").distinct()
        .groupBy("path").agg(F.collect_list("secret").alias("_secrets"))
    )
    masked = F.when(F.col("_secrets").isNull(), F.col(content)).otherwise(
        mask_all(F.col(content), F.col("_secrets")))
    return corpus.join(found, "path", "left").withColumn(content, masked).drop("_secrets")


def source_span(start: int, end: int, steps) -> tuple[int, int]:
    """The characters of the source out of which ``start`` to ``end`` of a normalised text came.

    ``steps`` are the changes of each step, in order.  A span that meets a change takes in all of what
    the change replaced.
    """
    for changes in reversed(steps):
        first = last = None
        new = old = 0  # where the stretch begins in the text after the step, and before it
        for change in changes:
            kept = new + change["gap"]
            if first is None and start < kept:
                first = start - new + old
            if last is None and end <= kept:
                last = end - new + old
            new, old = kept, old + change["gap"]
            if first is None and start < new + change["new"]:
                first = old
            if last is None and end <= new + change["new"]:
                last = old + change["old"]
            new, old = new + change["new"], old + change["old"]
        start = start - new + old if first is None else first
        end = end - new + old if last is None else last
    return start, end


SPANS = types.ArrayType(types.StructType([
    types.StructField(name, types.IntegerType()) for name in ("line", "start", "stop")]))


@F.arrow_udf(SPANS)
def _led_back(line: pa.Array, trimmed: pa.Array, wrapped: pa.Array, steps: pa.Array,
              found: pa.Array) -> pa.Array:
    """Spans of one line's normalised text as spans of its file's lines.

    ``wrapped`` is -1, or how many characters of the line before stand in front of the text; ``trimmed``
    holds how many were taken from the start of the line before and of the line itself.
    """
    def one(number, trimmed, joined, changes, spans):
        out = []
        for span in spans if spans is not None else ():
            start, stop = span["start"], span["stop"]
            if not span["raw"]:
                start, stop = source_span(start, stop, changes)
            elif joined >= 0:
                start, stop = start + joined - trimmed[1], stop + joined - trimmed[1]
            if joined < 0:
                out.append({"line": number, "start": start, "stop": stop})
                continue
            if start < joined:
                out.append({"line": number - 1, "start": start + trimmed[0], "stop": min(stop, joined) + trimmed[0]})
            if stop > joined:
                out.append({"line": number, "start": max(start - joined, 0) + trimmed[1],
                            "stop": stop - joined + trimmed[1]})
        return out

    rows = zip(*(column.to_pylist() for column in (line, trimmed, wrapped, steps, found)))
    return pa.array([one(*row) for row in rows], pa.list_(pa.struct(
        [(name, pa.int32()) for name in ("line", "start", "stop")])))


def secret_spans(lines: DataFrame, findings: DataFrame, decode_depth: int = DEFAULT_DECODE_DEPTH) -> DataFrame:
    """``path, spans``: the characters of each file's lines that its findings came from.

    ``lines`` are those that were scanned; ``findings`` must still hold ``secret``.  Only lines with
    findings are looked at; spans of one file come together in one row, as its text does.
    """
    spots = findings.where("secret <> '' and codec <> 'block'").groupBy("path", "line").agg(
        F.collect_set(F.struct("depth", "codec", "column", "secret")).alias("spots"))
    df = lines.select("path", "line", "text", "prev_text").join(spots, ["path", "line"])
    df = df.withColumn("joined", join_wrapped_base64(F.col("text"), F.col("prev_text")))
    is_joined = F.col("joined") != F.col("text")
    leading = lambda text: F.length(text) - F.length(F.ltrim(text, F.lit(WHITESPACE)))
    df = df.withColumns({
        "wrapped": F.when(is_joined, F.length(js_trim(F.col("prev_text")))).otherwise(-1),
        "trimmed": F.when(is_joined, F.array(leading(F.col("prev_text")), leading(F.col("text"))))
        .otherwise(F.array(F.lit(0), F.lit(0))),
        "n": normalized_with_lineage(F.col("joined"))})
    direct = F.transform(
        F.filter("spots", lambda s: s["depth"] == 0),
        lambda s: F.struct((s["column"] - 1).alias("start"),
                           (s["column"] - 1 + F.length(s["secret"])).alias("stop"),
                           (s["codec"] == "raw").alias("raw")))
    hidden = F.transform(F.filter("spots", lambda s: s["depth"] > 0), lambda s: s["secret"])
    tokens = df.where(F.size(hidden) > 0).select(
        "path", "line", hidden.alias("hidden"), F.explode(encoded_tokens(F.col("n.text"))).alias("token")).select(
        "path", "line", "hidden", F.col("token.pos").alias("pos"), F.length("token.hit").alias("size"),
        F.col("token.hit").alias("text"))
    holds = F.exists("hidden", lambda s: F.contains(F.col("text"), s))
    decoded = decode_texts(tokens.withColumn("token", F.col("text")), "text", decode_depth).where(holds).groupBy(
        "path", "line").agg(F.collect_set(F.struct(
            F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("stop"), F.lit(False).alias("raw"))).alias("more"))
    none = F.array().cast("array<struct<start:int,stop:int,raw:boolean>>")
    every = df.join(decoded, ["path", "line"], "left").withColumn(
        "found", F.concat(direct, F.coalesce("more", none)))
    led = every.withColumn("spans", _led_back("line", "trimmed", "wrapped", "n.changes", "found"))
    return led.groupBy("path").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _mask(text: str) -> str:
    shown = min(MASK_REVEAL_MAX, int(len(text) * MASK_REVEAL_SHARE)) if len(text) > MASK_ALL_UP_TO else 0
    head = shown // 2
    return text[:head] + "*" * (len(text) - shown) + text[len(text) - (shown - head):]


@F.arrow_udf(types.StringType())
def _masked(content: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts with the union of their spans masked; null where there is none."""
    def one(text, found):
        if text is None or found is None:
            return text
        starts = [0, *(m.end() for m in re.finditer(LINE_BREAK, text))]
        places = sorted((starts[s["line"] - 1] + s["start"], starts[s["line"] - 1] + s["stop"]) for s in found)
        out, at = [], 0
        while places:
            start, stop = places.pop(0)
            while places and places[0][0] <= stop:
                stop = max(stop, places.pop(0)[1])
            out += [text[at:start], _mask(text[start:stop])]
            at = stop
        return "".join([*out, text[at:]])

    return pa.array([one(*row) for row in zip(content.to_pylist(), spans.to_pylist())], pa.string())


def redact_texts(
    files: DataFrame, findings: DataFrame, content: str = "content",
    decode_depth: int = DEFAULT_DECODE_DEPTH,
) -> DataFrame:
    """``files`` with the source of every finding masked, however it was disguised or encoded.

    ``findings`` are those of ``scan_texts`` over the same files, by lines as they stand, with
    ``keep_secret``.  Secrets over several lines are masked as they stand.  Files keep their length;
    null texts, and files without findings, pass through.  ``path`` has to tell files apart.
    """
    spans = secret_spans(to_lines(files.select("path", content), content), findings, decode_depth)
    blocks = findings.where("secret <> '' and codec = 'block'")
    marked = files.join(spans, "path", "left").withColumn("_with", F.when(F.col("spans").isNotNull(), F.col(content)))
    masked = marked.withColumn(content, F.coalesce(_masked("_with", "spans"), F.col(content))).drop("spans", "_with")
    return redact(masked, blocks, content)
