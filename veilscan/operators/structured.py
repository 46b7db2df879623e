"""Structured files: every string leaf of a JSON document, every entry of a dotenv file.

A leaf becomes a synthetic line ``key: value``, so that the ordinary rules apply to it.
"""

from __future__ import annotations

import json
import re
from itertools import dropwhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.paths import any_of, suffix
from veilscan.functions.regex import let
from veilscan.functions.text import js_trim
from veilscan.operators.lines import split_lines
from veilscan.operators.screen import in_short_batches

LEAF_TYPE = T.ArrayType(T.StructType([
    T.StructField(name, T.StringType()) for name in ("key", "leaf_path", "value")]))


_TOKEN = re.compile(r"""[ \t\n\r]*(?:([][{}:,])|("(?:[^"\\]|\\.)*")|([^][{}:,"\s]+))""", re.S)


def _parse_deep(text: str):
    """What ``json.loads`` gives, for documents nested deeper than it goes.

    A stack of open containers; ``wanted`` says what may come next.
    """
    stack, root, wanted, key, at = [], None, "value", None, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at:].strip(" \t\n\r"):
                raise ValueError(f"no JSON at {at}")
            break
        at, (mark, quoted, bare) = m.end(), m.groups()
        if mark in ("}", "]"):
            if not stack or isinstance(stack[-1], dict) != (mark == "}") or (
                    wanted not in ("next", "key or end", "value or end")):
                raise ValueError(f"unexpected {mark} at {at}")
            stack.pop()
            wanted = "next" if stack else "nothing"
        elif mark == ",":
            if wanted != "next":
                raise ValueError(f"unexpected , at {at}")
            wanted = "key" if isinstance(stack[-1], dict) else "value"
        elif mark == ":":
            if wanted != "colon":
                raise ValueError(f"unexpected : at {at}")
            wanted = "value"
        elif wanted in ("key", "key or end"):
            if not quoted:
                raise ValueError(f"no key at {at}")
            key, wanted = json.loads(quoted), "colon"
        elif wanted in ("value", "value or end"):
            value = {} if mark == "{" else [] if mark == "[" else json.loads(quoted or bare)
            if not stack:
                root = value
            elif isinstance(stack[-1], dict):
                stack[-1][key] = value
            else:
                stack[-1].append(value)
            if mark:
                stack.append(value)
                wanted = "key or end" if mark == "{" else "value or end"
            else:
                wanted = "next" if stack else "nothing"
        else:
            raise ValueError(f"unexpected token at {at}")
    if stack or wanted != "nothing":
        raise ValueError("unfinished JSON")
    return root


def _string_leaves(node) -> list[dict]:
    """String leaves in document order.  Walked with a stack: documents may nest to any depth."""
    out, keys = [], []
    walks = [iter(node.items() if isinstance(node, dict) else enumerate(node))]
    while walks:
        for key, value in walks[-1]:
            if isinstance(value, str):
                out.append({"key": str(key), "value": value,
                            "leaf_path": ".".join(dropwhile(lambda k: not k, [*keys, str(key)]))})
            elif isinstance(value, (dict, list)):
                keys.append(str(key))
                walks.append(iter(value.items() if isinstance(value, dict) else enumerate(value)))
                break
        else:
            walks.pop()
            if keys:
                keys.pop()
    return out


def _whole(text: str) -> str:
    """Halves of surrogate pairs, which escapes may give, as replacement characters."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@F.arrow_udf(LEAF_TYPE)
def _leaves(document: pa.Array) -> pa.Array:
    """String leaves of each document in document order; null where it is null or not JSON."""
    def leaves(text):
        if text is None:
            return None
        try:
            try:
                node = json.loads(text)
            except RecursionError:
                node = _parse_deep(text)
        except ValueError:
            return None
        found = _string_leaves(node) if isinstance(node, (dict, list)) else []
        return [{name: _whole(value) for name, value in leaf.items()} for leaf in found]

    kind = pa.list_(pa.struct([("key", pa.string()), ("leaf_path", pa.string()),
                               ("value", pa.string())]))
    return pa.array([leaves(t) for t in document.to_pylist()], kind)


def json_leaves(df: DataFrame, column: str, out: str = "leaves", when: Column | None = None):
    """Add ``out``: string leaves of the JSON text, or null where it is not valid JSON.

    One walk for documents of any size and depth; texts that are not asked for are null to it.
    """
    text = F.col(column) if when is None else F.when(when, F.col(column))
    # Declared non-deterministic: the optimizer must not copy the call into other expressions.
    return in_short_batches(df).withColumn(out, _leaves.asNondeterministic()(text))


def env_entries(content: Column) -> Column:
    """``array<struct<line, text>>`` of the entries of a dotenv text."""
    def unquote(value):
        quoted = any_of(value.startswith(q) & value.endswith(q) for q in ('"', "'"))
        inner = F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))
        return F.when(quoted, inner).otherwise(value)

    def parse(trimmed, i):
        at = F.instr(trimmed, "=")
        value = let(js_trim(F.substring(trimmed, at + 1, F.length(trimmed))), unquote)
        is_entry = ~trimmed.startswith("#") & (at > 0)
        return F.when(is_entry, F.struct(
            (i + 1).alias("line"),
            F.concat(js_trim(F.left(trimmed, at - 1)), F.lit(": "), value).alias("text")))

    def entry(line, i):
        return let(js_trim(line), lambda trimmed: parse(trimmed, i))

    entries = F.transform(split_lines(content), entry)
    return F.filter(entries, lambda e: e.isNotNull())


def structured_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``entries``: ``array<struct<line, text, leaf_path>>`` of structured files.

    Null when the file must be read line by line: not structured or not parseable.
    """
    text = F.col(content)
    df = json_leaves(files, content, "_leaves", suffix(F.col("path")) == "json")
    leaf_rows = F.transform("_leaves", lambda leaf: F.struct(
        F.lit(1).alias("line"),
        F.concat(leaf["key"], F.lit(": "), leaf["value"]).alias("text"),
        leaf["leaf_path"].alias("leaf_path")))
    env_rows = F.transform(env_entries(text), lambda e: F.struct(
        e["line"].alias("line"), e["text"].alias("text"),
        F.lit(None).cast("string").alias("leaf_path")))
    entries = F.when(F.col("_leaves").isNotNull(), leaf_rows).when(
        suffix(F.col("path")) == "env", env_rows)
    return df.withColumn("entries", entries).drop("_leaves")
