"""Escapes for the report formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def xml_escape(text: Column) -> Column:
    return _replace_all(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                               ("'", "&apos;")])


def annotation_data(text: Column) -> Column:
    return _replace_all(text, [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")])


def annotation_property(text: Column) -> Column:
    return _replace_all(annotation_data(text), [(":", "%3A"), (",", "%2C")])


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("unknown")), r"([`|\\\r\n])", r"\\$1")
