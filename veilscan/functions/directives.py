"""Inline comments that silence findings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.regex import to_jvm_regex
from veilscan.functions.text import js_trim

DEFAULT_TAG = "scan"
COMMENT_OPENINGS = ("//", "#", "--", "/*", "<!--")
# What ends the list of rules: the comment's end or the next comment.
_ENDS = r"-->|\*/|#|//"


def _pattern(tag: str, kind: str) -> str:
    """A comment's opening, the tag and the kind, and the words after it up to the line's end."""
    opening = "(?:" + "|".join(map(re.escape, COMMENT_OPENINGS)) + ")"
    return to_jvm_regex(
        rf"{opening}\s*{re.escape(tag)}:{kind}(?=\s|{_ENDS}|$)([^\r\n]*)", "i")


def parse_directive(text: Column, kind: str = "ignore", tag: str = DEFAULT_TAG) -> Column:
    """``struct<all boolean, rules array<string>>``; null when the line has no such comment.

    ``kind`` is ``ignore`` (this line) or ``ignore-next-line``.
    """
    pattern = _pattern(tag, kind)
    words = F.regexp_extract(text, pattern, 1)
    listed = js_trim(F.regexp_replace(words, rf"(?:{_ENDS}).*$", ""))
    listed = js_trim(F.regexp_replace(F.regexp_replace(listed, r"^\[", ""), r"\]\z", ""))
    words = F.split(listed, to_jvm_regex(r"[\s,]+"), -1)
    rules = F.filter(words, lambda w: w != "")
    parsed = F.struct((F.size(rules) == 0).alias("all"), rules.alias("rules"))
    found = text.rlike(pattern)
    if tag.isascii():  # few texts hold the tag at all
        found = F.contains(F.lower(text), F.lit(f"{tag}:{kind}".lower())) & found
    return F.when(found, parsed)


def silenced(
    text: Column, previous: Column | None = None, tag: str = DEFAULT_TAG
) -> tuple[Column, Column]:
    """(whole line silenced, ids of silenced rules) from the line and the one before it."""
    found = [parse_directive(text, "ignore", tag)]
    if previous is not None:
        found.append(parse_directive(previous, "ignore-next-line", tag))
    empty = F.array().cast("array<string>")
    everything = F.lit(False)
    rules = empty
    for directive in found:
        everything = everything | F.coalesce(directive["all"], F.lit(False))
        rules = F.concat(rules, F.coalesce(directive["rules"], empty))
    return everything, rules
