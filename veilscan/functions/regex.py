"""Bring ECMAScript-flavoured patterns to java.util.regex, and the match idioms built on it.

Rules are written in the dialect their authors use (ECMAScript).  Four things differ in the JVM:
``\\b`` is Unicode-aware, ``$`` also matches before a last newline, ``\\s`` and ``.`` cover other
code points, and a class may not hold a bare ``[`` or ``&&``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript defines it (the part outside the JVM's own \s).
_WIDE_SPACE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_NOT_WORD_EDGE = r"(?:(?<!\w)(?!\w)|(?<=\w)(?=\w))"
_OUTSIDE = {r"\b": _WORD_EDGE, r"\B": _NOT_WORD_EDGE, r"\s": rf"[\s{_WIDE_SPACE}]",
            r"\S": rf"[^\s{_WIDE_SPACE}]"}

_LITERAL = re.compile(r"^/(.+)/([a-z]*)$", re.I | re.S)
_NESTED_QUANTIFIER = re.compile(r"\([^()]*[+*][^()]*\)[+*]")


def to_jvm_regex(source: str, flags: str = "") -> str:
    """Rewrite an ECMAScript pattern (and its flags) as a java.util.regex pattern."""
    out: list[str] = []
    in_class = False
    for token in re.findall(r"\\.|.", source, re.S):
        if in_class:
            if token == "]":
                in_class = False
            elif token in ("[", "&"):
                token = "\\" + token
            elif token == r"\s":
                token = r"\s" + _WIDE_SPACE
            elif token == r"\b":
                token = r"\x08"
        elif token == "[":
            in_class = True
        elif token == "." and "s" not in flags:
            token = r"[^\n\r\u2028\u2029]"
        elif token == "$" and "m" not in flags:
            token = r"\z"
        else:
            token = _OUTSIDE.get(token, token)
        out.append(token)
    inline = "".join(f for f in "ims" if f in flags)
    return (f"(?{inline})" if inline else "") + "".join(out)


def to_re2(source: str) -> str:
    """The same pattern for RE2, whose ``\\s`` is narrower still."""
    wide = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", r"\s\v" + _WIDE_SPACE)
    out, in_class = [], False
    for token in re.findall(r"\\.|.", source, re.S):
        if token == r"\s":
            token = wide if in_class else f"[{wide}]"
        elif token in ("[", "]"):
            in_class = token == "["
        out.append(token)
    return "".join(out)


_CLASS = re.compile(r"\\.|\[((?:\\.|[^\]\\])+)\]", re.S)


def any_character(pattern: str) -> str:
    """The same JVM pattern with a dot for classes of white space and all else, which are asked for each part."""
    def dot(m):
        body = m.group(1) or ""
        tokens = re.findall(r"\\.|.", body, re.S)
        return "(?s:.)" if not body.startswith("^") and "&&" not in body and "[" not in body and {
            r"\s", r"\S"} <= set(tokens) else m.group()

    return _CLASS.sub(dot, pattern)


def split_literal(regex: str) -> tuple[str, str]:
    """Split ``/body/flags`` into body and flags; a bare body has no flags."""
    m = _LITERAL.match(regex)
    return (m.group(1), m.group(2)) if m else (regex, "")


def has_nested_quantifier(source: str) -> bool:
    """Static check for a repeated group that itself holds a repeat, such as ``(a+)+``."""
    return _NESTED_QUANTIFIER.search(source) is not None


def count_groups(source: str) -> int:
    """Number of capturing groups in a pattern."""
    groups, in_class = 0, False
    for m in re.finditer(r"\\.|\[|\]|\((?!\?)|\(\?<(?![=!])", source, re.S):
        token = m.group()
        if token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        elif token.startswith("(") and not in_class:
            groups += 1
    return groups


def literal_alternation(words: list[str]) -> str:
    """Alternation of literals factored by first letter, longest first.

    The regex engine tries the branches one after the other at every offset, so grouping by the
    first letter cuts the branches tried per offset from the number of words to the number of
    initials.
    """
    by_initial: dict[str, list[str]] = {}
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        by_initial.setdefault(word[0], []).append(word[1:])
    return "|".join(
        jvm_quote(first) + "(?:" + "|".join(jvm_quote(rest) for rest in rests) + ")"
        for first, rests in sorted(by_initial.items())
    )


def jvm_quote(text: str) -> str:
    """Escape a literal for use in a JVM pattern."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text) if text.isascii() else re.escape(text)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``, which may use it any number of times."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def replace_matches(text: Column, pattern: str, group: int, fn) -> Column:
    """Replace every match of ``pattern`` by ``fn(group)``; rows without a match pass through.

    Built-in expressions only: the pieces between matches are zipped with the rewritten matches.
    The text appears once in the expression, so that such replacements can be nested.
    """
    def rewrite(t):
        gaps = F.split(t, pattern, -1)
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), fn)
        woven = F.zip_with(
            gaps, F.concat(hits, F.array(F.lit(""))), lambda gap, hit: F.concat(gap, hit))
        return F.when(t.rlike(pattern), F.array_join(woven, "")).otherwise(t)

    return let(text, rewrite)


def match_spans(text: Column, pattern: Column | str | Callable) -> Column:
    """All matches as ``array<struct<hit, pos>>``; ``pos`` counts characters from 0.

    The position of a match is the length of the gaps up to it plus the matches before it.  The
    usual single match in ASCII text is simply looked up, without the pattern where it stands once.  Instead of a pattern a function may be given
    that makes a column out of what is to be done with the row's pattern.
    """
    if isinstance(pattern, str):
        pattern = F.lit(pattern)
    with_pattern = pattern if not isinstance(pattern, Column) else lambda use: use(pattern)

    def one(hits):
        def place(at):
            again = F.call_function("locate", hits[0], text, at + 1)
            return F.when(again > 0, with_pattern(lambda p: F.regexp_instr(text, p))).otherwise(at)

        return F.array(F.struct(
            hits[0].alias("hit"), (let(F.instr(text, hits[0]), place) - 1).alias("pos")))

    def many(hits):
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))

        def step(state, pair):
            at = state["next"] + F.length(pair["gap"])
            return F.struct((at + F.length(pair["hit"])).alias("next"),
                            F.concat(state["at"], F.array(at)).alias("at"))

        pairs = F.zip_with(
            hits, F.slice(with_pattern(lambda p: F.split(text, p, -1)), F.lit(1), F.size(hits)),
            lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
        return F.zip_with(
            hits, F.aggregate(pairs, start, step)["at"],
            lambda hit, at: F.struct(hit.alias("hit"), at.alias("pos")))

    def spans(hits):
        plain = F.octet_length(text) == F.length(text)
        none = F.array().cast("array<struct<hit:string,pos:int>>")
        return F.when(F.size(hits) == 0, none).when((F.size(hits) == 1) & plain, one(hits)).otherwise(many(hits))

    return let(with_pattern(lambda p: F.regexp_extract_all(text, p, F.lit(0))), spans)
