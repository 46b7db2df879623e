"""Effective rules: built-ins plus custom rules, toggles and minimum severity."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.ambiguity import is_ambiguous
from veilscan.functions.regex import (
    has_nested_quantifier,
    literal_alternation,
    split_literal,
    to_re2,
    to_jvm_regex,
)
from veilscan.rules.catalog import Rule, builtin_rules
from veilscan.schemas import CUSTOM_RULE_SCHEMA, RULE_SCHEMA, SEVERITY_WEIGHT


class RuleError(ValueError):
    """A custom rule or rules file that cannot be used."""


def compile_custom_rule(definition: Mapping, check: bool = True) -> Rule:
    """Validate one custom rule definition and make it a rule."""
    rule_id = definition.get("id") or ""
    problems = [
        f"{key} must be a non-empty string"
        for key in ("id", "name", "regex")
        if not isinstance(definition.get(key), str) or not definition[key]
    ]
    severity = definition.get("severity") or "high"
    if severity not in SEVERITY_WEIGHT:
        problems.append(f"severity must be one of {', '.join(SEVERITY_WEIGHT)}")
    if problems:
        raise RuleError(f'Invalid custom rule "{rule_id}": ' + "; ".join(problems))

    source, flags = split_literal(definition["regex"])
    if "g" not in flags:
        flags += "g"
    if has_nested_quantifier(source) or is_ambiguous(source, flags):
        raise RuleError(
            f'Custom rule "{rule_id}" rejected: the pattern repeats a group that itself repeats or '
            "can read one text in several ways, which can take exponential time."
        )
    min_entropy = definition.get("minEntropy")
    requires = definition.get("requiresEntropy")
    rule = Rule(
        rule_id, source, tuple(definition.get("keywords") or ()), severity, flags,
        min_entropy, (min_entropy is not None) if requires is None else requires,
        definition["name"], definition.get("description") or "Custom user-defined detection rule",
    )
    if check:
        check_patterns([rule])
    return rule


def check_patterns(rules: list[Rule]) -> None:
    """Raise when the JVM cannot compile the pattern of a rule: one job for all of them, and more
    only to name the faulty one."""
    session = SparkSession.getActiveSession()
    if session is None or not rules:
        return
    try:
        session.range(1).select(
            *(F.regexp_instr(F.lit(""), F.lit(rule.pattern)) for rule in rules)).collect()
    except Exception as error:
        if len(rules) > 1:
            half = len(rules) // 2
            check_patterns(rules[:half])
            check_patterns(rules[half:])
        raise RuleError(f'Invalid regex in custom rule "{rules[0].rule_id}": {error}') from error


def load_custom_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Read a JSON rules file: an array of rules, or an object with ``customRules`` or ``rules``."""
    from pyspark.sql import types as T

    rule_array = T.ArrayType(CUSTOM_RULE_SCHEMA)
    wrapper = T.StructType([T.StructField("customRules", rule_array),
                            T.StructField("rules", rule_array)])
    body = F.regexp_replace(F.col("value"), "^﻿", "")
    try:
        row = (
            spark.read.text(path, wholetext=True)
            .select(
                body.rlike(r"^\s*\[").alias("is_array"),
                body.rlike(r"^\s*\{").alias("is_object"),
                F.try_parse_json(body).isNotNull().alias("is_json"),
                F.from_json(body, rule_array).alias("listed"),
                F.from_json(body, wrapper).alias("wrapped"),
            )
            .head()
        )
    except Exception as error:
        raise RuleError(f'Failed to read rules file at "{path}": {error}') from error
    if row is None or not row.is_json:
        raise RuleError(f'Invalid JSON in rules file "{path}"')
    if row.is_array:
        definitions = row.listed
    elif row.is_object and row.wrapped is not None:
        definitions = row.wrapped.customRules
        if definitions is None:
            definitions = row.wrapped.rules
    else:
        definitions = None
    if definitions is None:
        raise RuleError(f'Rules file "{path}" must hold a JSON array of rules or a "customRules" list')
    compiled = [compile_custom_rule(d.asDict(), check=False) for d in definitions]
    check_patterns(compiled)
    return compiled


@dataclass(frozen=True)
class RuleSet:
    """An ordered list of rules with the derived look-ups the scan needs."""

    rules: tuple[Rule, ...]

    def __len__(self) -> int:
        return len(self.rules)

    @cached_property
    def ids(self) -> list[str]:
        return [rule.rule_id for rule in self.rules]

    def only(self, rule_ids: Iterable[str]) -> RuleSet:
        wanted = set(rule_ids)
        return RuleSet(tuple(rule for rule in self.rules if rule.rule_id in wanted))

    def at_least(self, severity: str) -> RuleSet:
        """Drop rules below a severity before anything is matched."""
        if severity not in SEVERITY_WEIGHT:
            raise ValueError(f"unknown severity {severity!r}")
        floor = SEVERITY_WEIGHT[severity]
        return RuleSet(tuple(r for r in self.rules if SEVERITY_WEIGHT[r.severity] >= floor))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [rule.as_row(i) for i, rule in enumerate(self.rules)]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def joinable(self, spark: SparkSession) -> DataFrame:
        """Rule rows for the match join, sent to every task: the optimizer does not know their size and would
        shuffle the texts by rule, where a frequent rule is one task's work."""
        return F.broadcast(self.to_df(spark))

    @cached_property
    def anchor_regex(self) -> str | None:
        """Pattern over lower-case text that every text with a finding of a keyword rule matches."""
        literals = [k.lower() for r in self.rules if r.keywords and not r.anchor for k in r.keywords]
        tails: dict[str, list[str]] = {}
        for rule in self.rules:
            if rule.keywords and rule.anchor:
                tails.setdefault(to_jvm_regex(rule.anchor), []).append(rule.rule_id)
        parts = ([literal_alternation(literals)] if literals else []) + _share_tails(list(tails))
        return "|".join(parts) if parts else None

    @cached_property
    def anchor_re2(self) -> str | None:
        """The same for RE2; ``None`` when a rule without keywords has no RE2 form."""
        literals = [k.lower() for r in self.rules if r.keywords and not r.anchor for k in r.keywords]
        anchors = dict.fromkeys(r.anchor for r in self.rules if r.keywords and r.anchor)
        unkeyed = [_with_flags(to_re2(r.source), r.flags) for r in self.unkeyed]
        parts = [re.escape(word) for word in sorted(set(literals))]
        parts += _share_tails([to_re2(anchor) for anchor in anchors]) + unkeyed
        return "|".join(parts) or None

    @cached_property
    def unkeyed(self) -> list[Rule]:
        return [rule for rule in self.rules if not rule.keywords]

    @cached_property
    def keyword_regex(self) -> str | None:
        """Captures, at every offset, the longest keyword that starts there."""
        words = [k.lower() for rule in self.rules for k in rule.keywords]
        return f"(?=({literal_alternation(words)}))" if words else None

    @cached_property
    def keyword_owners(self) -> dict[str, list[int]]:
        """Keyword to the positions of all rules that have it."""
        owners: dict[str, set[int]] = {}
        for i, rule in enumerate(self.rules):
            for keyword in rule.keywords:
                owners.setdefault(keyword.lower(), set()).add(i)
        return {word: sorted(rules) for word, rules in owners.items()}

    @cached_property
    def rules_by_keyword(self) -> dict[str, list[int]]:
        """Keyword to the positions of all rules that have it, or any keyword inside it."""
        owners = self.keyword_owners
        return {
            word: sorted(set().union(*(owners[inner] for inner in owners if inner in word)))
            for word in owners
        }

    # -- columns --------------------------------------------------------------------------------

    def may_match(self, text: Column) -> Column:
        """Global pre-filter: false only for texts without any finding."""
        tests = [text.rlike(rule.pattern) for rule in self.unkeyed]
        if self.anchor_regex:
            tests.insert(0, F.lower(text).rlike(self.anchor_regex))
        if not tests:
            return F.lit(False)
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    def candidate_rules(self, text: Column) -> Column:
        """Positions of the rules whose keyword gate a text passes (array<int>)."""
        arrays = []
        if self.keyword_regex:
            lookup = F.from_json(
                F.lit(json.dumps(self.rules_by_keyword)), "map<string,array<int>>")
            found = F.array_distinct(
                F.regexp_extract_all(F.lower(text), F.lit(self.keyword_regex), F.lit(1)))
            arrays.append(F.flatten(F.transform(found, lambda word: F.element_at(lookup, word))))
        if self.unkeyed:
            arrays.append(F.array(*[F.lit(self.ids.index(r.rule_id)) for r in self.unkeyed]))
        if not arrays:
            return F.array().cast("array<int>")
        return F.array_distinct(F.concat(*arrays))


def _with_flags(pattern: str, flags: str) -> str:
    """An RE2 pattern under its own flags, within one that ignores case."""
    on = "".join(f for f in "ms" if f in flags)
    off = "" if "i" in flags else "-i"
    return f"(?{on}{off}:{pattern})" if on or off else f"(?:{pattern})"


def _share_tails(patterns: list[str]) -> list[str]:
    """Join ``(?:vendor)<same tail>`` patterns into one alternation in front of the shared tail."""
    shared: dict[str, list[str]] = {}
    rest: list[str] = []
    for pattern in patterns:
        m = re.match(r"^\(\?:([^()]*)\)(\(\?:.+)$", pattern, re.S)
        if m:
            shared.setdefault(m.group(2), []).append(m.group(1))
        else:
            rest.append(pattern)
    out = []
    for tail, heads in shared.items():
        words = [word for head in heads for word in head.split("|")]
        plain = [w for w in words if re.fullmatch(r"[\w ,-]+", w)]
        heads_regex = [literal_alternation(plain)] if plain else []
        heads_regex += [w for w in words if w not in plain]
        out.append("(?:" + "|".join(heads_regex) + ")" + tail)
    return out + rest


def effective_rules(
    custom: Iterable[Rule] = (),
    external: Iterable[Rule] = (),
    toggles: Mapping[str, bool] | None = None,
    min_severity: str = "low",
    builtin: Iterable[Rule] | None = None,
) -> RuleSet:
    """Merge built-in, custom and external rules.

    A built-in id cannot be overridden; an external rule replaces an earlier custom rule of the
    same id in place.  ``toggles`` switches rules off by id.
    """
    base = list(builtin_rules() if builtin is None else builtin)
    reserved = {rule.rule_id for rule in base}
    merged = {rule.rule_id: rule for rule in base}
    for rule in [*custom, *external]:
        if rule.rule_id not in reserved:
            merged[rule.rule_id] = rule
    toggles = dict(toggles or {})
    unknown = sorted(set(toggles) - reserved)
    if unknown:
        raise RuleError("unknown rule ids: " + ", ".join(unknown))
    kept = tuple(rule for rule in merged.values() if toggles.get(rule.rule_id, True))
    return RuleSet(kept).at_least(min_severity)
