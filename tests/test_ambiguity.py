"""Patterns that take exponential time, and patterns that look like them."""

import pytest

from veilscan.functions.ambiguity import is_ambiguous
from veilscan.rules.catalog import builtin_rules
from veilscan.rules.ruleset import RuleError, compile_custom_rule

UNSAFE = ["(a+)+b", "(a*)*", "(a|a)*b", "(?:a|ab|b)*c", r"(\w|\d)+x", "(a?b?)*c", "(?:a{2,3})*b",
          r"(?:\s*\w+\s*)*;", r"x(?:[a-z]+-?)+y", "(?:(?:ab)+c?)*d", r"^(?:.|\n|[a-c])*$", "(?:a|A)*b",
          r"(?:\w{1,20}){1,30}!", "(?=(a|a)+b)", "(?<n>x+)*y"]
SAFE = ["(ab)+c", "(a|b)*c", r"(?:\d+,)*\d+", r"(?:[^\"\\]|\\.)*\"", "(?:a{2})*b", "a*a*b", r"(?:\s+\w+)*;",
        "[a-z]+@[a-z]+", "(?:ab|ac)*d", "(?:[a-f0-9]{32})+", "(?:a++)+b", "(?>a+)+b", "(?:x|)*y", "", "(", "(?:a|A)*b"]


@pytest.mark.parametrize("pattern", UNSAFE)
def test_ambiguous_loops(pattern):
    assert is_ambiguous(pattern, "i")


@pytest.mark.parametrize("pattern", SAFE)
def test_loops_with_one_reading(pattern):
    assert not is_ambiguous(pattern)


def test_built_in_rules_are_unambiguous():
    assert [rule.rule_id for rule in builtin_rules() if is_ambiguous(rule.source, rule.flags)] == []


def test_custom_rules_are_judged():
    rule = {"id": "own", "name": "own", "keywords": ["own"]}
    with pytest.raises(RuleError, match="exponential"):
        compile_custom_rule({**rule, "regex": r"own(?:a|ab|b)*c"}, check=False)
    assert compile_custom_rule({**rule, "regex": r"own(?:a|b)*c"}, check=False).rule_id == "own"
