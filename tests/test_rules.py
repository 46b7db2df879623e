import json
import re

import pytest
from examples import example
from pyspark.sql import functions as F

from veilscan.functions.regex import (
    count_groups,
    has_nested_quantifier,
    split_literal,
    to_jvm_regex,
)
from veilscan.operators.match import find_matches, keyword_candidates
from veilscan.operators.screen import HIT, screen
from veilscan.rules import (
    PRIVATE_KEY_HEADER,
    RuleError,
    RuleSet,
    builtin_rules,
    compile_custom_rule,
    effective_rules,
    load_custom_rules,
)
from veilscan.rules.remediation import explain_rule, list_rules


def test_catalog_totals(rules):
    severities = [r.severity for r in rules.rules]
    assert len(rules) == len(set(rules.ids)) == 204
    assert {s: severities.count(s) for s in set(severities)} == {
        "critical": 9, "high": 191, "medium": 4}
    assert sum(r.requires_entropy for r in rules.rules) == 99
    assert len({k for r in rules.rules for k in r.keywords}) == 224


def test_group_counts_match_python():
    for rule in builtin_rules():
        assert count_groups(rule.source) == re.compile(rule.source).groups, rule.rule_id


def _example_texts():
    rows = []
    for i, rule in enumerate(builtin_rules()):
        text = example(rule.source, re.I if "i" in rule.flags else 0)
        # The gate asks for a keyword anywhere in the text, not only inside the match.
        if not any(k.lower() in text.lower() for k in rule.keywords):
            text = rule.keywords[0] + " " + text
        rows.append((i, rule.rule_id, " " + text))
    return rows


def test_every_rule_matches_its_example_and_passes_gate_and_screen(spark, rules):
    rows = _example_texts()
    df = spark.createDataFrame(rows, "want int, want_id string, text string").withColumn(
        "offset", F.lit(0))
    gated = keyword_candidates(df, rules).where("want = rule_ord")
    found = {r.want_id for r in find_matches(gated).select("want_id").collect()}
    assert set(rules.ids) - found == set()
    for engine in ("arrow", "jvm"):
        passed = df.where(screen(F.col("text"), rules, engine=engine).bitwiseAND(HIT) > 0)
        assert set(rules.ids) - {r.want_id for r in passed.collect()} == set(), engine


def test_each_rule_is_screened_by_its_own_anchor(spark):
    for rule, (_, _, text) in list(zip(builtin_rules(), _example_texts()))[::17]:
        df = spark.createDataFrame([(text,)], "text string")
        alone = RuleSet((rule,))
        assert df.where(screen(F.col("text"), alone).bitwiseAND(HIT) > 0).count() == 1, rule.rule_id


def test_dialect_translation(spark):
    cases = [
        (r"\bid\b", "éid", True), (r"\bid\b", "_id", False), (r"end$", "end\n", False),
        (r"a\sb", "a b", True), (r"[\s]x", "﻿x", True), (r"[[]x", "[x", True),
        (r"[a&&b]", "&", True), ("a.b", "a\u0085b", True), ("a.b", "a\nb", False),
    ]
    for source, text, expected in cases:
        row = spark.range(1).select(F.lit(text).rlike(to_jvm_regex(source)).alias("hit")).head()
        assert row.hit == expected, source
    assert to_jvm_regex("a$", "im").startswith("(?im)")
    assert split_literal("/a(b)/gi") == ("a(b)", "gi")
    assert has_nested_quantifier("(a+)+") and not has_nested_quantifier("(abc)+")


def _definition(**changes):
    return {"id": "corp-token", "name": "Corporate token", "regex": "corp-[a-z0-9]{8}",
            "severity": "critical", **changes}


def test_custom_rule_finds_tokens(spark, scan):
    from veilscan.plans.scan import scan_lines

    rule = compile_custom_rule(_definition())
    df = spark.createDataFrame([("a.ts", 1, "const t = 'corp-abc12345';")],
                               "path string, line int, text string")
    found = scan_lines(df, RuleSet((rule,))).collect()
    assert [(r.rule_id, r.severity, r.column) for r in found] == [("corp-token", "critical", 12)]


@pytest.mark.parametrize("changes, words", [
    ({"regex": "[a-z("}, "Invalid regex"),
    ({"regex": "(a+)+"}, "repeats"),
    ({"regex": ""}, "regex"),
    ({"id": ""}, "id"),
    ({"severity": "huge"}, "severity"),
])
def test_bad_custom_rules(spark, changes, words):
    with pytest.raises(RuleError, match=words):
        compile_custom_rule(_definition(**changes))


def test_custom_rule_options(spark):
    rule = compile_custom_rule(_definition(regex="/TOK-(\\d+)/i", minEntropy=2.5))
    assert rule.flags == "ig" and rule.requires_entropy and rule.pattern.startswith("(?i)")
    assert not compile_custom_rule(_definition(minEntropy=2, requiresEntropy=False)).requires_entropy


def test_precedence_and_toggles(spark):
    mine = compile_custom_rule(_definition())
    newer = compile_custom_rule(_definition(regex="corp-[0-9]{4}"))
    clash = compile_custom_rule(_definition(id="aws-access-key"))
    merged = effective_rules([mine, clash], [newer])
    assert len(merged) == 205 and merged.rules[-1].source == "corp-[0-9]{4}"
    assert merged.rules[0].name == "AWS Access Key"
    assert "jwt" not in effective_rules(toggles={"jwt": False}).ids
    assert len(effective_rules(min_severity="critical")) == 9
    with pytest.raises(RuleError):
        effective_rules(toggles={"no-such-rule": False})


def test_rules_file(spark, tmp_path):
    listed, wrapped, broken, wrong = (tmp_path / n for n in "abcd")
    listed.write_text("﻿" + json.dumps([_definition()]), encoding="utf-8")
    wrapped.write_text(json.dumps({"rules": [_definition(id="x")]}))
    broken.write_text("{")
    wrong.write_text('{"other": 1}')
    assert load_custom_rules(spark, str(listed))[0].rule_id == "corp-token"
    assert load_custom_rules(spark, str(wrapped))[0].rule_id == "x"
    for bad in (broken, wrong, tmp_path / "missing"):
        with pytest.raises(RuleError):
            load_custom_rules(spark, str(bad))


def test_listing_and_explanation(spark, rules):
    assert list_rules(spark, rules).count() == 204
    steps = explain_rule(spark, rules, "AWS-Access-Key").collect()
    assert [s.step_no for s in steps] == [1, 2, 3] and steps[0].severity == "critical"
    assert explain_rule(spark, rules, "jwt").count() == 3
    assert explain_rule(spark, rules, "nothing").count() == 0


def test_header_rule_is_opt_in(spark, scan, rules):
    from veilscan.plans.scan import scan_lines

    df = spark.createDataFrame(
        [("k.pem", 1, "-----BEGIN RSA " + "PRIVATE KEY-----")], "path string, line int, text string")
    assert scan_lines(df, rules).count() == 0
    assert scan_lines(df, effective_rules([PRIVATE_KEY_HEADER])).count() == 1


def test_screen_shares_vendor_anchors():
    """Anchors that differ in their vendor alone are one alternative, or RE2 leaves its fast path."""
    import time

    import pyarrow as pa
    import pyarrow.compute as pc

    anchors = effective_rules().anchor_re2
    assert len(anchors) < 4_000 and anchors.count("{0,24}") <= 4
    lines = pa.array(["the quick brown fox jumps over the lazy dog, and so on; " * 3] * 5_000)

    def seconds(pattern):
        start = time.perf_counter()
        pc.match_substring_regex(lines, pattern, ignore_case=True)
        return time.perf_counter() - start

    assert min(seconds(anchors) for _ in range(3)) < 25 * min(seconds("zebra|giraffe|[qx]uokka") for _ in range(3))
