"""Segments to findings: keyword gate, patterns, value filters, masking."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import text as T
from veilscan.functions.directives import DEFAULT_TAG, silenced
from veilscan.functions.placeholders import is_placeholder
from veilscan.functions.regex import any_character, let, match_spans
from veilscan.operators.screen import candidate_rules, in_short_batches
from veilscan.rules import Rule, RuleSet


def keyword_candidates(segments: DataFrame, rules: RuleSet, engine: str = "arrow") -> DataFrame:
    """One row per text and rule whose keyword it holds (rules without keywords always run)."""
    candidates = in_short_batches(segments).withColumn(
        "_rules", candidate_rules(F.col("text"), rules, engine)).withColumn(
        "rule_ord", F.explode("_rules")).drop("_rules")
    return candidates.join(rules.joinable(segments.sparkSession), "rule_ord")


def _by_rule(rules: RuleSet, leaf: Callable[[Rule], Column]) -> Column:
    """The column that ``leaf`` makes for the row's own rule, found by halving.

    Each rule has an expression of its own, which compiles its pattern once a task; one expression with the
    pattern as a column compiles it anew whenever the rule changes from row to row.
    """
    def choose(position, first, last):
        if last - first == 1:
            return leaf(rules.rules[first])
        middle = (first + last) // 2
        return F.when(position < middle, choose(position, first, middle)).otherwise(choose(position, middle, last))

    return let(F.col("rule_ord"), lambda position: choose(position, 0, len(rules)))


def find_matches(candidates: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """All matches of the row's own pattern: ``secret``, ``matched`` and ``column``.

    ``probe`` settles cheaply whether there is a match at all before spans are computed.  Rows stay where
    they are: sorting or moving them by rule would pile the frequent rules up on a few tasks.  Patterns are
    columns, or, when the ``rules`` that the rows were joined with are given, parts of the plan.
    """
    text, pattern = F.col("text"), F.col("pattern")
    groups = ("secret_group", "fallback_group")
    # Group 0 stands for the whole match, which the spans hold already.
    if rules:
        none = F.lit(None).cast("array<string>")
        df = candidates
        # A probe that is the pattern itself would only read the text once more.
        if any(rule.probe_pattern != rule.pattern for rule in rules.rules):
            df = df.where(_by_rule(rules, lambda rule: F.lit(True) if rule.probe_pattern == rule.pattern
                                   else text.rlike(rule.probe_pattern)))
        spans = match_spans(text, lambda use: _by_rule(rules, lambda rule: use(F.lit(any_character(rule.pattern)))))
        primary, fallback = [
            F.when(F.size("_span") > 0, _by_rule(rules, lambda rule, group=group: F.regexp_extract_all(
                text, F.lit(any_character(rule.pattern)), F.lit(getattr(rule, group)))
                if getattr(rule, group) > 0 else none))
            for group in groups
        ]
    else:
        df = candidates.where(F.regexp_instr(text, F.col("probe")) > 0)
        spans = match_spans(text, pattern)
        primary, fallback = [
            F.when(F.col(group) > 0, F.regexp_extract_all(text, pattern, F.col(group)))
            for group in groups
        ]
    df = df.withColumn("_span", spans).withColumn("_first", primary).withColumn("_second", fallback)
    none = F.array_repeat(F.lit(None).cast("string"), F.size("_span"))
    rows = F.arrays_zip(
        "_span", F.coalesce("_first", none).alias("_first"),
        F.coalesce("_second", none).alias("_second"))
    rows = F.when(F.col("is_global"), rows).otherwise(F.slice(rows, 1, 1))
    df = df.withColumn("_m", F.explode(rows)).drop("_span", "_first", "_second")
    matched = F.col("_m._span.hit")
    secret = F.coalesce(
        F.nullif(F.col("_m._first"), F.lit("")), F.nullif(F.col("_m._second"), F.lit("")), matched)
    return (
        df.withColumn("matched", matched)
        .withColumn("secret", secret)
        .withColumn(
            "column",
            F.col("offset") + F.col("_m._span.pos")
            + F.greatest(F.instr(F.col("matched"), F.col("secret")), F.lit(1)))
        .drop("_m")
    )


def drop_placeholders(matches: DataFrame) -> DataFrame:
    return matches.where(~is_placeholder(F.col("secret"), F.col("path")))


def drop_allowlisted(
    matches: DataFrame, allowlist: Iterable[str] | DataFrame | None
) -> DataFrame:
    """Drop secrets listed by value or by SHA-256.

    A list or a DataFrame (column ``entry``) of any size: it is anti-joined twice, each time on
    equality.  The optimizer broadcasts a short one; beside a long one a secret with very many
    matches is split over tasks by the skew join.
    """
    if allowlist is None:
        return matches
    if not isinstance(allowlist, DataFrame):
        values = sorted(set(allowlist))
        if not values:
            return matches
        allowlist = matches.sparkSession.createDataFrame([(v,) for v in values], "entry string")
    secret = F.col("secret")
    entries = allowlist.select(T.js_trim(F.col("entry")).alias("_entry")).where(
        "_entry <> ''").distinct()
    return (
        matches.join(entries, secret == F.col("_entry"), "left_anti")
        .join(entries, F.sha2(secret, 256) == F.col("_entry"), "left_anti")
    )


def passes_entropy(
    secret: Column, entropy: Column, min_entropy: Column, requires_entropy: Column
) -> Column:
    """Alphabet-aware gate and the rule's own floor."""
    return (
        (~requires_entropy | T.is_high_entropy(secret, entropy))
        & (min_entropy.isNull() | (entropy >= min_entropy))
    )


def drop_low_entropy(matches: DataFrame, engine: str = "arrow") -> DataFrame:
    """Drop secrets that are not random enough; only those that their rule judges are looked at."""
    secret, requires = F.col("secret"), F.col("requires_entropy")
    judged = requires | F.col("min_entropy").isNotNull()
    # Too short for the gate whatever their entropy.
    short = requires & (F.length(secret) < T.MIN_TOKEN_LENGTH)
    entropy = T.rounded_entropies(F.when(judged & ~short, secret), engine)
    # CASE, not OR: its branch is evaluated for the judged rows only.
    return matches.withColumn("_entropy", entropy).where(F.when(
        judged, ~short & passes_entropy(secret, F.col("_entropy"), F.col("min_entropy"), requires),
    ).otherwise(True)).drop("_entropy")


FINDING_COLUMNS = [
    "rule_id", "rule_name", "severity", "path", "line", "column", "masked_value", "secret_hash",
    "secret_sha", "depth", "codec", "rule_ord",
]


def to_findings(
    matches: DataFrame, extra: Iterable[str] = (), keep_secret: bool = False
) -> DataFrame:
    """Final shape; the secret itself is left out unless asked for."""
    secret = F.col("secret")
    columns = [
        F.col("rule_id"), F.coalesce("name", "rule_id").alias("rule_name"), F.col("severity"),
        F.col("path"), F.col("line"), F.col("column"), T.mask(secret).alias("masked_value"),
        T.secret_hash(F.col("path"), F.col("rule_id"), secret).alias("secret_hash"),
        F.sha2(secret, 256).alias("secret_sha"), F.col("depth"), F.col("codec"),
        F.col("rule_ord"),
    ]
    columns += [F.col(c) for c in extra]
    if keep_secret:
        columns.append(secret)
    return matches.select(*columns)


def drop_silenced(segments: DataFrame, tag: str = DEFAULT_TAG) -> DataFrame:
    """Drop lines silenced as a whole; keep the silenced rule ids of the others in ``_silenced``.

    Comments are read from the line as it was.  A decoded text is judged by its own comments: a
    comment for one rule on the line does not reach into decoded texts.
    """
    by_line, line_rules = silenced(F.col("line_text"), F.col("prev_text"), tag)
    by_text, text_rules = silenced(F.col("text"), None, tag)
    decoded = F.col("depth") > 0
    return (
        segments.where(~by_line)
        .where(~(decoded & by_text))
        .withColumn("_silenced", F.when(decoded, text_rules).otherwise(line_rules))
    )


def match_segments(
    segments: DataFrame, rules: RuleSet, *, allowlist: Iterable[str] | DataFrame | None = None,
    tag: str = DEFAULT_TAG, extra: Iterable[str] = (), keep_secret: bool = False,
    engine: str = "arrow",
) -> DataFrame:
    """Findings of all rules over all segments."""
    if len(rules) == 0:
        rules = RuleSet(())
    candidates = keyword_candidates(drop_silenced(segments, tag), rules, engine).where(
        ~F.array_contains("_silenced", F.col("rule_id"))
        & ((F.col("scope") == "raw") | (F.col("codec") != "raw"))
        & ((F.col("scope") != "raw") | (F.col("codec") != "plain")
           | (F.col("text") == F.col("line_text"))))
    matches = find_matches(candidates, rules)
    matches = drop_placeholders(matches)
    matches = drop_allowlisted(matches, allowlist)
    matches = drop_low_entropy(matches, engine)
    return to_findings(matches, extra, keep_secret)
