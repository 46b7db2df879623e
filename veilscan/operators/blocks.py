"""Rules that look at whole files: secrets that run over several lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import js_trim
from veilscan.operators.match import (
    drop_allowlisted,
    drop_low_entropy,
    drop_placeholders,
    find_matches,
    keyword_candidates,
    to_findings,
)
from veilscan.operators.screen import HIT, in_short_batches, screen
from veilscan.rules import RuleSet, effective_rules


def scan_blocks(
    files: DataFrame, rules: RuleSet | None = None, *,
    allowlist: Iterable[str] | DataFrame | None = None, keep_secret: bool = False,
    engine: str = "arrow", extra: Iterable[str] = (),
) -> DataFrame:
    """Findings of the block rules that span lines; ``line`` is where the match starts.

    Matches within one line are left to the line scan.
    """
    rules = rules or effective_rules()
    rules = RuleSet(tuple(rule for rule in rules.rules if rule.scope == "block"))
    texts = in_short_batches(files).select(
        "path", F.col("content").alias("text"), F.lit(0).alias("depth"),
        F.lit("block").alias("codec"), F.lit(0).alias("offset"), *extra)
    hit = screen(F.col("text"), rules, decode=False, rewrite=False, engine=engine)
    texts = texts.withColumn("_hit", hit).where(F.col("_hit").bitwiseAND(HIT) > 0).drop("_hit")
    matches = find_matches(keyword_candidates(texts, rules, engine), rules).where(
        js_trim(F.col("matched")).contains("\n"))
    before = F.left("text", F.col("column") - 1)
    matches = matches.withColumn("line", F.regexp_count(before, F.lit("\n")) + 1).withColumn(
        "column", F.length(F.substring_index(before, "\n", -1)) + 1)
    matches = drop_low_entropy(drop_allowlisted(drop_placeholders(matches), allowlist), engine)
    return to_findings(matches, extra, keep_secret)
