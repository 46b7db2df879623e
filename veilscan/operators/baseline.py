"""Accepted findings: fingerprints, suppression, and verdicts on secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.paths import normalize_path
from veilscan.functions.text import sha256_of


def fingerprint(
    path: Column, rule_id: Column, secret_hash: Column, masked_value: Column
) -> Column:
    """Identity of a finding that does not depend on its line."""
    return sha256_of(normalize_path(path), rule_id, F.coalesce(secret_hash, masked_value))


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint(
        F.col("path"), F.col("rule_id"), F.col("secret_hash"), F.col("masked_value")))


def baseline_entries(findings: DataFrame) -> DataFrame:
    """Rows of a baseline; neither secret nor masked value is kept."""
    return with_fingerprint(findings).select(
        "fingerprint", "rule_id", normalize_path(F.col("path")).alias("file"), "line")


def active_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings not in the baseline, duplicates kept.  The optimizer sizes the baseline side."""
    known = baseline.select("fingerprint").distinct()
    return with_fingerprint(findings).join(known, "fingerprint", "left_anti")


def suppressed_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    known = baseline.select("fingerprint").distinct()
    return with_fingerprint(findings).join(known, "fingerprint", "left_semi")


def split_by_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """All findings with ``suppressed``; for counting both kinds in one pass."""
    known = baseline.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    return (
        with_fingerprint(findings).join(known, "fingerprint", "left")
        .withColumn("suppressed", F.coalesce("_known", F.lit(False))).drop("_known")
    )


def with_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add ``verified`` from a table ``(secret_sha, verified)``; unknown secrets stay null."""
    known = verdicts.groupBy("secret_sha").agg(F.max("verified").alias("verified"))
    return findings.join(known, "secret_sha", "left")


def secrets_to_verify(findings: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Distinct secrets of the rules that can be verified, each asked about once."""
    return findings.where(F.col("rule_id").isin(rule_ids)).select("rule_id", "secret_sha").distinct()
