"""Security score, tiers, counts and the scan summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.schemas import SEVERITIES, TIERS, severity_lookup

SEVERITY_NAMES = [row[0] for row in SEVERITIES]


def dedup_key(secret_hash: Column, masked_value: Column) -> Column:
    return F.coalesce(F.nullif(secret_hash, F.lit("")), masked_value)


def distinct_risks(findings: DataFrame) -> DataFrame:
    """One row per secret with its highest severity.

    Only the weight is aggregated, so the shuffle carries one small pre-aggregated row per secret
    and task, however often a secret is repeated.
    """
    key = dedup_key(F.col("secret_hash"), F.col("masked_value")).alias("risk")
    weight = severity_lookup(F.col("severity"), "weight")
    top = findings.groupBy(key).agg(F.max(weight).alias("weight"))
    severity = F.lit(None).cast("string")
    for name, value, *_ in SEVERITIES:
        severity = F.when(F.col("weight") == value, name).otherwise(severity)
    return top.withColumn("severity", severity)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Distinct risks per severity, one row for each of the four severities."""
    risks = distinct_risks(findings)
    totals = risks.agg(*[
        F.count(F.when(F.col("severity") == name, 1)).alias(name) for name in SEVERITY_NAMES])
    return totals.select(F.explode(F.create_map(*[
        c for name in SEVERITY_NAMES for c in (F.lit(name), F.col(name))
    ])).alias("severity", "count"))


def tier(score: Column) -> Column:
    out = F.lit(TIERS[-1][1])
    for floor, name in reversed(TIERS[:-1]):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def score_report(findings: DataFrame) -> DataFrame:
    """One row: ``score``, ``tier`` and ``counts`` per severity."""
    penalty = severity_lookup(F.col("severity"), "penalty")
    totals = distinct_risks(findings).agg(
        F.coalesce(F.sum(penalty), F.lit(0)).alias("penalty"),
        *[F.count(F.when(F.col("severity") == n, 1)).alias(n) for n in SEVERITY_NAMES])
    score = F.greatest(F.lit(0), F.lit(100) - F.col("penalty")).cast("int")
    counts = F.create_map(*[c for n in SEVERITY_NAMES for c in (F.lit(n), F.col(n))])
    return totals.select(
        score.alias("score"), tier(score).alias("tier"), counts.alias("counts"))


def findings_per_severity(findings: DataFrame) -> DataFrame:
    """Findings as found, not merged; severities without findings are absent."""
    return findings.groupBy("severity").count()


def findings_per_file(findings: DataFrame) -> DataFrame:
    """Counts per file, in total and by severity."""
    return findings.groupBy("path").agg(
        F.count(F.lit(1)).alias("findings"),
        *[F.count(F.when(F.col("severity") == n, 1)).alias(n) for n in SEVERITY_NAMES])


REPORT_ORDER = ["path", "line", "depth", "rule_ord", "column"]


def first_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The first findings in report order (a top-k, never a full sort)."""
    return findings.orderBy(*REPORT_ORDER, "masked_value").limit(n)


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One finding per file, line, rule and secret: the direct one before decoded ones."""
    keys = ["path", "line", "rule_id", "secret_hash"]
    others = [c for c in findings.columns if c not in keys]
    best = F.min(F.struct("depth", "column", *[c for c in others if c not in ("depth", "column")]))
    return findings.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, *[F.col(f"_best.{c}").alias(c) for c in others])


def secret_reuse(findings: DataFrame) -> DataFrame:
    """How widely each secret is spread, by its unsalted hash.

    Rows are merged by secret and file, then by secret: a file, or a secret, that holds a great part
    of the findings is summed up before each shuffle.  A secret has few rules, so their sets stay
    small.
    """
    by_file = findings.groupBy("secret_sha", "path").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("rule_id").alias("ids"),
        F.max(severity_lookup(F.col("severity"), "weight")).alias("weight"))
    return by_file.groupBy("secret_sha").agg(
        F.sum("n").alias("findings"), F.count("path").alias("files"),
        F.size(F.array_distinct(F.flatten(F.collect_set("ids")))).cast("long").alias("rules"),
        F.max("weight").alias("max_weight"))


def file_totals(files: DataFrame, content: str = "content") -> DataFrame:
    """One row: distinct files scanned and skipped, and lines scanned.  ``status`` is optional."""
    scanned = F.col("status") == "scanned" if "status" in files.columns else F.lit(True)
    breaks = F.regexp_count(F.col(content), F.lit("\n"))
    return files.agg(
        F.count_distinct(F.when(scanned, F.col("path"))).alias("files_scanned"),
        F.count_distinct(F.when(~scanned, F.col("path"))).alias("skipped_files"),
        F.coalesce(F.sum(F.when(scanned, breaks + 1)), F.lit(0)).alias("lines_scanned"))


def history_totals(lines: DataFrame, diffs: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: commits, distinct files and lines of a history scan."""
    return (
        commits.agg(F.count_distinct("commit").alias("commits_scanned"))
        .crossJoin(diffs.agg(F.count_distinct("path").alias("files_scanned")))
        .crossJoin(lines.agg(F.count(F.lit(1)).alias("lines_scanned")))
    )


def summary(
    totals: DataFrame, findings: DataFrame, baseline: DataFrame | None = None
) -> DataFrame:
    """One row: totals, findings, suppressed findings, score and tier.

    ``totals`` and the aggregates of the findings have exactly one row each, which is what the
    cross joins combine.
    """
    from veilscan.operators.baseline import split_by_baseline

    if baseline is None:
        marked = findings.withColumn("suppressed", F.lit(False))
    else:
        marked = split_by_baseline(findings, baseline)
    counted = marked.groupBy(
        dedup_key(F.col("secret_hash"), F.col("masked_value")).alias("risk"), "suppressed"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(severity_lookup(F.col("severity"), "weight")).alias("weight"))
    penalty = F.lit(0)
    for _, weight, points, *_ in SEVERITIES:
        penalty = F.when(F.col("weight") == weight, points).otherwise(penalty)
    active = ~F.col("suppressed")
    numbers = counted.agg(
        F.coalesce(F.sum(F.when(active, F.col("n"))), F.lit(0)).alias("findings"),
        F.coalesce(F.sum(F.when(~active, F.col("n"))), F.lit(0)).alias("suppressed_findings"),
        F.greatest(
            F.lit(0), F.lit(100) - F.coalesce(F.sum(F.when(active, penalty)), F.lit(0))
        ).cast("int").alias("score"))
    return totals.crossJoin(numbers).withColumn("tier", tier(F.col("score")))
