"""Writing findings, baselines and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.operators.baseline import baseline_entries
from veilscan.operators.score import REPORT_ORDER
from veilscan.rules import RuleSet, effective_rules
from veilscan.sinks import reports as R

# A report is a folder of files, each a complete document of about this many findings with its own
# counts; a small report is a folder of one.
FINDINGS_PER_FILE = 50_000


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Findings table, partitioned by severity; never with the secret."""
    findings.drop("secret").write.mode(mode).partitionBy("severity").parquet(path)


def write_baseline_table(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    baseline_entries(findings).write.mode(mode).parquet(path)


def write_baseline_json(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of baseline files of the JSON layout, each with its own number of entries."""
    entries = baseline_entries(findings).select(F.to_json(F.struct(
        "fingerprint", F.col("rule_id").alias("ruleId"), "file", "line")).alias("fragment"))
    created = datetime.now(timezone.utc).isoformat()
    entries = entries.persist()
    try:
        total = entries.count()

        def head(count: int) -> str:
            return f'{{"version":"1.0","createdAt":"{created}","totalFindings":{count},"entries":['

        _write_framed(entries.repartition(_files(total)), path, head, "]}", ",", mode)
    finally:
        entries.unpersist()


def _files(total: int) -> int:
    return max(1, -(-total // FINDINGS_PER_FILE))


def _write_framed(
    rows: DataFrame, path: str, head: Callable[[int], str], tail: str, separator: str, mode: str,
    counted: str = "",
) -> None:
    """Write each partition of ``fragment`` as one complete document.

    The head states the document's own number of findings (fragments that hold ``counted``), so a
    partition, which holds about
    ``FINDINGS_PER_FILE`` of them, is read before its first row is written.
    """

    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = [line for batch in batches for line in batch["fragment"]]
        count = sum(counted in line for line in lines)
        # The separator goes before a row, so that the last row has none after it.
        rest = [separator + line for line in lines[1:]]
        yield pd.DataFrame({"value": [head(count), *lines[:1], *rest, tail]})

    rows.select("fragment").mapInPandas(frame, "value string").write.mode(mode).text(path)


def _sorted_parts(fragments: DataFrame, total: int, order: list[str]) -> DataFrame:
    """Range partitions of about equal size, each in report order."""
    n = _files(total)
    parts = fragments.repartitionByRange(n, *order) if n > 1 else fragments.coalesce(1)
    return parts.sortWithinPartitions(*order)


def write_report(
    findings: DataFrame, path: str, kind: str, *, rules: RuleSet | None = None,
    summary: DataFrame | None = None, mode: str = "overwrite",
) -> None:
    """Write a ``sarif``, ``junit``, ``quality``, ``json`` or ``annotations`` report.

    ``path`` becomes a folder of complete documents (see ``FINDINGS_PER_FILE``).  A summary is that of
    the whole report.
    """
    findings = findings.drop("secret").persist()
    try:
        total = findings.count()
        spark = findings.sparkSession
        if kind == "sarif":
            start, tail = R.sarif_frame(spark, rules or effective_rules())
            rows, separator = R.sarif_results(findings), ","
        elif kind == "quality":
            start, tail, separator, rows = "[", "]", ",", R.quality_issues(findings)
        elif kind == "json":
            about = "{}" if summary is None else R.json_summary(summary).head().fragment
            start, tail, separator = f'{{"summary":{about},"findings":[', "]}", ","
            rows = R.json_findings(findings)
        elif kind == "junit":
            files = 0 if summary is None else summary.head().files_scanned
            tail, rows, separator = R.junit_frame(files, 0)[1], R.junit_rows(findings), ""
        elif kind == "annotations":
            _sorted_parts(R.annotations(findings), total, REPORT_ORDER).select(
                F.col("fragment").alias("value")).write.mode(mode).text(path)
            return
        else:
            raise ValueError(f"unknown report kind {kind!r}")
        if kind == "junit":
            # A suite must not be cut, so files of a report are ranges of paths.
            n = _files(total)
            parts = rows.repartitionByRange(n, "path") if n > 1 else rows.coalesce(1)
            parts = parts.sortWithinPartitions("path", "part", *REPORT_ORDER[1:])
        else:
            parts = _sorted_parts(rows, total, REPORT_ORDER)

        def head(count: int) -> str:
            return R.junit_frame(files, count)[0] if kind == "junit" else start

        _write_framed(parts, path, head, tail, separator, mode,
                      "<testcase " if kind == "junit" else "")
    finally:
        findings.unpersist()


def write_redacted(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    corpus.write.mode(mode).parquet(path)


def read_framed_json(spark, path: str) -> list[dict]:
    """Documents written by :func:`write_report`, for small reports and tests."""
    rows = spark.read.text(path, wholetext=True).collect()
    return [json.loads(row.value) for row in rows]
