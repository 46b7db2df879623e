"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores.  Every query runs to the end into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.operators.lines import to_lines
from veilscan.operators.screen import screen
from veilscan.plans import queries as Q
from veilscan.plans.scan import scan_lines, scan_texts
from veilscan.rules import effective_rules

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    Q.lines_documents, Q.merged_lines, Q.keyword_gate_texts, Q.scan_text_tables, Q.scan_seeded,
    Q.decoded_findings, Q.disguise_findings, Q.structured_findings, Q.history_findings,
    Q.block_findings, Q.findings_per_file, Q.secret_reuse, Q.baseline_active, Q.redacted_documents,
    Q.report_sarif,
]


def run(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("veilscan-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # Start the Python workers and the code generator before anything is timed.
    run(Q.scan_seeded(spark, SF_DIR).where("line < 10"))

    timings: dict[str, float] = {}
    for query in HEADLINES:
        start = time.perf_counter()
        run(query(spark, SF_DIR))
        timings[query.__name__] = round(time.perf_counter() - start, 3)

    # Throughput of the built-in scan, and of the screen alone with and without RE2.
    corpus = Q.text_corpus(spark, SF_DIR).persist()
    size = corpus.agg(F.sum(F.octet_length("content"))).head()[0]
    lines = to_lines(corpus)
    n_lines = lines.count()
    rules = effective_rules()
    scan = run(scan_texts(corpus, rules))
    arrow = run(lines.where(screen(F.col("text"), rules) > 0))
    # Eight lines of 200,000 characters, each with every rule.
    long_lines = spark.range(8).selectExpr(
        "'long.txt' AS path", "id AS line", "repeat('abcdefghij ', 18200) AS text").persist()
    long_lines.count()
    long_line = run(scan_lines(long_lines, rules)) / 8
    jvm = run(lines.where(screen(F.col("text"), rules, engine="jvm", decode=False,
                                 rewrite=False) > 0))
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "throughput": {
            "corpus_mb": round(size / 1e6, 2), "lines": n_lines,
            "scan_sec": round(scan, 3), "scan_mb_per_sec": round(size / 1e6 / scan, 2),
            "scan_lines_per_sec": round(n_lines / scan),
            "long_line_ms": round(1000 * long_line, 1),
            "screen_arrow_sec": round(arrow, 3), "screen_jvm_sec": round(jvm, 3),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
