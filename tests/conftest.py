import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("veilscan-tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rules(spark):
    from veilscan.rules import effective_rules

    return effective_rules()


@pytest.fixture(scope="session")
def ak():
    """An access key id, put together so that no source line holds one."""
    return "AK" + "IA" + "QAZWSXEDCRFVTGBY"


@pytest.fixture
def scan(spark, rules):
    """Scan lines of one file; returns rows ordered as in a report."""
    from veilscan.plans.scan import scan_lines

    def run(lines, path="src/app.ts", only=None, previous=None, **options):
        previous = previous or [None] * len(lines)
        df = spark.createDataFrame(
            [(path, i, text, before) for i, (text, before) in enumerate(zip(lines, previous), 1)],
            "path string, line int, text string, prev_text string")
        chosen = rules if only is None else rules.only(only)
        found = scan_lines(df, chosen, **options)
        return found.orderBy("line", "depth", "rule_ord", "column").collect()

    return run
