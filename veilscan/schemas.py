"""Table schemas and the severity dimension shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("rule_ord", T.IntegerType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("probe", T.StringType(), False),
    T.StructField("n_groups", T.IntegerType(), False),
    T.StructField("secret_group", T.IntegerType(), False),
    T.StructField("fallback_group", T.IntegerType(), False),
    T.StructField("scope", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType(), False)),
    T.StructField("min_entropy", T.DoubleType()),
    T.StructField("requires_entropy", T.BooleanType(), False),
    T.StructField("is_global", T.BooleanType(), False),
])

CUSTOM_RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("regex", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("minEntropy", T.DoubleType()),
    T.StructField("requiresEntropy", T.BooleanType()),
])

BASELINE_ENTRY_SCHEMA = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("ruleId", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.LongType()),
])

BASELINE_FILE_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("totalFindings", T.LongType()),
    T.StructField("entries", T.ArrayType(BASELINE_ENTRY_SCHEMA)),
])

# Weight and penalty per severity, and its name in each report format.
SEVERITIES = [
    # severity, weight, penalty, sarif_level, quality_severity, annotation_level
    ("critical", 4, 35, "error", "blocker", "error"),
    ("high", 3, 20, "error", "critical", "error"),
    ("medium", 2, 10, "warning", "major", "warning"),
    ("low", 1, 5, "note", "minor", "warning"),
]

SEVERITY_WEIGHT = {row[0]: row[1] for row in SEVERITIES}

# Lowest score of each tier.
TIERS = [(90, "Excellent"), (75, "Good"), (50, "Warning"), (0, "Critical")]


def severity_dim(spark: SparkSession) -> DataFrame:
    """Four-row severity dimension."""
    return spark.createDataFrame(
        SEVERITIES,
        "severity string, weight int, penalty int, sarif_level string, "
        "quality_severity string, annotation_level string",
    )


def severity_lookup(severity: Column, field: str) -> Column:
    """One attribute of the severity dimension as a CASE expression (no join)."""
    index = {"weight": 1, "penalty": 2, "sarif_level": 3, "quality_severity": 4,
             "annotation_level": 5}[field]
    case = None
    for row in SEVERITIES:
        hit = severity == row[0]
        case = F.when(hit, row[index]) if case is None else case.when(hit, row[index])
    return case
