"""What to do about a finding, and the rule listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.rules.ruleset import RuleSet

DEFAULT_STEPS = [
    "Revoke the credential at its provider.",
    "Search audit logs for use of it during the time it was exposed.",
    "Keep credentials in a secrets manager or in protected environment variables.",
]

# Provider-specific first steps; the last step is common to all.
STEPS = {
    "aws-access-key": ["Deactivate and delete the key in the IAM console.",
                       "Look through CloudTrail for calls made with the key."],
    "github-pat": ["Revoke the token in the developer settings of the account.",
                   "Look through the account and repository audit logs."],
    "stripe-api-key": ["Roll the key in the developers dashboard.",
                       "Check recent charges and payouts."],
    "openai-api-key": ["Revoke the key in the platform dashboard.",
                       "Check usage and set a hard spending limit."],
    "private-key": ["Treat every system that trusts the key as compromised and remove its public key.",
                    "Generate a new key pair with strong parameters."],
    "twilio-api-key": ["Delete the key in the account console.",
                       "Check usage logs for calls and messages you did not send."],
    "sendgrid-api-key": ["Revoke the key in the dashboard.",
                         "Check the activity feed for mail you did not send."],
    "npm-token": ["Revoke the token in the account settings.",
                  "Check recently published package versions for tampering."],
    "pypi-token": ["Revoke the token in the account settings.",
                   "Check recently published releases for tampering."],
    "digitalocean-token": ["Revoke the token in the control panel.",
                           "Check for unknown machines, DNS changes and charges."],
    "discord-webhook": ["Delete or regenerate the webhook.",
                        "Check the channel for messages you did not send."],
}


def remediation(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """``rule_id, step_no, step`` for every rule."""
    rows = [
        (rule_id, i, step)
        for rule_id in rules.ids
        for i, step in enumerate([*STEPS[rule_id], DEFAULT_STEPS[-1]] if rule_id in STEPS
                                 else DEFAULT_STEPS, 1)
    ]
    return spark.createDataFrame(rows, "rule_id string, step_no int, step string")


def list_rules(spark: SparkSession, rules: RuleSet) -> DataFrame:
    return rules.to_df(spark).select(
        "rule_ord", "rule_id", F.coalesce("name", "rule_id").alias("name"), "severity")


def explain_rule(spark: SparkSession, rules: RuleSet, rule_id: str) -> DataFrame:
    """Everything about one rule (id without regard to case), one row per remediation step."""
    chosen = rules.to_df(spark).where(F.lower("rule_id") == rule_id.lower())
    return chosen.join(remediation(spark, rules), "rule_id", "left").orderBy("step_no")


def with_remediation(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings with the steps of their rule as an array."""
    steps = remediation(findings.sparkSession, rules).groupBy("rule_id").agg(
        F.array_sort(F.collect_list(F.struct("step_no", "step"))).alias("_steps"))
    return findings.join(steps, "rule_id", "left").withColumn(
        "steps", F.transform("_steps", lambda s: s["step"])).drop("_steps")
