import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veilscan.operators import baseline as B
from veilscan.operators import score as S
from veilscan.operators.redact import redact
from veilscan.sinks import reports as R
from veilscan.sinks import writers as W
from veilscan.sources.baselines import read_baseline_json, read_baseline_table
from veilscan.streaming import scan as streams

SCHEMA = ("rule_id string, rule_name string, severity string, path string, line int, column int, "
          "masked_value string, secret_hash string, secret_sha string, depth int, codec string, "
          "rule_ord int")


@pytest.fixture
def make(spark):
    def build(*rows):
        full = []
        for i, (rule, severity, path, digest) in enumerate(rows):
            full.append((rule, rule.upper(), severity, path, i + 1, 3, f"m{i}", digest, digest or "s",
                         0, "plain", i))
        return spark.createDataFrame(full, SCHEMA)
    return build


def _score(findings):
    row = S.score_report(findings).head()
    return row.score, row.tier, row.counts


def test_scores(make):
    zero = {"critical": 0, "high": 0, "medium": 0, "low": 0}
    assert _score(make()) == (100, "Excellent", zero)
    three = make(*[("r", "critical", "a", h) for h in "abc"])
    assert _score(three) == (0, "Critical", {**zero, "critical": 3})
    assert _score(make(*[("r", "critical", "a", "h")] * 2)) == (65, "Warning", {**zero, "critical": 1})
    mixed = make(("r", "medium", "a", "h"), ("q", "critical", "b", "h"))
    assert _score(mixed) == (65, "Warning", {**zero, "critical": 1})
    masked = make(("r", "low", "a", ""), ("r", "low", "a", None))
    assert _score(masked) == (90, "Excellent", {**zero, "low": 2})


def test_counts_and_summary(spark, make):
    found = make(("r", "high", "a", "x"), ("r", "high", "b", "y"), ("q", "low", "a", "z"))
    assert {r.severity: r["count"] for r in S.findings_per_severity(found).collect()} == {
        "high": 2, "low": 1}
    assert {r.path: (r.findings, r.high, r.low) for r in S.findings_per_file(found).collect()} == {
        "a": (2, 1, 1), "b": (1, 1, 0)}
    files = spark.createDataFrame([("a", "1\n2", "scanned"), ("b", None, "symlink")],
                                  "path string, content string, status string")
    accepted = B.baseline_entries(found.where("path = 'b'"))
    row = S.summary(S.file_totals(files), found, accepted).head()
    assert (row.files_scanned, row.skipped_files, row.lines_scanned) == (1, 1, 2)
    assert (row.findings, row.suppressed_findings, row.score, row.tier) == (2, 1, 75, "Good")


def test_baseline(spark, make, tmp_path):
    found = make(("r", "high", "src\\a", "x"), ("r", "high", "src/b", "y"), ("r", "high", "src/b", "y"))
    slash = make(("r", "high", "src/a", "x"))
    prints = [r.fingerprint for r in B.with_fingerprint(found).collect()]
    assert prints[0] == B.with_fingerprint(slash).head().fingerprint
    assert prints[0] == hashlib.sha256(b"src/a:r:x").hexdigest()
    W.write_baseline_json(slash, str(tmp_path / "json"))
    W.write_baseline_table(slash, str(tmp_path / "table"))
    for known in (read_baseline_json(spark, str(tmp_path / "json")),
                  read_baseline_table(spark, str(tmp_path / "table"))):
        assert B.active_findings(found, known).count() == 2
        assert B.suppressed_findings(found, known).count() == 1
    other = make(("r", "high", "src/a", "another"))
    assert B.suppressed_findings(other, B.baseline_entries(slash)).count() == 0


def test_verdicts(spark, make):
    found = make(("r", "high", "a", "x"), ("r", "high", "b", "x"), ("r", "high", "c", "y"))
    verdicts = spark.createDataFrame([("x", True), ("x", False)], "secret_sha string, verified boolean")
    got = {r.path: r.verified for r in B.with_verdicts(found, verdicts).collect()}
    assert got == {"a": True, "b": True, "c": None}
    assert B.secrets_to_verify(found, ["r"]).count() == 2


def test_reports(spark, make, rules, tmp_path):
    found = make(("aws-access-key", "critical", "src/<a>.ts", "x"), ("jwt", "medium", "b:c", None))
    out = str(tmp_path)
    for kind in ("sarif", "quality", "json", "junit", "annotations"):
        W.write_report(found, f"{out}/{kind}", kind, rules=rules)
    sarif = W.read_framed_json(spark, f"{out}/sarif")[0]
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 204
    by_rule = {r["ruleId"]: r for r in run["results"]}
    assert by_rule["aws-access-key"]["level"] == "error" and by_rule["jwt"]["level"] == "warning"
    assert by_rule["aws-access-key"]["partialFingerprints"] == {
        "secretHash": "x", "primaryLocationLineHash": "x"}
    assert "partialFingerprints" not in by_rule["jwt"]
    issues = W.read_framed_json(spark, f"{out}/quality")[0]
    assert [i["severity"] for i in issues] == ["major", "blocker"]
    assert issues[0]["fingerprint"] == hashlib.sha256(b"b:c:2:3:jwt:m1").hexdigest()
    report = W.read_framed_json(spark, f"{out}/json")[0]
    assert set(report["findings"][0]) == {
        "rule", "name", "severity", "file", "line", "column", "maskedValue"}
    xml = "".join(r.value for r in spark.read.text(f"{out}/junit", wholetext=True).collect())
    import xml.etree.ElementTree as ET
    suites = ET.fromstring(xml)
    assert suites.get("failures") == "2" and len(suites) == 2
    assert suites[1].get("name") == "Security.SecretScanning.src.<a>.ts"
    notes = [r.value for r in spark.read.text(f"{out}/annotations").collect()]
    assert notes[0].startswith("::warning file=b%3Ac,line=2,col=3,title=veilscan%3A JWT [MEDIUM]::")
    clean = ET.fromstring("\n".join(R.junit_frame(5, 0)))
    assert clean[0][0].get("name") == "NoSecretsDetected" and clean.get("tests") == "5"
    with pytest.raises(ValueError):
        W.write_report(found, f"{out}/x", "pdf")


def test_commit_replaces_fingerprint(make):
    found = make(("jwt", "high", "a", "x")).withColumns({
        "commit": F.lit("c" * 40), "commit_author": F.lit("Lead Dev"),
        "commit_date": F.lit("2026-03-31T00:00:00Z")})
    result = json.loads(R.sarif_results(found).head().fragment)
    assert result["partialFingerprints"] == {"commitHash": "c" * 40}
    assert result["properties"]["commitAuthor"] == "Lead Dev"


def test_markdown(make):
    found = make(*[("jwt", "high", f"a|{i:02}", str(i)) for i in range(12)])
    text = R.markdown_summary(found)
    assert "12 finding(s)" in text and text.count("| `jwt`") == 10 and "a\\|00" in text
    assert "Nothing found" in R.markdown_summary(make())


def test_redaction(spark):
    corpus = spark.createDataFrame([("a", "k=abcdefgh abcdefghij"), ("b", "none")],
                                   "path string, content string")
    found = spark.createDataFrame([("a", "abcdefgh"), ("a", "abcdefghij")], "path string, secret string")
    got = {r.path: r.content for r in redact(corpus, found).collect()}
    assert got == {"a": "k=a******h a********j".replace("a********j", "a********j"), "b": "none"}


def test_findings_table_has_no_secret(spark, make, tmp_path):
    W.write_findings(make(("jwt", "high", "a", "x")).withColumn("secret", F.lit("raw")),
                     str(tmp_path / "f"))
    assert "secret" not in spark.read.parquet(str(tmp_path / "f")).columns


def test_streaming_scan(spark, rules, tmp_path, ak):
    picked = rules.only(["aws-access-key"])
    drop, out = tmp_path / "in", tmp_path / "out"
    drop.mkdir()
    (drop / "a.txt").write_text(f"id {ak}")
    spark.sql("CREATE DATABASE IF NOT EXISTS veil_test")
    spark.sql("DROP TABLE IF EXISTS veil_test.seen")

    def run_once():
        # Two lines of the same file and secret have one fingerprint.
        texts = streams.read_text_stream(spark, str(drop)).withColumn("path", F.lit("a.txt"))
        found = streams.stream_texts(texts, picked, decode_depth=0)
        streams.append_new_findings(found, "veil_test.seen", str(out / "cp")).awaitTermination()
        spark.catalog.refreshTable("veil_test.seen")
        return spark.table("veil_test.seen").count()

    try:
        assert run_once() == 1
        (drop / "b.txt").write_text(f"again {ak}\nnew {ak[:-1]}Z")
        assert run_once() == 2
    finally:
        spark.sql("DROP DATABASE veil_test CASCADE")
    with pytest.raises(ValueError):
        streams.stream_history(spark.createDataFrame([], "block string"), picked, max_commits=3)
