import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from veilscan.plans import queries
from veilscan.sinks import report_source as S


def _found(spark, n, files=7):
    return spark.range(n).select(
        F.concat(F.lit('src/<"é">'), F.col("id") % files, F.lit(".ts")).alias("path"), F.col("id").cast("int").alias("line"),
        F.lit(0).alias("depth"), F.lit(1).alias("rule_ord"), F.lit(3).alias("column"), F.lit("jwt").alias("rule_id"),
        F.lit("JWT").alias("rule_name"), F.lit("high").alias("severity"),
        F.concat(F.lit('m"\\'), F.col("id")).alias("masked_value"), F.lit("x").alias("secret_hash"), F.lit("s3cr3t").alias("secret"))


def _documents(path):
    return [p.read_text() for p in sorted(path.glob("report-*"))]


@pytest.mark.parametrize("kind", S.KINDS)
def test_documents_are_complete_and_counted(spark, rules, tmp_path, kind):
    for n, per_file in ((500, 40), (0, 40)):  # the second report replaces the first
        S.save_report(_found(spark, n), str(tmp_path / "r"), kind, rules=rules, findings_per_file=per_file)
        texts, manifest = _documents(tmp_path / "r"), S.read_manifest(str(tmp_path / "r"))
        assert manifest["findings"] == n and manifest["kind"] == kind
        assert len(manifest["documents"]) == len(texts) and (len(texts) > 4) == (n > 0)
        assert not list((tmp_path / "r").glob("_attempt-*")) and "s3cr3t" not in "".join(texts)
        if kind == "junit":
            suites = [ET.fromstring(t) for t in texts]
            assert [int(s.get("failures")) for s in suites] == [d["findings"] for d in manifest["documents"]]
            cases = [c for s in suites for suite in s for c in suite if c.get("name") != "NoSecretsDetected"]
            assert len(cases) == n
            names = [suite.get("name") for s in suites for suite in s]
            assert len(set(names)) == len(names) == (7 if n else 1)  # no suite is cut
        else:
            parsed = [json.loads(t) for t in texts]
            lists = [p["runs"][0]["results"] if kind == "sarif" else p["findings"] if kind == "json" else p for p in parsed]
            assert [len(part) for part in lists] == [d["findings"] for d in manifest["documents"]]
            assert sum(map(len, lists)) == n and all(len(part) <= per_file for part in lists)
            if kind == "json" and n:
                assert {i["line"] for part in lists for i in part} == set(range(n))


def test_large_bodies_go_on_in_a_file(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(S, "BODY_BYTES", 50)
    document = S._Document(fs.LocalFileSystem(), str(tmp_path / "d"), {
        "kind": "quality", "head": "[", "tail": "]", "separator": ","})
    for i in range(100):
        document.add("p", json.dumps({"i": i}), 1)
    document.close()
    assert [r["i"] for r in json.loads((tmp_path / "d").read_text())] == list(range(100))
    assert [p.name for p in tmp_path.iterdir()] == ["d"]


def test_failed_reports_leave_the_last_one(spark, tmp_path):
    path = str(tmp_path / "r")
    S.save_report(_found(spark, 50), path, "json")
    before = _documents(tmp_path / "r")
    broken = _found(spark, 50).withColumn(
        "masked_value", F.when(F.col("line") == 49, F.raise_error(F.lit("stop"))).otherwise("m"))
    with pytest.raises(Exception, match="stop"):
        S.save_report(broken, path, "json")
    assert _documents(tmp_path / "r") == before and S.read_manifest(path)["findings"] == 50
    with pytest.raises(ValueError):
        S.save_report(_found(spark, 1), path, "pdf")


def test_suites_are_read_once_whatever_their_cases(spark, tmp_path):
    """The number that a suite states is taken from it before its cases become rows."""
    S.save_report(_found(spark, 300, files=2), str(tmp_path / "r"), "junit", findings_per_file=100)
    read = queries._read_junit(spark.read.text(str(tmp_path / "r"), wholetext=True))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    cases = plan.index("Generate explode(arrays_zip")
    assert plan.index('tests="') > cases
    rows = read.collect()
    assert len(rows) == 300 and {r.detail for r in rows} == {"150"} and {r.rule_id for r in rows} == {"jwt"}
    assert sorted(r.line for r in rows) == list(range(300))
