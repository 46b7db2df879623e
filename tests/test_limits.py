"""Texts that cross former limits, and results that used to be incomplete."""

import base64
import json
import time

import pytest

from veilscan.plans.scan import scan_files, scan_history, scan_lines, scan_texts
from veilscan.rules import compile_custom_rule, effective_rules
from veilscan.sinks.writers import read_framed_json, write_report
from veilscan.sources.files import read_files
from veilscan.sources.history import COMMIT_MARKER, read_log


def texts(spark, *rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_a_long_secret_at_a_former_window_edge_is_whole(spark, rules):
    token = "pypi-AgEIcHlwaS5vcmc" + "Ab3dEf7h" * 48
    found = scan_texts(texts(spark, ("a.txt", "x " * 32_625 + token + " y")), rules, keep_secret=True).collect()
    assert (token, 65_251) in {(r.secret, r.column) for r in found}


def test_long_decoded_texts_are_scanned(spark, rules, ak):
    blob = base64.b64encode(("note " * 3_000 + f"id {ak} " + "end " * 1_000).encode()).decode()
    found = scan_texts(texts(spark, ("a.txt", f"blob {blob}")), rules.only(["aws-access-key"]))
    assert [(r.depth, r.codec) for r in found.collect()] == [(1, "base64")]


def test_structured_files_of_any_size_and_depth(spark, rules, ak):
    wide = json.dumps({"pad": ["x" * 50] * 3_000, "deep": {"id": ak}})
    env = "A=b\n" * 30_000 + f"ID={ak}\n"
    found = scan_texts(texts(spark, ("a.json", wide), ("b.env", env)), rules.only(["aws-access-key"]),
                       structured=True).collect()
    assert {(r.path, r.leaf_path, r.line) for r in found} == {("a.json", "deep.id", 1), ("b.env", None, 30_001)}


def test_json_of_any_nesting_and_with_half_characters(spark, rules, ak):
    deep = "[" * 60_000 + json.dumps({"id": ak}) + "]" * 60_000
    half = '{"note": "\\ud800x", "id": "%s"}' % ak
    broken = "[" * 60_000 + f'"{ak}"'
    found = scan_texts(texts(spark, ("a.json", deep), ("b.json", half), ("c.json", broken)),
                       rules.only(["aws-access-key"]), structured=True).collect()
    paths = {r.path: r.leaf_path for r in found}
    assert set(paths) == {"a.json", "b.json", "c.json"} and paths["b.json"] == "id" and paths["c.json"] is None
    assert paths["a.json"] == "0." * 59_999 + "0.id"


def test_reversed_tokens_are_read_in_linear_time(spark):
    from pyspark.sql import functions as F

    from veilscan.functions.codecs import reversed_token

    token = "x" * 200_000 + "AIKA"
    start = time.perf_counter()
    rows = spark.createDataFrame([(token,), ("a" * 200_000,), ("a" * 14 + "AIKA",), ("a" * 15 + "aika",)], "t string")
    got = [r[0] for r in rows.select(reversed_token(F.col("t"))).collect()]
    assert got == [token[::-1], None, None, "akia" + "a" * 15] and time.perf_counter() - start < 10


def test_normalisation_reads_the_whole_text(spark, rules, ak):
    line = "z " * 40_000 + f"key = {ak[:9]}\u200b{ak[9:]}"
    found = scan_texts(texts(spark, ("a.txt", line)), rules.only(["aws-access-key"])).collect()
    assert [r.path for r in found] == ["a.txt"]


def test_marker_within_a_line_is_text(spark, rules, ak, tmp_path):
    head = f"{COMMIT_MARKER}\0{{}}\0Dev\0" + "2024-01-01T00:00:00+00:00\0\n\n"
    diff = f"diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -0,0 +1,2 @@\n+const M = '{COMMIT_MARKER}'\n+id {ak}\n"
    log = tmp_path / "log.txt"
    log.write_text("".join(head.format(c) + diff for c in ("c1", "c2")))
    blocks = read_log(spark, str(log))
    assert blocks.count() == 2
    found = scan_history(blocks, rules.only(["aws-access-key"])).collect()
    assert {(r.commit, r.line) for r in found} == {("c1", 2), ("c2", 2)}


@pytest.mark.parametrize("pattern, text", [
    ("/^corp-[a-z]{4}$/m", "one\ncorp-abcd\ntwo"), ("/a.b{3}c/s", "a\nbbbc"), ("/Corp-[A-Z]{4}/", "Corp-ABCD"),
    ("/corp-[a-z]{4}/i", "CORP-ABCD"), ("/^corp.[a-z]+$/ims", "x\nCORP\nABCD")])
def test_engines_agree_over_flags(spark, pattern, text):
    rule = compile_custom_rule({"id": "own", "name": "Own", "regex": pattern, "minEntropy": 0, "requiresEntropy": False})
    only = effective_rules([rule], builtin=[])
    lines = spark.createDataFrame([("a.txt", 1, text), ("b.txt", 1, "nothing")], "path string, line int, text string")
    counts = [scan_lines(lines, only, engine=e).count() for e in ("arrow", "jvm")]
    assert counts == [1, 1]


def test_files_give_their_multi_line_keys(spark, tmp_path):
    pem = "-----BEGIN RSA " + "PRIVATE KEY-----\n" + "Mab1" * 20 + "\n-----END RSA " + "PRIVATE KEY-----\n"
    (tmp_path / "key.pem").write_text("intro\n" + pem)
    found = scan_files(spark, str(tmp_path)).collect()
    assert [r.line for r in found if r.codec == "block"] == [2]


def test_size_limit_reaches_the_reader(spark, tmp_path):
    (tmp_path / "small.txt").write_text("a")
    (tmp_path / "large.txt").write_text("b" * 5_000)
    (tmp_path / "link.txt").symlink_to(tmp_path / "small.txt")
    files = read_files(spark, str(tmp_path), max_file_size=1_000)
    assert {(r.path, r.status, r.content is None) for r in files.collect()} == {
        ("small.txt", "scanned", False), ("large.txt", "too-large", True), ("link.txt", "symlink", True)}
    plan = files._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,1000)" in plan
    assert {r.status for r in read_files(spark, str(tmp_path)).where("path = 'large.txt'").collect()} == {"scanned"}


def test_report_files_state_their_own_counts(spark, tmp_path, monkeypatch):
    from veilscan.sinks import writers

    monkeypatch.setattr(writers, "FINDINGS_PER_FILE", 10)
    rows = [(f"f{i}.txt", i, "key " + "AK" + "IA" + f"{i:04d}" + "WSXEDCRFVTGB") for i in range(35)]
    found = scan_lines(spark.createDataFrame(rows, "path string, line int, text string"))
    path = str(tmp_path / "baseline")
    writers.write_baseline_json(found, path)
    documents = read_framed_json(spark, path)
    assert len(documents) > 1
    assert all(d["totalFindings"] == len(d["entries"]) for d in documents)
    junit = str(tmp_path / "junit")
    write_report(found, junit, "junit")
    for row in spark.read.text(junit, wholetext=True).collect():
        assert f'failures="{row.value.count("<testcase ")}"' in row.value.split("\n")[1]


def test_long_line_time(spark, rules):
    lines = spark.createDataFrame([("a.txt", 1, "abcdefghij " * 20_000)], "path string, line int, text string")
    scan_lines(lines, rules).count()
    start = time.perf_counter()
    scan_lines(lines, rules).count()
    assert time.perf_counter() - start < 60


def test_long_texts_have_a_query(spark, tmp_path):
    """A registered query plants keys beyond the former limits of lines, decoded texts and JSON."""
    from oracle import all_oracles
    from veilscan.plans import queries

    assert "long_text_findings" in queries.all_queries() and "long_text_findings" in all_oracles()
    spark.range(198, 201).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    sizes = {r.path: len(r.content) for r in queries.long_files(spark, str(tmp_path)).collect()}
    assert sizes["long198.txt"] > 65_536 and sizes["blob199.txt"] > 8_192 and sizes["long200.json"] > 65_536
