import os
import zipfile

import pytest
from pyspark.sql import functions as F

from veilscan.operators.blocks import scan_blocks
from veilscan.operators.score import history_totals
from veilscan.plans.scan import file_lines, scan_files, scan_history
from veilscan.sources.baselines import read_baseline_json
from veilscan.sources.files import decode_bytes, expand_archives, read_files
from veilscan.sources.history import (
    COMMIT_MARKER,
    added_lines,
    file_diffs,
    history_lines,
    is_binary_diff,
    parse_commits,
    read_log,
)
from veilscan.sources.snapshots import changed_since, guard, staged


@pytest.fixture
def tree(tmp_path, ak):
    def put(name, body):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body if isinstance(body, bytes) else body.encode())

    put("src/a.js", f"const k = '{ak}';\n")
    put(".env", "# note\nAPI_KEY=prod_api_token_abcdef1234567890abcdef\n")
    put("conf/x.json", '{"a":{"b":["x","%s"]},"deep":%s"%s"%s}' % (ak, '{"k":' * 9, ak, "}" * 9))
    put("bad.json", '{"a": "%s"' % ak)
    put("img.png", ak)
    put("node_modules/a.js", ak)
    put("vendor/v.js", ak)
    put("le.txt", ("﻿key " + ak).encode("utf-16-le"))
    put("be.txt", ("key " + ak).encode("utf-16-be"))
    put("nul.txt", ak[:6].encode() + b"\0" + ak[6:].encode())
    put("broken.zip", "not an archive " + ak)
    put("big.txt", "x" * 5_000 + ak)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.writestr("in/a.txt", "x " + ak)
        archive.writestr("b.bin", b"\0" + ak.encode())
        archive.writestr("folder/", "")
    os.symlink(tmp_path / "src/a.js", tmp_path / "link.js")
    return str(tmp_path)


def test_directory_scan(spark, rules, tree):
    found = scan_files(
        spark, tree, rules.only(["aws-access-key", "generic-api-key"]), ignore=["vendor"],
        max_file_size="4KB").collect()
    assert sorted((r.path, r.line, r.leaf_path) for r in found if r.leaf_path) == [
        ("conf/x.json", 1, "a.b.1"), ("conf/x.json", 1, "deep" + ".k" * 9)]
    assert sorted({r.path for r in found}) == [
        ".env", "bad.json", "be.txt", "broken.zip", "conf/x.json", "le.txt", "nul.txt", "src/a.js",
        "z.zip://in/a.txt"]
    status = {r.path: r.status for r in read_files(spark, tree, max_file_size="4KB").collect()}
    assert status["big.txt"] == "too-large" and status["link.js"] == "symlink"
    assert "img.png" not in status and "node_modules/a.js" not in status
    everything = {r.path for r in read_files(spark, tree, scan_all_extensions=True).collect()}
    assert "img.png" in everything


def test_archive_members_are_read_like_plain_files(spark, rules, tmp_path, ak):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("wide.txt", ("\ufeffkey " + ak).encode("utf-16-le"))
        archive.writestr("nul.txt", (ak[:6].encode() + b"\0" + ak[6:].encode()))
        archive.writestr("bad.txt", "unread " * 50 + ak)
        archive.writestr("good.txt", "x " + ak)
        archive.writestr("locked.txt", "y " + ak)
        archive.writestr("pic.png", b"\0" * 50)
        archive.writestr("note.png", "z " + ak)
        places = {i.filename: i.header_offset for i in archive.infolist()}
    body = bytearray((tmp_path / "a.zip").read_bytes())
    at = places["bad.txt"] + 30 + len("bad.txt")
    body[at:at + 8] = b"\xff" * 8
    # The flag of encrypted members, in the member's header and in the directory.
    body[places["locked.txt"] + 6] |= 1
    body[body.rindex(b"locked.txt") - 46 + 8] |= 1
    (tmp_path / "a.zip").write_bytes(bytes(body))
    files = expand_archives(read_files(spark, str(tmp_path)))
    assert {r.path.removeprefix("a.zip://"): r.status for r in files.collect()} == {
        "wide.txt": "scanned", "nul.txt": "scanned", "bad.txt": "unreadable", "good.txt": "scanned",
        "locked.txt": "unreadable", "pic.png": "binary", "note.png": "scanned", "a.zip": "scanned"}
    found = scan_files(spark, str(tmp_path), rules.only(["aws-access-key"])).collect()
    assert sorted(r.path for r in found) == [
        f"a.zip://{n}" for n in ("good.txt", "note.png", "nul.txt", "wide.txt")]


def test_single_file_scan(spark, rules, tree):
    picked = rules.only(["aws-access-key", "generic-api-key"])
    assert [r.path for r in scan_files(spark, tree + "/src/a.js", picked).collect()] == ["a.js"]
    assert [r.line for r in scan_files(spark, tree + "/.env", picked).collect()] == [2]
    for bad in ("/link.js", "/nothing"):
        with pytest.raises(ValueError):
            scan_files(spark, tree + bad, picked)


def test_byte_decoding(spark):
    cases = [
        ("﻿hé".encode("utf-16-le"), "hé"), ("﻿hé".encode("utf-16-be"), "hé"),
        ("plain text".encode("utf-16-le"), "plain text"), ("abcd".encode("utf-16-be"), "abcd"),
        (b"a\0\0bc", "abc"), ("é".encode(), "é"), (b"\xff\xfe\x00\xd8x", "�"), (b"", ""),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c binary")
    got = df.select("i", decode_bytes(F.col("c")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [want for _, want in cases]


def test_structured_lines(spark):
    deep = '{"n":' * 40 + '{"k":"v"}' + "}" * 40
    rows = [
        ("a.json", '{"s":"x","l":["y",{"m":"z"}],"n":1,"t":true,"z":null}'), ("d.json", deep),
        ("bad.json", '{"a":\n1'), ("e.env", "A = 1 # c\n\nexport B='q'\nnone\nC=\"'x'\"\nD="),
        ("t.txt", "one\ntwo"), ("s.json", '"text"'),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    got = [(r.path, r.line, r.text, r.leaf_path)
           for r in file_lines(df).orderBy("path", "line", "text").collect()]
    assert got == [
        ("a.json", 1, "0: y", "l.0"), ("a.json", 1, "m: z", "l.1.m"), ("a.json", 1, "s: x", "s"),
        ("bad.json", 1, '{"a":', None), ("bad.json", 2, "1", None),
        ("d.json", 1, "k: v", "n." * 40 + "k"),
        ("e.env", 1, "A: 1 # c", None), ("e.env", 3, "export B: q", None),
        ("e.env", 5, "C: 'x'", None), ("e.env", 6, "D: ", None),
        ("t.txt", 1, "one", None), ("t.txt", 2, "two", None)]


def test_block_rules(spark):
    pem = "-----BEGIN EC " + "PRIVATE KEY-----\n" + "Mab1" * 20 + "\n-----END EC " + "PRIVATE KEY-----"
    curl = "x\ncurl https://h \\\n  -H 'a: b' -u admin:" + "s3cr3tw0rdX9 \nend"
    df = spark.createDataFrame(
        [("k.pem", "top\n  " + pem), ("one.txt", pem.replace("\n", " ")), ("c.sh", curl)],
        "path string, content string")
    got = [(r.path, r.line, r.column, r.rule_id) for r in scan_blocks(df).orderBy("path").collect()]
    assert ("k.pem", 2, 3, "private-key") in got
    assert all(path != "one.txt" for path, *_ in got)


def _log(ak):
    m = COMMIT_MARKER
    return (
        f"{m}\0c1\0Ann | Dev\x002024-01-01T00:00:00Z\0\n\ndiff --git a/x.js b/x.js\n--- /dev/null\n"
        f"+++ b/x.js\n@@ -0,0 +1,3 @@\n+// hi\n+k='{ak}'\n++++ tricky\n"
        f"diff --git a/p.png b/p.png\n--- a/p.png\n+++ b/p.png\n@@ -1 +1 @@\n+{ak}\n"
        f"diff --git a/q b/q\nBinary files a/q and b/q differ\n"
        f"{m}\0c2\0Bob\x002024-01-02T00:00:00Z\0\ndiff --git a/x.js b/x.js\n--- a/x.js\n"
        f"+++ \"b/x.js\"\n@@ -2 +1,0 @@\n-k='{ak}'\n@@ -9,0 +10,2 @@ fn\n+one\n+two {ak}\n"
        f"diff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n{m}\0short\n")


def test_history(spark, rules, tmp_path, ak):
    target = tmp_path / "log.txt"
    target.write_text(_log(ak))
    blocks = read_log(spark, str(target))
    commits = parse_commits(blocks)
    assert commits.count() == 2
    lines = history_lines(blocks).orderBy("commit", "line").collect()
    assert [(r.commit, r.commit_author, r.path, r.line, r.text) for r in lines] == [
        ("c1", "Ann | Dev", "x.js", 1, "// hi"), ("c1", "Ann | Dev", "x.js", 2, f"k='{ak}'"),
        ("c1", "Ann | Dev", "x.js", 3, "+++ tricky"),
        ("c2", "Bob", "x.js", 10, "one"), ("c2", "Bob", "x.js", 11, f"two {ak}")]
    picked = rules.only(["aws-access-key"])
    found = scan_history(blocks, picked).orderBy("commit").collect()
    assert [(r.commit, r.line, r.column) for r in found] == [("c1", 2, 4), ("c2", 11, 5)]
    assert scan_history(blocks, picked, max_commits=1).head().commit == "c2"
    assert scan_history(blocks, picked, only_file="other.js").count() == 0
    assert scan_history(blocks, picked, ignore=["x.js"]).count() == 0
    assert [r.text for r in history_lines(blocks, max_diff_bytes="10B").orderBy("commit").collect()] == [
        "// hi", "one"]
    diffs = file_diffs(commits)
    totals = history_totals(added_lines(diffs), diffs, commits).head()
    assert (totals.commits_scanned, totals.files_scanned, totals.lines_scanned) == (2, 1, 5)
    sections = spark.createDataFrame([("Binary files a/q and b/q differ",), ("+x",)], "s string")
    assert sections.where(is_binary_diff(F.col("s"))).count() == 1


def test_empty_history(spark, rules):
    blocks = spark.createDataFrame([], "block string")
    assert scan_history(blocks, rules).count() == 0
    commits = parse_commits(blocks)
    diffs = file_diffs(commits)
    assert tuple(history_totals(added_lines(diffs), diffs, commits).head()) == (0, 0, 0)


def test_snapshots(spark, ak):
    schema = "snapshot_id string, path string, mode string, content string"
    rows = [
        ("head", "same", "100644", "a"), ("head", "edited", "100644", "a"),
        ("head", "gone", "100644", "a"), ("index", "same", "100644", "a"),
        ("index", "edited", "100644", f"id {ak}"), ("index", "new", "100644", "n"),
        ("index", "link", "120000", "t"), ("index", "../out", "100644", "o"),
        ("index", "bin", "100644", "a\0\0b"), ("index", "big", "100644", "x" * 100),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.path: r.status for r in guard(staged(df), 50).collect()}
    assert got == {"edited": "scanned", "new": "scanned", "link": "symlink",
                   "../out": "path-traversal", "bin": "binary (null-check)", "big": "too-large"}
    current = df.where("snapshot_id = 'index'").drop("snapshot_id")
    extra = spark.createDataFrame([("loose", "100644", "u"), ("same", "100644", "u")],
                                  "path string, mode string, content string")
    changed = changed_since(current, df.where("snapshot_id = 'head'"), extra)
    assert sorted(r.path for r in changed.collect()) == [
        "../out", "big", "bin", "edited", "link", "loose", "new", "same"]


def test_baseline_files(spark, tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{"version":"1.0","entries":[{"fingerprint":"f1"},{"fingerprint":"f1"}]}')
    bad.write_text("not json")
    assert [r.fingerprint for r in read_baseline_json(spark, str(good)).collect()] == ["f1"]
    assert read_baseline_json(spark, str(bad)).count() == 0
    assert read_baseline_json(spark, str(tmp_path / "missing")).count() == 0
