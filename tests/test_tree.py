import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from veilscan.plans.scan import scan_tree
from veilscan.sources import tree
from veilscan.sources.tree import inflate, list_members, read_members, tree_contents, walk_tree


def _put(root, name, body):
    target = root / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_walk_lists_hidden_linked_large_and_pruned(spark, tmp_path):
    root = tmp_path / "root"
    for name in (".env", "a/b/c/d/e/deep.txt", "a/_x/y.txt", "node_modules/n.js", "a/.git/config", "vendor/v.js",
                 "a/vendor/w.js", "shots.js/in.txt", "pic.png", "sp ace/ü.txt"):
        _put(root, name, "text")
    _put(root, "big.txt", "x" * 5_000)
    (root / "empty").mkdir()
    os.symlink(root, root / "a/loop")
    os.symlink(root / ".env", root / "link.txt")
    (root / os.fsdecode(b"bad\xff.txt")).write_text("x")
    os.mkfifo(root / "pipe")
    rows = walk_tree(spark, str(root), str(tmp_path / "w"), ignore=["vendor", "*.js"], max_file_size="4KB").collect()
    assert {r.path: r.status for r in rows} == {
        ".env": "scanned", "a/b/c/d/e/deep.txt": "scanned", "a/_x/y.txt": "scanned", "shots.js/in.txt": "scanned",
        "sp ace/ü.txt": "scanned", "big.txt": "too-large", "a/loop": "symlink", "link.txt": "symlink",
        "bad�.txt": "unreadable"}
    assert len(rows) == 9 and {r.path: r.length for r in rows}["big.txt"] == 5_000
    every = walk_tree(spark, str(root), str(tmp_path / "w"), scan_all_extensions=True)
    assert {r.path for r in every.collect()} >= {"pic.png", "vendor/v.js"}
    for bad in ("a/loop", "nothing", ".env"):
        with pytest.raises(ValueError):
            walk_tree(spark, str(root / bad), str(tmp_path / "w2"))
    (tmp_path / "none").mkdir()
    assert walk_tree(spark, str(tmp_path / "none"), str(tmp_path / "w3")).count() == 0


def _archive(bodies, method=zipfile.ZIP_DEFLATED):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", method) as archive:
        for name, body in bodies:
            archive.writestr(name, body)
    return packed.getvalue()


@pytest.mark.parametrize("method", [
    zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_inflate_equals_the_library(method):
    bodies = [("a", b""), ("b", b"text " * 1_000), ("c", os.urandom(3_000_000))]
    body = _archive(bodies, method)
    with zipfile.ZipFile(io.BytesIO(body)) as archive:
        for member, (_, want) in zip(archive.infolist(), bodies):
            place = (member.header_offset, member.compress_size, member.file_size, member.compress_type)
            assert inflate(io.BytesIO(body), *place, member.CRC) == want
            with pytest.raises(tree.UNREADABLE):
                inflate(io.BytesIO(body), *place, member.CRC ^ 1)
            with pytest.raises(tree.UNREADABLE):
                inflate(io.BytesIO(body[: member.header_offset + 20]), *place, member.CRC)
            if want:  # a member that unpacks to more than it states is left at that size
                with pytest.raises(tree.UNREADABLE):
                    inflate(io.BytesIO(body), *place[:2], 3, place[3], member.CRC)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "TASK_BYTES", 40_000)
    _put(tmp_path, "in/a.jar", b"#!prefix\n" + _archive([(f"m{i:03}.txt", f"text {i} " * 100) for i in range(100)]))
    listed = walk_tree(spark, str(tmp_path / "in"), str(tmp_path / "w"))
    members = list_members(listed, str(tmp_path / "in"))
    assert members.count() == 100
    read = read_members(members, str(tmp_path / "in"))
    got = read.select("path", F.col("content").cast("string").alias("text"), F.spark_partition_id().alias("p")).collect()
    assert {r.path: r.text for r in got} == {f"a.jar://m{i:03}.txt": f"text {i} " * 100 for i in range(100)}
    assert len({r.p for r in got}) > 5


def test_tree_scan(spark, rules, tmp_path, ak):
    root = tmp_path / "root"
    _put(root, "src/a.js", f"const k = '{ak}';\n")
    _put(root, "x.json", '{"a":{"b":["x","%s"]}}' % ak)
    _put(root, "le.txt", ("﻿key " + ak).encode("utf-16-le"))
    _put(root, "broken.zip", "not an archive " + ak)
    _put(root, "empty.zip", _archive([]))
    _put(root, "cut.zip", _archive([("a.txt", ak)])[:-8])
    body = bytearray(_archive([
        ("bad.txt", "unread " * 50 + ak), ("dir/", ""), ("good.txt", "x " + ak), ("pic.png", b"\0" * 50),
        ("note.png", "z " + ak), ("wide.txt", ("﻿key " + ak).encode("utf-16-le")), ("locked.txt", "y " + ak)]))
    body[37:45] = b"\xff" * 8
    body[body.rindex(b"locked.txt") - 46 + 8] |= 1
    _put(root, "z.zip", bytes(body))
    listed = walk_tree(spark, str(root), str(tmp_path / "w"))
    status = {r.path: r.status for r in tree_contents(listed, str(root), str(tmp_path / "m")).collect()}
    assert status == {
        "src/a.js": "scanned", "x.json": "scanned", "le.txt": "scanned", "broken.zip": "scanned", "cut.zip": "scanned",
        "z.zip://bad.txt": "unreadable", "z.zip://good.txt": "scanned", "z.zip://pic.png": "binary",
        "z.zip://note.png": "scanned", "z.zip://wide.txt": "scanned", "z.zip://locked.txt": "unreadable"}
    found = scan_tree(spark, str(root), str(tmp_path / "s"), rules.only(["aws-access-key"])).collect()
    assert sorted((r.path, r.leaf_path) for r in found if r.path != "cut.zip") == [
        ("broken.zip", None), ("le.txt", None), ("src/a.js", None), ("x.json", "a.b.1"), ("z.zip://good.txt", None),
        ("z.zip://note.png", None), ("z.zip://wide.txt", None)]
