import random

import pytest

from veilscan.sources.history import COMMIT_MARKER, history_lines, read_log
from veilscan.sources.log_ranges import BEGINNING, NOTHING, _RangeParser, final_state, log_lines, read_log_lines, then
from veilscan.streaming.scan import write_log_lines

COLUMNS = ("commit", "commit_author", "commit_date", "path", "line", "text")


def _random_log(seed, commits=22):
    """Diffs with headers that look like added lines, bad hunks, binary files, lone \\r and CRLF."""
    rng = random.Random(seed)
    out = []
    for c in range(commits):
        date = f"2024-01-{rng.randint(1, 28):02}"
        out.append(f"{COMMIT_MARKER}\0{c:04x}\0Ann é | {c}\0{date}\0" if rng.random() > 0.1
                   else f"{COMMIT_MARKER}\0short{c}")
        out.append("")
        for f in range(rng.randint(0, 4)):
            out.append(f"diff --git a/f{f} b/f{f}")
            if rng.random() < 0.1:
                out.append(f"Binary files a/f{f} and b/f{f} differ")
                continue
            out.append(f"--- a/f{f}")
            if rng.random() > 0.1:
                out.append(rng.choice([f"+++ b/f{f}", f'+++ "b/f{f} x"', "+++ /dev/null", f"+++ b/f{f}\t", "+++ "]))
            for _ in range(rng.randint(0, 3)):
                out.append(rng.choice(["@@ -1,2 +%d,9 @@ fn", "@@ -0,0 +%d @@", "@@ broken %d"]) % rng.randint(1, 50))
                for i in range(rng.randint(0, 6)):
                    out.append(rng.choice([
                        f"+row {i} é", f"-gone {i}", " kept", f"+++ b/not{i}", "+", f"+crlf {i}\r",
                        f"+one\r+two {i}\rthree", f"+ {COMMIT_MARKER}", "\\ No newline"]))
    return out


def _rows(df):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    before = {name: spark.conf.get(name) for name in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("seed", [1, 6])
def test_ranges_give_the_rows_of_whole_commits(spark, tmp_path, small_splits, seed):
    lines = _random_log(seed)
    (tmp_path / "whole.txt").write_text("\n".join(lines) + "\n", newline="")
    expected = history_lines(read_log(spark, str(tmp_path / "whole.txt")))
    wanted, capped = _rows(expected), _rows(history_lines(
        read_log(spark, str(tmp_path / "whole.txt")), max_diff_bytes="30B", ignore=["f1"]))
    assert len(wanted) > 30
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(lines)), 6))
    (tmp_path / "cut").mkdir()
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        (tmp_path / "cut" / f"part-{n:03}.txt").write_text("\n".join(lines[a:b]) + "\n", newline="")
    read = read_log_lines(spark, str(tmp_path / "cut"))
    assert read.select("file", "start").distinct().count() > 20
    assert _rows(log_lines(read, str(tmp_path / "work"))) == wanted
    assert _rows(log_lines(read, str(tmp_path / "work2"), max_diff_bytes="30B", ignore=["f1"])) == capped


def test_summaries_compose_associatively():
    import pyarrow as pa

    lines = _random_log(3, 12)

    def summary(a, b):
        parser = _RangeParser(COMMIT_MARKER)
        parser.feed(pa.array(lines[a:b], pa.string()))
        return parser.summary

    rng = random.Random(4)
    for _ in range(300):
        a, b, c, d = sorted(rng.sample(range(len(lines) + 1), 4))
        x, y, z = summary(a, b), summary(b, c), summary(c, d)
        assert then(then(x, y), z) == then(x, then(y, z)) == summary(a, d)
        assert then(NOTHING, x) == x == then(x, NOTHING)


def test_one_commit_over_many_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    head = f"{COMMIT_MARKER}\0c1\0Ann\x002024-01-01\0\n\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +5,900 @@\n"
    (tmp_path / "log" / "0.txt").write_text(head)
    for n in range(1, 10):
        (tmp_path / "log" / f"{n}.txt").write_text("".join(f"+row {n} {i}\n" for i in range(100)))
    found = log_lines(read_log_lines(spark, str(tmp_path / "log")), str(tmp_path / "work")).orderBy("line").collect()
    assert [(r.line, r.text) for r in found] == [
        (5 + 100 * (n - 1) + i, f"row {n} {i}") for n in range(1, 10) for i in range(100)]
    assert {(r.commit, r.path) for r in found} == {("c1", "x")}
    assert final_state(spark, str(tmp_path / "work"))["line"] == 905


def test_empty_logs_and_invalid_bytes(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0.txt").write_text("")
    read = read_log_lines(spark, str(tmp_path / "log"))
    assert log_lines(read, str(tmp_path / "work")).count() == 0
    assert final_state(spark, str(tmp_path / "work")) == BEGINNING
    (tmp_path / "log" / "1.txt").write_bytes(
        b"+lost\n" + f"{COMMIT_MARKER}\0c\0a\0d\0\ndiff --git a b\n+++ b/x\n@@ -0 +1 @@\n+".encode() + b"\xff!\n")
    assert [r.text for r in log_lines(read_log_lines(spark, str(tmp_path / "log")), str(tmp_path / "work")).collect()] == ["�!"]


def test_stream_goes_on_within_a_commit(spark, tmp_path):
    from veilscan.sources.log_ranges import read_log_line_stream

    lines = _random_log(5)
    (tmp_path / "whole.txt").write_text("\n".join(lines) + "\n", newline="")
    wanted = _rows(history_lines(read_log(spark, str(tmp_path / "whole.txt"))))
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    third = len(lines) // 3
    for n in range(3):
        part = lines[n * third:] if n == 2 else lines[n * third:(n + 1) * third]
        (folder / f"{n}.txt").write_text("\n".join(part) + "\n", newline="")
        write_log_lines(read_log_line_stream(spark, str(folder)), out, checkpoint).awaitTermination()
    assert _rows(spark.read.parquet(f"{out}/lines")) == wanted
