"""Commit history: added lines of a diff log, tagged with commit, author, date and line number.

The log is read as one row per commit (the commit marker is the record separator), so commits are
parsed independently and nothing has to be ordered across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.paths import is_ignored_path
from veilscan.functions.sizes import parse_byte_size

COMMIT_MARKER = "__COMMIT_START__"
HUNK_HEADER = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
LOG_LINE_BREAK = r"\r\n|\n|\r"


def read_log(spark: SparkSession, path: str, marker: str = COMMIT_MARKER) -> DataFrame:
    """One row per commit from text exported with ``marker NUL hash NUL author NUL date NUL``."""
    return log_blocks(spark.read.option("lineSep", record_separator(marker)).text(path), marker)


def record_separator(marker: str) -> str:
    """A commit begins at the marker at a line's start, before a NUL; elsewhere it is text."""
    return f"\n{marker}\0"


def log_blocks(records: DataFrame, marker: str) -> DataFrame:
    """Whole blocks of records that were split at the separator; only a file's first has its head."""
    head = F.lit(f"{marker}\0")
    return records.where(F.length("value") > 0).select(F.when(
        F.col("value").startswith(head), F.col("value")).otherwise(
        F.concat(head, "value")).alias("block"))


def parse_commits(blocks: DataFrame, marker: str = COMMIT_MARKER) -> DataFrame:
    """``commit, commit_author, commit_date, body`` from ``block``.

    A header needs all four parts; the author may hold any character but NUL.
    """
    first = F.substring_index("block", "\n", 1)
    parts = F.split(first, "\0")
    return (
        blocks.where(F.col("block").startswith(marker) & (F.size(parts) >= 4))
        .select(
            parts[1].alias("commit"), parts[2].alias("commit_author"),
            parts[3].alias("commit_date"),
            F.substring(F.col("block"), F.length(first) + 2, F.length("block")).alias("body"))
    )


def newest_commits(commits: DataFrame, max_commits: int | None) -> DataFrame:
    """Keep the newest commits; only ids and dates take part in the ordering."""
    if not max_commits or max_commits < 0:
        return commits
    newest = (
        commits.select("commit", F.to_timestamp("commit_date").alias("_at"))
        .orderBy(F.col("_at").desc(), "commit").limit(max_commits).select("commit")
    )
    return commits.join(newest, "commit", "left_semi")


def _new_path(section: Column) -> Column:
    """Path of the ``+++`` header, which stands before the first hunk."""
    header = F.concat(F.lit("\n"), F.substring_index(section, "\n@@ ", 1))
    raw = F.btrim(F.regexp_extract(header, r"\n\+\+\+ ([^\r\n]*)", 1), F.lit(" \t"))
    unquoted = F.when(raw.rlike(r'^".*"\z'), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.regexp_replace(unquoted, "^b/", "")


def file_diffs(
    commits: DataFrame, ignore: list[str] | tuple[str, ...] = (), only_file: str | None = None
) -> DataFrame:
    """One row per changed file: the columns of the commit, ``path`` and ``section``."""
    keep = [c for c in commits.columns if c != "body"]
    sections = F.split(F.concat(F.lit("\n"), "body"), "\ndiff --git ", -1)
    df = (
        commits.select(*keep, F.explode(sections).alias("section"))
        .withColumn("path", _new_path(F.col("section")))
        .where((F.col("path") != "") & (F.col("path") != "/dev/null"))
        .where(~is_ignored_path(F.col("path"), ignore))
    )
    return df if only_file is None else df.where(F.col("path") == only_file)


def is_binary_diff(section: Column) -> Column:
    return section.rlike(r"(?m)^Binary files .*differ$")


def added_lines(
    diffs: DataFrame, max_diff_bytes: str | int | None = None
) -> DataFrame:
    """One row per added line: ``line`` and ``text``, up to the byte limit of each file diff."""
    limit = parse_byte_size(max_diff_bytes)
    keep = [c for c in diffs.columns if c != "section"]
    hunks = F.slice(F.split("section", "\n@@ ", -1), F.lit(2), F.lit(2_000_000_000))

    def lines_of(hunk):
        start = F.regexp_extract(F.concat(F.lit("@@ "), hunk), HUNK_HEADER, 1).try_cast("int")
        added = F.filter(F.split(hunk, LOG_LINE_BREAK, -1), lambda row: row.startswith("+"))
        return F.transform(added, lambda row, i: F.struct(
            (start + i).alias("line"), F.substring(row, F.lit(2), F.length(row)).alias("text")))

    df = diffs.withColumn("_added", F.flatten(F.transform(hunks, lines_of)))
    # Bytes only grow, so the lines within the limit are a prefix; most diffs are short enough
    # as a whole, and only the others are added up.
    start = F.struct(F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("kept"))

    def add(state, row):
        total = state["bytes"] + F.octet_length(row["text"])
        return F.struct(
            total.alias("bytes"),
            (state["kept"] + F.when(total <= limit, 1).otherwise(0)).alias("kept"))

    kept = F.aggregate("_added", start, add)["kept"]
    within = F.when(F.octet_length("section") > limit, F.slice("_added", F.lit(1), kept)).otherwise(
        F.col("_added"))
    return df.select(*keep, F.explode(within).alias("_row")).select(
        *keep, "_row.line", "_row.text")


def history_lines(
    blocks: DataFrame, *, marker: str = COMMIT_MARKER, max_commits: int | None = None,
    ignore: list[str] | tuple[str, ...] = (), only_file: str | None = None,
    max_diff_bytes: str | int | None = None,
) -> DataFrame:
    """Added lines of a whole log, ready to scan."""
    commits = newest_commits(parse_commits(blocks, marker), max_commits)
    return added_lines(file_diffs(commits, ignore, only_file), max_diff_bytes)
