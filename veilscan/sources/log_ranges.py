"""Commit logs of any shape: lines in order, whatever range of whatever file they lie in.

``sources.history`` reads a commit as one row.  Here a row is a line, so that a commit may exceed a row
(2 GB) and may be cut by the end of a file; the log is the files in the order of their names.  Spark
reads a file in ranges, each of which is parsed on its own:

1. A range's lines leave a summary, what they do to the state of the parser (commit, file, hunk, line,
   bytes).  Summaries compose associatively: two ranges one after the other have a summary again.
2. Summaries, one small row for each range, are dealt into blocks by range of their order.  A block
   folds into one summary, blocks are folded in order, and each block hands on to its ranges the state
   they begin in: two levels of a parallel prefix, with no task that holds all ranges.
3. Lines behind a commit header of their own range are complete as they are and are never shuffled.
   Only those before it (``open``) meet the state of their range, by an equi-join.

The log is read twice: for summaries and open lines, which are written, and for complete lines, which
are not.  Both readings give the same ranges as long as the files and the split size stay the same.

Empty logs give no rows; lines before the first commit header, and those of a header with fewer than
four parts, are dropped; a file that appears twice in a commit is two diffs; a hunk whose header does not
parse has lines without a number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.paths import is_ignored_path
from veilscan.functions.sizes import parse_byte_size
from veilscan.sources.history import COMMIT_MARKER, HUNK_HEADER

COMMIT = ("commit", "commit_author", "commit_date")
# What a passage does to the parser.  ``lead_*`` concern its lines before any commit, diff or hunk
# header, whose meaning depends on what came before; the rest is what holds at its end.
SUMMARY = (
    "has_commit boolean, commit string, commit_author string, commit_date string, reset boolean, "
    "hunk boolean, path string, line bigint, bytes bigint, "
    "lead_path string, lead_added bigint, lead_bytes bigint")
STATE = "struct<" + ",".join(part.replace(" ", ":") for part in SUMMARY.split(", ")) + ">"
RANGE = "file string, start bigint"
ADDED = "path string, line bigint, bytes bigint, text string"
DONE = f"commit string, commit_author string, commit_date string, {ADDED}"

NOTHING = {
    "has_commit": False, "commit": None, "commit_author": None, "commit_date": None, "reset": False,
    "hunk": False, "path": None, "line": None, "bytes": 0,
    "lead_path": None, "lead_added": 0, "lead_bytes": 0}
#: The state at the beginning of a log: no commit, so that lines are dropped until the first one.
BEGINNING = NOTHING | {"has_commit": True, "reset": True}


def then(a: dict, b: dict) -> dict:
    """The summary of two passages, one after the other (associative)."""
    out = dict(a)
    if b["has_commit"]:
        out.update({name: b[name] for name in ("has_commit", *COMMIT)})
    if not (a["reset"] or a["hunk"]):
        out["lead_path"] = b["lead_path"] if a["lead_path"] is None else a["lead_path"]
        out["lead_added"] += b["lead_added"]
        out["lead_bytes"] += b["lead_bytes"]
        after = b
    elif b["reset"]:
        after = b
    else:
        inside = a["hunk"]
        line = b["line"] if b["hunk"] else a["line"]
        if inside and not b["hunk"] and line is not None:
            line += b["lead_added"]
        after = {
            "reset": a["reset"], "hunk": inside or b["hunk"], "line": line,
            "path": a["path"] if inside or a["path"] is not None else b["lead_path"],
            "bytes": a["bytes"] + b["bytes"] + (b["lead_bytes"] if inside else 0)}
    out.update({name: after[name] for name in ("reset", "hunk", "path", "line", "bytes")})
    return out


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log's files with the range that they were read in: ``file, start, value``.

    Bytes that are no UTF-8 become replacement characters.
    Rows of one range come in order and in one partition; no step before the parser may move them.
    """
    return _with_range(spark.read.option("lineSep", "\n").text(path))


def read_log_line_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """The same lines of files that arrive in a folder; a batch goes on where the last one ended."""
    return _with_range(spark.readStream.option("lineSep", "\n").option(
        "maxFilesPerTrigger", files_per_batch).text(path))


def _with_range(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("value"))


def _header_path(header: str) -> str:
    raw = header[4:].split("\r", 1)[0].strip(" \t")
    if len(raw) > 1 and raw[0] == raw[-1] == '"':
        raw = raw[1:-1]
    return raw.removeprefix("b/")


class _RangeParser:
    """Parses the lines of one range, batch by batch; ``summary`` is that of the lines so far."""

    def __init__(self, marker: str):
        self.head = marker + "\0"
        self.summary = dict(NOTHING)

    def _section(self) -> tuple:
        """What holds for added lines from here on; the first part is None where there are none."""
        s = self.summary
        kind = ("diff" if s["reset"] else "hunk") if s["hunk"] else None if s["reset"] else "lead"
        return (kind, s["has_commit"], *(s[c] for c in COMMIT), s["path"], s["hunk"] and s["line"] is None)

    def _control(self, line: str) -> bool:
        """Take in a header; False where the line is none at this place."""
        s = self.summary
        if line.startswith("+"):
            if s["hunk"]:
                return False
            name = "path" if s["reset"] else "lead_path"
            if s[name] is None:
                s[name] = _header_path(line)
            return s["reset"]
        if line.startswith("@@"):
            found = re.match(HUNK_HEADER, line, re.ASCII)
            first = int(found[1]) if found else None
            s.update(hunk=True, line=first if first is None or first < 2**31 else None)
            return True
        s.update(reset=True, hunk=False, path=None, line=None, bytes=0)
        if line.startswith(self.head):
            parts = line.split("\0")
            named = parts[1:4] if len(parts) >= 4 else (None, None, None)
            s.update(zip(COMMIT, named), has_commit=True)
        return True

    def feed(self, values: pa.Array) -> pa.Table:
        """Added lines of the next lines, with the section each stands in."""
        lines = pc.replace_substring_regex(values, r"\r\z", "")
        first = None
        if pc.any(pc.match_substring(lines, "\r")).as_py():  # a lone \r ends a line within a hunk
            split = pc.split_pattern(lines, "\r")
            origin = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
            first, lines = np.diff(origin, prepend=-1) != 0, split.flatten()
        is_added = pc.starts_with(lines, "+").to_numpy(zero_copy_only=False)
        marks = reduce(pc.or_, (pc.starts_with(lines, p) for p in ("diff --git ", "@@ ", "+++ ", self.head)))
        marks = marks.to_numpy(zero_copy_only=False)
        if first is not None:
            marks = marks & first
        sizes = np.where(is_added, pc.binary_length(lines).to_numpy(zero_copy_only=False) - 1, 0)
        counted = np.concatenate([[0], np.cumsum(is_added)])
        weighed = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

        sections, begins, at = [], [], 0
        s = self.summary

        def close(end: int) -> None:
            """Lines up to ``end`` belong to the present section."""
            nonlocal at
            added, size = int(counted[end] - counted[at]), int(weighed[end] - weighed[at])
            section = self._section()
            before = (s["lead_added"], s["lead_bytes"]) if section[0] == "lead" else (s["line"], s["bytes"])
            sections.append((*section, (before[0] or 0) - int(counted[at]), before[1] - int(weighed[at])))
            begins.append(at)
            if section[0] == "lead":
                s["lead_added"] += added
                s["lead_bytes"] += size
            elif section[0]:
                s["bytes"] += size
                if s["line"] is not None:
                    s["line"] += added
            at = end

        for position in np.flatnonzero(marks):
            position = int(position)
            line = values[position if first is None else int(origin[position])].as_py()
            if line.startswith("+") and (s["hunk"] or not s["reset"]):
                self._control(line)  # an added line, or one of which only the state tells
                continue
            close(position)
            self._control(line)
            if line.startswith("+"):
                at = position + 1  # the header itself is no added line
        close(len(lines))

        rows = np.flatnonzero(is_added)
        where = np.searchsorted(np.array(begins), rows, "right") - 1
        kinds, known, commits, authors, dates, paths, unnumbered, line_base, byte_base = (
            list(column) for column in zip(*sections))
        keep = np.array([k is not None for k in kinds])[where]
        rows, where = rows[keep], where[keep]
        taken = pa.array(where)
        number = np.array(line_base, np.int64)[where] + counted[rows]
        return pa.table({
            "section": pa.array(kinds, pa.string()).take(taken),
            "known": pa.array(known, pa.bool_()).take(taken),
            "commit": pa.array(commits, pa.string()).take(taken),
            "commit_author": pa.array(authors, pa.string()).take(taken),
            "commit_date": pa.array(dates, pa.string()).take(taken),
            "path": pa.array(paths, pa.string()).take(taken),
            "line": pa.array(number, mask=np.array(unnumbered, bool)[where]),
            "bytes": pa.array(np.array(byte_base, np.int64)[where] + weighed[rows + 1]),
            "text": pc.utf8_slice_codeunits(lines.take(pa.array(rows)), 1),
        })


    def feed_open(self, values: pa.Array) -> pa.Table:
        """Added lines of the next lines, but for those between two commit headers.

        A header makes an end of what holds before it, so that only the last one of these lines tells what
        holds after them.
        """
        heads = np.flatnonzero(pc.starts_with(values, self.head).to_numpy(zero_copy_only=False))
        if not len(heads):
            return self.feed(values)
        last = self.feed if self.summary["has_commit"] else lambda tail: pa.concat_tables(
            [self.feed(values.slice(0, int(heads[0]))), self.feed(tail)])
        return last(values.slice(int(heads[-1])))


def _ranges(batches: Iterable[pa.RecordBatch], marker: str, only_open: bool = False) -> Iterator[tuple]:
    """``(file, start, added lines or None, parser)``; None once a range has ended.

    ``only_open`` leaves out added lines between two commit headers.
    """
    key, parser = None, None
    for batch in batches:
        files, starts, values = (batch.column(name) for name in ("file", "start", "value"))
        if not len(values):
            continue
        file_ids = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(
            (np.diff(file_ids) != 0) | (np.diff(starts.to_numpy(zero_copy_only=False)) != 0)) + 1
        edges = [0, *cuts.tolist(), len(values)]
        for begin, end in zip(edges, edges[1:]):
            here = (files[begin].as_py(), starts[begin].as_py())
            if here != key:
                if parser is not None:
                    yield (*key, None, parser)
                key, parser = here, _RangeParser(marker)
            part = values.slice(begin, end - begin)
            yield (*key, parser.feed_open(part) if only_open else parser.feed(part), parser)
    if parser is not None:
        yield (*key, None, parser)


def complete_lines(lines: DataFrame, marker: str = COMMIT_MARKER) -> DataFrame:
    """Added lines behind a commit header of their own range."""
    columns = ["commit", "commit_author", "commit_date", "path", "line", "bytes", "text"]

    def parse(batches):
        for _, _, added, _ in _ranges(batches, marker):
            if added is not None and added.num_rows:
                yield from added.filter(pc.and_(added["known"], pc.is_valid(added["commit"]))).select(
                    columns).to_batches()

    # Names are not looked at but for where one ends; 64 bits of them do, instead of a name beside each line.
    return lines.withColumn("file", F.xxhash64("file")).mapInArrow(parse, DONE)


def open_lines(lines: DataFrame, marker: str = COMMIT_MARKER) -> DataFrame:
    """Added lines before the first commit header of their range, and a row for each range with its
    ``summary``."""
    columns = ["section", "path", "line", "bytes", "text"]
    summary = pa.struct([(name, {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}[kind])
                         for name, kind in (part.split(" ") for part in SUMMARY.split(", "))])

    def parse(batches):
        for file, start, added, parser in _ranges(batches, marker, only_open=True):
            if added is None:
                end = [NOTHING | parser.summary]
                rows = pa.table({c: pa.nulls(1, pa.int64() if c in ("line", "bytes") else pa.string())
                                 for c in columns})
                states = pa.array(end, summary)
            else:
                rows = added.filter(pc.invert(added["known"])).select(columns)
                states = pa.nulls(rows.num_rows, summary)
            if rows.num_rows:
                n = rows.num_rows
                yield from pa.table({
                    "file": pa.array([file] * n, pa.string()), "start": pa.array([start] * n, pa.int64()),
                    **{c: rows[c] for c in columns}, "summary": states}).to_batches()

    return lines.mapInArrow(parse, f"{RANGE}, section string, {ADDED}, summary {STATE}")


def _fold(table: pa.Table, state: dict) -> Iterator[tuple[dict, dict]]:
    """Each row in order, and the state before it."""
    for row in sorted(table.to_pylist(), key=lambda r: (r["file"], r["start"])):
        yield row, state
        state = then(state, row["summary"])


def _carried(ranges: DataFrame, totals: DataFrame, before: dict) -> DataFrame:
    """For each range the state that it begins in: ``file, start, state, summary``."""
    def blocks(table: pa.Table) -> pa.Table:
        out = [{"block": row["block"], "state": state} for row, state in _fold(table, before)]
        return pa.Table.from_pylist(out, pa.schema(
            [("block", pa.int32()), ("state", table.schema.field("summary").type)]))

    def within(table: pa.Table) -> pa.Table:
        kind = table.schema.field("summary").type
        out = [{"file": row["file"], "start": row["start"], "state": state, "summary": row["summary"]}
               for row, state in _fold(table, table["state"][0].as_py())]
        return pa.Table.from_pylist(out, pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("state", kind), ("summary", kind)]))

    begins = totals.groupBy().applyInArrow(blocks, f"block int, state {STATE}")
    return ranges.join(begins, "block").groupBy("block").applyInArrow(
        within, f"{RANGE}, state {STATE}, summary {STATE}")


def _totals(ranges: DataFrame) -> DataFrame:
    """One summary for each block, under its first range."""
    def total(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["file"], r["start"]))
        return pa.Table.from_pylist([rows[0] | {"summary": reduce(then, (r["summary"] for r in rows))}],
                                    table.schema)

    return ranges.groupBy("block").applyInArrow(total, ranges.schema)


def _closed(opened: DataFrame, carried: DataFrame) -> DataFrame:
    """Open lines with the state of their range put in."""
    s, own = F.col("state"), F.col("summary")
    lead, diff = F.col("section") == "lead", F.col("section") == "diff"
    path = F.coalesce(s["path"], F.when(~s["hunk"], own["lead_path"]))
    so_far = s["bytes"] + F.when(~lead & s["hunk"], own["lead_bytes"]).otherwise(0)
    return (
        opened.where("summary IS NULL").drop("summary").join(carried, ["file", "start"])
        .where(s["commit"].isNotNull() & (~lead | s["hunk"]))
        .select(
            *[s[c].alias(c) for c in COMMIT],
            F.when(diff, F.col("path")).when(lead, s["path"]).otherwise(path).alias("path"),
            F.when(lead, s["line"] + F.col("line")).otherwise(F.col("line")).alias("line"),
            F.when(diff, F.col("bytes")).otherwise(so_far + F.col("bytes")).alias("bytes"),
            "text"))


def log_lines(
    lines: DataFrame, folder: str, *, marker: str = COMMIT_MARKER,
    ignore: Iterable[str] = (), only_file: str | None = None,
    max_diff_bytes: str | int | None = None, before: dict | None = None,
) -> DataFrame:
    """Added lines of a log, ready to scan: the rows of ``history.history_lines``.

    ``lines`` come from ``read_log_lines``; ``folder`` is a folder that driver and executors share, for
    open lines and summaries; what it held is replaced.  ``before`` is the state that the log begins in (``final_state`` of
    what came before).  The newest commits alone cannot be asked for: a commit has no row of its own.
    """
    spark = lines.sparkSession
    open_lines(lines, marker).write.mode("overwrite").parquet(f"{folder}/open")
    opened = spark.read.parquet(f"{folder}/open")
    # Written, so that the blocks are the same for every reader of them.
    opened.where("summary IS NOT NULL").select("file", "start", "summary").repartitionByRange(
        "file", "start").withColumn("block", F.spark_partition_id()).write.mode(
        "overwrite").parquet(f"{folder}/ranges")
    totals = _totals(spark.read.parquet(f"{folder}/ranges"))
    carried = _carried(spark.read.parquet(f"{folder}/ranges"), totals, before or BEGINNING)
    found = complete_lines(lines, marker).unionByName(_closed(opened, carried))
    found = found.where((F.col("path") != "") & (F.col("path") != "/dev/null")).where(
        (F.col("bytes") <= parse_byte_size(max_diff_bytes)) & ~is_ignored_path(F.col("path"), list(ignore)))
    if only_file is not None:
        found = found.where(F.col("path") == only_file)
    return found.select(*COMMIT, "path", F.col("line").cast("int").alias("line"), "text")


def final_state(spark: SparkSession, folder: str, before: dict | None = None) -> dict:
    """The state after a log whose lines were read with ``folder``: one row for each block is folded."""
    def last(table: pa.Table) -> pa.Table:
        state = before or BEGINNING
        for row, _ in _fold(table, state):
            state = then(state, row["summary"])
        return pa.Table.from_pylist([{"summary": state}], pa.schema([table.schema.field("summary")]))

    totals = _totals(spark.read.parquet(f"{folder}/ranges"))
    row = totals.groupBy().applyInArrow(last, totals.select("summary").schema).head()
    return row.summary.asDict() if row else dict(before or BEGINNING)
