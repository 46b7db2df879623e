"""The scan: a table of lines, texts or files in, a table of findings out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.directives import DEFAULT_TAG
from veilscan.operators.blocks import scan_blocks
from veilscan.operators.lines import line_rows, to_lines
from veilscan.operators.match import match_segments
from veilscan.operators.segments import DEFAULT_DECODE_DEPTH, to_segments
from veilscan.operators.structured import structured_rows
from veilscan.rules import RuleSet, effective_rules
from veilscan.sources.files import decode_bytes, expand_archives, read_files
from veilscan.sources.history import history_lines
from veilscan.sources.tree import tree_contents, walk_tree


def scan_lines(
    lines: DataFrame, rules: RuleSet | None = None, *,
    allowlist: Iterable[str] | DataFrame | None = None,
    min_severity: str = "low", decode_depth: int = DEFAULT_DECODE_DEPTH, normalise: bool = True,
    tag: str = DEFAULT_TAG, keep_secret: bool = False,
    engine: str = "arrow", extra: Iterable[str] = (),
) -> DataFrame:
    """Findings of a table ``(path, line, text[, prev_text])``.

    ``extra`` names further columns of ``lines`` to carry into the findings.
    """
    rules = (rules or effective_rules()).at_least(min_severity)
    if "prev_text" not in lines.columns:
        lines = lines.withColumn("prev_text", F.lit(None).cast("string"))
    extra = list(extra)
    lines = lines.select("path", "line", "text", "prev_text", *extra)
    segments = to_segments(
        lines, rules, decode_depth=decode_depth, normalise=normalise, engine=engine)
    return match_segments(
        segments, rules, allowlist=allowlist, tag=tag, extra=extra, keep_secret=keep_secret,
        engine=engine)


def scan_texts(
    files: DataFrame, rules: RuleSet | None = None, *, merge_lines: bool = False,
    structured: bool = False, **options,
) -> DataFrame:
    """Findings of a table ``(path, content)``.

    ``merge_lines`` joins spliced source lines (leave it off for prose, where apostrophes look
    like open quotes).  ``structured`` reads JSON and dotenv files by their entries; findings then
    carry ``leaf_path``.  Rules for secrets over several lines look at whole texts as well.
    """
    extra = list(options.pop("extra", ()))
    files = files.select("path", "content", *extra)
    if structured:
        files = files.withColumn("leaf_path", F.lit(None).cast("string"))
        extra = [*extra, "leaf_path"]
    lines = (file_lines(files.drop("leaf_path"), merge_lines) if structured
             else to_lines(files, "content", merge_lines))
    found = scan_lines(lines, rules, extra=extra, **options)
    chosen = (rules or effective_rules()).at_least(options.get("min_severity", "low"))
    if not any(rule.scope == "block" for rule in chosen.rules):
        return found
    kept = {k: v for k, v in options.items() if k in ("allowlist", "keep_secret", "engine")}
    return found.unionByName(scan_blocks(files, chosen, extra=extra, **kept))


def file_lines(files: DataFrame, merge_lines: bool = True) -> DataFrame:
    """Lines of files; JSON and dotenv files give synthetic lines instead of their raw ones.

    Every file becomes one array of rows, whichever way it is read, so the input is read once.
    """
    keep = [c for c in files.columns if c != "content"]
    df = structured_rows(files)
    df = line_rows(df, "content", merge_lines, F.col("entries").isNull())
    none = F.lit(None).cast("string")
    rows = F.coalesce(
        F.transform("entries", lambda e: F.struct(
            e["line"].alias("line"), e["text"].alias("text"), none.alias("prev_text"),
            e["leaf_path"].alias("leaf_path"))),
        F.transform("rows", lambda r: F.struct(
            r["line"].alias("line"), r["text"].alias("text"), r["prev_text"].alias("prev_text"),
            none.alias("leaf_path"))))
    return df.select(*keep, F.explode(rows).alias("_row")).select(
        *keep, "_row.line", "_row.text", "_row.prev_text", "_row.leaf_path")


def scan_files(
    spark: SparkSession, path: str, rules: RuleSet | None = None, *,
    ignore: Iterable[str] = (), scan_all_extensions: bool = False,
    max_file_size: str | int | None = None, merge_lines: bool = True, **options,
) -> DataFrame:
    """Findings of a directory tree or a single file."""
    files = read_files(
        spark, path, ignore=ignore, scan_all_extensions=scan_all_extensions,
        max_file_size=max_file_size).where("status = 'scanned'")
    texts = expand_archives(files, scan_all_extensions).where("status = 'scanned'").select(
        "path", decode_bytes(F.col("content")).alias("content"))
    return scan_texts(texts, rules, merge_lines=merge_lines, structured=True, **options)


def scan_tree(
    spark: SparkSession, path: str, folder: str, rules: RuleSet | None = None, *,
    ignore: Iterable[str] = (), scan_all_extensions: bool = False,
    max_file_size: str | int | None = None, merge_lines: bool = True, **options,
) -> DataFrame:
    """Findings of a directory tree that is listed and taken apart by tasks (``sources.tree``).

    ``folder`` is shared by driver and executors, for listings.  Unlike in ``scan_files``, a damaged
    member does not make its archive be read as a plain file.
    """
    listed = walk_tree(
        spark, path, f"{folder}/listing", ignore=ignore, scan_all_extensions=scan_all_extensions,
        max_file_size=max_file_size)
    texts = tree_contents(listed, path, f"{folder}/members", scan_all_extensions).where(
        "status = 'scanned'").select("path", decode_bytes(F.col("content")).alias("content"))
    return scan_texts(texts, rules, merge_lines=merge_lines, structured=True, **options)


def scan_history(
    blocks: DataFrame, rules: RuleSet | None = None, *, marker: str | None = None,
    max_commits: int | None = None, ignore: Iterable[str] = (), only_file: str | None = None,
    max_diff_bytes: str | int | None = None, **options,
) -> DataFrame:
    """Findings in the added lines of a commit log, tagged with their commit.

    Each added line stands alone: there is no previous line and no merging.
    """
    named = {} if marker is None else {"marker": marker}
    lines = history_lines(
        blocks, max_commits=max_commits, ignore=list(ignore), only_file=only_file,
        max_diff_bytes=max_diff_bytes, **named)
    return scan_lines(
        lines, rules, extra=["commit", "commit_author", "commit_date"], **options)
