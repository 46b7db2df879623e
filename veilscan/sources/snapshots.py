"""Snapshot tables ``(snapshot_id, path, mode, content)``: pick one, or what changed since one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import paths as P
from veilscan.functions.sizes import parse_byte_size
from veilscan.sources.files import looks_binary

SYMLINK_MODE = "120000"


def pick_snapshot(snapshots: DataFrame, snapshot_id: Column | str) -> DataFrame:
    return snapshots.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")


def guard(files: DataFrame, max_file_size: str | int | None = None) -> DataFrame:
    """Add ``status``: ``scanned`` or the reason a file is skipped; skipped content becomes null."""
    limit = parse_byte_size(max_file_size)
    data = F.col("content").cast("binary")
    status = (
        F.when(P.escapes_root(F.col("path")), "path-traversal")
        .when(F.col("mode") == SYMLINK_MODE, "symlink")
        .when(F.octet_length("content") > limit, "too-large")
        .when(looks_binary(data), "binary (null-check)")
        .otherwise("scanned")
    )
    df = files.withColumn("status", status)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\0"), F.lit(""))
    return df.withColumn("content", F.when(F.col("status") == "scanned", text))


def changed_paths(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Paths that are new or differ; only paths and content hashes are shuffled."""
    def digest(df, name):
        return df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias(name))

    old = digest(previous, "old_sha")
    return (
        digest(current, "new_sha").join(old, "path", "left")
        .where(F.col("old_sha").isNull() | (F.col("old_sha") != F.col("new_sha")))
        .select("path").distinct()
    )


def changed_since(
    current: DataFrame, previous: DataFrame, untracked: DataFrame | None = None
) -> DataFrame:
    """Files of ``current`` that are new or differ from ``previous``, plus untracked ones.

    Paths only in ``previous`` were deleted and do not appear.
    """
    wanted = changed_paths(current, previous)
    files = current
    if untracked is not None:
        known = current.select("path")
        files = current.unionByName(untracked.join(known, "path", "left_anti"))
        wanted = wanted.union(untracked.select("path")).distinct()
    return files.join(wanted, "path", "left_semi")


def staged(snapshots: DataFrame, index_id: str = "index", head_id: str = "head") -> DataFrame:
    """The index version of the files that differ from the last commit."""
    return changed_since(
        pick_snapshot(snapshots, index_id), pick_snapshot(snapshots, head_id))
