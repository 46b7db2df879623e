"""Files on any Spark file system: listing, guards, byte decoding, archives."""

from __future__ import annotations

import io
import lzma
import os
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions import paths as P
from veilscan.functions.sizes import parse_byte_size

FILE_SCHEMA = "path string, content binary, length bigint"
# Shares of zero bytes that mean binary, or UTF-16 without a byte order mark.
UTF16_NULL_SHARE, BINARY_NULL_SHARE = 0.3, 0.01
ARCHIVE_SUFFIXES = ["zip", "jar"]
# What reading an archive or a member raises: damaged, encrypted, of an unknown method.
UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError,
              EOFError, OSError, ValueError)


def _is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def _local_path(path: str) -> str:
    return os.path.abspath(unquote(urlparse(path).path))


def _symlinks(root: str) -> list[str]:
    """Relative paths of symbolic links below a local root (object stores have none)."""
    found = []
    for folder, folders, files in os.walk(root):
        for name in folders + files:
            full = os.path.join(folder, name)
            if os.path.islink(full):
                found.append(os.path.relpath(full, root).replace(os.sep, "/"))
    return found


def _hidden_files(root: str) -> list[tuple[str, str, int]]:
    """Files Spark's own listing leaves out because a path part starts with a dot or underscore.

    Names and sizes only, as in the listing Spark itself does on the driver.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(
        "file://" + _local_path(root) if _is_local(root) else root)
    selector = fs.FileSelector(base, recursive=True, allow_not_found=True)
    out = []
    for info in system.get_file_info(selector):
        relative = info.path[len(base):].lstrip("/")
        parts = relative.split("/")
        excluded = any(part in P.EXCLUDED_DIRECTORIES for part in parts[:-1])
        if info.type == fs.FileType.File and not excluded and any(
                part[0] in "._" for part in parts):
            out.append((relative, info.path, info.size))
    return out


def _read_hidden(spark: SparkSession, root: str, hidden: list[tuple[str, str, int]]) -> DataFrame:
    from pyarrow import fs

    uri = "file:///" if _is_local(root) else root

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.itertuples():
                with system.open_input_stream(row.location) as stream:
                    body = stream.read()
                yield pd.DataFrame(
                    {"path": [row.path], "content": [body], "length": [row.length]})

    listing = spark.createDataFrame(hidden, "path string, location string, length bigint")
    return listing.repartition(max(1, len(hidden) // 64)).mapInPandas(read, FILE_SCHEMA)


def read_files(
    spark: SparkSession, path: str, *, ignore: Iterable[str] = (),
    scan_all_extensions: bool = False, max_file_size: str | int | None = None,
) -> DataFrame:
    """Walk a directory (or take one file): ``path, content, length, status``.

    ``path`` is relative to the directory.  ``status`` is ``scanned``, ``too-large`` or
    ``symlink``; ignored paths are left out, and the content of skipped files is not read.  Without
    ``max_file_size`` no file is too large.
    """
    ignore = list(ignore)
    limit = parse_byte_size(max_file_size)
    links: list[str] = []
    hidden: list[tuple[str, str, int]] = []
    if _is_local(path):
        local = _local_path(path)
        if os.path.islink(local):
            raise ValueError(f'Invalid scan path: "{path}" is a symbolic link')
        if not os.path.exists(local):
            raise ValueError(f'Invalid scan path: "{path}" does not exist')
        root = os.path.dirname(local) if os.path.isfile(local) else local
        if os.path.isfile(local):
            name = os.path.basename(local)
            if name[0] in "._":
                hidden = [(name, local, os.path.getsize(local))]
        else:
            links = _symlinks(local)
            hidden = [h for h in _hidden_files(path) if h[0] not in set(links)]
    else:
        root = path.rstrip("/")
        hidden = _hidden_files(path)

    location = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "")
    prefix = _local_path(root) if _is_local(path) else urlparse(root).path
    relative = F.substring(location, F.lit(len(prefix.rstrip("/")) + 2), F.length(location))
    only_hidden = bool(hidden) and _is_local(path) and os.path.isfile(_local_path(path))
    frames = []
    if not only_hidden:
        frames.append(
            spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .load(_local_path(path) if _is_local(path) else path)
            .select(relative.alias("path"), "content", "length"))
    if hidden:
        frames.append(_read_hidden(spark, path, hidden))
    files = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    name = F.col("path")
    files = files.where(
        ~P.in_excluded_directory(name) & ~P.is_ignored_path(name, ignore, scan_all_extensions))
    if links:
        # A path is linked when it, or a folder above it, is a link: equi-joins on its beginnings.
        table = spark.createDataFrame([(link,) for link in links], "_link string")
        parts = F.split(name, "/")
        starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(
            F.slice(parts, F.lit(1), n), "/"))
        linked = files.select(name, F.explode(starts).alias("_link")).join(
            table, "_link", "left_semi").select("path").distinct()
        files = files.join(linked, "path", "left_anti").withColumn(
            "_linked", F.lit(False)).unionByName(
            files.join(linked, "path", "left_semi").withColumn("_linked", F.lit(True)))
    else:
        files = files.withColumn("_linked", F.lit(False))
    # The limit reaches the reader of the scanned branch; the other one reads names and sizes.
    taken = files.where(~F.col("_linked") & (F.col("length") <= limit))
    skipped = files.where(F.col("_linked") | (F.col("length") > limit))
    return taken.select("path", "content", "length", F.lit("scanned").alias("status")).unionByName(
        skipped.select("path", F.lit(None).cast("binary").alias("content"), "length", F.when(
            F.col("_linked"), "symlink").otherwise("too-large").alias("status")))


def null_share(content: Column) -> Column:
    """Share of zero bytes in the whole content; 0 for empty content."""
    body = F.decode(content, "ISO-8859-1")
    nulls = F.length(body) - F.length(F.replace(body, F.lit("\0"), F.lit("")))
    return F.when(F.length(body) > 0, nulls / F.length(body)).otherwise(0.0)


def looks_binary(content: Column) -> Column:
    """The guard of snapshot content: more than a trace of zero bytes."""
    return null_share(content) > BINARY_NULL_SHARE


@F.arrow_udf(T.StringType())
def _decode_utf16(content: pa.Array, big_endian: pa.Array) -> pa.Array:
    """Tolerant UTF-16 decoding (the built-in decoder fails on malformed input)."""
    out = []
    for body, big in zip(content.to_pylist(), big_endian.to_pylist()):
        even = None if body is None else body[: len(body) // 2 * 2]
        out.append(None if even is None else even.decode(
            "utf-16-be" if big else "utf-16-le", "replace"))
    return pa.array(out, pa.string())


def decode_bytes(content: Column) -> Column:
    """Text of a file: UTF-16 by byte order mark or by its zero bytes, else UTF-8 without NULs."""
    head = F.hex(F.substring(content, 1, 4))
    ascii_byte = "(?:[2-6][0-9A-F]|7[0-9A-E])"
    many_nulls = null_share(content) > UTF16_NULL_SHARE
    little_mark, big_mark = head.startswith("FFFE"), head.startswith("FEFF")
    little = little_mark | (many_nulls & head.rlike(f"^{ascii_byte}00{ascii_byte}00$"))
    big = big_mark | (many_nulls & head.rlike(f"^00{ascii_byte}00{ascii_byte}$"))
    body = F.when(little_mark | big_mark, F.substring(content, F.lit(3), F.length(content)))
    body = body.otherwise(content)
    utf8 = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\0"), F.lit(""))
    # Declared non-deterministic: the optimizer must not copy the call into other expressions.
    wide = _decode_utf16.asNondeterministic()(F.when(little | big, body), F.coalesce(big, F.lit(False)))
    return F.when(little | big, wide).otherwise(utf8)


def expand_archives(files: DataFrame, scan_all_extensions: bool = False) -> DataFrame:
    """Replace zip and jar files by their members, path ``archive://member``: ``path, content, status``.

    Members are read one by one, whatever their content.  ``status`` is that of ``files`` (``scanned``
    without the column), ``unreadable`` for a damaged or encrypted member and ``binary`` for one that
    has more than a trace of zero bytes and an extension that is not scanned among plain files
    either; both have no content.  Folders give no row.  An archive that cannot be opened, or has
    unreadable members, also stays as it is.
    """
    binary = () if scan_all_extensions else tuple(P.EXCLUDED_EXTENSIONS)

    def opened(path: str, content: bytes) -> Iterator[tuple]:
        whole = False
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.infolist():
                    if member.is_dir():
                        continue
                    name = f"{path}://{member.filename}"
                    try:
                        body = archive.read(member)
                    except UNREADABLE:
                        whole = True
                        yield name, None, "unreadable"
                        continue
                    if member.filename.lower().endswith(binary) and (
                            body.count(0) > BINARY_NULL_SHARE * len(body)):
                        yield name, None, "binary"
                    else:
                        yield name, body, "scanned"
        except UNREADABLE:
            whole = True
        if whole:
            yield path, content, "scanned"

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in opened(path, content):
                    yield pd.DataFrame([row], columns=["path", "content", "status"])

    status = F.col("status") if "status" in files.columns else F.lit("scanned").alias("status")
    is_archive = P.suffix(F.col("path")).isin(ARCHIVE_SUFFIXES) & F.col("content").isNotNull()
    plain = files.where(~is_archive).select("path", "content", status)
    packed = files.select("path", "content").where(is_archive)
    return plain.unionByName(
        packed.mapInPandas(members, "path string, content binary, status string"))
