"""Folder trees and archives, listed and read by tasks: no listing passes through the driver.

A walk is a breadth-first expansion: each round lists the folders that the last one found, dealt over
all tasks, and writes its rows; excluded and ignored folders are not entered.  Archives are taken apart
the same way: their directories become rows, one for each member, and members are dealt over tasks by
their size, so that one archive of many members is read by many tasks.  A task seeks to a member and
inflates it piece by piece.

Files that vanish during a walk, and folders that may not be read, have the status ``unreadable``; so has a
damaged, truncated or encrypted member.  Names that are no UTF-8 cannot be opened again and are
``unreadable`` as well.  Empty folders give no rows.  On file systems without symbolic links there are none.
"""

from __future__ import annotations

import os
import struct
import zipfile
import zlib
from bz2 import BZ2Decompressor
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions import paths as P
from veilscan.functions.sizes import parse_byte_size
from veilscan.sources.files import ARCHIVE_SUFFIXES, BINARY_NULL_SHARE, UNREADABLE, _is_local, _local_path

LISTED = "path string, kind string, length bigint"
MEMBERS = (
    "archive string, name string, offset bigint, packed bigint, length bigint, method int, crc bigint, "
    "status string")
CONTENT = "path string, content binary, status string"
#: Bytes that a task reads, about; a file or member is read by one task.
TASK_BYTES = 64 << 20
#: Folders that a task lists, and rows of a listing that are sent on together.
TASK_FOLDERS, LISTED_ROWS = 64, 10_000
BATCH_BYTES = 8 << 20
#: What one value of a row can hold.
LARGEST_VALUE = (1 << 31) - (1 << 20)
ENCRYPTED = 1
LOCAL_HEADER = struct.Struct("<4s22xHH")


def _system(root: str):
    """The file system of a root and the root's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + _local_path(root) if _is_local(root) else root)


def _local_entries(folder: str) -> Iterator[tuple[str, str, int | None]]:
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                try:
                    entry.name.encode()
                    if entry.is_symlink():
                        yield entry.name, "link", None
                    elif entry.is_dir(follow_symlinks=False):
                        yield entry.name, "folder", None
                    elif entry.is_file(follow_symlinks=False):
                        yield entry.name, "file", entry.stat(follow_symlinks=False).st_size
                except UnicodeEncodeError:
                    yield os.fsencode(entry.name).decode("utf-8", "replace"), "unreadable", None
                except OSError:
                    yield entry.name, "unreadable", None
    except OSError:
        yield "", "unreadable", None


def _other_entries(system, folder: str) -> Iterator[tuple[str, str, int | None]]:
    from pyarrow import fs

    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}
    try:
        listed = system.get_file_info(fs.FileSelector(folder))
    except OSError:
        listed = []
        yield "", "unreadable", None
    for info in listed:
        if info.type in kinds:
            yield info.base_name, kinds[info.type], info.size


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sent on together, until they are many or their ``content`` is large."""
    at = schema.get_field_index("content")
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[at] or b"") if at >= 0 else 0
        if len(held) >= LISTED_ROWS or size >= BATCH_BYTES:
            yield _table(held, schema)
            held, size = [], 0
    if held:
        yield _table(held, schema)


def _list_folders(folders: DataFrame, root: str) -> DataFrame:
    """The entries of each folder ``path`` (relative to the root)."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = (None, _local_path(root)) if _is_local(root) else _system(root)

        def entries(folder: str) -> Iterator[tuple]:
            place = f"{base}/{folder}" if folder else base
            found = _local_entries(place) if system is None else _other_entries(system, place)
            return ((f"{folder}/{name}".strip("/"), kind, length) for name, kind, length in found)

        yield from _batches(
            (row for batch in batches for folder in batch.column("path").to_pylist() for row in entries(folder)),
            schema)

    return folders.select("path").mapInArrow(expand, LISTED)


def _pruned(folder: Column, ignore: list[str]) -> Column:
    inside = F.concat(folder, F.lit("/"))
    return P.in_excluded_directory(inside) | P.matches_ignore(inside, ignore)


def walk_tree(
    spark: SparkSession, root: str, folder: str, *, ignore: Iterable[str] = (),
    scan_all_extensions: bool = False, max_file_size: str | int | None = None,
) -> DataFrame:
    """Files below a folder, hidden ones too: ``path, length, status`` (``scanned``, ``too-large``, ``symlink``,
    ``unreadable``).

    ``path`` is relative to the root.  Links are rows and are not followed.  A file over 2 GB, more than a
    row holds, is too large whatever ``max_file_size`` is.  ``folder`` is shared by driver
    and executors and keeps the listing; what it held is replaced.
    """
    if _is_local(root):
        local = _local_path(root)
        if os.path.islink(local) or not os.path.isdir(local):
            raise ValueError(f'Invalid scan path: "{root}" is not a folder')
    ignore = list(ignore)
    limit = min(parse_byte_size(max_file_size), LARGEST_VALUE)
    frontier, waiting, level = spark.createDataFrame([("",)], "path string"), 1, 0
    rounds = []
    while waiting:
        place = f"{folder}/round-{level}"
        tasks = -(-waiting // TASK_FOLDERS)
        _list_folders(frontier.repartition(tasks, "path"), root).write.mode("overwrite").parquet(place)
        listed = spark.read.schema(LISTED).parquet(place)
        rounds.append(place)
        frontier = listed.where((F.col("kind") == "folder") & ~_pruned(F.col("path"), ignore))
        waiting, level = frontier.count(), level + 1
    path = F.col("path")
    return (
        spark.read.schema(LISTED).parquet(*rounds).where("kind <> 'folder'")
        .where(~P.in_excluded_directory(path) & ~P.is_ignored_path(path, ignore, scan_all_extensions))
        .select("path", "length", F.when(F.col("kind") == "link", "symlink")
                .when(F.col("kind") == "unreadable", "unreadable")
                .when(F.col("length") > limit, "too-large")
                .otherwise("scanned").alias("status")))


def _dealt(rows: DataFrame, size: str, *keys: str) -> DataFrame:
    """Rows over as many tasks as their bytes ask for."""
    # Opening a file costs about as much as some thousand bytes.
    total = rows.agg(F.sum(F.coalesce(size, F.lit(0)) + 4_096)).head()[0] or 0
    return rows.repartition(max(1, -(-total // TASK_BYTES)), *keys)


def read_listed(files: DataFrame, root: str) -> DataFrame:
    """Content of listed files with the status ``scanned``: ``path, content, status``."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("status", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)

        def content(path: str) -> tuple:
            try:
                with system.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    return path, stream.read(), "scanned"
            except OSError:
                return path, None, "unreadable"

        yield from _batches(
            (content(path) for batch in batches for path in batch.column("path").to_pylist()), schema)

    chosen = files.where("status = 'scanned'").select("path", "length")
    return _dealt(chosen, "length", "path").select("path").mapInArrow(read, CONTENT)


def is_archive(path: Column) -> Column:
    return P.suffix(path).isin(ARCHIVE_SUFFIXES)


class _Seeking:
    """A file that cannot be moved before its beginning, in the way the archive reader knows."""

    def __init__(self, file):
        self._file = file

    def __getattr__(self, name):
        return getattr(self._file, name)

    def seek(self, *to):
        try:
            return self._file.seek(*to)
        except ValueError as error:
            raise OSError(str(error)) from error


def list_members(archives: DataFrame, root: str) -> DataFrame:
    """One row for each member of zip and jar files, read from their directories alone.

    ``status``: ``listed``, ``unreadable`` (encrypted), ``too-large`` (over 2 GB unpacked, more than a row holds);
    a file that is no archive has one row without a name, ``broken``.
    """
    names = [part.split(" ")[0] for part in MEMBERS.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[part.split(" ")[1]]) for n, part in zip(names, MEMBERS.split(", "))])

    def entries(system, base: str, path: str) -> Iterator[tuple]:
        try:
            with system.open_input_file(f"{base}/{path}") as file, zipfile.ZipFile(
                    _Seeking(file)) as archive:
                for m in archive.infolist():
                    if not m.is_dir():
                        status = ("unreadable" if m.flag_bits & ENCRYPTED
                                  else "too-large" if m.file_size > LARGEST_VALUE else "listed")
                        yield (path, m.filename.encode("utf-8", "replace").decode(), m.header_offset,
                               m.compress_size, m.file_size, m.compress_type, m.CRC, status)
        except UNREADABLE:
            yield (path, None, None, None, None, None, None, "broken")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        yield from _batches(
            (row for batch in batches for path in batch.column("path").to_pylist()
             for row in entries(system, base, path)), schema)

    chosen = archives.where("status = 'scanned'").select("path")
    return chosen.repartition(max(1, -(-chosen.count() // TASK_FOLDERS)), "path").mapInArrow(read, MEMBERS)


class _Stored:
    def decompress(self, data: bytes) -> bytes:
        return data


def _decoder(method: int):
    if method == zipfile.ZIP_STORED:
        return _Stored()
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompressobj(-zlib.MAX_WBITS)
    if method == zipfile.ZIP_BZIP2:
        return BZ2Decompressor()
    if method == zipfile.ZIP_LZMA:
        return zipfile.LZMADecompressor()
    raise NotImplementedError(f"compression method {method}")


def inflate(file, offset: int, packed: int, length: int, method: int, crc: int) -> bytes:
    """A member of a seekable archive; holds what it gives and a piece of what it reads.

    Raises one of ``UNREADABLE`` when the member is not what its directory says.
    """
    file.seek(offset)
    head = file.read(LOCAL_HEADER.size)
    if len(head) < LOCAL_HEADER.size:
        raise EOFError("member's header is cut")
    signature, name, extra = LOCAL_HEADER.unpack(head)
    if signature != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member at its offset")
    file.seek(offset + LOCAL_HEADER.size + name + extra)
    decoder, out, left = _decoder(method), bytearray(), packed
    while left:
        piece = file.read(min(left, 1 << 20))
        if not piece:
            raise EOFError("member is cut")
        left -= len(piece)
        out += decoder.decompress(piece)
        if len(out) > length:
            raise zipfile.BadZipFile("member is longer than stated")
    if isinstance(decoder, type(zlib.decompressobj())):
        out += decoder.flush()
    if len(out) != length or zlib.crc32(out) != crc:
        raise zipfile.BadZipFile("member is damaged")
    return bytes(out)


def read_members(members: DataFrame, root: str, scan_all_extensions: bool = False) -> DataFrame:
    """Content of listed members, path ``archive://member``: ``path, content, status``.

    ``binary`` are members with more than a trace of zero bytes and an extension that is not scanned.
    """
    binary = () if scan_all_extensions else tuple(P.EXCLUDED_EXTENSIONS)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("status", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        opened = {}  # the archive that is open

        def content(row: dict) -> tuple:
            path = f"{row['archive']}://{row['name']}"
            if row["status"] != "listed":
                return path, None, row["status"]
            try:
                if row["archive"] not in opened:
                    for file in opened.values():
                        file.close()
                    opened.clear()
                    opened[row["archive"]] = system.open_input_file(f"{base}/{row['archive']}")
                body = inflate(
                    opened[row["archive"]], *(row[c] for c in ("offset", "packed", "length", "method", "crc")))
            except UNREADABLE:
                return path, None, "unreadable"
            if row["name"].lower().endswith(binary) and body.count(0) > BINARY_NULL_SHARE * len(body):
                return path, None, "binary"
            return path, body, "scanned"

        yield from _batches((content(row) for batch in batches for row in batch.to_pylist()), schema)

    chosen = members.where("status <> 'broken'")
    return _dealt(chosen, "length", "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(
        read, CONTENT)


def tree_contents(
    listed: DataFrame, root: str, folder: str, scan_all_extensions: bool = False
) -> DataFrame:
    """Content of all listed files and members of archives: ``path, content, status``.

    A file that only has an archive's name is read as a plain one.  The directories of archives are kept in
    ``folder``, which driver and executors share; what it held is replaced.
    """
    spark = listed.sparkSession
    archives = listed.where(is_archive(F.col("path")))
    list_members(archives, root).write.mode("overwrite").parquet(folder)
    members = spark.read.schema(MEMBERS).parquet(folder)
    broken = members.where("status = 'broken'").select(F.col("archive").alias("path"))
    plain = listed.where(~is_archive(F.col("path"))).select("path", "length", "status").unionByName(
        archives.join(broken, "path", "left_semi").select("path", "length", "status"))
    return read_listed(plain, root).unionByName(read_members(members, root, scan_all_extensions))
