"""Listing source files: walking, excluding, ignoring, and what changed."""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import extension
from ..session import prepared



#: Bytes of texts that one batch holds, unless a single file is larger.
BATCH = 8 << 20
_LISTED = "path string, size long, mtime timestamp"


def _folder(root: str, folder: str) -> tuple[list[tuple[str, int, float]], list[str]]:
    """(path, size, time) of the files of one folder, and the folders in it; links and unreadable folders hold nothing."""
    files, folders = [], []
    try:
        if "://" in root:
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(root)
            for x in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=False)):
                path = f"{folder}/{x.base_name}".lstrip("/")
                if x.type == fs.FileType.Directory:
                    folders.append(path)
                elif x.type == fs.FileType.File:
                    files.append((path, x.size, x.mtime.timestamp() if x.mtime else 0.0))
        else:
            with os.scandir(os.path.join(root, folder)) as found:
                for x in found:
                    path = f"{folder}/{x.name}".lstrip("/")
                    if x.is_symlink():
                        continue
                    if x.is_dir(follow_symlinks=False):
                        folders.append(path)
                    elif x.is_file(follow_symlinks=False):
                        at = x.stat(follow_symlinks=False)
                        files.append((path, at.st_size, at.st_mtime))
    except OSError:
        return [], []
    return files, [x for x in folders if x.rsplit("/", 1)[-1] not in S.EXCLUDED_FOLDERS and x.count("/") < S.DEEPEST_FOLDER]


def _walk(root: str, folder: str):
    todo = [folder]
    while todo:
        files, folders = _folder(root, todo.pop())
        yield from files
        todo += folders


def _plain(root: str) -> str:
    """A local folder's own path; what has another scheme keeps it."""
    return re.sub("^file:/+", "/", root) if root.startswith("file:") else root


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), size, mtime of all files under ``root``, whatever their names; links are not followed.

    The two uppermost levels are listed here; each folder below them is walked by a task, so names never pass through the driver.
    """
    spark, root = prepared(spark), _plain(root)
    top, folders = _folder(root, "")
    below = []
    for folder in folders:
        files, inner = _folder(root, folder)
        top += files
        below += inner
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])

    def batches_of(rows):
        rows = iter(rows)
        while part := list(islice(rows, 4096)):
            path, size, at = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(size, pa.int64()), pa.array([int(x * 1e6) for x in at], pa.int64()).cast(pa.timestamp("us", "UTC"))], schema=schema)

    def run(batches):
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                yield from batches_of(_walk(root, folder))

    here = spark.createDataFrame([(p, n, datetime.fromtimestamp(int(t * 1e6) / 1e6, UTC)) for p, n, t in top], _LISTED)
    if not below:
        return here
    tasks = spark.createDataFrame([(x,) for x in below], "folder string").repartition(max(1, min(len(below), spark.sparkContext.defaultParallelism * 4)))
    return here.unionByName(tasks.mapInArrow(run, _LISTED))


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """path, text, size, mtime of ``listed`` files (path) below ``root``. Files that are gone or can't be opened are left out."""
    spark, root = prepared(listed.sparkSession), _plain(root)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])

    def content(path: str) -> tuple[bytes, int] | None:
        try:
            if "://" in root:
                from pyarrow import fs

                system, base = fs.FileSystem.from_uri(f"{root}/{path}")
                info = system.get_file_info(base)
                with system.open_input_stream(base) as f:
                    return f.read(), int(info.mtime.timestamp() * 1e6) if info.mtime else 0
            full = os.path.join(root, path)
            with open(full, "rb") as f:
                return f.read(), int(os.stat(full).st_mtime * 1e6)
        except (OSError, ValueError):
            return None

    def told(rows):
        path, data, at = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(data, pa.binary()), pa.array([len(x) for x in data], pa.int64()), pa.array(at, pa.int64()).cast(pa.timestamp("us", "UTC"))], schema=schema)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if (got := content(path)) is not None:
                    rows.append((path, *got))
                    held += len(got[0])
                    if held >= BATCH:
                        yield told(rows)
                        rows, held = [], 0
        if rows:
            yield told(rows)

    rows = listed.select("path").mapInArrow(run, "path string, content binary, size long, mtime timestamp")
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "size", "mtime")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), text, size, mtime of all files under ``root``, also of those whose names begin with a dot or an underscore."""
    return read_files(list_tree(spark, root), root)


def ignore_pattern(lines: list[str]) -> str | None:
    """One regular expression for the lines of an ignore file; None if they ignore nothing.

    A leading slash anchors at the root, a trailing one means a folder and all below, and * is any run within a segment; the rest is literal.
    A pattern without trailing slash must end where the path ends. Comments, empty lines and very long patterns are left out.
    """
    parts = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        anchored, folder = line.startswith("/"), line.endswith("/") and len(line) > 1
        body = line.removeprefix("/")
        body = body.removesuffix("/") if folder else body
        if not body or body == "/" or len(body) > S.LONGEST_PATTERN:
            continue
        glob = "[^/]*".join(re.escape(x) for x in re.split(r"\*+", body))
        parts.append(("^" if anchored else "(?:^|/)") + glob + ("(?:/|$)" if folder else "$"))
    return "|".join(f"(?:{x})" for x in parts) or None


def is_source(path) -> F.Column:
    return path.rlike(r"\.(" + "|".join((*S.CODE_EXTENSIONS, S.SFC_EXTENSION)) + ")$")


def sources(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """The source files that a map may know: no excluded folder, no ignored path; ``is_node`` is false for declaration files."""
    path = F.col("path")
    rows = files.where(is_source(path))
    for folder in S.EXCLUDED_FOLDERS:
        rows = rows.where(~F.array_contains(F.split("path", "/"), folder))
    if pattern := ignore_pattern(list(ignore)):
        rows = rows.where(~path.rlike(pattern))
    return rows.withColumn("is_node", ~path.rlike(r"\.d\.[cm]?ts$"))


def languages(files: DataFrame) -> DataFrame:
    """path, language: of supported sources "supported", of other code its language; other files are left out."""
    ext = extension(F.col("path"))
    known = F.create_map(*[F.lit(x) for kv in S.FOREIGN.items() for x in kv])
    language = F.when(ext.isin(*S.CODE_EXTENSIONS, S.SFC_EXTENSION), "supported").otherwise(F.try_element_at(known, ext))
    return files.select("path", language.alias("language")).where("language is not null")
