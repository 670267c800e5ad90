"""What a git working tree holds and what has changed in it. Only lists of names pass through the driver; texts are read by Spark."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import fingerprint
from .configs import CONFIG_FILE
from .files import is_source, list_tree, read_files, read_tree


def _git(root: str, *args: str) -> bytes:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return b""


def tracked(root: str) -> list[str]:
    """Tracked files and others that aren't ignored; nothing outside a repository."""
    return sorted({x.decode("utf-8", "replace") for x in _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split(b"\0") if x})


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").decode().strip()


def parse_changes(listed: bytes) -> list[tuple[str, str, str | None]]:
    """(code, path, old path) of NUL-separated status records; renames and copies carry the old path in the next record."""
    out, fields = [], listed.split(b"\0")
    at = 0
    while at < len(fields):
        if len(fields[at]) > 3:
            code, path, old = fields[at][:2].decode(), fields[at][3:].decode("utf-8", "replace"), None
            if code[0] in "RC":
                at += 1
                old = fields[at].decode("utf-8", "replace") if at < len(fields) else None
            out.append((code.strip(), path, old))
        at += 1
    return out


def changes(root: str) -> list[tuple[str, str, str | None]]:
    """What differs from the last commit, files of untracked folders one by one."""
    return parse_changes(_git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all"))


def read_worktree(spark: SparkSession, root: str) -> DataFrame:
    """path, text, size, mtime of the files that git knows; of all files below ``root`` where there is no repository."""
    names = tracked(root)
    if not names:
        return read_tree(spark, root)
    parts = max(1, min(len(names) // 256, spark.sparkContext.defaultParallelism * 4))
    return read_files(spark.createDataFrame([(x,) for x in names], "path string").repartition(parts), root)


def current_state(spark: SparkSession, root: str) -> tuple[str, str]:
    """(commit, key of the state) of a working tree; without a repository no commit, and a key of all source files' times and sizes."""
    if commit := head(root):
        changed = changes(root)
        stat = {}
        for _, path, _ in changed:
            full = os.path.join(root, path)
            if os.path.lexists(full):
                at = os.lstat(full)
                stat[path] = f"{at.st_mtime_ns}:{at.st_size}"
        return commit, state_token(commit, changed, stat)
    listed = list_tree(spark, root).where(is_source(F.col("path")) | F.col("path").rlike(CONFIG_FILE))
    rows = listed.select("path", F.concat_ws(":", F.unix_micros("mtime"), "size").alias("token"))
    got = fingerprint(rows).first()
    return "", got["fingerprint"] if got else ""


def state_token(head_id: str, changed: list[tuple[str, str, str | None]], stat: dict[str, str]) -> str:
    """One key for a commit and what differs from it: equal exactly if a build would see the same files.

    ``stat`` gives time and size of files that are there; others count by their code; a rename also by both names.
    """
    import hashlib

    rows = sorted((f"{p}:{stat[p]}" if p in stat else f"{c or '?'}:{p}") + (f"\0{old}->{p}" if old else "") for c, p, old in changed)
    return hashlib.sha1("\n".join([f"HEAD:{head_id}", *rows]).encode()).hexdigest()
