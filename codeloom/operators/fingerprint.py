"""Snapshots: what differs between two, and one key for a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, modified or same) between two tables of (path, token)."""
    both = old.select("path", F.col("token").alias("a"), F.lit(True).alias("in_old")).join(new.select("path", F.col("token").alias("b"), F.lit(True).alias("in_new")), "path", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("modified")
    return both.select("path", change.alias("change"))


def fingerprint(files: DataFrame, by: list[str] = ()) -> DataFrame:
    """*by, fingerprint of (path, token) rows: a SHA-1 that depends on the rows and not on their order.

    Rows are hashed, hashes are gathered by their first three digits, and the digests of these are hashed again: no group is
    larger than a 4096th of the rows.
    """
    row = F.sha1(F.concat_ws(":", "path", F.coalesce("token", F.lit(""))).cast("binary"))
    rows = files.select(*by, row.alias("h"))
    part = rows.groupBy(*by, F.substring("h", 1, 3).alias("p")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("h")), "\n").cast("binary")).alias("h"))
    return part.groupBy(*by).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "\n").cast("binary")).alias("fingerprint"))
