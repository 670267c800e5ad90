"""Keeping facts up to date: snapshots, fingerprints, and micro-batches of changed files.

Only facts are kept by file; everything global (ranks, degrees, indexes) is computed anew from all facts, so an incremental
refresh and a full build give the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import fingerprint, snapshot_diff  # noqa: F401 - what refreshing starts from
from ..session import prepared, release, stable
from ..sources.store import FactLog


def refresh(changes: DataFrame, log: FactLog, facts_of: Callable[[DataFrame], DataFrame], checkpoint: str, compact: int = 64, after: Callable[[int], None] | None = None) -> None:
    """Brings ``log`` up to date with a stream of changed files (path, .., removed): one batch of the log per micro-batch.

    ``facts_of`` makes facts (path, ..) of the changed files; those that are ``removed``, or of which it says nothing any more, lose
    theirs. Every ``compact`` batches the log is folded. ``after`` is called with each batch's number, for what is global.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = stable(rows)
        gone = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in rows.columns else F.lit(False)
        log.write(batch_id, rows, facts_of(rows.where(~gone)))
        if batch_id and batch_id % compact == 0:
            log.compact()
        release(rows)
        if after:
            after(batch_id)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()


def refresh_map(changes: DataFrame, root: str, spark: SparkSession) -> None:
    """Keeps a stored map up to date with a stream of changed files (path, text, removed).

    Only the batch's files are read; what is global (resolution, ranks, degrees, indexes) is made anew from the facts of all files, so that
    added, removed and renamed files need no other way than changed ones.
    """
    from ..plans.api import CodeMap
    from ..sources.provider import raw_facts, source_facts

    texts, raw = FactLog(spark, f"{root}/texts"), FactLog(spark, f"{root}/raw")

    def said(rows: DataFrame) -> DataFrame:
        return raw_facts(rows.select("path", "text"))

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = stable(rows)
        there = rows.where(~F.coalesce("removed", F.lit(False)))
        texts.write(batch_id, rows, there.select("path", "text"))
        raw.write(batch_id, rows, said(there))
        CodeMap.build(texts.read(), lambda files: source_facts(files, raw=raw.read()), root=f"{root}/map", source_version=str(batch_id))
        release(rows)

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()


def _event_path() -> F.Column:
    """A user's day is a file, and its event types are names."""
    return F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), F.col("user_id").cast("string"))


def event_changes(t) -> tuple[DataFrame, str]:
    """Changed files (path, name, n, removed) as ten batches in a folder: eight of new files, then removed ones, then files that say less.

    Files of users that five divides are removed; of those that leave one only views stay, and where there are none the file says nothing.
    """
    spark = prepared(t.spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/refresh-{uuid.uuid4().hex[:12]}"
    user = F.pmod(F.col("user_id"), F.lit(5))
    events = t.read("events").withColumn("part", F.pmod(F.datediff("ts", F.lit("2024-01-01")), F.lit(8))).withColumn("removed", F.lit(False))
    batches = [events.where(F.col("part") == k) for k in range(8)]  # whole days, so each file is in one of them
    batches.append(events.where(user == 0).withColumn("removed", F.lit(True)))
    batches.append(events.where(user == 1).withColumn("event_type", F.when(F.col("event_type") == "view", F.col("event_type"))))
    for rows in batches:
        rows.select(_event_path().alias("path"), "event_type", "removed").coalesce(1).write.mode("append").parquet(f"{root}/changes")
    return spark.readStream.schema("path string, event_type string, removed boolean").option("maxFilesPerTrigger", 1).parquet(f"{root}/changes"), root


def incremental_equals_full(t) -> DataFrame:
    """name, files, n of the facts that a stream of new, removed and changed files leaves in the log."""
    stream, root = event_changes(t)
    log = FactLog(t.spark, f"{root}/log")
    said = lambda rows: rows.where("event_type is not null").groupBy("path", F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    refresh(stream, log, said, f"{root}/progress", compact=6)
    return log.read().groupBy("name").agg(F.countDistinct("path").alias("files"), F.sum("n").alias("n"))
