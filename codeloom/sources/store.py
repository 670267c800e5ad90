"""A map kept as Parquet tables, by version, with one meta row per version.

A version's tables are written first and its meta row last, so readers see whole versions only; a version that is written again
replaces itself. All reading and writing goes through Spark, so any shared file system will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import release, stable

META = "version long, schema int, source_version string, fingerprint string, file_count long, skipped_count long, edge_coverage double, degraded boolean"


class MapStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(META).parquet(f"{self.root}/meta")
        except AnalysisException:
            return self.spark.createDataFrame([], META)

    def latest(self) -> int | None:
        return self.versions().where(F.col("schema") == S.SCHEMA_VERSION).agg(F.max("version")).first()[0]

    def fresh(self, source_version: str, fingerprint: str = "") -> bool:
        """Whether the latest version was made of this source, with this schema."""
        last = self.latest()
        if last is None:
            return False
        row = self.versions().where(F.col("version") == last).first()
        return row["source_version"] == source_version and (row["fingerprint"] or "") == fingerprint

    def write(self, version: int, tables: dict[str, DataFrame], source_version: str = "", fingerprint: str = "", file_count: int = 0, skipped_count: int = 0, edge_coverage: float = 1.0, degraded: bool = False) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        row = (version, S.SCHEMA_VERSION, source_version, fingerprint, file_count, skipped_count, edge_coverage, degraded)
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/meta/v={version}")

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of the latest or of a given version; None where there is none."""
        version = self.latest() if version is None else version
        if version is None:
            return None
        try:
            return self.spark.read.parquet(f"{self.root}/{name}/version={version}")
        except AnalysisException:
            return None


class FactLog:
    """Facts by file as a log of batches: what a batch says of a file holds until a later one names that file.

    A batch writes its own facts and the paths that it names, changed and removed ones alike, and nothing else; so it costs what it
    changes. ``compact`` folds all batches into one. A batch that runs again replaces itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, batch: int, named: DataFrame, facts: DataFrame) -> None:
        """``named`` (path): all files that this batch is about; ``facts`` (path, ..) of those that still say something."""
        self._write(2 * batch, named, facts)

    def _write(self, number: int, named: DataFrame, facts: DataFrame) -> None:
        facts.write.mode("overwrite").parquet(f"{self.root}/facts/number={number}")
        named.select("path").distinct().write.mode("overwrite").parquet(f"{self.root}/named/number={number}")

    def _named(self) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.root}/named").parquet(f"{self.root}/named")
        except AnalysisException:
            return None

    def read(self) -> DataFrame | None:
        """The facts that hold; None before the first batch."""
        named = self._named()
        if named is None:
            return None
        last = named.groupBy("path").agg(F.max("number").alias("number"))
        facts = self.spark.read.option("basePath", f"{self.root}/facts").parquet(f"{self.root}/facts")
        return facts.join(last, ["path", "number"], "left_semi").drop("number")

    def compact(self) -> None:
        """Folds all batches into one that stands behind the last.

        The others go when it is written, oldest first, names before facts: a reader finds the same at any time, and so does one after a crash.
        """
        named = self._named()
        if named is None:
            return
        numbers = sorted(r["number"] for r in named.select("number").distinct().collect())
        whole = stable(self.read())
        self._write(numbers[-1] | 1, whole, whole)
        for number in numbers:
            if number != numbers[-1] | 1:
                for kind in ("named", "facts"):
                    remove(self.spark, f"{self.root}/{kind}/number={number}")
        release(whole)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(old: DataFrame | None, new: DataFrame, named: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Facts by file: those of files in ``named`` (key) are replaced by what ``new`` says of them, which may be nothing; others stay.

    Without ``named``, only files with new facts are replaced.
    """
    if old is None:
        return new
    gone = (new if named is None else new.select(key).union(named.select(key))).select(key).distinct()
    return old.join(gone, key, "left_anti").unionByName(new)
