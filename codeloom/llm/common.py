"""What the operators of this subpackage share: scratch tables, Arrow batches, word hashes.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` splits at exactly these six.
"""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WHITE = " \t\n\x0b\x0c\r"
#: Rows and bytes of one Arrow batch: what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20

_SCRATCH: dict[str, str] = {}


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session by rows and bytes, and lets Python workers find this package."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if (home := str(Path(__file__).resolve().parents[2])) not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """This session's folder for written tables, under the shared spark.checkpoint.dir."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _SCRATCH:
        base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "/tmp/checkpoints"
        _SCRATCH[app] = f"{base.rstrip('/')}/codeloom-{app}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


class Scratch:
    """Written tables of one call. A table outlives lost executors; ``drop`` frees those that no result needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``work`` on each Arrow batch; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class WordHashes(dict):
    """Word to a stable 64-bit hash; forgets all at LIMIT words and never holds one of over LONGEST bytes, so memory is bounded."""

    LIMIT, LONGEST = 1 << 18, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


ODD = 0x9E3779B97F4A7C15


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive hashes; order matters. Empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(ODD)
        out += hashes[j : j + n]
    return mixed(out)


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """The lists' items one after the other, and where each list begins and the last ends."""
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return [y for x in lists for y in x], bounds


def inside(bounds: np.ndarray, width: int) -> np.ndarray:
    """For flat items, whether the run of ``width`` items from here ends within the same list."""
    n = int(bounds[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + width <= ends[:n]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each list's values."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
