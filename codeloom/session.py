"""Session settings and results that are cut from their lineage."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package, and sets a checkpoint folder where none is set (local runs only)."""
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if (home := str(Path(__file__).resolve().parents[1])) not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "/tmp/checkpoints"
        context.setCheckpointDir(folder)
    return spark


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed now and written to the shared checkpoint folder, so that loops neither grow plans nor lose work."""
    spark = prepared(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written, and held by the executors dealt by ``keys`` for a loop that joins by them; lost parts are read and dealt again."""
    kept = stable(df)
    out = kept.repartition(*keys).persist()
    out.written = kept.written
    return out


def stepped(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` checkpointed, which keeps how it is dealt (by ``keys``): for the small steps of a loop, and for what they all join by."""
    out = prepared(df.sparkSession) and (df.repartition(*keys) if keys else df).checkpoint()
    out.written = out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what ``stable``, ``placed`` and ``stepped`` wrote and hold for ``tables``, which nothing may read any more."""
    for df in tables:
        if path := getattr(df, "written", None):
            df.unpersist()
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
