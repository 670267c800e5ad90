"""A corpus pipeline over ``documents``: quality rules, line and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes each stage's result as Parquet in
the shared scratch folder and reads it again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import Scratch
from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.mixing import mixed_documents
from codeloom.llm.near_dedup import near_dedup
from codeloom.llm.packing import pack
from codeloom.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the adaptive limits."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents stay in the first only."""
    return dedup_lines(docs, min_docs=10, keep="first")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 similar sets of five-word shingles."""
    return near_dedup(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("source_mix", source_mix), ("packing", packing)]

#: Sketches, MinHash groups and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
