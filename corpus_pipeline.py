"""A corpus from raw documents to packed token sequences; each stage is an operator of sparkloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.mixing import mix_sources
from sparkloom.llm.nearcopies import keep_one_of_each
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.pii import mask_pii
from sparkloom.llm.quality import filter_quality
from sparkloom.llm.shared import settled, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return filter_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts masked."""
    return mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global random order."""
    return mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in token sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("personal data", personal_data), ("mixing sources", mix), ("packing", pack)]

#: Similarity joins and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again; what only a stage itself needed goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = staged()
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settled(docs, f"stage{i}", begin)
    return docs
