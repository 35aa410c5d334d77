"""A corpus pipeline of five stages; each works on all rows that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what each returns as
Parquet to the folder that the cluster shares and gives it to the next one, so lineage is cut between
stages and a lost executor costs one stage's work at most. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import fm_index, hilbert, mixing, quality, simhash
from panelforge.llm.common import remove_folder, shared_dir, table
from panelforge.session import reach


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality ranking doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: shingles of five words, found by wide SimHash and compared, a similarity of 0.8 or more."""
    return simhash.keep_unlike(docs, size=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages of ten words out of the texts."""
    return fm_index.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents to the sources' target weights, some of them more than once."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot`` along the Hilbert curve."""
    return hilbert.sharded(docs, shards=24)


def _reaching(stage):
    return lambda spark, docs, sf_dir: stage(reach(spark), docs, sf_dir)


STAGES = [
    ("quality", _reaching(quality_stage)),
    ("simhash_dedup", _reaching(dedup_stage)),
    ("decontamination", _reaching(decontamination_stage)),
    ("mixing", _reaching(mixing_stage)),
    ("sharding", _reaching(sharding_stage)),
]

#: A trained model, fingerprints and an index: no SQL gives these rows; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The shards are written as folders, in slot order, so that readers skip them by shard and by the ranges in their files; what a stage wrote goes when the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(path)
        else:
            hilbert.write_sharded(out, path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
